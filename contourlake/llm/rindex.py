"""Suffix dedup: bytes of repeated 200-byte strings, found by matching statistics on run-length indexes.

Every 200-byte window has an anchor, its leftmost smallest 41-gram, so equal
windows have equal anchors at equal places. Anchors are counted over the corpus
by hash; only text around anchors that repeat goes further. Around an anchor,
all windows it serves lie in one context of 360 bytes at most. Where a context
occurs twice, all of its windows repeat. The other contexts of an anchor are
gathered, many anchors to an index: a suffix array, its Burrows-Wheeler
transform in runs, and the common prefix lengths at run starts and run ends.
Contexts are aligned by their anchors there. Streaming the samples in text
order gives the matching statistics, the length of the longest match of each
suffix with any other one, and marks the windows. An anchor with very many
different contexts is split by the bytes around it before: windows that begin
at nearly the same place of it have more than the anchor in common, so the text
they share is a longer anchor of theirs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, forget, met, mix64, shuffle_width, table, text_buffers, written
from .words import _powers

#: Length of the anchors' grams; different contexts that an anchor may have before it is split, and into how many; bytes of an index.
GRAM, CROWD, SPLIT, INDEX = 41, 8192, 8, 1 << 16
#: Bytes of a document that are worked on at once.
STRETCH = 1 << 20
#: The bits of a place in a stretch and what stands around it; grams are compared by the others.
PLACE = np.uint64((1 << 22) - 1)


def _prefix_hash(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    power, inverse = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    return sums, inverse


def anchors(data: np.ndarray, size: int, stretch: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(grams, contexts, at, low, high) for stretches of one document.

    at: where anchors begin; low, high: the first and last window that each
    serves; grams, contexts: hashes of the anchor and of its context. All places
    are in the document, and each comes once: an anchor with windows in several
    stretches is held until its last one.
    """
    n, reach = len(data), size - GRAM
    rest = None
    for begin in range(0, max(0, n - size + 1), stretch):
        end = min(n, begin + stretch + size - 1)
        base, stop = max(0, begin - reach), min(n, end + size)
        part = data[base:stop]
        sums, inverse = _prefix_hash(part)
        gram = mix64((sums[GRAM:] - sums[:-GRAM]) * inverse[: len(part) - GRAM + 1])
        first, last = begin - base, end - size - base  # windows of this stretch
        own = gram[first : last + reach + 1]
        # the leftmost gram of the least value: places stand in the low bits
        own = (own & ~PLACE) | np.arange(len(own), dtype=np.uint64)
        w = reach + 1
        pad = -len(own) % w
        blocks = np.concatenate((own, np.full(pad, ~np.uint64(0)))).reshape(-1, w)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        m = last - first + 1
        place = (np.minimum(behind[:m], ahead[w - 1 : w - 1 + m]) & PLACE).astype(np.int64)
        runs = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        at = place[runs] + first
        low, high = runs + first, np.append(runs[1:], m) - 1 + first
        a, b = np.maximum(at - reach, 0), np.minimum(at + size, len(part))
        # how much of the context the document's ends cut off is part of its hash
        shape = (at - a).astype(np.uint64) * np.uint64(1024) + (b - at).astype(np.uint64)
        context = mix64((sums[b] - sums[a]) * inverse[a] + mix64(shape))
        found = (gram[at], context, at + base, low + base, high + base)
        if rest is not None and rest[2][0] == found[2][0]:
            found[3][0] = rest[3][0]
        elif rest is not None:
            yield rest
        rest = tuple(x[-1:] for x in found)
        yield tuple(x[:-1] for x in found)
    if rest is not None:
        yield rest


#: Columns that a symbol can stand in, groups of an index, and symbols of an end mark and a byte.
COLUMNS, GROUPS, ALPHABET = 512, 1 << 14, 257


def suffix_ranks(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """The suffix array of texts that each close with an end mark, and ranks by the first 5, 10, ... symbols.

    text: symbols, 0 at end marks; ends: the places of these. Every end mark
    differs from all others, so no comparison passes one.
    """
    n = len(text)
    to_end = np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(n)
    key = (text // ALPHABET).astype(np.uint64)
    wide = np.concatenate((text % ALPHABET, np.zeros(5, text.dtype))).astype(np.uint64)
    for k in range(5):
        key = key * np.uint64(ALPHABET) + np.where(to_end > k, wide[k : k + n], np.uint64(0))
    order = np.argsort(key, kind="stable")
    new = np.concatenate(([True], key[order[1:]] != key[order[:-1]])) | (to_end[order] < 5)
    # a short suffix is alone, and so is what follows it
    new[1:] |= to_end[order[:-1]] < 5
    depth, levels = 5, []
    while True:
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        levels.append((depth, rank))
        tied = np.flatnonzero(~new)
        if not len(tied):
            return order, levels
        member = np.zeros(n, bool)
        member[tied] = member[tied - 1] = True
        spots = np.flatnonzero(member)
        some = order[spots]
        follow = rank[np.minimum(some + depth, n - 1)]
        sub = np.argsort(rank[some] * n + follow, kind="stable")
        order[spots] = some[sub]
        pair = (rank[some] * n + follow)[sub]
        new[spots] = np.concatenate(([True], pair[1:] != pair[:-1]))
        depth *= 2


def common_prefix(i: np.ndarray, j: np.ndarray, text: np.ndarray, levels: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Lengths of the common prefixes of suffixes i and j, from the ranks of ever fewer symbols."""
    n = len(text)
    i, j = i.copy(), j.copy()
    out = np.zeros(len(i), np.int64)
    for depth, rank in reversed(levels):
        same = (i < n) & (j < n)
        same[same] = rank[i[same]] == rank[j[same]]
        out[same] += depth
        i[same] += depth
        j[same] += depth
    for _ in range(4):
        same = (i < n) & (j < n)
        same[same] = (text[i[same]] == text[j[same]]) & (text[i[same]] > 0)
        out[same] += 1
        i[same] += 1
        j[same] += 1
        i[~same] = n
    return out


class RunLengthIndex:
    """The run-length Burrows-Wheeler transform of texts, with common prefix lengths sampled at its run ends.

    Texts may be aligned: a text of a group begins in a column, and its symbols
    then match those of the same group in the same column only. Overlapping
    pieces of one document, which hold one place in different columns, so never
    match themselves.
    """

    def __init__(self, texts: list[bytes], groups: list[int] | None = None, columns: list[int] | None = None):
        self._build(np.frombuffer(b"".join(texts), np.uint8), np.fromiter(map(len, texts), np.int64, len(texts)), groups, columns)

    @classmethod
    def of(cls, data: np.ndarray, sizes: np.ndarray, groups: np.ndarray, columns: np.ndarray) -> RunLengthIndex:
        """The same of texts that lie one after the other in `data`."""
        out = cls.__new__(cls)
        out._build(data, sizes, groups, columns)
        return out

    def _build(self, data: np.ndarray, sizes: np.ndarray, groups, columns) -> None:
        self.starts = np.concatenate(([0], np.cumsum(sizes + 1)))
        self.text = np.zeros(int(self.starts[-1]), np.int64)
        inside = np.ones(len(self.text), bool)
        ends = self.starts[1:] - 1
        inside[ends] = False
        self.text[inside] = data.astype(np.int64) + 1
        if groups is not None:
            first = np.repeat(np.asarray(groups) * COLUMNS + np.asarray(columns) - self.starts[:-1], sizes)
            self.text[inside] += (first + np.flatnonzero(inside)) * ALPHABET
        order, levels = suffix_ranks(self.text, ends)
        before = np.concatenate(([0], self.text[:-1]))[order]  # the transform; 0 before each text's first symbol
        step = np.concatenate(([True], (before[1:] != before[:-1]) | (before[1:] == 0)))
        #: Heads of the runs: where in the suffix array they begin, and their symbol.
        self.heads = np.flatnonzero(step)
        self.symbols = before[self.heads]
        # where one run ends the next one begins: one common prefix is the sample of both
        top = self.heads[self.heads > 0]
        length = common_prefix(order[top], order[top - 1], self.text, levels)
        self._above, self._below = (order[top], length), (order[top - 1], length)
        self._ends = (order[0], order[-1])

    def matching_statistics(self) -> np.ndarray:
        """For each suffix the length of its longest match with any other suffix, streamed from the samples in text order."""
        out = np.zeros(len(self.text), np.int64)
        for (at, length), lone in ((self._above, self._ends[0]), (self._below, self._ends[1])):
            sampled = np.full(len(self.text), -1, np.int64)
            sampled[at] = length
            sampled[lone] = 0
            # between samples a match shrinks by one from place to place
            places = np.arange(len(self.text))
            near = np.maximum.accumulate(np.where(sampled >= 0, places, -1))
            shrunk = np.where(near >= 0, sampled[near] - (places - near), 0)
            np.maximum(out, shrunk, out=out)
        return out


def _key(id_col: Column, text: Column) -> Column:
    """128 bits of a row: two hashes of its id and text."""
    return F.struct(F.xxhash64(id_col, text).alias("a"), F.xxhash64(text, F.lit(1), id_col).alias("b"))


KEY = "struct<a:bigint,b:bigint>"


def _anchored(rows: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            held: list[tuple] = []
            for i in range(batch.num_rows):
                for gram, context, at, low, high in anchors(data[offsets[i] : offsets[i + 1]], size, STRETCH):
                    held.append((gram, context, np.full(len(at), i), at, at - low, high - low))
            if held:
                g, c, row, at, back, span = (np.concatenate(x) for x in zip(*held, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(c.view(np.int64)), batch.column(0).take(pa.array(row)), pa.array(at), pa.array(back.astype(np.int16)), pa.array(span.astype(np.int16))], names=["gram", "context", "key", "place", "back", "span"])

    return rows.mapInArrow(run, f"gram long, context long, key {KEY}, place long, back short, span short")


#: A context: it begins at `at` of its text, `lead` bytes late in the columns of its anchor at `place`, and its windows begin at low to high.
CONTEXT = ["gram", "key", "place", "at", "low", "high", "lead", "bytes"]
CONTEXT_TYPES = [pa.int64(), None, *[pa.int64()] * 5, pa.binary()]
CONTEXT_SCHEMA = f"gram long, key {KEY}, place long, at long, low long, high long, lead long, bytes binary"


def _contexts(rows: DataFrame, size: int) -> DataFrame:
    """From (key, text, wanted): the contexts of anchors, with their flags `known` and `crowded`."""
    reach = size - GRAM
    names = [*CONTEXT, "known", "crowded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            wanted, lists = batch.column(2).flatten(), np.diff(batch.column(2).offsets.to_numpy())
            row = np.repeat(np.arange(batch.num_rows), lists)
            place, back, span = (wanted.field(c).to_numpy().astype(np.int64) for c in ("place", "back", "span"))
            at, end = np.maximum(0, place - reach), np.minimum(place + size, np.diff(offsets)[row])
            low, begin = place - back, offsets[row]
            for i in range(0, len(row), 5000):
                k = slice(i, i + 5000)
                cut = [data[x:y].tobytes() for x, y in zip((begin[k] + at[k]).tolist(), (begin[k] + end[k]).tolist(), strict=True)]
                numbers = [place[k], at[k], low[k], low[k] + span[k], reach - (place[k] - at[k])]
                part = wanted.slice(i, 5000)
                yield pa.RecordBatch.from_arrays([part.field("gram"), batch.column(0).take(pa.array(row[k])), *(pa.array(v, pa.int64()) for v in numbers), pa.array(cut, pa.binary()), part.field("known"), part.field("crowded")], names=names)

    return rows.mapInArrow(run, f"{CONTEXT_SCHEMA}, known boolean, crowded boolean")


def longer_anchors(data: np.ndarray, offsets: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray, size: int, width: int) -> tuple[np.ndarray, ...]:
    """(row, gram, context, begin, end, near): the windows of contexts dealt out by how far before the anchor they begin, `width` places together.

    data, offsets: the contexts' bytes; place, low, high: the anchor and its
    windows there. The gram is a hash of the bytes that all windows have that
    begin near to near + width - 1 before the anchor, the context of those that
    they cover together.
    """
    sums, inverse = _prefix_hash(data)
    first, last = (place - high) // width, (place - low) // width
    many = last - first + 1
    row = np.repeat(np.arange(len(place)), many)
    near = (np.repeat(first, many) + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)) * width
    at, far = place[row], near + width - 1
    a, b = at - near, at - far + size
    gram = mix64((sums[b] - sums[a]) * inverse[a] + mix64(near.astype(np.uint64) + np.uint64(width << 32)))
    a, b = np.maximum(at - far, offsets[row]), np.minimum(at - near + size, offsets[row + 1])
    shape = (at - a).astype(np.uint64) * np.uint64(1024) + (b - at + near).astype(np.uint64)
    return row, gram, mix64((sums[b] - sums[a]) * inverse[a] + mix64(shape)), a, b, near


def _split(contexts: DataFrame, size: int, width: int) -> DataFrame:
    """The contexts of crowded anchors cut to longer anchors, and `context`, a hash of their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffers(batch.column(7))
            place, at, low, high = (batch.column(k).to_numpy() for k in (2, 3, 4, 5))
            shift = offsets[:-1] - at  # from places of the text to places of the batch's bytes
            row, gram, context, a, b, near = longer_anchors(raw, offsets, place + shift, low + shift, high + shift, size, width)
            far = place[row] - near - width + 1
            begin, whole = a - shift[row], raw.tobytes()
            columns = [gram.view(np.int64), None, place[row], begin, np.maximum(low[row], far), np.minimum(high[row], far + width - 1), begin - far, [whole[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True)]]
            columns = [batch.column(1).take(pa.array(row)) if t is None else pa.array(c, t) for c, t in zip(columns, CONTEXT_TYPES, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(context.view(np.int64))], names=[*CONTEXT, "context"])

    return contexts.select(*CONTEXT).mapInArrow(run, f"{CONTEXT_SCHEMA}, context long")


def paired(data: np.ndarray, offsets: np.ndarray, groups: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) for each context: windows that it may share with another one of its group begin so far before the anchor; last is -1 for none.

    All places are places of `data`. Windows that begin at nearly the same
    distance before the anchor have most of their bytes in common; where a
    context's hash of these is its own it shares none of them.
    """
    sums, inverse = _prefix_hash(data)
    reach = size - GRAM
    width = -(-(reach + 1) // SPLIT)
    nearest, furthest = np.full(len(groups), reach + 1), np.full(len(groups), -1)
    for near in range(0, reach + 1, width):
        begin = place - near
        end = begin + size - width + 1
        some = np.flatnonzero((begin >= offsets[:-1]) & (end <= offsets[1:]) & (place - high < near + width) & (place - low >= near))
        if len(some) > 1:
            b, e = begin[some], end[some]
            key = mix64((sums[e] - sums[b]) * inverse[b] + mix64(groups[some].astype(np.uint64)))
            _, which, count = np.unique(key, return_inverse=True, return_counts=True)
            shared = some[count[which] > 1]
            nearest[shared] = np.minimum(nearest[shared], near)
            furthest[shared] = near + width - 1
    return nearest, furthest


def _marked(contexts: DataFrame, size: int) -> DataFrame:
    """(key, low, high): runs of windows that occur in another place of their anchor's contexts."""
    dealt = contexts.repartition(shuffle_width(contexts.sparkSession), "gram").sortWithinPartitions("gram", "key", "place")

    def marks(batch: pa.RecordBatch) -> pa.RecordBatch:
        gram, place, at, low, high = (batch.column(k).to_numpy() for k in (0, 2, 3, 4, 5))
        data, offsets = text_buffers(batch.column(7))
        groups = np.cumsum(np.concatenate(([0], gram[1:] != gram[:-1])))
        shift, known, lead = offsets[:-1] - at, batch.column(8).to_numpy(zero_copy_only=False), batch.column(6).to_numpy()
        nearest, furthest = paired(data, offsets, groups, place + shift, low + shift, high + shift, size)
        fit = np.flatnonzero(furthest >= 0)
        if not len(fit):
            return pa.RecordBatch.from_arrays([batch.column(1).slice(0, 0), *[pa.array([], pa.int64())] * 2], names=["key", "low", "high"])
        # of each context what its shared windows cover goes on
        place, at, low, high, lead, shift, known, groups, end = (v[fit] for v in (place, at, low, high, lead, shift, known, groups, at + np.diff(offsets)))
        begin = np.maximum(at, place - furthest[fit])
        end, lead = np.minimum(end, place - nearest[fit] + size), lead + begin - at
        low, high = np.maximum(low, begin), np.minimum(high, place - nearest[fit])
        sizes = end - begin
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        data = data[np.arange(offsets[-1]) + np.repeat(begin + shift - offsets[:-1], sizes)]
        at = begin
        index = RunLengthIndex.of(data, np.diff(offsets), groups, lead)
        enough = index.matching_statistics() >= size
        # the windows of all contexts that are not known, one after the other
        some = np.flatnonzero(~known & (high >= low))
        many = (high - low + 1)[some]
        first = np.cumsum(many) - many
        owner = np.repeat(np.arange(len(some)), many)
        nth = np.arange(len(owner)) - first[owner]
        hit = enough[(index.starts[:-1][some] + low[some] - at[some])[owner] + nth]
        edge = np.zeros(len(hit) + 1, bool)
        edge[first], edge[-1] = True, True  # a run ends with its context
        begin = np.flatnonzero(hit & (edge[:-1] | ~np.concatenate(([False], hit[:-1]))))
        end = np.flatnonzero(hit & (edge[1:] | ~np.concatenate((hit[1:], [False]))))
        row = some[owner[begin]]
        return pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(fit[row])), pa.array(low[row] + nth[begin]), pa.array(low[row] + nth[end])], names=["key", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        weight, rows, last = 0, 0, None

        def flush() -> pa.RecordBatch:
            nonlocal weight, rows
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held.clear()
            weight = rows = 0
            return marks(whole)

        for batch in batches:
            gram, ends = batch.column(0).to_numpy(), np.cumsum(pc.binary_length(batch.column(7)).to_numpy())
            # an index ends where an anchor does
            turns = np.flatnonzero(np.concatenate(([last is None or gram[0] != last], gram[1:] != gram[:-1])))
            begin = 0
            for t in turns.tolist():
                before = int(ends[t - 1]) if t else 0
                done = int(ends[begin - 1]) if begin else 0
                if weight + before - done > INDEX or rows + t - begin >= GROUPS:
                    if t > begin:
                        held.append(batch.slice(begin, t - begin))
                    if held:
                        yield flush()
                    begin = t
            held.append(batch.slice(begin))
            weight += int(ends[-1]) - (int(ends[begin - 1]) if begin else 0)
            rows += batch.num_rows - begin
            last = gram[-1]
        if held:
            yield flush()

    return dealt.mapInArrow(run, f"key {KEY}, low long, high long")


def _widths(size: int) -> list[int]:
    """How many places together windows of an anchor may begin at: all, then ever fewer, down to one."""
    out = [size - GRAM + 1]
    while out[-1] > 1:
        out.append(-(-out[-1] // SPLIT))
    return out


def _judged(found: DataFrame, crowd: int) -> tuple[DataFrame, DataFrame]:
    """Anchors (gram, context, key, place, ...) that repeat: those with one context, and the others with `known`, `crowded` and `first`.

    known: the context occurs in another place too; first: it is the one place
    that stands for all of these; crowded: the anchor has more than `crowd` contexts.
    """
    grams = written(found.groupBy("gram").agg(F.count("*").alias("n"), (F.min("context") == F.max("context")).alias("same")).where("n > 1"))
    shared = written(met(found, grams, ["gram"], ["key", "place"]))
    forget(found, grams, shuffles=True)
    mixed = shared.where("not same").drop("same")
    kinds = written(mixed.groupBy("gram", "context").agg(F.count("*").alias("n"), F.min(F.struct("key", "place")).alias("one")).withColumn("known", F.col("n") > 1))
    crowds = written(kinds.groupBy("gram").agg(F.sum("n").alias("n"), (F.count("*") > crowd).alias("crowded")))
    judged = met(met(mixed, kinds, ["gram", "context"], ["key", "place"]), crowds, ["gram"], ["key", "place"])
    judged = written(judged.withColumn("first", F.struct("key", "place") == F.col("one")).drop("one", "context"))
    forget(kinds, crowds)
    return shared.where("same"), judged


def repeated_windows(rows: DataFrame, size: int = 200) -> DataFrame:
    """(key, spans): for each key of rows (key, text) the windows, as runs of first bytes, that start in another place too. Keys are distinct."""
    runs = lambda df: df.select("key", (F.col("place") - F.col("back")).alias("low"), (F.col("place") - F.col("back") + F.col("span")).alias("high"))
    same, judged = _judged(written(_anchored(rows, size)), CROWD)
    sure = [runs(same), written(runs(judged.where("known")))]
    # a context that occurs often goes on once, for others to match
    left = judged.where("not known or first").groupBy("key").agg(F.collect_list(F.struct("gram", "place", "back", "span", "known", "crowded")).alias("wanted"))
    with arrow_rows(rows.sparkSession, 500):
        contexts = written(_contexts(rows.join(left, "key").select("key", "text", "wanted"), size))
    forget(judged, shuffles=True)
    whole = [*CONTEXT, "known"]
    indexed, crowd = [contexts.where("not crowded").select(*whole)], contexts.where("crowded")
    for width in _widths(size)[1:]:
        if crowd.isEmpty():
            break
        same, judged = _judged(written(_split(crowd, size, width)), CROWD if width > 1 else size)
        sure += [same.select("key", "low", "high"), judged.where("known").select("key", "low", "high")]
        left = judged.where("not known or first")
        indexed.append(left.where("not crowded").select(*whole))
        crowd = left.where("crowded")
    marks = _marked(reduce(DataFrame.unionByName, indexed), size)
    return reduce(DataFrame.unionByName, sure, marks).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("low", "high"))).alias("spans"))


def covered(spans: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """Byte ranges that runs of window starts cover, merged where they touch."""
    out: list[list[int]] = []
    for low, high in spans:
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high + size)
        else:
            out.append([low, high + size])
    return [(a, b) for a, b in out]


def drop_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 200) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept) for each row: its text as UTF-8 without bytes of repeated strings.

    A byte goes if a string of `size` bytes that covers it starts in any other
    place too, of any row or of the same one; strings are judged on the input.
    Null text is empty; texts below `size` bytes lose nothing; equal rows are
    different places, so both lose all. Rows without an id are treated alike.
    `kept` is binary, for cuts may fall inside a character.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).withColumn("key", _key(F.col("id"), F.col("text")))
    # of equal rows all goes, and one of them stands for all
    many = written(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    each = rows.select("key", "text")
    equal = not many.isEmpty()
    if equal:
        each = each.join(many, "key", "left_anti").unionByName(each.join(many, "key", "left_semi").dropDuplicates(["key"]))
    spans = written(repeated_windows(each, size))
    if equal:
        alone = spans.join(many, "key", "left_anti")
        bytes_ = F.octet_length("text")
        whole = rows.join(many, "key", "left_semi").select("id", "text", F.when(bytes_ >= size, F.array(F.struct(F.lit(0).cast("long").alias("low"), (bytes_ - size).cast("long").alias("high")))).alias("spans"))
        joined = rows.join(many, "key", "left_anti").join(alone, "key", "left").select("id", "text", "spans").unionByName(whole)
    else:
        joined = rows.join(spans, "key", "left").select("id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            out = []
            for i, own in enumerate(batch.column(2).to_pylist()):
                raw = data[offsets[i] : offsets[i + 1]].tobytes()
                cut = covered([(x["low"], x["high"]) for x in own], size) if own else []
                parts, at = [], 0
                for a, b in cut:
                    parts.append(raw[at:a])
                    at = b
                parts.append(raw[at:])
                out.append((len(raw), sum(b - a for a, b in cut), len(cut), b"".join(parts)))
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.binary())], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def op9_repeats(spark, sf_dir):
    out = drop_repeated_bytes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
