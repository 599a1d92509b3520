"""Packing into fixed windows by order-preserving dynamic programming.

The ids of the documents of a partition form one stream, each document closed by
an end id. A stream is cut into windows of at most `size` ids. Cuts go to the
ends of documents (free), of sentences, or between any ids on a fixed grid
inside long sentences; each kind has its penalty, and a window costs its
padding too. A monotone queue over the window's reach gives each cut its best
predecessor in constant time. What is left at the end of a partition is dealt
to windows whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .tokens import Encoder

#: Costs in padding ids: of a cut at a sentence's end and of one inside a sentence; the grid of cuts in long sentences.
SENTENCE, INSIDE, GRID = 4, 12, 32
#: Ids that are cut at once.
BLOCK = 1 << 20


def cut_points(ends: np.ndarray, sentences: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a stream may be cut, ascending from 0, and what each cut costs."""
    base = np.unique(np.concatenate(([0], ends, sentences, [total])))
    extra = (np.diff(base) - 1) // GRID
    owner = np.repeat(np.arange(len(extra)), extra)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(extra) - extra, extra) + 1
    fill = base[owner] + nth * GRID
    at = np.concatenate((base, fill))
    cost = np.concatenate((np.full(len(base), SENTENCE), np.full(len(fill), INSIDE)))
    order = np.argsort(at, kind="stable")
    at, cost = at[order], cost[order]
    cost[np.searchsorted(at, ends)] = 0
    return at, cost


def best_cuts(at: list[int], cost: list[int], size: int) -> tuple[list[int], list[int]]:
    """For each cut its least cost plus its position, and its predecessor; windows reach back at most `size`."""
    n = len(at)
    key, back = [0] * n, [0] * n
    queue, head = [0], 0
    for i in range(1, n):
        least = at[i] - size
        while at[queue[head]] < least:
            head += 1
        back[i] = queue[head]
        k = key[queue[head]] + cost[i] + size
        while len(queue) > head and key[queue[-1]] >= k:
            queue.pop()
        queue.append(i)
        key[i] = k
    return key, back


def _tail(rest: int, size: int) -> tuple[int, list[int]]:
    """The cost of the last `rest` ids and the lengths of their windows."""
    powers = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    split = INSIDE * (len(powers) - 1)
    return (split, powers) if split <= size - rest else (size - rest, [rest])


class Packer:
    """Takes the ids of documents in order and gives rows of pieces; `closing` at the end of a partition."""

    def __init__(self, size: int, ends_sentence: np.ndarray, first_sequence: int):
        self.size, self.flags, self.sequence = size, ends_sentence, first_sequence
        self.docs: list[tuple] = []  # id, ids before these, ids in all, ids
        self.held = 0

    def add(self, doc, ids: np.ndarray) -> Iterator[tuple]:
        self.docs.append((doc, 0, len(ids), ids))
        self.held += len(ids)
        if self.held >= BLOCK:
            yield from self._flush(False)

    def closing(self) -> Iterator[tuple]:
        if self.held:
            yield from self._flush(True)

    def _flush(self, last: bool) -> Iterator[tuple]:
        ids = np.concatenate([d[3] for d in self.docs])
        ends = np.cumsum([len(d[3]) for d in self.docs])
        total = len(ids)
        at_, cost_ = cut_points(ends, np.flatnonzero(self.flags[ids]) + 1, total)
        at, cost = at_.tolist(), cost_.tolist()
        key, back = best_cuts(at, cost, self.size)
        reach = range(int(np.searchsorted(at_, total - self.size)), len(at))
        if last:
            node = min(reach, key=lambda i: (key[i] - at[i] + (_tail(total - at[i], self.size)[0] if at[i] < total else 0), -i))
        else:
            node = min(reach, key=lambda i: (key[i] - at[i], -i))
        cuts = []
        end = node
        while node:
            cuts.append(at[node])
            node = back[node]
        cuts = [0, *cuts[::-1]]
        if last and at[end] < total:
            for n in _tail(total - at[end], self.size)[1]:
                cuts.append(cuts[-1] + n)
        edges = np.array(cuts)
        done = edges[-1]
        points = np.unique(np.concatenate((edges, ends[ends < done])))
        begins, sizes = points[:-1], np.diff(points)
        which = np.searchsorted(ends, begins, side="right")
        window = np.searchsorted(edges, begins, side="right") - 1
        starts = np.concatenate(([0], ends[:-1]))
        raw = ids.astype("<u4", copy=False)
        for b, n, d, w in zip(begins.tolist(), sizes.tolist(), which.tolist(), window.tolist(), strict=True):
            doc, before, all_, _ = self.docs[d]
            yield doc, before + b - int(starts[d]), n, zlib.crc32(raw[b : b + n].tobytes()), all_, self.sequence + w, b - cuts[w]
        self.sequence += len(edges) - 1
        self.docs = [(doc, before + max(0, int(done - s)), all_, x[max(0, int(done - s)) :]) for (doc, before, all_, x), s, e in zip(self.docs, starts, ends, strict=True) if e > done]
        self.held = int(total - done)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end_id: int = 1) -> DataFrame:
    """One row for each piece of a document in a window.

    Columns: the id, `start`, `length`, `ids_crc32`, `doc_tokens`, `sequence_id`,
    `offset`. Rows of the table are packed in the order in which Spark reads
    them, each partition for itself, so nothing is shuffled; `sequence_id` is
    the partition times 2^32 plus a running number. Null text is empty and gives
    the end id alone; repeated rows and rows without an id are packed like any
    other; an empty table gives no rows. Other columns are not read.
    """
    fields = [("start", "long"), ("length", "long"), ("ids_crc32", "long"), ("doc_tokens", "long"), ("sequence_id", "long"), ("offset", "long")]
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, *(n for n, _ in fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer)
        packer = Packer(size, encoder.ends_sentence, TaskContext.get().partitionId() << 32)
        rows: list[tuple] = []
        kinds = None

        def out() -> pa.RecordBatch:
            arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [kinds, *[pa.int64()] * 6], strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            kinds = batch.schema.field(0).type
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, tokens in encoder.encode([t or "" for t in texts]):
                rows.extend(packer.add(ids[i], np.append(tokens, np.uint32(end_id))))
                if len(rows) >= 20_000:
                    yield out()
        rows.extend(packer.closing())
        if rows:
            yield out()

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"`{n}` {t}" for n, t in fields))


def op8_packing(spark, sf_dir):
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
