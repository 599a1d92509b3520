"""Sparse indicator features of text, made in numpy for whole Arrow columns, and the bounded sample that classifiers fit on."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import mix64, row_groups, text_buffers, written
from .words import word_hashes

#: Features of one group of rows: the row and the feature of each pair, ascending and distinct.
Pairs = tuple[np.ndarray, np.ndarray]


def _distinct(rows: list[np.ndarray], features: list[np.ndarray], bits: int) -> Pairs:
    keys = np.unique((np.concatenate(rows).astype(np.int64) << bits) | np.concatenate(features).astype(np.int64))
    return keys >> bits, keys & ((1 << bits) - 1)


def word_features(bits: int, bigrams: bool = False, prefixes: tuple[int, ...] = ()) -> Callable[[np.ndarray, np.ndarray], Pairs]:
    """Hashed words, their prefixes of these lengths in bytes, and pairs of neighbouring words if asked for, in 2**bits features."""

    def make(data: np.ndarray, offsets: np.ndarray) -> Pairs:
        words, at, *heads = word_hashes(data, offsets, prefixes)
        row = np.repeat(np.arange(len(at) - 1), np.diff(at))
        shift = np.uint64(64 - bits)
        rows, found = [row], [words >> shift]
        for head in heads[0] if heads else ():
            rows.append(row[head != 0])
            found.append(head[head != 0] >> shift)
        if bigrams and len(words) > 1:
            same = row[1:] == row[:-1]
            rows.append(row[1:][same])
            found.append(mix64(words[:-1][same] * np.uint64(31) + words[1:][same]) >> shift)
        return _distinct(rows, found, bits)

    return make


#: Classes of bytes for shapes: letters, capitals, digits, blanks, line ends, single marks, other marks.
_CLASS = np.full(256, 15, np.uint8)
_CLASS[97:123] = _CLASS[128:] = 0
_CLASS[65:91], _CLASS[48:58], _CLASS[32], _CLASS[10] = 1, 2, 3, 4
for _k, _c in enumerate(b".,!|*#$%&"):
    _CLASS[_c] = 5 + _k
SHAPE_BITS = 18


def shape_features(data: np.ndarray, offsets: np.ndarray) -> Pairs:
    """Runs of 1 to 4 byte classes (equal neighbours count once), and whether a word stands 2, 3 or 4 times in a row."""
    kind = _CLASS[data]
    first = np.zeros(len(data), bool)
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    keep = np.ones(len(data), bool)
    keep[1:] = (kind[1:] != kind[:-1]) | first[1:]
    kind = kind[keep].astype(np.int64)
    at = np.concatenate(([0], np.cumsum(keep)))[offsets]
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    rows, found = [row], [kind]
    code = kind
    for n in range(2, 5):
        if len(kind) < n:
            break
        code = code[:-1] * 16 + kind[n - 1 :]
        same = row[n - 1 :] == row[: len(row) - n + 1]
        rows.append(row[n - 1 :][same])
        found.append(code[same] + (n - 1) * 65536)
    words, wat = word_hashes(data, offsets)
    wrow = np.repeat(np.arange(len(wat) - 1), np.diff(wat))
    again = np.zeros(len(words), bool)
    if len(words) > 1:
        again[1:] = (words[1:] == words[:-1]) & (wrow[1:] == wrow[:-1])
    run = again
    for n in range(3):
        rows.append(wrow[run])
        found.append(np.full(int(run.sum()), 16 + n))
        run = run & np.concatenate((np.zeros(1, bool), run[:-1]))[: len(run)]
    return _distinct(rows, found, SHAPE_BITS)


def featurised(docs: DataFrame, text_col: str, makers: list[tuple[Callable, int]]) -> DataFrame:
    """docs with the text replaced by `features`: the int32 feature numbers of each row as bytes, one range after the other."""
    kept = [c for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(batch.num_columns - 1))
            out: list[bytes] = []
            for i, j in row_groups(offsets):
                part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                for r in feature_lists(part, at, makers):
                    out.append(r.astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.binary())], names=[*kept, "features"])

    return docs.select(*kept, text_col).mapInArrow(run, docs.select(*kept).schema.add("features", "binary"))


def feature_lists(data: np.ndarray, offsets: np.ndarray, makers: list[tuple[Callable, int]]) -> list[np.ndarray]:
    n = len(offsets) - 1
    base, lists = 0, [[] for _ in range(n)]
    for make, size in makers:
        rows, found = make(data, offsets)
        at = np.searchsorted(rows, np.arange(n + 1))
        for k in range(n):
            lists[k].append(found[at[k] : at[k + 1]] + base)
        base += size
    return [np.concatenate(x) for x in lists]


def sums(data: np.ndarray, offsets: np.ndarray, makers: list[tuple[Callable, int]], weights: np.ndarray) -> np.ndarray:
    """For each row the sum of the weights of its features."""
    n, base = len(offsets) - 1, 0
    out = np.zeros(n)
    for make, size in makers:
        rows, found = make(data, offsets)
        out += np.bincount(rows, weights[base : base + size][found], minlength=n)
        base += size
    return out


def scored(docs: DataFrame, text_col: str, makers: list[tuple[Callable, int]], weights: np.ndarray, name: str) -> DataFrame:
    """docs with the column `name`: the sum of the weights of the text's features. weights: float32, of fixed size."""
    kept = [c for c in docs.columns if c != name]
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(batch.num_columns - 1))
            out = np.zeros(batch.num_rows)
            for i, j in row_groups(offsets):
                out[i:j] = sums(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], makers, weights)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.float64())], names=[*kept, name])

    return source.mapInArrow(run, docs.select(*[F.col(f"`{c}`") for c in kept]).schema.add(name, "double"))


#: Bytes of features that a sample has at most, and different rows (samples have fewer ids than that).
SAMPLE_BYTES, FETCHED = 256 << 20, 100_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, most: int, id_col: str = "doc_id", text_col: str = "text", where: Column | None = None) -> DataFrame:
    """At most `most` ids that have a label, those with the smallest hashes, as rows (id, label, text).

    An id with several labels gets the largest; an id with several texts gives
    each of them. The picked ids are broadcast, which `most` bounds.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    if where is not None:
        known = known.where(where)
    picked = known.groupBy(F.col(id_col).alias("doc")).agg(F.max(F.col(label_col).cast("double")).alias("label")).orderBy(F.xxhash64("doc"), "doc").limit(most)
    source = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return source.join(F.broadcast(picked), "doc").select("doc", "label", "text")


def drawn(sample: DataFrame, makers: list[tuple[Callable, int]], bytes_: int = SAMPLE_BYTES) -> DataFrame:
    """Rows (nr, label, features) of a sample, numbered from 0 in the order of the ids' hashes: the first ones whose features have so many bytes together."""
    rows = written(featurised(sample, "text", makers).withColumn("h", F.xxhash64("doc")).withColumn("g", F.xxhash64("features")))
    order = ["h", "doc", "g"]
    # equal rows of one id go together: a row for each kind, with the bytes of all before it
    kinds = rows.groupBy(*order).agg(F.sum(F.length("features")).alias("n"), F.count("*").alias("rows"), F.max(F.length("features")).alias("one")).orderBy(*order).limit(FETCHED).collect()
    room, left, first = [], bytes_, 0
    for r in kinds:
        fit = min(r["rows"], max(left // max(r["one"], 1), 0 if room else 1))
        if fit:
            room.append((r["h"], r["doc"], r["g"], fit, first))
        left -= fit * r["one"]
        first += fit
        if fit < r["rows"]:
            break
    taken = rows.sparkSession.createDataFrame(room, rows.select(*order).schema.add("fit", "long").add("first", "long"))
    nth = F.row_number().over(Window.partitionBy(*order).orderBy("label"))
    rows = rows.join(F.broadcast(taken), order).withColumn("nth", nth).where(F.col("nth") <= F.col("fit"))
    return rows.select((F.col("first") + F.col("nth") - 1).alias("nr"), "label", "features")


def gathered(rows: DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
    """The features and labels of rows (nr, label, features) on the driver, in the order of their numbers."""
    got = rows.orderBy("nr").select("features", "label").collect()
    return [np.frombuffer(r["features"], "<i4") for r in got], np.array([r["label"] for r in got], float)


def fetched(sample: DataFrame, makers: list[tuple[Callable, int]], bytes_: int = SAMPLE_BYTES) -> tuple[list[np.ndarray], np.ndarray]:
    """The features and labels of the rows that drawn() leaves of a sample, in their order."""
    return gathered(drawn(sample, makers, bytes_))


def feature_counts(rows: DataFrame, group: Column, n: int) -> DataFrame:
    """Of rows with `features`: (feature, n0, n1, ...), in how many rows of each of n groups, numbered from 0, a feature is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = text_buffers(batch.column(1))
            for i, j in row_groups(offsets):
                flat = data[offsets[i] : offsets[j]].view("<i4").astype(np.int64)
                keys, count = np.unique(flat * n + np.repeat(own[i:j], np.diff(offsets[i : j + 1]) // 4), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys // n, pa.int32()), pa.array(keys % n), pa.array(count, pa.int64())], names=["feature", "own", "n"])

    parts = rows.select(group.cast("long"), "features").mapInArrow(run, "feature int, own long, n long")
    return parts.groupBy("feature").agg(*[F.sum(F.when(F.col("own") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(n)])


def narrowed(rows: DataFrame, chosen: np.ndarray, size: int) -> DataFrame:
    """rows (nr, label, features) with the chosen ones of their features alone, of which there are `size`; no row goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.zeros(size, bool)
        wanted[chosen] = True
        for batch in batches:
            data, offsets = text_buffers(batch.column(2))
            out = (data[a:b].view("<i4") for a, b in zip(offsets[:-1], offsets[1:], strict=True))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([r[wanted[r]].tobytes() for r in out], pa.binary())], names=["nr", "label", "features"])

    return rows.select("nr", "label", "features").mapInArrow(run, rows.select("nr", "label", "features").schema)
