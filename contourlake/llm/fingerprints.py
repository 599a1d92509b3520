"""Document fingerprints by context-triggered piecewise hashing, and their likeness.

A rolling hash over seven code points sets chunk boundaries; a chunk gives one
base64 letter, so a signature is a string that changes only where the text
does. Each fingerprint holds the signatures at its block size and at twice
that; block sizes are powers of two, so the boundaries of the second are among
those of the first. A chunk that finds no boundary is cut at four block sizes
from its start, so that monotonous text has signatures too. Two fingerprints
are compared at a block size that both hold, by the edit distance of insertions
and deletions, if they share a run of seven letters (of a third of the shorter
signature, where that is less).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, renamed, shuffle_width, table

LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
#: Letters that a signature aims at, code points in the rolling window, and the shared run that a comparison needs.
LENGTH, WINDOW, RUN = 64, 7, 7
_STEP, _STEP2, _STEP3 = (np.uint32(pow(0x9E3779B1, k, 1 << 32)) for k in (1, 2, 3))
_SPREAD = np.uint32(0x85EBCA6B)


def block_size(n: int) -> int:
    """The smallest power of two at which n code points give at most LENGTH average chunks."""
    return 1 << max(0, -(-n // LENGTH) - 1).bit_length()


def _spread(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint32(15))
    h *= _SPREAD
    return h ^ (h >> np.uint32(13))


def _signature(mixed: np.ndarray, ends: np.ndarray, block: int) -> str:
    n, most = len(mixed), 4 * block
    edges = np.concatenate(([-1], ends, [n - 1])) if not len(ends) or ends[-1] != n - 1 else np.concatenate(([-1], ends))
    gaps = np.diff(edges)
    if gaps.max() > most:
        extra = (gaps - 1) // most
        owner = np.repeat(np.arange(len(gaps)), extra)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(extra) - extra, extra) + 1
        edges = np.sort(np.concatenate((edges, edges[owner] + nth * most)))
    sums = np.add.reduceat(mixed, edges[:-1] + 1, dtype=np.uint32)
    return LETTERS[_spread(sums) >> np.uint32(26)].tobytes().decode()


def fingerprint(text: str) -> str:
    """block size:signature:signature at twice the size; '1::' for the empty text."""
    n = len(text)
    if n == 0:
        return "1::"
    if text.isascii():
        x = np.zeros(n + WINDOW - 1, np.uint32)
        x[WINDOW - 1 :] = np.frombuffer(text.encode(), np.uint8)
    else:
        x = np.concatenate((np.zeros(WINDOW - 1, np.uint32), np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)))
    two = x[:-1] * _STEP
    two += x[1:]
    four = two[:-2] * _STEP2
    four += two[2:]
    seven = four[:-3] * _STEP3
    seven += four[3:]
    mixed = _spread(seven)
    block = block_size(n)
    ends = np.flatnonzero(mixed < (1 << 32) // block) if block > 1 else np.arange(n)
    wide = ends[mixed[ends] < (1 << 32) // (2 * block)]
    return f"{block}:{_signature(mixed, ends, block)}:{_signature(mixed, wide, 2 * block)}"


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit for each letter of a."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    open_ = full
    for c in b:
        hit = open_ & masks.get(c, 0)
        open_ = ((open_ + hit) | (open_ - hit)) & full
    return len(a) - open_.bit_count()


def _similar(a: str, b: str) -> float:
    if a == b:
        return 1.0
    run = min(RUN, max(1, len(a) // 3), max(1, len(b) // 3), len(a), len(b))
    if run == 0:
        return 0.0
    grams = {a[i : i + run] for i in range(len(a) - run + 1)}
    if not any(b[i : i + run] in grams for i in range(len(b) - run + 1)):
        return 0.0
    return 2.0 * _common(a, b) / (len(a) + len(b))


def likeness(x: str, y: str) -> float:
    """1 for equal fingerprints, 0 where block sizes are incompatible or no run is shared, else 1 - distance / total length."""
    if x == y:
        return 1.0
    bx, x1, x2 = x.split(":")
    by, y1, y2 = y.split(":")
    p, q = int(bx), int(by)
    if p == q:
        return max(_similar(x1, y1), _similar(x2, y2))
    if p == 2 * q:
        return _similar(x1, y2)
    if q == 2 * p:
        return _similar(x2, y1)
    return 0.0


def with_fingerprints(docs: DataFrame, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """docs and the fingerprint of each whole text; null counts as empty. A column named out_col is replaced."""
    kept = [c for c in docs.columns if c != out_col]
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = pa.array([fingerprint(t.as_py() or "") for t in batch.column(batch.num_columns - 1)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], prints], names=[*batch.schema.names[:-1], out_col])

    return source.mapInArrow(run, docs.select(*[F.col(f"`{c}`") for c in kept]).schema.add(out_col, "string"))


def _in_id_order(docs: DataFrame) -> tuple[DataFrame, int]:
    """Rows (part, id, text, guest) in ranges of descending id; each range also gets the first rows of the next one as guests.

    The range limits come from quantiles of the ids alone, so texts are
    shuffled once; the guests are at most one id for each range.
    """
    spark = docs.sparkSession
    parts = max(1, shuffle_width(spark))
    limits = np.array(sorted(set(docs.approxQuantile("id", [k / parts for k in range(1, parts)], 0.5 / parts))), np.int64)

    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        return pd.Series(len(limits) - np.searchsorted(limits, ids.to_numpy()))

    # part 0 has the largest ids; rows without an id come last
    part = F.when(F.col("id").isNull(), F.lit(len(limits))).otherwise(place(F.coalesce("id", F.lit(0))))
    parted = docs.withColumn("part", part)
    heads = sorted((r["part"], r["head"]) for r in parted.groupBy("part").agg(F.max("id").alias("head")).collect())
    before = [(p, h, heads[i - 1][0]) for i, (p, h) in enumerate(heads)]
    if not before:
        return parted.withColumn("guest", F.lit(0)), 1
    marks = F.broadcast(spark.createDataFrame(before, "part int, head long, before int"))
    both = parted.join(marks, "part").withColumn(
        "to", F.when(F.col("id").eqNullSafe(F.col("head")), F.array(F.struct(F.col("part").alias("part"), F.lit(0).alias("guest")), F.struct(F.col("before").alias("part"), F.lit(1).alias("guest")))).otherwise(F.array(F.struct(F.col("part").alias("part"), F.lit(0).alias("guest"))))
    )
    return both.select("id", "text", F.explode("to").alias("to")).select("to.part", "to.guest", "id", "text"), len(heads)


def compare_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness to each other and to the next document.

    The next document has the next smaller id (after the last: the first); rows
    with one id follow each other by text, rows without an id come last. The
    edited text is the text with its last floor(n / 2) code points replaced by
    as many first ones of the next text, or by all of that. Null text is empty.
    Ids are of any type that can be sorted; other columns are not read; an empty
    table gives no rows.
    """
    source, names = numbered(docs.select(*dict.fromkeys((id_col, text_col))), id_col, "__id")
    rows, parts = _in_id_order(source.select(F.col("__id").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")))
    dealt = rows.repartitionByRange(parts, "part").sortWithinPartitions("part", "guest", F.col("id").desc_nulls_last(), "text")

    def one(key, text: str, own: str, after: str, after_print: str) -> tuple:
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        changed = fingerprint(edited)
        return key, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own, changed, likeness(own, changed), likeness(own, after_print)

    schema = pa.schema([(id_col, pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        ended = -1  # the part whose first guest has been used
        for batch in batches:
            out = []
            for part, guest, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part == ended:
                    continue
                own = fingerprint(text)
                if last is not None:
                    out.append(one(*last, text, own))
                last = (key, text, own)
                if guest:
                    last, ended = None, part
            for i in range(0, len(out), 2048):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[i : i + 2048], strict=True), schema, strict=True)], schema=schema)

    out = dealt.mapInArrow(run, f"`{id_col}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return renamed(out, [id_col], names)


def op1_fingerprints(spark, sf_dir):
    return compare_neighbours(table(spark, sf_dir, "documents"))
