"""Exact top-k search by MaxScore over vectors of whole numbers, whose dimensions are the terms.

Rows are packed where they are read into shards of a few megabytes, each with
its own postings; every query visits every shard, and the shards' best are
merged. In a block of a shard, terms are essential as long as what the others
can add together reaches the k-th score so far: only documents in essential
postings can still get among the best. These postings are traversed, the other
terms are probed for the documents that remain competitive.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_rows, numbered, renamed, shuffle_width, table, written

#: Numbers in a shard, in a block of it that has its own bounds, and in a block of queries; terms that are probed between two looks at the bounds.
SHARD, BLOCK, QUERIES, PROBED = 1 << 22, 1 << 19, 1 << 17, 4
#: Sums below these are exact in doubles, and in longs.
DOUBLES, LONGS = 1 << 53, 1 << 62
LONG = (-(1 << 63), (1 << 63) - 1)


class Postings:
    """The postings of a block: for each term the documents that have it with their weights, and the term's least and largest weight."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.n = ids, len(ids)
        self.low, self.high = np.minimum(vectors.min(axis=0, initial=0), 0), np.maximum(vectors.max(axis=0, initial=0), 0)
        self.most = np.maximum(self.high, -self.low).astype(object) if vectors.dtype == object else np.maximum(self.high.astype(object), -self.low.astype(object))
        self.columns = np.ascontiguousarray(vectors.T)
        self.rows = [np.flatnonzero(c) for c in self.columns]
        self._doubles: np.ndarray | None = None

    def _weights(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Postings and query in a type that holds all sums exactly."""
        bound = sum(int(m) * abs(int(w)) for m, w in zip(self.most.tolist(), query.tolist(), strict=True))
        if bound < DOUBLES:
            if self._doubles is None:
                self._doubles = self.columns.astype(float)
            return self._doubles, query.astype(float)
        kind = np.int64 if bound < LONGS else object
        return self.columns.astype(kind), query.astype(kind)

    def search(self, query: np.ndarray, own: int, k: int, least: int | None) -> list[tuple[int, int]]:
        """(score, id) of the documents, without `own`, that may be among the k best; least: the k-th score so far, which ids may still tie."""
        d = min(len(query), len(self.columns))
        query = query[:d] if d == len(self.columns) else np.concatenate((query[:d], np.zeros(len(self.columns) - d, query.dtype)))
        columns, weights = self._weights(query)
        low, high = self.low.astype(columns.dtype), self.high.astype(columns.dtype)
        gain = np.maximum(weights * low, weights * high)  # what a term can add; at least 0
        terms = np.flatnonzero(weights != 0)
        terms = terms[np.argsort(-gain[terms], kind="stable")]
        rest = np.concatenate((np.cumsum(gain[terms][::-1])[::-1], np.zeros(1, gain.dtype)))  # what terms i and on can add together
        essential = len(terms) if least is None or least <= 0 else int((rest[:-1] >= least).sum())
        scores = np.zeros(self.n, columns.dtype)
        for t in terms[:essential].tolist():
            rows = self.rows[t]
            if 2 * len(rows) > self.n:
                scores += weights[t] * columns[t]
            else:
                scores[rows] += weights[t] * columns[t][rows]
        # documents in no essential posting have a score of 0 here, too little to go on
        alive = np.flatnonzero(self.ids != own)
        if least is not None:
            alive = alive[scores[alive] + rest[essential] >= least]
        scores = scores[alive]
        for i in range(essential, len(terms), PROBED):
            for t in terms[i : i + PROBED].tolist():
                scores += weights[t] * columns[t][alive]
            fit = scores + rest[min(i + PROBED, len(terms))] >= least
            alive, scores = alive[fit], scores[fit]
        if len(alive) > k:
            cut = np.partition(scores, len(scores) - k)[len(scores) - k] if scores.dtype != object else sorted(scores.tolist())[-k]
            alive, scores = alive[scores >= cut], scores[scores >= cut]
        return list(zip(map(int, scores.tolist()), self.ids[alive].tolist(), strict=True))


def best(found: list[tuple[int, int]], k: int) -> list[tuple[int, int]]:
    """The k highest scores, ties to the smaller id."""
    return sorted(found, key=lambda x: (-x[0], x[1]))[:k]


def _packed(rows: DataFrame, most: int) -> DataFrame:
    """(part, n, first, ids, sizes, width, numbers): runs of rows (id, v) in the order in which they are read, of about `most` numbers each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, first = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        weight = 0

        def block() -> pa.RecordBatch:
            nonlocal n, first, weight
            ids, sizes, numbers = (np.concatenate(x) for x in zip(*held, strict=True))
            top = max(abs(int(numbers.min(initial=0))), abs(int(numbers.max(initial=0))))
            width = 2 if top < 1 << 15 else 4 if top < 1 << 31 else 8
            row = [[part], [n], [(part << 33) + first], [ids.tobytes()], [sizes.astype("<i4").tobytes()], [width], [numbers.astype(f"<i{width}").tobytes()]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary()]
            n, first, weight = n + 1, first + len(ids), 0
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, kinds, strict=True)], names=["part", "n", "first", "ids", "sizes", "width", "numbers"])

        for batch in batches:
            ids, sizes = batch.column(0).to_numpy(), np.diff(batch.column(1).offsets.to_numpy())
            numbers, ends = batch.column(1).flatten().to_numpy(), np.concatenate(([0], np.cumsum(sizes)))
            at = 0
            while at < len(ids):
                end = max(at + 1, int(np.searchsorted(ends, ends[at] + most - weight, side="right")) - 1)
                held.append((ids[at:end], sizes[at:end], numbers[ends[at] : ends[end]]))
                weight += int(ends[end] - ends[at]) + end - at
                at = end
                if weight >= most:
                    yield block()
        if held:
            yield block()

    return rows.mapInArrow(run, "part int, n int, first long, ids binary, sizes binary, width int, numbers binary")


def _unpacked(ids: bytes, sizes: bytes, width: int, numbers: bytes) -> tuple[np.ndarray, list[np.ndarray]]:
    flat, at = np.frombuffer(numbers, f"<i{width}").astype(np.int64), np.cumsum(np.frombuffer(sizes, "<i4"))
    return np.frombuffer(ids, "<i8"), np.split(flat, at[:-1]) if len(at) else []


def _postings(ids: np.ndarray, vectors: list[np.ndarray]) -> Iterator[Postings]:
    """Blocks of a shard; shorter vectors lack the last terms."""
    i = 0
    while i < len(ids):
        wide, j = max(1, len(vectors[i])), i + 1
        while j < len(ids) and (j + 1 - i) * max(wide, len(vectors[j])) <= BLOCK:
            wide, j = max(wide, len(vectors[j])), j + 1
        grid = np.zeros((j - i, wide), np.int64)
        sizes = [len(v) for v in vectors[i:j]]
        if min(sizes) == wide:
            grid[:] = np.concatenate(vectors[i:j]).reshape(j - i, wide)
        else:
            for k, v in enumerate(vectors[i:j]):
                grid[k, : len(v)] = v
        yield Postings(ids[i:j], grid)
        i = j


def _searched(shards: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(row, query, id, score): of each shard the k best for each query; a shard is held while all queries pass it, block by block."""
    spark = shards.sparkSession
    # a number for each shard, gapless: one entry a partition on the driver
    counts = {r["part"]: r["count"] for r in shards.groupBy("part").count().collect()}
    before, total = {}, 0
    for p in sorted(counts):
        before[p], total = total, total + counts[p]
    columns = ["first", "ids", "sizes", "width", "numbers"]
    if not total:
        return spark.createDataFrame([], "row long, query long, id long, score decimal(38,0)")
    offsets = spark.createDataFrame(list(before.items()), "part int, before int")
    items = shards.join(F.broadcast(offsets), "part").select((F.col("before") + F.col("n")).alias("shard"), F.lit(0).alias("kind"), *columns)
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(total - 1))).alias("shard"), F.lit(1).alias("kind"), *columns)
    dealt = items.unionByName(asked).repartition(min(total, 8 * shuffle_width(spark)), "shard").sortWithinPartitions("shard", "kind", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Postings] = []
        for batch in batches:
            for i in range(batch.num_rows):
                _, kind, first, *packed = (c[i].as_py() for c in batch.columns)
                ids, vectors = _unpacked(*packed)
                if kind == 0:
                    held = list(_postings(ids, vectors))
                    continue
                rows: list[tuple] = []
                for q, v in enumerate(vectors):
                    found: list[tuple[int, int]] = []
                    for block in held:
                        found = best(found + block.search(v, int(ids[q]), k, found[-1][0] if len(found) == k else None), k)
                    rows += [(first + q, int(ids[q]), x, s) for s, x in found]
                if rows:
                    row, query, other, score = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in (row, query, other)), pa.array([str(s) for s in score])], names=["row", "query", "id", "score"])

    return dealt.mapInArrow(run, "row long, query long, id long, score string").withColumn("score", F.col("score").cast("decimal(38,0)"))


def max_score(items: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD) -> DataFrame:
    """(query_id, rank, id, score): for each row of queries the k rows of items with the highest inner products.

    Both tables have an id and a vector of whole numbers (array<bigint>); ties go
    to the smaller id, and rows with the query's own id are no candidates. Fewer
    than k candidates give fewer rows. Scores are exact; one beyond a long is
    null, but ranked by its value. Rows with a null id or vector, or a null
    component, take no part; a vector that is shorter has zeros where it lacks
    components. Repeated rows of items are candidates each, repeated rows of
    queries are queries each. Ids are of any type that can be sorted. Other
    columns are not read; an empty table gives no rows.
    """
    fine = lambda df: df.select(F.col(f"`{id_col}`"), F.col(f"`{vector_col}`").cast("array<bigint>").alias("__v"), F.lit(True).alias("__item")).where(F.col(f"`{id_col}`").isNotNull() & F.forall("__v", lambda x: x.isNotNull()))
    both, names = numbered(fine(items).unionByName(fine(queries).withColumn("__item", F.lit(False))), id_col, "__id")
    pick = lambda item: both.where(F.col("__item") == item).select(F.col("__id").alias("id"), F.col("__v").alias("v"))
    shards, asked = written(_packed(pick(True), shard)), written(_packed(pick(False), min(QUERIES, shard)))
    with arrow_rows(items.sparkSession, 4):
        found = written(_searched(shards, asked, k))
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.col("score").desc(), "id"))
    out = found.withColumn("rank", rank).where(F.col("rank") <= k)
    out = out.select(F.col("query").alias("query_id"), "rank", F.col("id").alias(id_col), F.when(F.col("score").between(*map(F.lit, LONG)), F.col("score")).cast("long").alias("score"))
    return renamed(out, ["query_id", id_col], names)


def quantised(vectors: DataFrame, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, vector): components as floor(scale * x), x in double precision; vectors that are null or hold null or non-finite components are left out."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(fine).select(F.col(f"`{id_col}`"), F.transform(v, lambda x: F.floor(x * scale)).alias(vector_col))


def op11_max_score(spark, sf_dir):
    vectors = quantised(table(spark, sf_dir, "embeddings"))
    return max_score(vectors, vectors.where("vec_id % 50 = 0"))


OP11_SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 5"""
