"""Embedding near-dedup by an epsilon grid order join.

Unit vectors are projected on leading principal axes, placed in grid cells as
wide as the join distance, and sorted by label and cells. Runs of the sorted
sequence become blocks of about a megabyte with bounding boxes. The join
recurses from whole sequences to ever shorter intervals and drops pairs of
intervals whose boxes are further apart than the distance. Pairs of blocks that
remain meet in one task, which recurses once more and multiplies what is left.
Equal vectors are joined as one vector with a count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_rows, forget, met, numbered, renamed, shuffle_width, table, written
from .components import connected_components
from .whitening import gramian

#: Principal axes of the grid, bytes of vectors in a block, how many intervals one interval splits into, and vectors in the shortest ones.
AXES, BLOCK, FAN, INNER = 8, 1 << 20, 8, 256
#: What rounding may take from a box before it counts as distant.
SLACK = 1e-9


def _matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column of equal lengths."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1 in double precision, scaled by powers of two first, so that no square overflows or vanishes."""
    x = x.astype(np.float64)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0))[1][:, None])
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def usable(vectors: DataFrame, num_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec, label, v) of rows that can link: id and label not null, all components finite, not all zero. Vectors of floats stay such."""
    v = F.col("v")
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    out = vectors.select(F.col(num_col).alias("vec"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").cast(kind).alias("v"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0.0)
    return out.where(F.col("vec").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & fine)


def principal_axes(heads: DataFrame, axes: int = AXES) -> dict[int, np.ndarray]:
    """For each dimension that occurs, the leading axes of all unit vectors; MLlib adds up products on the executors and brings one matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = _unit(_matrix(batch.column(0)))
            flat = pa.array(np.hstack((u, np.ones((len(u), 1)))).ravel())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, u.shape[1] + 1), pa.int32()), flat)], names=["u"])

    out = {}
    for d in sorted(r["d"] for r in heads.select(F.size("v").alias("d")).distinct().collect()):
        m = gramian(heads.where(F.size("v") == d).select("v").mapInArrow(run, "u array<double>"), F.col("u"))
        mean = m[:d, d] / m[d, d]
        _, vectors = np.linalg.eigh(m[:d, :d] / m[d, d] - np.outer(mean, mean))
        out[d] = np.zeros((d, axes))
        out[d][:, : min(d, axes)] = vectors[:, ::-1][:, :axes]
    return out


def _placed(heads: DataFrame, axes: dict[int, np.ndarray], eps: float) -> DataFrame:
    """heads with their grid cells c0, c1, ..."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(batch.schema.get_field_index("v"))
            sizes = np.diff(v.offsets.to_numpy())
            cells = np.zeros((batch.num_rows, AXES), np.int32)
            for d in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == d)
                cells[rows] = np.floor(_unit(_matrix(v.take(pa.array(rows)))) @ axes[d] / eps)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(cells[:, k]) for k in range(AXES))], names=[*batch.schema.names, *(f"c{k}" for k in range(AXES))])

    schema = T.StructType(list(heads.schema.fields))
    for k in range(AXES):
        schema = schema.add(f"c{k}", "integer")
    return heads.mapInArrow(run, schema)


def _blocks(placed: DataFrame, axes: dict[int, np.ndarray]) -> DataFrame:
    """(label, d, part, n, low, high, ids, counts, vectors): runs of the sorted sequence and their boxes."""
    cells = [f"c{k}" for k in range(AXES)]
    ordered = placed.withColumn("d", F.size("v"))
    ordered = ordered.repartitionByRange(shuffle_width(placed.sparkSession), "label", "d", *cells, "vec").sortWithinPartitions("label", "d", *cells, "vec").select("label", "d", "vec", "n_same", "v")
    label_type = placed.schema["label"].dataType.simpleString()
    names = ["label", "d", "part", "n", "low", "high", "ids", "counts", "vectors"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        held: list[tuple] = []  # of one label: ids, counts, vectors
        last, size = None, 0

        def block() -> pa.RecordBatch:
            nonlocal n, size
            ids, counts, x = (np.concatenate(c) for c in zip(*held, strict=True))
            p = _unit(x) @ axes[last[1]]
            row = [[last[0]], [last[1]], [part], [n], [p.min(axis=0).tolist()], [p.max(axis=0).tolist()], [ids.tobytes()], [counts.tobytes()], [x.tobytes()]]
            kinds = [label_kind, pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary(), pa.binary(), pa.binary()]
            n, size = n + 1, 0
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, kinds, strict=True)], names=names)

        for batch in batches:
            label_kind = batch.schema.field(0).type
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            ids, counts = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            at = 0
            while at < len(keys):
                end = at + 1
                most = max(1, BLOCK // (max(1, keys[at][1]) * 4))
                if held and keys[at] != last:
                    yield block()
                last = keys[at]
                while end < len(keys) and keys[end] == last and size + end - at < most:
                    end += 1
                held.append((ids[at:end], counts[at:end], _matrix(batch.column(4).slice(at, end - at))))
                size += end - at
                at = end
                if size >= most:
                    yield block()
        if held:
            yield block()

    return ordered.mapInArrow(run, f"label {label_type}, d int, part int, n int, low array<double>, high array<double>, ids binary, counts binary, vectors binary")


def _near(eps: float):
    """Whether the boxes of sides p and q are within eps on the leading axes."""
    gaps = F.zip_with(F.zip_with("q.low", "p.high", lambda x, y: x - y), F.zip_with("p.low", "q.high", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    return F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x * x) <= (eps + SLACK) ** 2


def _interval_pairs(blocks: DataFrame, eps: float) -> DataFrame:
    """(label, d, i, j), i <= j: pairs of blocks of one label that may hold links.

    The recursion of the sequence join, level by level: it begins with the whole
    sequence of each label paired with itself, and pairs the FAN children of what
    is left.
    """
    ends = blocks.agg(F.max("n").alias("n"), F.max("part").alias("part")).collect()[0]
    wide = 1
    while wide <= (ends["n"] or 0):
        wide *= FAN
    depth = 0
    while FAN**depth < wide * ((ends["part"] or 0) + 1):
        depth += 1
    base = blocks.select("label", "d", (F.col("part").cast("long") * wide + F.col("n")).alias("i"), "low", "high")

    def level(k: int) -> DataFrame:
        at = F.expr(f"i div {FAN**k}")
        if k == 0:
            out = base
        else:
            sides = [F.min(F.col("low")[x]).alias(f"l{x}") for x in range(AXES)] + [F.max(F.col("high")[x]).alias(f"h{x}") for x in range(AXES)]
            boxes = base.groupBy("label", "d", at.alias("i")).agg(*sides)
            out = boxes.select("label", "d", "i", F.array(*[f"l{x}" for x in range(AXES)]).alias("low"), F.array(*[f"h{x}" for x in range(AXES)]).alias("high"))
        return out.withColumn("up", F.expr(f"i div {FAN}"))

    pairs = base.select("label", "d").distinct().select("label", "d", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"))
    for k in range(depth - 1, -1, -1):
        own = level(k)
        keys = lambda s, c: [F.col(f"pairs.{x}") == F.col(f"{s}.{x}") for x in ("label", "d")] + [F.col(f"pairs.{c}") == F.col(f"{s}.up")]
        joined = pairs.alias("pairs").join(own.alias("p"), keys("p", "i")).join(own.alias("q"), keys("q", "j")).where((F.col("p.i") <= F.col("q.i")) & _near(eps))
        pairs = joined.select("p.label", "p.d", F.col("p.i").alias("i"), F.col("q.i").alias("j"))
    return pairs.select("label", "d", F.expr(f"cast(i div {wide} as int)").alias("pa"), F.expr(f"cast(i % {wide} as int)").alias("na"), F.expr(f"cast(j div {wide} as int)").alias("pb"), F.expr(f"cast(j % {wide} as int)").alias("nb"))


def linked(ids: list[np.ndarray], counts: list[np.ndarray], units: list[np.ndarray], boxed: list[np.ndarray], own: bool, least: float, eps: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, links, to) of the vectors of two blocks that link: how many vectors of the other block, and the smallest id that links within the two lead to.

    boxed: the vectors on the leading axes; own: the blocks are one. Intervals of
    INNER vectors are multiplied where their boxes are near.
    """
    cuts = [np.arange(0, len(x), INNER) for x in units]
    low, high = ([f.reduceat(p, c, axis=0) for p, c in zip(boxed, cuts, strict=True)] for f in (np.minimum, np.maximum))
    base = [0, 0 if own else len(ids[0])]
    every = ids[0] if own else np.concatenate(ids)
    links = np.zeros(len(every), np.int64)
    sides: list[tuple[np.ndarray, np.ndarray]] = []
    for a, i in enumerate(cuts[0].tolist()):
        gaps = np.maximum(0.0, np.maximum(low[1] - high[0][a], low[0][a] - high[1]))
        for b in np.flatnonzero((gaps * gaps).sum(axis=1) <= (eps + SLACK) ** 2).tolist():
            j = int(cuts[1][b])
            if own and j < i:
                continue
            hit = units[0][i : i + INNER] @ units[1][j : j + INNER].T >= least
            if own and i == j:
                np.fill_diagonal(hit, False)
            if not hit.any():
                continue
            p, q = np.nonzero(hit)
            x, y = p + base[0] + i, q + base[1] + j
            np.add.at(links, x, counts[1][q + j])
            if not (own and i == j):
                np.add.at(links, y, counts[0][p + i])
            # of all links of the two intervals a forest of at most as many as there are vectors goes on
            sides.append(forest(x, y, every))
    if not sides:
        return
    x, y = (np.concatenate(c) for c in zip(*sides, strict=True))
    label = settled(x, y, every)
    seen = np.flatnonzero(links)
    yield every[seen], links[seen], label[seen]


def settled(x: np.ndarray, y: np.ndarray, label: np.ndarray) -> np.ndarray:
    """For each vertex the smallest label that edges between x and y lead to."""
    label = label.copy()
    while True:
        before = label.copy()
        np.minimum.at(label, x, label[y])
        np.minimum.at(label, y, label[x])
        if (before == label).all():
            return label


def forest(x: np.ndarray, y: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each vertex of x and y to the one with the smallest label of its component."""
    inside, place = np.unique(np.concatenate((x, y)), return_inverse=True)
    own = settled(place[: len(x)], place[len(x) :], label[inside])
    order = np.argsort(label[inside], kind="stable")
    root = inside[order[np.searchsorted(label[inside][order], own)]]
    return inside[inside != root], root[inside != root]


def _multiplied(pairs: DataFrame, blocks: DataFrame, axes: dict[int, np.ndarray], least: float, eps: float, kind: str) -> DataFrame:
    """(vec, links, to) from the pairs of blocks; edges grow with vectors, not with links."""
    data = lambda s: blocks.select("label", "d", F.col("part").alias(f"p{s}"), F.col("n").alias(f"n{s}"), *[F.col(c).alias(f"{c}_{s}") for c in ("ids", "counts", "vectors")])
    full = pairs.join(data("a"), ["label", "d", "pa", "na"]).join(data("b"), ["label", "d", "pb", "nb"]).select("d", "ids_a", "counts_a", "vectors_a", "ids_b", "counts_b", "vectors_b", ((F.col("pa") == F.col("pb")) & (F.col("na") == F.col("nb"))).alias("own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                d, ids_a, counts_a, va, ids_b, counts_b, vb, own = (c[i].as_py() for c in batch.columns)
                ids, counts = [np.frombuffer(x, "<i8") for x in (ids_a, ids_b)], [np.frombuffer(x, "<i8") for x in (counts_a, counts_b)]
                units = [_unit(np.frombuffer(x, kind).reshape(-1, d)) for x in (va, vb)]
                for found in linked(ids, counts, units, [u @ axes[d] for u in units], own, least, eps):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["vec", "links", "to"])

    return full.mapInArrow(run, "vec long, links long, to long")


def epsilon_join(vectors: DataFrame, least: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) for every row of vectors.

    Rows link if their labels are equal and the cosine of their vectors, in
    double precision, is at least `least`. Rows with a null id, label or vector,
    a null or non-finite component, or a zero vector link with nothing, as do
    vectors of different lengths. Rows with one id are one vertex, whose links
    are those of all its rows, these among each other included. Ids are of any
    type that can be sorted. Other columns are not read; an empty table gives no
    rows.
    """
    eps = float(np.sqrt(max(0.0, 2 - 2 * least)))
    rows, names = numbered(vectors.select(*dict.fromkeys((id_col, vector_col, label_col))), id_col, "__vec")
    good = usable(rows, "__vec", vector_col, label_col)
    kind = "<f4" if good.schema["v"].dataType.simpleString() == "array<float>" else "<f8"
    heads = written(good.groupBy("label", "v").agg(F.min("vec").alias("vec"), F.count("*").alias("n_same")))
    axes = principal_axes(heads)
    blocks = written(_blocks(_placed(heads, axes, eps), axes))
    with arrow_rows(vectors.sparkSession, 8):
        found = written(_multiplied(_interval_pairs(blocks, eps), blocks, axes, least, eps, kind))
    forget(blocks)
    counts = written(found.groupBy("vec").agg(F.sum("links").alias("links")))
    several = heads.where("n_same > 1").select("label", "v", F.col("vec").alias("head"), "n_same", F.col("n_same").alias("n"))
    copies = met(good, several, ["label", "v"], ["vec"]).select("vec", "head", "n_same").unionByName(heads.where("n_same = 1").select("vec", F.col("vec").alias("head"), "n_same"))
    # a head's links go to each of its copies: a vector that very many rows hold is no hot key, as its row is one of counts
    links = counts.join(several.select(F.col("head").alias("vec"), "n"), "vec", "left").select(F.col("vec").alias("head"), "links", F.coalesce("n", F.lit(1)).alias("n"))
    linking = met(copies, links, ["head"], ["vec"]).select("vec", "links")
    member = copies.select("vec", (F.col("n_same") - 1).alias("links")).unionByName(linking).groupBy("vec").agg(F.sum("links").alias("n_links"))
    edges = found.select(F.col("vec").alias("a"), F.col("to").alias("b")).unionByName(copies.where("vec != head").select(F.col("vec").alias("a"), F.col("head").alias("b")))
    parts = connected_components(edges)
    out = rows.select(F.col("__vec").alias("id")).join(member.withColumnRenamed("vec", "id"), "id", "left").join(parts, "id", "left")
    out = out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    return renamed(out, [id_col, "component_id"], names).withColumn("kept", F.col(f"`{id_col}`") == F.col("component_id"))


def op4_epsilon_join(spark, sf_dir):
    return epsilon_join(table(spark, sf_dir, "embeddings"))
