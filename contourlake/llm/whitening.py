"""Whitening of embeddings: MLlib's RowMatrix over exactly centred rows gives the covariance, its eigenvectors whiten.

Components are whole numbers, so sums are exact, and n times a row minus the
sums is the row centred without rounding. The Gramian matrix of the centred
rows divided by n is decomposed on the driver, where it is as large as the
dimension squared, and the whitening matrix is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WHOLE, table, written

#: Components that are given at most; an eigenvalue below this share of the largest one is zero.
COMPONENTS, ZERO = 32, 1e-13


def gramian(rows: DataFrame, column: Column) -> np.ndarray:
    """The sum of the outer products of a column of double arrays, by MLlib."""
    vectors = rows.select(array_to_vector(column).alias("v"))
    return RowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "v")).computeGramianMatrix().toArray()


def axes(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) by falling eigenvalue, `most` at most; the largest entry of each vector is positive."""
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    top = np.abs(vectors).argmax(axis=0)
    return np.maximum(values, 0.0), vectors * np.sign(vectors[top, np.arange(vectors.shape[1])])


def deviations(centred: np.ndarray) -> list[int | None]:
    """Exact sums of squares of rows of longs; None beyond a long."""
    if centred.size == 0 or int(np.abs(centred).max()) ** 2 * centred.shape[1] < 1 << 63:
        return (centred * centred).sum(axis=1).tolist()
    sums = [sum(x * x for x in row) for row in centred.tolist()]
    return [s if s < 1 << 63 else None for s in sums]


def _fitted(good: DataFrame, d: int, n: int, sums: list[int], most: int) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of the rows (id, x) of length d."""
    spark = good.sparkSession
    exact = lambda x, s: x * F.lit(n) - s
    totals = F.array(*[F.lit(s).cast("long") for s in sums])
    centred = F.zip_with("x", totals, lambda x, s: exact(x, s).cast("double") / F.lit(float(n)))
    covariance = gramian(good, centred) / n
    values, vectors = axes(covariance, min(most, d))
    real = int((values > values[0] * ZERO).sum()) if values[0] > 0 else 0
    shared = spark.sparkContext.broadcast((np.array(sums, np.int64), vectors[:, :real] / np.sqrt(values[:real])))
    kind = good.schema["id"].dataType

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s, w = shared.value
        for pdf in frames:
            if len(pdf):
                exact_ = np.stack(pdf["x"].to_list()).astype(np.int64) * n - s
                yield pd.DataFrame({"id": pdf["id"], "known": pdf["known"], "deviation": pd.array(deviations(exact_), dtype="Int64"), "w": list(exact_ / n @ w)})

    # pandas holds whole numbers with nulls as doubles, so null ids travel as zeros
    safe = F.coalesce("id", F.lit(0).cast(kind)) if kind.simpleString() in WHOLE else F.col("id")
    schema = T.StructType().add("id", kind).add("known", "boolean").add("deviation", "long").add("w", T.ArrayType(T.DoubleType()))
    white = written(good.select(safe.alias("id"), F.col("id").isNotNull().alias("known"), "x").mapInPandas(run, schema))
    error = 0.0
    if real:
        means = {r["pos"]: r["mean"] for r in white.select(F.posexplode("w")).groupBy("pos").agg(F.avg("col").alias("mean")).collect()}
        own = F.zip_with("w", F.array(*[F.lit(means[k]) for k in range(real)]), lambda x, m: x - m)
        error = float(np.abs(gramian(white, own) / n - np.eye(real)).max())
    trace = float(np.trace(covariance))
    share = F.array(*[F.lit(float(e / trace) if trace > 0 else None).cast("double") for e in values])
    rows = white.select(F.when(F.col("known"), F.col("id")).alias("id"), "deviation", "w", F.explode(F.sequence(F.lit(1), F.lit(len(values)))).alias("component"))
    return rows.select("id", "component", F.lit(n).cast("long").alias("n"), "deviation", F.get("w", F.col("component") - 1).alias("whitened"), F.get(share, F.col("component") - 1).alias("explained"), F.lit(error).alias("identity_error"))


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = 64, shift: int = 1_000_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for each row and component.

    Vectors that are null or hold null or non-finite entries are left out. An
    entry c becomes the whole number floor(scale * c) + shift, in double
    precision. All other rows are fitted, repeated rows and rows without an id
    too. Vectors of one length are fitted together, each length apart; empty
    vectors have no components. A component without variance has a null
    `whitened` and is left out of the identity error; where no entry varies
    `explained` is null. A deviation beyond a long is null. Other columns are not
    read; an empty table gives no rows.
    """
    v = F.col(f"`{vector_col}`").cast("array<double>")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    good = written(vectors.where(fine).select(F.col(f"`{id_col}`").alias("id"), F.transform(v, lambda c: F.floor(c * scale) + shift).alias("x")))
    # a row for each dimension of each length
    sums: dict[int, dict[int, tuple[int, int]]] = {}
    for r in good.select(F.size("x").alias("d"), F.posexplode("x")).groupBy("d", "pos").agg(F.sum("col").alias("s"), F.count("*").alias("n")).collect():
        sums.setdefault(r["d"], {})[r["pos"]] = (r["s"], r["n"])
    out = [_fitted(good.where(F.size("x") == d), d, s[0][1], [s[k][0] for k in range(d)], components) for d, s in sorted(sums.items())]
    whole = out[0] if out else vectors.sparkSession.createDataFrame([], T.StructType().add("id", vectors.schema[id_col].dataType).add("component", "integer").add("n", "long").add("deviation", "long").add("whitened", "double").add("explained", "double").add("identity_error", "double"))
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole.withColumnRenamed("id", id_col)


def op13_whitening(spark, sf_dir):
    return whiten(table(spark, sf_dir, "embeddings"))
