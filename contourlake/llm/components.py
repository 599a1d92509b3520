"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, met, written

#: Rounds after which the star algorithm must have ended; it needs about the logarithm of the longest path.
ROUNDS = 60


def _settled(edges: DataFrame) -> bool:
    """Whether each vertex has edges of one kind only: one to its smallest, or those of the others to it."""
    ends = edges.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("a"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("a").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for each end of an edge; component is the smallest id reachable.

    edges: columns a and b, comparable ids; loops and repeated edges do no harm,
    rows with a null end are left out. Each round is written to the shared
    folder, so that lost executors cost one round at most. No round gathers the
    neighbours of a vertex: a star's centre only needs their minimum, and hot
    centres are dealt over several tasks.
    """
    now = written(edges.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if now.isEmpty():
        return now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    for _ in range(ROUNDS):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("a", "m")))
        large = written(met(both, least, ["a"], ["b"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b"))
        low = written(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
        small = met(large, low, ["a"], ["b"]).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        last, now = now, written(small)
        forget(last, least, large, low)
        if _settled(now):
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
