"""Graph operators on tables: connected components and the ranks of linked lists, in rounds of joins that are each written once.

`key` is what separates graphs, as a struct, so that null parts equal each
other; vertices are numbers within it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stages import staged

#: Rounds after which either algorithm must have ended: they need about the logarithm of the longest path.
ROUNDS = 64


def components(edges: DataFrame) -> DataFrame:
    """(key, id, component) of the ends of edges (key, a, b): component is the smallest vertex that edges lead to.

    Alternating stars: each vertex hands its larger neighbours, then its smaller
    ones, to the smallest. Minima are combined before the shuffle, so the centre
    of a large star is one row; its edges meet it in a join that Spark may split.
    """
    own = lambda a, b: F.struct(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    now = staged(edges.where("a != b").select("key", own("a", "b").alias("e")).distinct().select("key", "e.*"))
    for _ in range(ROUNDS):
        # a is settled where it has one edge and nothing points to it
        tops = now.groupBy("key", F.col("a").alias("v")).agg(F.count("*").alias("n")).withColumn("below", F.lit(0))
        feet = now.select("key", F.col("b").alias("v")).distinct().select("key", "v", F.lit(0).cast("long").alias("n"), F.lit(1).alias("below"))
        if tops.unionByName(feet).groupBy("key", "v").agg(F.sum("n").alias("n"), F.sum("below").alias("below")).where("n > 1 or n = 1 and below > 0").isEmpty():
            break
        both = now.unionByName(now.select("key", F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("key", "a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = staged(both.join(least, ["key", "a"]).where("b > a").select("key", F.col("b").alias("a"), F.col("m").alias("b")))
        least = large.groupBy("key", "a").agg(F.min("b").alias("m"))
        small = large.join(least, ["key", "a"]).select("key", F.col("a").alias("c"), "b", "m")
        now = staged(small.where("b != m").select("key", F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("key", F.col("c").alias("a"), F.col("m").alias("b"))).distinct())
    else:
        raise RuntimeError("components did not settle")
    ends = now.select("key", F.col("a").alias("id"), F.col("b").alias("component"))
    return ends.unionByName(now.select("key", F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def ranked(links: DataFrame) -> DataFrame:
    """(key, id, head, before, closed) of links (key, id, next, n): lists and rings of elements that are n long.

    Pointer doubling: each element knows the smallest element of a stretch before
    it, and how far back that is; stretches double from round to round. head is a
    list's first element, or a ring's smallest (`closed`); before is the length
    of what stands between the head and the element.
    """
    back = links.where("next is not null").select("key", F.col("next").alias("id"), F.col("id").alias("ptr"), F.col("n").alias("gap"))
    # the head of a list is smaller than all elements
    now = links.select("key", "id").join(back, ["key", "id"], "left").select("key", "id", "ptr", F.coalesce("gap", F.lit(0)).cast("long").alias("gap"), F.when(F.col("ptr").isNull(), -F.col("id") - 1).otherwise(F.col("id")).alias("low"), F.lit(0).cast("long").alias("far"), F.lit(True).alias("moved"))
    now = staged(now)
    for _ in range(ROUNDS):
        if now.where("moved").isEmpty():
            break
        before = now.select("key", F.col("id").alias("ptr"), F.col("ptr").alias("p"), F.col("gap").alias("g"), F.col("low").alias("l"), F.col("far").alias("f"))
        met = now.join(before, ["key", "ptr"], "left")
        less = F.col("l") < F.col("low")
        now = staged(met.select("key", "id", F.col("p").alias("ptr"), (F.col("gap") + F.coalesce("g", F.lit(0))).alias("gap"), F.when(less, F.col("l")).otherwise(F.col("low")).alias("low"), F.when(less, F.col("gap") + F.col("f")).otherwise(F.col("far")).alias("far"), F.coalesce(less, F.lit(False)).alias("moved")))
    else:
        raise RuntimeError("lists did not end")
    return now.select("key", "id", F.when(F.col("low") < 0, -F.col("low") - 1).otherwise(F.col("low")).alias("head"), F.col("far").alias("before"), (F.col("low") >= 0).alias("closed"))
