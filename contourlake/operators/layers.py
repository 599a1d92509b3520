"""Selection and order of paths and layers, and metrics of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LAYER = ["layer"]
#: Detail that dark layers keep: so many small paths, and their areas (fixed values).
RESERVE, SMALL = 2, (8, 320)


def rank_paths(paths: DataFrame, keys: list[str] = LAYER) -> DataFrame:
    """paths with `rank` from 1 by area, largest first, ties by pos."""
    return paths.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("area").desc(), "pos")))


def cap_paths(paths: DataFrame, cap: int, dark: Column | bool = False, keys: list[str] = LAYER, mode: str = "library") -> DataFrame:
    """paths (keys, pos, area) of layers cut to `cap`, with `rank` from 1, their new order.

    Layers within the cap keep their order. Others keep the largest; dark ones
    reserve places for the smallest of middling area, and fill up by area. Batch
    mode always reserves 2 and gives dark layers a cap of 8 at least.
    """
    is_dark = dark if isinstance(dark, Column) else F.lit(dark)
    if mode == "batch":
        limit = F.when(is_dark, F.greatest(F.lit(cap), F.lit(8))).otherwise(F.lit(cap))
        reserve = F.lit(RESERVE)
    else:
        limit = F.lit(cap)
        reserve = F.lit(min(RESERVE, max(0, cap - 1)))
    head = F.when(is_dark, F.greatest(F.lit(1), limit - reserve)).otherwise(limit)
    by = Window.partitionBy(*keys)
    ranked = paths.withColumn("rn", F.row_number().over(by.orderBy(F.col("area").desc(), "pos"))).withColumn("n", F.count("*").over(by)).withColumn("head", head).withColumn("cap", limit)
    fits = is_dark & (F.col("rn") > F.col("head")) & F.col("area").between(*SMALL)
    small = ranked.withColumn("fits", fits).withColumn("drn", F.when(F.col("fits"), F.row_number().over(Window.partitionBy(*keys, "fits").orderBy("area", "rn"))))
    tier = F.when(F.col("n") <= F.col("cap"), 0).when(F.col("rn") <= F.col("head"), 1).when(F.col("drn") <= reserve, 2).otherwise(3)
    order = F.when(F.col("tier") == 0, F.col("pos")).when(F.col("tier") == 2, F.col("drn")).otherwise(F.col("rn"))
    placed = small.withColumn("tier", tier).withColumn("rank", F.row_number().over(by.orderBy("tier", order, "rn")))
    return placed.where((F.col("tier") == 0) | (F.col("rank") <= F.col("cap"))).select(*paths.columns, "rank")


def select_layers(layers: DataFrame, min_coverage: float, min_count: int, max_count: int, keys: list[str] = ["image_id"]) -> DataFrame:  # noqa: B006
    """layers with enough coverage, filled up to min_count by coverage, cut at max_count, with `rank` by coverage."""
    by = Window.partitionBy(*keys)
    fine = F.col("coverage") >= min_coverage
    ranked = layers.withColumn("rn", F.row_number().over(by.orderBy(fine.desc(), F.col("coverage").desc(), "pos"))).withColumn("fine", F.sum(fine.cast("int")).over(by))
    kept = ranked.where(F.col("rn") <= F.greatest(F.col("fine"), F.lit(min_count)))
    return kept.withColumn("rank", F.row_number().over(by.orderBy(F.col("coverage").desc(), "pos"))).where(F.col("rank") <= max_count).select(*layers.columns, "rank")


def layer_area(paths: DataFrame, keys: list[str] = LAYER) -> DataFrame:
    """(keys, area): the sum over a layer's paths; holes play no part."""
    return paths.groupBy(*keys).agg(F.sum("area").alias("area"))


def primary_area(paths: DataFrame, keys: list[str] = LAYER) -> DataFrame:
    """(keys, largest): the largest area of a layer's paths, 0 for none."""
    return paths.groupBy(*keys).agg(F.coalesce(F.max("area"), F.lit(0)).alias("largest"))


def order_layers(layers: DataFrame, keys: list[str] = ["image_id"]) -> DataFrame:  # noqa: B006
    """layers with `place` from 1 by their largest path, ties by coverage and pos."""
    return layers.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("largest").desc(), F.col("coverage").desc(), "pos")))


def number_layers(paths: DataFrame, keys: list[str] = ["image_id"]) -> DataFrame:  # noqa: B006
    """paths with `layer_no` from 1: colours in the order in which they first occur."""
    first = paths.withColumn("first", F.min("pos").over(Window.partitionBy(*keys, "color")))
    return first.withColumn("layer_no", F.dense_rank().over(Window.partitionBy(*keys).orderBy("first"))).drop("first")


def layer_name(number: Column) -> Column:
    return F.format_string("COLOR_%02d", number)


def group_layers(paths: DataFrame, keys: list[str] = ["image_id"]) -> DataFrame:  # noqa: B006
    """(keys, layers): paths (pos, color, points, holes) in layers by colour, both in the order of pos."""
    inner = number_layers(paths, keys).groupBy(*keys, "layer_no", "color").agg(F.array_sort(F.collect_list(F.struct("pos", "points", "holes"))).alias("paths"))
    layer = F.struct(F.col("layer_no"), layer_name(F.col("layer_no")).alias("name"), "color", F.transform("paths", lambda p: F.struct(p["points"].alias("points"), p["holes"].alias("holes"), F.lit(True).alias("closed"))).alias("paths"))
    return inner.groupBy(*keys).agg(F.array_sort(F.collect_list(layer)).alias("layers"))


def drawable(paths: Column) -> Column:
    """Paths with exact data, 3 points or more, or a hole of 3 or more."""
    return F.filter(paths, lambda p: (F.length(F.coalesce(p["svg_path_data"], F.lit(""))) > 0) | (F.size(p["points"]) >= 3) | F.exists(F.coalesce(p["holes"], F.array().cast("array<array<struct<x:double,y:double>>>")), lambda h: F.size(h) >= 3))


def metrics(paths: DataFrame, keys: list[str] = ["image_id"]) -> DataFrame:  # noqa: B006
    """(keys, path_count, node_count): a path has its own node count where positive, else its points and those of its holes."""
    holes = F.aggregate(F.coalesce(F.col("holes"), F.array().cast("array<array<struct<x:double,y:double>>>")), F.lit(0), lambda s, h: s + F.size(h))
    nodes = F.when(F.col("node_count") > 0, F.col("node_count")).otherwise(F.size("points") + holes)
    return paths.groupBy(*keys).agg(F.count("*").alias("path_count"), F.sum(nodes).cast("long").alias("node_count"))


def join_text(pieces: DataFrame, keys: list[str] = ["image_id"], separator: str = "\n") -> DataFrame:  # noqa: B006
    """(keys, text): pieces (pos, text) in order."""
    return pieces.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda p: p["text"]), separator).alias("text"))
