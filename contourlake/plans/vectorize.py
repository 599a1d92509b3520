"""The whole way from pixels to ordered layers, metrics and documents; all images and labels run at once."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.color import layer_params, luminance
from ..functions.geometry import POINTS, douglas_peucker_points
from ..functions.numbers import round_to
from ..functions.settings import BatchOptions
from ..operators import kmeans, layers, masks, pixels
from ..sources.stages import staged


def _finished(points: list[tuple[float, float]], tolerance: float, smoothing: float, corner: float) -> list[tuple[float, float]]:
    """A ring simplified by distance, then smoothed once."""
    from .export import _angle

    if len(points) < 4:
        return points
    kept = douglas_peucker_points([*points, points[0]], max(0.4, tolerance))[:-1]
    if len(kept) < 4 or smoothing <= 0:
        return kept
    out = [kept[0]]
    for a, b, c in zip(kept, kept[1:], kept[2:], strict=False):
        sharp = _angle(a, b, c) < corner
        out.append(b if sharp else tuple(q * (1 - smoothing) + (p + r) * 0.5 * smoothing for p, q, r in zip(a, b, c, strict=True)))
    return [*out, kept[-1]]


def _area(points: list[tuple[float, float]]) -> float:
    return abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(points, [*points[1:], *points[:1]], strict=True))) / 2


def _simplified(paths: DataFrame, corner: float) -> DataFrame:
    """paths (keys, pos, points, params) with finished points, their exact area, and points rounded to two decimals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points, areas = [], []
            for own, params in zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                done = _finished([(p["x"], p["y"]) for p in own], params["tolerance"], params["smoothing"], corner)
                areas.append(_area(done))
                points.append([{"x": round_to(x, 2), "y": round_to(y, 2)} for x, y in done])
            kind = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], batch.column(batch.num_columns - 1), pa.array(points, kind), pa.array(areas, pa.float64())], names=[*batch.schema.names[:-2], "params", "points", "area"])

    kept = [c for c in paths.columns if c not in ("points", "params")]
    schema = ", ".join(f"`{c}` {paths.schema[c].dataType.simpleString()}" for c in [*kept, "params"])
    return paths.select(*kept, "points", "params").mapInArrow(run, f"{schema}, points {POINTS}, area double")


def vectorize(images: DataFrame, options: BatchOptions | None = None) -> DataFrame:
    """(image_id, width, height, layers, path_count, node_count) of pixels (image_id, width, height, x, y, r, g, b, a).

    What several later steps read is written once: labels, palettes, masks and finished paths.
    """
    o = options or BatchOptions()
    labelled = staged(kmeans.quantize(images, o.palette_size))
    palette = staged(pixels.keep_covered(kmeans.palette(labelled)).withColumn("params", layer_params(F.col("hex"), o.speckle_threshold, o.simplify_tolerance, o.smoothing)))
    small = palette.select("image_id", "label", F.col("params.speckle").cast("int").alias("speckle"))
    mask = labelled.select("image_id", "label", "x", "y", "width", "height").join(small, ["image_id", "label"])
    sized = masks.components(mask)
    from pyspark.sql.window import Window

    mask = staged(sized.withColumn("size", F.count("*").over(Window.partitionBy("image_id", "label", "component"))).where("size >= speckle").select("image_id", "label", "x", "y", "width", "height"))
    dry = staged(pixels.drop_flooded(palette, pixels.background_flood(mask)))
    outlines = masks.trace_edges(mask.join(dry.select("image_id", "label"), ["image_id", "label"], "left_semi"))
    points = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    paths = outlines.groupBy("image_id", "label", "path").agg(points.alias("points")).withColumnRenamed("path", "pos").join(dry.select("image_id", "label", "params"), ["image_id", "label"])
    fine = staged(_simplified(paths, o.corner_threshold).where((F.size("points") >= 3) & (F.col("area") >= F.col("params.min_area"))).drop("params"))
    # a layer's paths by area; candidates without paths have gone
    ranked = layers.rank_paths(fine, ["image_id", "label"]).drop("pos").withColumnRenamed("rank", "pos")
    candidates = dry.join(fine.select("image_id", "label").distinct(), ["image_id", "label"], "left_semi").withColumn("pos", F.col("label"))
    chosen = layers.select_layers(candidates, o.min_layer_coverage, o.min_layer_count, o.max_layer_count).drop("rank")
    dark = luminance(F.col("hex")) < 55
    kept = layers.cap_paths(ranked.join(chosen.select("image_id", "label", "hex", "coverage"), ["image_id", "label"]), o.max_paths_per_layer, dark, ["image_id", "label"], "batch")
    path = F.struct("rank", "points")
    none = F.array().cast(f"array<{POINTS}>")
    rows = kept.groupBy("image_id", "label").agg(F.max("hex").alias("color"), F.max("coverage").alias("coverage"), F.max("area").alias("largest"), F.array_sort(F.collect_list(path)).alias("paths")).withColumn("pos", F.col("label"))
    placed = layers.order_layers(rows)
    layer = F.struct("place", layers.layer_name(F.col("label") + 1).alias("name"), "color", F.transform("paths", lambda p: F.struct(p["points"].alias("points"), none.alias("holes"), F.lit(True).alias("closed"))).alias("paths"))
    grouped = placed.groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(layer)), lambda x: F.struct(x["name"].alias("name"), x["color"].alias("color"), x["paths"].alias("paths"))).alias("layers"))
    sizes = images.groupBy("image_id").agg(F.max("width").alias("width"), F.max("height").alias("height"))
    out = sizes.join(grouped, "image_id", "left")
    count = F.coalesce(F.aggregate("layers", F.lit(0), lambda s, x: s + F.size(x["paths"])), F.lit(0)).cast("long")
    nodes = F.coalesce(F.aggregate("layers", F.lit(0), lambda s, x: s + F.aggregate(x["paths"], F.lit(0), lambda t, p: t + F.size(p["points"]))), F.lit(0)).cast("long")
    return out.select("image_id", "width", "height", "layers", count.alias("path_count"), nodes.alias("node_count"))


def vectorize_binary(images: DataFrame, speckle: int = 4, cutoff: int = 128) -> DataFrame:
    """(image_id, label, path, pos, x, y): outlines of the dark parts, without small ones."""
    return masks.trace_edges(masks.drop_speckles(pixels.binary_mask(images, cutoff), speckle))


def trace(images: DataFrame, mode: str = "color", options: BatchOptions | None = None) -> DataFrame:
    """The entry of a conversion by its clustering mode."""
    if mode == "binary":
        return vectorize_binary(images)
    if mode != "color":
        raise ValueError(f"mode {mode}")
    keyed = pixels.key_pixels(images, pixels.needs_keying(images), pixels.unused_color(images))
    return vectorize(keyed, options)
