"""Deterministic k-means of images to a palette, all images at once.

The opaque pixels of an image become rows of BLOCK colours in row order, the
only aggregate over pixels. An image of one block is clustered where the block
is. Larger ones go round by round: each seed is one pass over the blocks, whose
totals give the block that the draw falls into, and each iteration is an
aggregate over distinct colours with weights. Sums are of whole numbers, so
both ways give the same palette bit for bit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import Lcg, lcg_next
from ..sources.stages import staged

#: Iterations, the least alpha of a pixel, and the factors of the seed (fixed values).
ITERATIONS, MIN_ALPHA = 10, 8
SEED_FACTORS = (73856093, 19349663, 83492791)
#: Pixels of a block, and bits of a channel in a packed colour.
BLOCK, BITS = 1 << 16, 20


def seed_state(width: int, height: int, k: int) -> int:
    a, b, c = (v * f & 0xFFFFFFFF for v, f in zip((width, height, k), SEED_FACTORS, strict=True))
    return a ^ b ^ c


def seeds(rgb: np.ndarray, k: int, draw: Lcg) -> np.ndarray:
    """k-means++ seeds from pixels in row order: one draw each, also where all pixels coincide with seeds."""
    n = len(rgb)
    found = [rgb[int(draw() * n)]]
    gap = ((rgb - found[0]) ** 2).sum(axis=1)
    for _ in range(1, k):
        total = float(gap.sum())
        if total <= 0:
            found.append(rgb[int(draw() * n)])
            continue
        sums = np.cumsum(gap)
        at = int(np.searchsorted(sums, draw() * total))
        # a pixel without distance can only be met at a target of 0
        found.append(rgb[at if at < n else 0])
        gap = np.minimum(gap, ((rgb - found[-1]) ** 2).sum(axis=1))
    return np.array(found, float)


def cluster(rgb: np.ndarray, k: int, draw: Lcg, iterations: int = ITERATIONS) -> tuple[np.ndarray, np.ndarray]:
    """(labels, centroids); labels belong to the centroids before the last update."""
    label, _, centers = clustered(rgb, k, draw, iterations)
    return label, centers


def clustered(rgb: np.ndarray, k: int, draw: Lcg, iterations: int = ITERATIONS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(labels, the centroids that they belong to, centroids after one more update)."""
    colors, weight = np.unique(rgb, axis=0, return_counts=True)
    which = np.unique(rgb, axis=0, return_inverse=True)[1].ravel()
    centers = used = seeds(rgb, k, draw)
    label = np.zeros(len(colors), int)
    for _ in range(iterations):
        used = centers
        label = ((colors[:, None, :] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
        n = np.bincount(label, weight, minlength=k)
        sums = np.stack([np.bincount(label, weight * colors[:, c], minlength=k) for c in range(3)], axis=1)
        centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centers)
    return label[which], used, centers


def _channels(packed: np.ndarray) -> np.ndarray:
    return np.stack([packed >> 2 * BITS, (packed >> BITS) & ((1 << BITS) - 1), packed & ((1 << BITS) - 1)], axis=1)


def _blocks(pixels: DataFrame) -> DataFrame:
    """(image_id, width, height, block, colors): the opaque pixels of BLOCK places, packed, in row order."""
    place = F.col("y").cast("long") * F.col("width") + F.col("x")
    packed = F.shiftleft(F.col("r").cast("long"), 2 * BITS) + F.shiftleft(F.col("g").cast("long"), BITS) + F.col("b")
    at = pixels.where(F.col("a") >= MIN_ALPHA).select("image_id", "width", "height", place.alias("place"), packed.alias("color"))
    own = at.groupBy("image_id", F.floor(F.col("place") / BLOCK).alias("block")).agg(F.max("width").alias("width"), F.max("height").alias("height"), F.array_sort(F.collect_list(F.struct("place", "color"))).alias("p"))
    return own.select("image_id", "width", "height", "block", F.transform("p", lambda v: v["color"]).alias("colors"))


CENTERS = "array<struct<r:double,g:double,b:double>>"
_CENTER = pa.list_(pa.struct([(c, pa.float64()) for c in "rgb"]))


def _single(blocks: DataFrame, k: int) -> DataFrame:
    """(image_id, used, centers) of images of one block: the centroids that labels belong to, and those of the palette."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for width, height, colors in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                rgb, draw = _channels(colors.values.to_numpy()), Lcg(seed_state(width, height, k))
                found.append(clustered(rgb, k, draw)[1:])
            columns = [pa.array([[dict(zip("rgb", c, strict=True)) for c in centers.tolist()] for centers in own], _CENTER) for own in zip(*found, strict=True)] if found else [pa.array([], _CENTER)] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["image_id", "used", "centers"])

    kind = blocks.schema["image_id"].dataType.simpleString()
    return blocks.select("image_id", "width", "height", "colors").mapInArrow(run, f"image_id {kind}, used {CENTERS}, centers {CENTERS}")


def _gaps(colors: np.ndarray, seeds_: list[dict]) -> np.ndarray:
    """The squared distance of each pixel to the nearest seed; 1 without seeds."""
    if not seeds_:
        return np.ones(len(colors), np.int64)
    own, which = np.unique(colors, return_inverse=True)
    rgb = _channels(own)
    return np.min([((rgb - np.array([int(s[c]) for c in "rgb"])) ** 2).sum(axis=1) for s in seeds_], axis=0)[which]


def _seeded(blocks: DataFrame, k: int) -> DataFrame:
    """(image_id, centers): the seeds of images of any size, one pass over their blocks for each."""
    kind = blocks.schema["image_id"].dataType.simpleString()
    mask = F.lit(0xFFFFFFFF)
    begin = [(v.cast("long") * F.lit(f)).bitwiseAND(mask) for v, f in zip((F.max("width"), F.max("height"), F.lit(k)), SEED_FACTORS, strict=True)]
    state = blocks.groupBy("image_id").agg(begin[0].bitwiseXOR(begin[1]).bitwiseXOR(begin[2]).alias("s")).withColumn("centers", F.array().cast(CENTERS))

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [(len(c.values), int(_gaps(c.values.to_numpy(), s).sum())) for c, s in zip(batch.column(2), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], batch.column(4), *(pa.array(c, pa.int64()) for c in zip(*sums, strict=True))], names=["image_id", "block", "s", "n", "total"])

    def picks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for colors, centers, base, target, even in zip(batch.column(1), *(c.to_pylist() for c in batch.columns[2:]), strict=True):
                own = colors.values.to_numpy()
                at = int(np.searchsorted(base + np.cumsum(_gaps(own, [] if even else centers)), target))
                out.append(int(own[at]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], names=["image_id", "color"])

    for turn in range(k):
        state = staged(state.withColumn("s", lcg_next(F.col("s"))))
        each = blocks.join(state, "image_id").select("image_id", "block", "colors", "centers", "s").mapInArrow(totals, f"image_id {kind}, block long, s long, n long, total long")
        image = Window.partitionBy("image_id")
        draw = F.col("s").cast("double") / F.lit(float(1 << 32))
        # where all pixels coincide with seeds, and at first, pixels are drawn evenly
        even = each.withColumn("whole", F.sum("total").over(image)).withColumn("count", F.sum("n").over(image)).withColumn("even", (F.col("whole") <= 0) | F.lit(turn == 0))
        share = F.when(F.col("even"), F.col("n")).otherwise(F.col("total"))
        target = F.when(F.col("even"), F.floor(draw * F.col("count")).cast("double") + 1.0).otherwise(draw * F.col("whole"))
        cut = even.withColumn("share", share).withColumn("target", target).withColumn("upto", F.sum("share").over(image.orderBy("block").rowsBetween(Window.unboundedPreceding, 0)))
        place = F.struct("block", (F.col("upto") - F.col("share")).alias("base"), "target", "even")
        # a draw that falls behind all pixels takes the first one
        first = F.struct("block", F.lit(0).cast("long").alias("base"), F.lit(0.0).alias("target"), F.lit(True).alias("even"))
        hit = cut.groupBy("image_id").agg(F.coalesce(F.min(F.when(F.col("upto") >= F.col("target"), place)), F.min(first)).alias("h")).select("image_id", "h.*")
        chosen = blocks.join(hit, ["image_id", "block"]).join(state, "image_id").select("image_id", "colors", "centers", "base", "target", "even").mapInArrow(picks, f"image_id {kind}, color long")
        channel = lambda shift: F.shiftright("color", shift).bitwiseAND(F.lit((1 << BITS) - 1)).cast("double")
        seed = F.struct(channel(2 * BITS).alias("r"), channel(BITS).alias("g"), channel(0).alias("b"))
        state = staged(state.join(chosen, "image_id").select("image_id", "s", F.concat("centers", F.array(seed)).alias("centers")))
    return state.select("image_id", "centers")


def _nearest(centers: str, r: Column, g: Column, b: Column) -> Column:
    """The index of the nearest centroid, the lowest of equally near ones."""
    square = lambda v: v * v
    return F.array_min(F.transform(centers, lambda c, i: F.struct((square(r - c["r"]) + square(g - c["g"]) + square(b - c["b"])).alias("d"), i.alias("i"))))["i"]


def _rounds(blocks: DataFrame, k: int, iterations: int = ITERATIONS) -> DataFrame:
    """The same as _single() of images of any size: a pass over distinct colours for each iteration."""
    kind = blocks.schema["image_id"].dataType.simpleString()

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, colors in enumerate(batch.column(1)):
                own, n = np.unique(colors.values.to_numpy(), return_counts=True)
                rgb = _channels(own)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(own), i))), *(pa.array(np.ascontiguousarray(rgb[:, c])) for c in range(3)), pa.array(n)], names=["image_id", "r", "g", "b", "w"])

    colors = blocks.select("image_id", "colors").mapInArrow(weights, f"image_id {kind}, r long, g long, b long, w long")
    colors = staged(colors.groupBy("image_id", "r", "g", "b").agg(F.sum("w").alias("w")))
    state = _seeded(blocks, k).withColumn("used", F.col("centers"))
    for _ in range(iterations):
        near = colors.join(state, "image_id").select("image_id", "r", "g", "b", "w", _nearest("centers", F.col("r"), F.col("g"), F.col("b")).alias("i"))
        sums = near.groupBy("image_id", "i").agg(F.sum("w").alias("n"), *[F.sum(F.col(c) * F.col("w")).alias(c) for c in "rgb"])
        moved = sums.groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("i", F.struct(*[(F.col(c) / F.col("n")).alias(c) for c in "rgb"])))).alias("moved"))
        state = staged(state.join(moved, "image_id").select("image_id", F.col("centers").alias("used"), F.transform("centers", lambda c, i: F.coalesce(F.try_element_at("moved", i), c)).alias("centers")))
    return state.select("image_id", "used", "centers")


def _named(found: DataFrame, by_luminance: bool) -> DataFrame:
    """(image_id, used, labels, names): the label of each centroid, and the colours of labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, names = [], []
            for centers in batch.column(2).to_pylist():
                whole = np.floor(np.array([[c[v] for v in "rgb"] for c in centers]) + 0.5).astype(int)
                order = np.argsort(whole @ np.array([0.299, 0.587, 0.114]), kind="stable") if by_luminance else np.arange(len(whole))
                place = np.empty(len(whole), int)
                place[order] = np.arange(len(whole))
                labels.append(place.tolist())
                names.append([f"#{r:02x}{g:02x}{b:02x}" for r, g, b in whole[order]])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(labels, pa.list_(pa.int32())), pa.array(names, pa.list_(pa.string()))], names=["image_id", "used", "labels", "names"])

    kind = found.schema["image_id"].dataType.simpleString()
    return found.select("image_id", "used", "centers").mapInArrow(run, f"image_id {kind}, used {CENTERS}, labels array<int>, names array<string>")


def quantize(pixels: DataFrame, k: int, by_luminance: bool = False) -> DataFrame:
    """pixels with `label` and `hex`, the rounded colour of the label's centroid.

    pixels: image_id, width, height, x, y, r, g, b, a. Transparent pixels get
    label 0, or null with by_luminance, which also numbers labels by luminance,
    ties by number. Images without opaque pixels have label 0, black.
    """
    blocks = staged(_blocks(pixels))
    size = F.col("width").cast("long") * F.col("height")
    large = blocks.where(size > BLOCK)
    found = _single(blocks.where(size <= BLOCK), k)
    if not large.isEmpty():
        found = found.unionByName(_rounds(large, k))
    palettes = staged(_named(found, by_luminance)).select(F.col("image_id").alias("__image"), "used", "labels", "names")
    both = pixels.join(palettes, F.col("image_id").eqNullSafe(F.col("__image")), "left")
    own = F.get("labels", _nearest("used", F.col("r"), F.col("g"), F.col("b")))
    label = F.when(F.col("a") >= MIN_ALPHA, own)
    if not by_luminance:
        label = F.coalesce(label, F.lit(0))
    named = both.select(*[F.col(f"`{c}`") for c in pixels.columns], label.cast("int").alias("label"), "names")
    return named.select(*[F.col(f"`{c}`") for c in pixels.columns], "label", F.when(F.col("label").isNotNull(), F.coalesce(F.get("names", F.col("label")), F.lit("#000000"))).alias("hex"))


def palette(quantized: DataFrame) -> DataFrame:
    """(image_id, label, hex, n, width, height, coverage) of the labels that pixels have."""
    counts = quantized.where("label is not null").groupBy("image_id", "label").agg(F.max("hex").alias("hex"), F.count("*").alias("n"), F.max("width").alias("width"), F.max("height").alias("height"))
    return counts.withColumn("coverage", F.col("n") / (F.col("width") * F.col("height")))
