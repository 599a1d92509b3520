"""Operators on tables of pixels, labels, palettes and masks.

pixel: image_id, width, height, x, y, r, g, b, a (a row may be absent where a
pixel is transparent). label: image_id, width, height, x, y, label. mask: the
same; a row is a set bit, and all labels of all images are one table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.color import DARK, luminance, packed

IMAGE = ("image_id",)
MASK = ("image_id", "label")


def opaque(pixels: DataFrame, min_alpha: int = 8) -> DataFrame:
    return pixels.where(F.col("a") >= min_alpha)


def binary_mask(pixels: DataFrame, cutoff: int = 128) -> DataFrame:
    """Pixels darker than the cutoff in red, as a mask of label 0; alpha plays no part."""
    return pixels.where(F.col("r") < cutoff).select("image_id", F.lit(0).alias("label"), "x", "y", "width", "height")


def nearest(centroids: list[tuple[float, float, float]]) -> Column:
    """The index of the nearest centroid to (r, g, b), the lowest of equally near ones; no row is multiplied."""
    d = [F.struct(((F.col("r") - c[0]) ** 2 + (F.col("g") - c[1]) ** 2 + (F.col("b") - c[2]) ** 2).alias("d"), F.lit(k).alias("c")) for k, c in enumerate(centroids)]
    return F.array_min(F.array(*d))["c"]


def assign(pixels: DataFrame, centroids: DataFrame, keys: tuple[str, ...] = IMAGE) -> DataFrame:
    """pixels with `label`, the nearest centroid of their image.

    centroids: keys, label, r, g, b. They are gathered to one array an image (a
    palette has 16 colours at most), so a pixel stays one row.
    """
    palettes = centroids.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("label", "r", "g", "b"))).alias("palette"))
    gap = lambda c, n: (F.col(n) - c[n]) * (F.col(n) - c[n])
    near = F.array_min(F.transform("palette", lambda c: F.struct((gap(c, "r") + gap(c, "g") + gap(c, "b")).alias("d"), c["label"].alias("label"))))
    return pixels.join(palettes, list(keys)).withColumn("label", near["label"]).drop("palette")


def update(labelled: DataFrame, centroids: DataFrame, keys: tuple[str, ...] = IMAGE) -> DataFrame:
    """Centroids moved to the mean of their pixels; one without pixels stays. Sums are integers, so order does not matter."""
    weight = F.col("weight") if "weight" in labelled.columns else F.lit(1)
    sums = labelled.groupBy(*keys, "label").agg(*[F.sum(F.col(c) * weight).alias(f"s{c}") for c in "rgb"], F.sum(weight).alias("n"))
    moved = centroids.join(sums, [*keys, "label"], "left")
    return moved.select(*keys, "label", *[F.coalesce(F.col(f"s{c}") / F.col("n"), F.col(c).cast("double")).alias(c) for c in "rgb"])


def label_counts(labels: DataFrame, palette: DataFrame | None = None, transparent_as_zero: bool = False) -> DataFrame:
    """(image_id, label, n); labels of the palette that no pixel has count 0; null labels count as 0 or not at all."""
    own = labels.withColumn("label", F.coalesce("label", F.lit(0))) if transparent_as_zero else labels.where("label is not null")
    counts = own.groupBy("image_id", "label").agg(F.count("*").alias("n"))
    if palette is None:
        return counts
    return palette.select("image_id", "label").join(counts, ["image_id", "label"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def with_coverage(counts: DataFrame, sizes: DataFrame) -> DataFrame:
    """counts with `coverage`, their share of the image; sizes: image_id, width, height."""
    return counts.join(sizes, "image_id").withColumn("coverage", F.col("n") / (F.col("width") * F.col("height")))


def keep_covered(palette: DataFrame) -> DataFrame:
    """Labels with enough coverage: 0.0001 for colours lighter than 170 or darker than 40, else 0.002."""
    lum = luminance(F.col("hex"))
    return palette.where(F.col("coverage") >= F.when((lum > 170) | (lum < 40), 0.0001).otherwise(0.002))


def background_flood(mask: DataFrame, keys: tuple[str, ...] = MASK) -> DataFrame:
    """(keys, n, flood): whether a mask covers over a quarter of its image and touches all four sides."""
    size = F.max(F.col("width") * F.col("height"))
    sides = [F.col("y") == 0, F.col("y") == F.col("height") - 1, F.col("x") == 0, F.col("x") == F.col("width") - 1]
    touch = F.bool_or(sides[0]) & F.bool_or(sides[1]) & F.bool_or(sides[2]) & F.bool_or(sides[3])
    return mask.groupBy(*keys).agg(F.count("*").alias("n"), ((F.count("*") / size > 0.25) & touch).alias("flood"))


def drop_flooded(palette: DataFrame, flood: DataFrame, max_lum: float = 220) -> DataFrame:
    """palette (image_id, label, hex) without flooded labels that are darker than max_lum."""
    return palette.join(flood.select("image_id", "label", "flood"), ["image_id", "label"], "left").where(~(F.coalesce("flood", F.lit(False)) & (luminance(F.col("hex")) < max_lum))).drop("flood")


def sort_palette(palette: DataFrame) -> DataFrame:
    """palette with `rank` from 0 by luminance, ties by label."""
    from pyspark.sql.window import Window

    return palette.withColumn("rank", F.row_number().over(Window.partitionBy("image_id").orderBy(luminance(F.col("hex")), "label")) - 1)


def relabel(labels: DataFrame, ranked: DataFrame) -> DataFrame:
    """labels numbered by the rank of their colour."""
    return labels.join(ranked.select("image_id", "label", "rank"), ["image_id", "label"]).withColumn("label", F.col("rank")).drop("rank")


def distinct_opaque(pixels: DataFrame) -> DataFrame:
    """(image_id, color): packed colours of fully opaque pixels."""
    return pixels.where("a = 255").select("image_id", packed(F.col("r"), F.col("g"), F.col("b")).alias("color")).distinct()


#: Colours that are tried first as the key, in order (fixed values).
KEY_COLORS = ((255, 0, 0), (0, 255, 0), (0, 0, 255), (255, 255, 0), (0, 255, 255), (255, 0, 255), (128, 128, 128))


def unused_color(pixels: DataFrame) -> DataFrame:
    """(image_id, color): the first key colour that no opaque pixel has; then the least unused packed colour; then red.

    The least unused colour is found from the sorted gaps of used ones, which an
    image has at most 2^24 of, and only where all key colours are used.
    """
    from pyspark.sql.window import Window

    used = distinct_opaque(pixels)
    images = pixels.select("image_id").distinct()
    pairs = images.select("image_id", F.explode(F.array(*[F.struct(F.lit(i).alias("pos"), F.lit((r << 16) | (g << 8) | b).alias("color")) for i, (r, g, b) in enumerate(KEY_COLORS)])).alias("t")).select("image_id", "t.*")
    free = pairs.join(used, ["image_id", "color"], "left_anti").groupBy("image_id").agg(F.min_by("color", "pos").alias("color"))
    rest = used.join(free, "image_id", "left_anti")
    at = F.row_number().over(Window.partitionBy("image_id").orderBy("color")) - 1
    gap = rest.withColumn("at", at).groupBy("image_id").agg(F.coalesce(F.min(F.when(F.col("color") != F.col("at"), F.col("at"))), F.count("*")).alias("color"))
    gap = gap.select("image_id", F.when(F.col("color") > 0xFFFFFF, F.lit(0xFF0000)).otherwise(F.col("color")).cast("int").alias("color"))
    return free.unionByName(gap)


def needs_keying(pixels: DataFrame) -> DataFrame:
    """(image_id, keyed): whether enough pixels of five sample rows are fully transparent.

    Sample rows that coincide count as often as they do. pixels must hold
    transparent pixels as rows. The threshold is a product of 32-bit floats.
    """
    h = F.col("height")
    rows = [F.lit(0), F.floor(h / 4), F.floor(h / 2), F.floor(3 * h / 4), h - 1]
    times = sum((F.when(F.col("y") == y, 1).otherwise(0) for y in rows), F.lit(0))
    threshold = ((2 * F.max("width")).cast("float") * F.lit(0.2).cast("float")).cast("int")
    return pixels.groupBy("image_id").agg((F.coalesce(F.sum(F.when(F.col("a") == 0, times)), F.lit(0)) >= threshold).alias("keyed"))


def key_pixels(pixels: DataFrame, keyed: DataFrame, colors: DataFrame) -> DataFrame:
    """pixels with fully transparent ones painted in the key colour, in images that need it."""
    both = pixels.join(keyed.where("keyed").join(colors, "image_id"), "image_id", "left")
    paint = F.coalesce("keyed", F.lit(False)) & (F.col("a") == 0)
    own = {c: F.when(paint, F.shiftright("color", s).bitwiseAND(F.lit(255))).otherwise(F.col(c)).alias(c) for c, s in (("r", 16), ("g", 8), ("b", 0))}
    return both.select(*[own.get(c) if c in own else F.when(paint, F.lit(255)).otherwise(F.col("a")).alias("a") if c == "a" else F.col(c) for c in pixels.columns])


def resize_bilinear(pixels: DataFrame, max_dim: int) -> DataFrame:
    """Images no larger than max_dim on their longer side; smaller ones stay. pixels must be dense.

    Each target pixel is the weighted mean of four neighbours, found by an
    equi-join on their places; the channels are interpolated one by one. The
    join is a merge: the targets look as small as the table of sizes that they
    are exploded from, so Spark would broadcast them through the driver.
    """
    sizes = pixels.select("image_id", "width", "height").distinct()
    scale = F.least(F.lit(1.0), F.lit(float(max_dim)) / F.greatest("width", "height"))
    sizes = sizes.withColumn("tw", F.greatest(F.lit(1), F.floor(F.col("width") * scale + 0.5)).cast("int")).withColumn("th", F.greatest(F.lit(1), F.floor(F.col("height") * scale + 0.5)).cast("int"))
    grid = sizes.select("*", F.explode(F.sequence(F.lit(0), F.col("tw") - 1)).alias("tx")).select("*", F.explode(F.sequence(F.lit(0), F.col("th") - 1)).alias("ty"))
    sx = F.greatest(F.lit(0.0), F.least(F.col("width") - 1.0, (F.col("tx") + 0.5) * F.col("width") / F.col("tw") - 0.5))
    sy = F.greatest(F.lit(0.0), F.least(F.col("height") - 1.0, (F.col("ty") + 0.5) * F.col("height") / F.col("th") - 0.5))
    at = grid.withColumn("sx", sx).withColumn("sy", sy).withColumn("x0", F.floor("sx").cast("int")).withColumn("y0", F.floor("sy").cast("int"))
    at = at.withColumn("fx", F.col("sx") - F.col("x0")).withColumn("fy", F.col("sy") - F.col("y0"))
    corner = lambda k, dx, dy: F.struct(F.lit(k).alias("k"), F.least(F.col("x0") + dx, F.col("width") - 1).alias("x"), F.least(F.col("y0") + dy, F.col("height") - 1).alias("y"))
    keys = ["image_id", "tw", "th", "tx", "ty"]
    taps = at.select(*keys, "fx", "fy", F.explode(F.array(corner(0, 0, 0), corner(1, 1, 0), corner(2, 0, 1), corner(3, 1, 1))).alias("t")).select(*keys, "fx", "fy", "t.*")
    met = taps.hint("merge").join(pixels.select("image_id", "x", "y", "r", "g", "b", "a"), ["image_id", "x", "y"])
    four = met.groupBy(*keys, "fx", "fy").agg(*[F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{c}{k}") for c in "rgba" for k in range(4)])

    def blend(c: str) -> Column:
        p, q, r, s = (F.col(f"{c}{k}") for k in range(4))
        top, bottom = p + (q - p) * F.col("fx"), r + (s - r) * F.col("fx")
        return F.floor(top + (bottom - top) * F.col("fy") + 0.5).cast("int").alias(c)

    return four.select("image_id", F.col("tw").alias("width"), F.col("th").alias("height"), F.col("tx").alias("x"), F.col("ty").alias("y"), *map(blend, "rgba"))


def is_dark(hex_: Column) -> Column:
    return luminance(hex_) < DARK
