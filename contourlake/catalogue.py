"""The engine's registered queries, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import color, geometry, numbers, settings
from .operators import layers, masks, paths, pixels
from .plans import derived, export, vectorize
from .plans.derived import AREA, DENSE, LEDGER, LEDGER_WIDTH, MASK, PATH, RASTER, RING
from .registered import QUERIES, SQL
from .registered import register as _register
from .streaming import queue


def queries() -> dict[str, Callable]:
    from . import catalogue_documents, catalogue_points  # noqa: F401  they enter their queries when imported

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)


#: A fixed palette for queries that need one.
PALETTE = [(0, 0, 0), (255, 0, 0), (48, 120, 60), (200, 220, 240)]
_HEX = ["#000000", "#ff0000", "#30783c", "#c8dcf0"]
_COLORS = "k AS (SELECT * FROM (VALUES (0, 0, 0, 0, '#000000'), (1, 255, 0, 0, '#ff0000'), (2, 48, 120, 60, '#30783c'), (3, 200, 220, 240, '#c8dcf0')) t(label, cr, cg, cb, hex))"
_ASSIGNED = f"""{RASTER}, {_COLORS}, o AS (SELECT r.*, (SELECT arg_min(k.label, ((r.r - cr) * (r.r - cr) + (r.g - cg) * (r.g - cg) + (r.b - cb) * (r.b - cb)) * 10 + k.label) FROM k) AS label FROM r WHERE a >= 8)"""


def _palette(spark, images: DataFrame) -> DataFrame:
    rows = [(k, *c, h) for k, (c, h) in enumerate(zip(PALETTE, _HEX, strict=True))]
    colors = F.array(*[F.struct(F.lit(k).alias("label"), F.lit(r).alias("r"), F.lit(g).alias("g"), F.lit(b).alias("b"), F.lit(h).alias("hex")) for k, r, g, b, h in rows])
    return images.select("image_id").distinct().select("image_id", F.explode(colors).alias("c")).select("image_id", "c.*")


def _labelled(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    r = derived.raster(spark, sf_dir)
    colors = _palette(spark, r)
    return pixels.assign(pixels.opaque(r), colors.drop("hex")), colors


@_register(f"WITH {RASTER} SELECT image_id, x, y, r, g, b FROM r WHERE a >= 8")
def opaque_pixels(spark, sf_dir):
    return pixels.opaque(derived.raster(spark, sf_dir)).select("image_id", "x", "y", "r", "g", "b")


@_register(f"WITH {_ASSIGNED} SELECT image_id, x, y, label FROM o")
def palette_assign(spark, sf_dir):
    return _labelled(spark, sf_dir)[0].select("image_id", "x", "y", "label")


@_register(f"WITH {_ASSIGNED} SELECT i.image_id, k.label, coalesce(CAST(sum(o.r) AS DOUBLE) / count(o.r), any_value(cr)) AS r, coalesce(CAST(sum(o.g) AS DOUBLE) / count(o.r), any_value(cg)) AS g, coalesce(CAST(sum(o.b) AS DOUBLE) / count(o.r), any_value(cb)) AS b FROM (SELECT DISTINCT image_id FROM r) i CROSS JOIN k LEFT JOIN o ON o.image_id = i.image_id AND o.label = k.label GROUP BY i.image_id, k.label")
def centroid_update(spark, sf_dir):
    own, colors = _labelled(spark, sf_dir)
    return pixels.update(own, colors.drop("hex"))


@_register(f"WITH {_ASSIGNED} SELECT i.image_id, k.label, CAST(count(o.r) AS BIGINT) AS n FROM (SELECT DISTINCT image_id FROM r) i CROSS JOIN k LEFT JOIN o ON o.image_id = i.image_id AND o.label = k.label GROUP BY i.image_id, k.label")
def label_counts(spark, sf_dir):
    own, colors = _labelled(spark, sf_dir)
    return pixels.label_counts(own, colors)


@_register(f"WITH {_ASSIGNED} SELECT o.image_id, o.label, k.hex, CAST(count(*) AS BIGINT) AS n, count(*) / 744.0::DOUBLE AS coverage, count(*) / 744.0::DOUBLE > 0.25 AND bool_or(y = 0) AND bool_or(y = 23) AND bool_or(x = 0) AND bool_or(x = 30) AS flood FROM o JOIN k ON k.label = o.label GROUP BY o.image_id, o.label, k.hex")
def label_coverage(spark, sf_dir):
    """The flagship: raster, nearest colour, counts, coverage and flood flag."""
    own, colors = _labelled(spark, sf_dir)
    flood = pixels.background_flood(own)
    return flood.join(colors.select("image_id", "label", "hex"), ["image_id", "label"]).select("image_id", "label", "hex", "n", (F.col("n") / (derived.WIDTH * derived.HEIGHT)).alias("coverage"), "flood")


@_register(f"WITH {MASK} SELECT image_id, label, CAST(count(*) AS BIGINT) AS n, count(*) / 744.0 > 0.25 AND bool_or(y = 0) AND bool_or(y = 23) AND bool_or(x = 0) AND bool_or(x = 30) AS flood FROM m GROUP BY image_id, label")
def background_flood(spark, sf_dir):
    return pixels.background_flood(derived.mask(spark, sf_dir))


@_register(f"WITH {_ASSIGNED}, c AS (SELECT o.image_id, o.label, k.hex, cr * 0.299 + cg * 0.587 + cb * 0.114 AS lum, count(*) / 744.0 AS coverage FROM o JOIN k ON k.label = o.label GROUP BY ALL) SELECT image_id, label, hex FROM c WHERE coverage >= CASE WHEN lum > 170 OR lum < 40 THEN 0.0001 ELSE 0.002 END")
def covered_labels(spark, sf_dir):
    own, colors = _labelled(spark, sf_dir)
    sizes = own.groupBy("image_id").agg(F.max("width").alias("width"), F.max("height").alias("height"))
    counts = pixels.with_coverage(pixels.label_counts(own), sizes).join(colors.select("image_id", "label", "hex"), ["image_id", "label"])
    return pixels.keep_covered(counts).select("image_id", "label", "hex")


@_register(f"WITH {RASTER}, {_COLORS} SELECT i.image_id, label, hex, CAST(row_number() OVER (PARTITION BY i.image_id ORDER BY cr * 0.299 + cg * 0.587 + cb * 0.114, label) - 1 AS INTEGER) AS rank FROM (SELECT DISTINCT image_id FROM r) i, k")
def luminance_sort(spark, sf_dir):
    return pixels.sort_palette(_palette(spark, derived.raster(spark, sf_dir))).select("image_id", "label", "hex", "rank")


@_register(f"WITH {_ASSIGNED}, z AS (SELECT label, row_number() OVER (ORDER BY cr * 0.299 + cg * 0.587 + cb * 0.114, label) - 1 AS rank FROM k) SELECT image_id, x, y, CAST(z.rank AS INTEGER) AS label FROM o JOIN z ON z.label = o.label")
def relabelled(spark, sf_dir):
    own, colors = _labelled(spark, sf_dir)
    return pixels.relabel(own, pixels.sort_palette(colors)).select("image_id", "x", "y", "label")


@_register("SELECT DISTINCT l_partkey % 300 AS r, l_suppkey % 256 AS g, l_linenumber * 40 AS b, '#' || lower(lpad(hex(least(255, l_partkey % 300)), 2, '0')) || lower(lpad(hex(l_suppkey % 256), 2, '0')) || lower(lpad(hex(least(255, l_linenumber * 40)), 2, '0')) AS hex FROM lineitem")
def hex_encode(spark, sf_dir):
    c = derived.table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 300).alias("r"), (F.col("l_suppkey") % 256).alias("g"), (F.col("l_linenumber") * 40).alias("b")).distinct()
    return c.withColumn("hex", color.rgb_to_hex(F.col("r"), F.col("g"), F.col("b")))


_PARTHEX = "h AS (SELECT p_partkey, '#' || lower(lpad(hex(p_partkey % 256), 2, '0')) || lower(lpad(hex(p_size * 5 % 256), 2, '0')) || lower(lpad(hex(p_partkey * 7 % 256), 2, '0')) AS hex, p_partkey % 256 AS r, p_size * 5 % 256 AS g, p_partkey * 7 % 256 AS b FROM part)"


def _part_hex(spark, sf_dir):
    p = derived.table(spark, sf_dir, "part")
    return p.select("p_partkey", color.rgb_to_hex(F.col("p_partkey") % 256, F.col("p_size") * 5 % 256, F.col("p_partkey") * 7 % 256).alias("hex"))


@_register(f"WITH {_PARTHEX} SELECT p_partkey, hex, r, g, b, CAST(r * 65536 + g * 256 + b AS BIGINT) AS packed FROM h")
def hex_decode(spark, sf_dir):
    c = color.hex_to_rgb(F.col("hex"))
    return _part_hex(spark, sf_dir).withColumn("c", c).select("p_partkey", "hex", "c.r", "c.g", "c.b", color.packed(F.col("c.r"), F.col("c.g"), F.col("c.b")).cast("long").alias("packed"))


@_register(f"WITH {_PARTHEX} SELECT p_partkey, CASE WHEN r * 0.299::DOUBLE + g * 0.587::DOUBLE + b * 0.114::DOUBLE < 30 THEN '#000000' ELSE hex END AS hex FROM h")
def near_black(spark, sf_dir):
    return _part_hex(spark, sf_dir).select("p_partkey", color.near_black(F.col("hex")).alias("hex"))


@_register(f"WITH {_PARTHEX}, l AS (SELECT *, r * 0.299::DOUBLE + g * 0.587::DOUBLE + b * 0.114::DOUBLE AS lum FROM h) SELECT p_partkey, CASE WHEN lum < 55 OR lum > 240 THEN 1 ELSE 10 END AS speckle, CASE WHEN lum < 55 THEN 1.8 WHEN lum > 240 THEN 2.025 ELSE 4.5 END::DOUBLE AS tolerance, CASE WHEN lum < 55 OR lum > 240 THEN 1 ELSE 8 END AS min_area FROM l")
def layer_parameters(spark, sf_dir):
    p = color.layer_params(F.col("hex"), 10, 4.5, 0.35)
    return _part_hex(spark, sf_dir).withColumn("p", p).select("p_partkey", "p.speckle", "p.tolerance", "p.min_area")


@_register("SELECT c_custkey, CASE WHEN c_custkey * 100 < 12000 THEN 4 WHEN c_custkey * 100 < 90000 THEN 8 ELSE 10 END AS auto, CAST(least(16, greatest(2, floor(c_acctbal / 300))) AS INTEGER) AS requested FROM customer")
def palette_sizes(spark, sf_dir):
    return derived.table(spark, sf_dir, "customer").select("c_custkey", color.auto_palette_size(F.col("c_custkey") * 100).alias("auto"), color.requested_palette_size(F.col("c_acctbal") / 300).alias("requested"))


_CANDIDATES = "k AS (SELECT * FROM (VALUES (0, 16711680), (1, 65280), (2, 255), (3, 16776960), (4, 65535), (5, 16711935), (6, 8421504)) t(pos, color))"


@_register(f"WITH {RASTER}, {_CANDIDATES} SELECT i.image_id, CAST(arg_min(k.color, k.pos) AS INTEGER) AS color FROM (SELECT DISTINCT image_id FROM r) i, k WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.image_id = i.image_id AND r.a = 255 AND r.r * 65536 + r.g * 256 + r.b = k.color) GROUP BY i.image_id")
def unused_color(spark, sf_dir):
    return pixels.unused_color(derived.raster(spark, sf_dir))


@_register(f"WITH {DENSE} SELECT image_id, coalesce(sum(CASE WHEN a = 0 THEN (y = 0)::INT + (y = 6)::INT + (y = 12)::INT + (y = 18)::INT + (y = 23)::INT END), 0) >= 12 AS keyed FROM d GROUP BY image_id")
def transparency_keying(spark, sf_dir):
    return pixels.needs_keying(derived.dense(spark, sf_dir))


@_register(f"WITH {DENSE}, {_CANDIDATES}, c AS (SELECT i.image_id, arg_min(k.color, k.pos) AS color FROM (SELECT DISTINCT image_id FROM d) i, k WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.image_id = i.image_id AND d.a = 255 AND d.r * 65536 + d.g * 256 + d.b = k.color) GROUP BY i.image_id), t AS (SELECT image_id, coalesce(sum(CASE WHEN a = 0 THEN (y = 0)::INT + (y = 6)::INT + (y = 12)::INT + (y = 18)::INT + (y = 23)::INT END), 0) >= 12 AS keyed FROM d GROUP BY image_id) SELECT d.image_id, d.x, d.y, CASE WHEN keyed AND a = 0 THEN color // 65536 ELSE r END AS r, CASE WHEN keyed AND a = 0 THEN color // 256 % 256 ELSE g END AS g, CASE WHEN keyed AND a = 0 THEN color % 256 ELSE b END AS b, CASE WHEN keyed AND a = 0 THEN 255 ELSE a END AS a FROM d JOIN c ON c.image_id = d.image_id JOIN t ON t.image_id = d.image_id")
def keyed_pixels(spark, sf_dir):
    d = derived.dense(spark, sf_dir)
    return pixels.key_pixels(d, pixels.needs_keying(d), pixels.unused_color(d)).select("image_id", "x", "y", "r", "g", "b", "a")


@_register(f"WITH {DENSE}, t AS (SELECT i.image_id, CAST(tx AS INTEGER) AS x, CAST(ty AS INTEGER) AS y, (tx + 0.5::DOUBLE) * 31 / 16 - 0.5::DOUBLE AS sx, (ty + 0.5::DOUBLE) * 24 / 12 - 0.5::DOUBLE AS sy FROM (SELECT DISTINCT image_id FROM d) i, (SELECT unnest(range(16)) AS tx), (SELECT unnest(range(12)) AS ty)), u AS (SELECT *, CAST(floor(sx) AS INTEGER) AS x0, CAST(floor(sy) AS INTEGER) AS y0 FROM t) SELECT u.image_id, u.x, u.y, "
    + ", ".join(f"CAST(floor((p.{c} + (q.{c} - p.{c}) * (sx - x0)) + ((v.{c} + (w.{c} - v.{c}) * (sx - x0)) - (p.{c} + (q.{c} - p.{c}) * (sx - x0))) * (sy - y0) + 0.5) AS INTEGER) AS {c}" for c in "rgba")
    + " FROM u JOIN d p ON p.image_id = u.image_id AND p.x = x0 AND p.y = y0 JOIN d q ON q.image_id = u.image_id AND q.x = least(x0 + 1, 30) AND q.y = y0 JOIN d v ON v.image_id = u.image_id AND v.x = x0 AND v.y = least(y0 + 1, 23) JOIN d w ON w.image_id = u.image_id AND w.x = least(x0 + 1, 30) AND w.y = least(y0 + 1, 23)")
def bilinear_resize(spark, sf_dir):
    return pixels.resize_bilinear(derived.dense(spark, sf_dir), 16).select("image_id", "x", "y", "r", "g", "b", "a")


@_register(f"WITH {RASTER} SELECT image_id, x, y FROM r WHERE r < 128")
def binary_threshold(spark, sf_dir):
    return pixels.binary_mask(derived.raster(spark, sf_dir)).select("image_id", "x", "y")


_STEPS = "(SELECT CAST(unnest(range(-1, 2)) AS INTEGER) AS dx), (SELECT CAST(unnest(range(-1, 2)) AS INTEGER) AS dy)"


def _dilated(name: str, source: str) -> str:
    return f"{name} AS (SELECT DISTINCT image_id, label, width, height, x + dx AS x, y + dy AS y FROM {source}, {_STEPS} WHERE x + dx BETWEEN 0 AND width - 1 AND y + dy BETWEEN 0 AND height - 1)"


def _eroded(name: str, source: str) -> str:
    return f"{name} AS (SELECT image_id, label, width, height, x + dx AS x, y + dy AS y FROM {source}, {_STEPS} GROUP BY image_id, label, width, height, x + dx, y + dy HAVING count(*) = 9)"


@_register(f"WITH {MASK}, {_dilated('t', 'm')} SELECT image_id, label, x, y FROM t")
def mask_dilate(spark, sf_dir):
    return masks.dilate(derived.mask(spark, sf_dir)).select("image_id", "label", "x", "y")


@_register(f"WITH {MASK}, {_eroded('t', 'm')} SELECT image_id, label, x, y FROM t")
def mask_erode(spark, sf_dir):
    return masks.erode(derived.mask(spark, sf_dir)).select("image_id", "label", "x", "y")


@_register(f"WITH {MASK}, {_dilated('s', 'm')}, {_eroded('t', 's')} SELECT image_id, label, x, y FROM t")
def mask_close(spark, sf_dir):
    return masks.close(derived.mask(spark, sf_dir)).select("image_id", "label", "x", "y")


@_register(f"WITH {MASK}, {_dilated('t1', 'm')}, {_eroded('t2', 't1')}, {_dilated('t3', 't2')}, {_eroded('t4', 't3')} SELECT image_id, label, x, y FROM t4")
def mask_close_feather(spark, sf_dir):
    return masks.close_feather(derived.mask(spark, sf_dir)).select("image_id", "label", "x", "y")


_COMPONENTS = MASK + ", c AS (SELECT image_id, label, x, y, width, height, CAST(y * 31 + x AS BIGINT) AS root FROM m UNION SELECT m.image_id, m.label, m.x, m.y, m.width, m.height, c.root FROM c JOIN m ON m.image_id = c.image_id AND m.label = c.label AND abs(m.x - c.x) + abs(m.y - c.y) = 1), z AS (SELECT image_id, label, x, y, width, height, min(root) AS component FROM c GROUP BY ALL), n AS (SELECT *, count(*) OVER (PARTITION BY image_id, label, component) AS size FROM z)"


@_register(f"WITH RECURSIVE {_COMPONENTS} SELECT image_id, label, component, CAST(count(*) AS BIGINT) AS size FROM z GROUP BY ALL")
def component_sizes(spark, sf_dir):
    return masks.component_sizes(derived.mask(spark, sf_dir))


@_register(f"WITH RECURSIVE {LEDGER}, d AS (SELECT * FROM (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) t(dx, dy)), c AS (SELECT x, y, CAST(y AS BIGINT) * {LEDGER_WIDTH} + x AS root FROM m UNION SELECT m.x, m.y, k.root FROM (SELECT x + dx AS x, y + dy AS y, root FROM c, d) k JOIN m ON m.x = k.x AND m.y = k.y), z AS (SELECT x, y, min(root) AS component FROM c GROUP BY ALL) SELECT component, CAST(count(*) AS BIGINT) AS size FROM z GROUP BY ALL")
def table_components(spark, sf_dir):
    """The connected parts of one mask over a whole table, over many tiles."""
    return masks.component_sizes(derived.ledger(spark, sf_dir)).select("component", "size")


@_register(f"WITH RECURSIVE {_COMPONENTS} SELECT image_id, label, x, y FROM n WHERE size >= 6")
def remove_small(spark, sf_dir):
    return masks.remove_small(derived.mask(spark, sf_dir), 6).select("image_id", "label", "x", "y")


@_register(f"WITH RECURSIVE {_COMPONENTS} SELECT image_id, label, x, y FROM n WHERE size >= 9")
def speckle_filter(spark, sf_dir):
    return masks.drop_speckles(derived.mask(spark, sf_dir), 3).select("image_id", "label", "x", "y")


@_register(f"WITH RECURSIVE {_COMPONENTS}, {_eroded('t', 'm')} SELECT image_id, label, x, y FROM t UNION SELECT image_id, label, x, y FROM n WHERE size <= 5")
def preserve_small(spark, sf_dir):
    return masks.erode_preserve(derived.mask(spark, sf_dir), 1, 5).select("image_id", "label", "x", "y")


_CELLS = MASK + ", w AS (SELECT * FROM (VALUES (0, 0, 2), (1, 0, 1), (0, 1, 4), (1, 1, 8)) t(dx, dy, bit)), s AS (SELECT image_id, label, x + dx AS x, y + dy AS y, CAST(sum(bit) AS INTEGER) AS state FROM m, w GROUP BY image_id, label, x + dx, y + dy)"
#: The same table of segments as the operator's, in doubled coordinates of the sides' middles.
_CASES = ", ".join(f"({state}, {masks.SIDES[p[0]][0]}, {masks.SIDES[p[0]][1]}, {masks.SIDES[p[1]][0]}, {masks.SIDES[p[1]][1]})" for state, pairs in masks.CASES.items() for p in pairs)
_SEGMENTS = _CELLS + f", k AS (SELECT * FROM (VALUES {_CASES}) t(state, ax, ay, bx, bw)), e AS (SELECT image_id, label, 2 * x + ax AS sx, 2 * y + ay AS sy, 2 * x + bx AS ex, 2 * y + bw AS ey FROM s JOIN k ON k.state = s.state)"


@_register(f"WITH {_CELLS} SELECT image_id, label, x, y, state FROM s")
def marching_states(spark, sf_dir):
    return masks.marching_cells(derived.mask(spark, sf_dir))


@_register(f"WITH {_SEGMENTS} SELECT * FROM e")
def contour_segments(spark, sf_dir):
    return masks.cell_segments(masks.marching_cells(derived.mask(spark, sf_dir)))


@_register(f"WITH RECURSIVE {_SEGMENTS}, v AS (SELECT image_id, label, sx AS x, sy AS y, ex AS x2, ey AS y2 FROM e UNION SELECT image_id, label, ex, ey, sx, sy FROM e), c AS (SELECT image_id, label, x, y, y * 1000 + x AS root FROM v UNION SELECT v.image_id, v.label, v.x2, v.y2, c.root FROM c JOIN v ON v.image_id = c.image_id AND v.label = c.label AND v.x = c.x AND v.y = c.y), z AS (SELECT image_id, label, x, y, min(root) AS root FROM c GROUP BY ALL) SELECT image_id, label, root, CAST(count(*) AS BIGINT) AS points FROM z GROUP BY ALL HAVING count(*) >= 3")
def loop_sizes(spark, sf_dir):
    loops = masks.trace_loops(masks.cell_segments(masks.marching_cells(derived.mask(spark, sf_dir))))
    return loops.groupBy("image_id", "label", "path").agg(F.min(F.col("y") * 1000 + F.col("x")).alias("root"), F.count("*").alias("points")).drop("path")


_WALK = f"""{_SEGMENTS}, v AS (SELECT image_id, label, sx AS x, sy AS y, ex AS x2, ey AS y2 FROM e UNION SELECT image_id, label, ex, ey, sx, sy FROM e), c AS (SELECT image_id, label, x, y, y * 1000 + x AS root FROM v UNION SELECT v.image_id, v.label, v.x2, v.y2, c.root FROM c JOIN v ON v.image_id = c.image_id AND v.label = c.label AND v.x = c.x AND v.y = c.y),
s0 AS (SELECT image_id, label, min(root) AS root FROM (SELECT image_id, label, x, y, min(root) AS root FROM c GROUP BY ALL) GROUP BY image_id, label, root HAVING count(*) >= 3),
t AS (SELECT v.image_id, v.label, root, v.x, v.y, v.x2, v.y2, 0 AS pos FROM s0 JOIN v ON v.image_id = s0.image_id AND v.label = s0.label AND v.y * 1000 + v.x = root AND v.x2 > v.x
  UNION ALL SELECT t.image_id, t.label, t.root, v.x, v.y, v.x2, v.y2, pos + 1 FROM t JOIN v ON v.image_id = t.image_id AND v.label = t.label AND v.x = t.x2 AND v.y = t.y2 AND NOT (v.x2 = t.x AND v.y2 = t.y) WHERE t.y2 * 1000 + t.x2 <> t.root)"""


@_register(f"WITH RECURSIVE {_WALK} SELECT image_id, label, root, pos, x, y FROM t")
def loop_points(spark, sf_dir):
    """Loops point by point, from the topmost, then leftmost one to the right."""
    loops = masks.trace_loops(masks.cell_segments(masks.marching_cells(derived.mask(spark, sf_dir))))
    first = F.min(F.col("y") * 1000 + F.col("x")).over(Window.partitionBy("image_id", "label", "path"))
    return loops.withColumn("root", first).drop("path")


_BOUNDARY = MASK + ", w AS (SELECT * FROM (VALUES (0, 0, -1, 0, 0, 1, 0), (1, 1, 0, 1, 0, 1, 1), (2, 0, 1, 1, 1, 0, 1), (3, -1, 0, 0, 1, 0, 0)) t(side, dx, dy, ax, ay, bx, bw)), b AS (SELECT image_id, label, x, y, side, x + ax AS sx, y + ay AS sy, x + bx AS ex, y + bw AS ey FROM m, w WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.image_id = m.image_id AND o.label = m.label AND o.x = m.x + dx AND o.y = m.y + dy))"


@_register(f"WITH {_BOUNDARY} SELECT * FROM b")
def boundary_edges(spark, sf_dir):
    return masks.boundary_edges(derived.mask(spark, sf_dir))


@_register(f"WITH {_BOUNDARY}, n AS (SELECT image_id, label, count(*) AS cells FROM m GROUP BY ALL) SELECT b.image_id, b.label, CAST(count(*) AS BIGINT) AS edges, CAST(any_value(cells) AS DOUBLE) AS area FROM b JOIN n ON n.image_id = b.image_id AND n.label = b.label GROUP BY b.image_id, b.label")
def edge_loops(spark, sf_dir):
    """Outlines keep every edge, and their signed areas add up to the mask."""
    keys = ["image_id", "label", "path"]
    loops = masks.trace_edges(derived.mask(spark, sf_dir))
    sizes = loops.groupBy(*keys).agg(F.count("*").alias("edges"))
    return sizes.join(paths.signed_area(loops, keys), keys).groupBy("image_id", "label").agg(F.sum("edges").alias("edges"), F.sum("area").alias("area"))


@_register(f"WITH {_BOUNDARY.replace(MASK, LEDGER)} SELECT (SELECT CAST(count(*) AS BIGINT) FROM b) AS edges, (SELECT CAST(count(*) AS DOUBLE) FROM m) AS area")
def table_outlines(spark, sf_dir):
    """The outlines of one mask over a whole table: all edges, and areas that add up to the bits."""
    return masks.outline_sizes(derived.ledger(spark, sf_dir, repeated=True)).agg(F.sum("edges").alias("edges"), F.sum("area").alias("area"))


@_register(f"WITH {RING} SELECT path_id, CAST(abs(sum(x * ny - nx * y)) AS DOUBLE) / 2 AS area FROM g GROUP BY path_id")
def polygon_area(spark, sf_dir):
    return paths.polygon_area(derived.order_path(spark, sf_dir))


@_register(f"WITH {RING} SELECT path_id, sum(x * ny - nx * y) < 0 AS clockwise FROM g GROUP BY path_id")
def winding(spark, sf_dir):
    return paths.winding(derived.order_path(spark, sf_dir))


@_register(f"WITH {PATH} SELECT path_id, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM p GROUP BY path_id")
def bbox(spark, sf_dir):
    return paths.bounds(derived.order_path(spark, sf_dir))


@_register(f"WITH {PATH} SELECT path_id, CAST(sum(x) AS DOUBLE) / count(*) AS cx, CAST(sum(y) AS DOUBLE) / count(*) AS cy FROM p GROUP BY path_id")
def vertex_centroid(spark, sf_dir):
    return paths.vertex_centroid(derived.order_path(spark, sf_dir))


_STEP_SQL = "t AS (SELECT *, CAST(x - px AS DOUBLE) AS ax, CAST(y - py AS DOUBLE) AS ay, CAST(nx - x AS DOUBLE) AS bx, CAST(ny - y AS DOUBLE) AS bw FROM g), u AS (SELECT *, sqrt(ax * ax + ay * ay) * sqrt(bx * bx + bw * bw) AS size FROM t)"
_TURN = "CASE WHEN size = 0 THEN 0 ELSE acos(greatest(-1, least(1, (ax * bx + ay * bw) / size))) END"
_ANGLE = "CASE WHEN size = 0 THEN 180 ELSE degrees(acos(greatest(-1, least(1, -(ax * bx + ay * bw) / size)))) END"


@_register(f"WITH {RING}, {_STEP_SQL} SELECT path_id, CAST(sum(CASE WHEN n >= 3 AND {_TURN} > 0.6 THEN 1 ELSE 0 END) AS BIGINT) AS sharp FROM u GROUP BY path_id")
def sharp_turns(spark, sf_dir):
    return paths.sharp_turns(derived.order_path(spark, sf_dir))


@_register(f"WITH {RING} SELECT path_id, bool_or(sqrt(CAST((x - nx) * (x - nx) + (y - ny) * (y - ny) AS DOUBLE)) < 5000) AS short FROM g GROUP BY path_id")
def short_edges(spark, sf_dir):
    return paths.short_edges(derived.order_path(spark, sf_dir), 5000)


_CROSS = "(({1}.y - {0}.y) * ({2}.x - {1}.x) - ({1}.x - {0}.x) * ({2}.y - {1}.y))"
_INTERSECT = """i AS (SELECT path_id, n, pos, x, y, nx, ny FROM g), j AS (SELECT a.path_id,
  (a.ny - a.y) * (b.x - a.nx) - (a.nx - a.x) * (b.y - a.ny) AS o1, (a.ny - a.y) * (b.nx - a.nx) - (a.nx - a.x) * (b.ny - a.ny) AS o2,
  (b.ny - b.y) * (a.x - b.nx) - (b.nx - b.x) * (a.y - b.ny) AS o3, (b.ny - b.y) * (a.nx - b.nx) - (b.nx - b.x) * (a.ny - b.ny) AS o4,
  b.x BETWEEN least(a.x, a.nx) AND greatest(a.x, a.nx) AND b.y BETWEEN least(a.y, a.ny) AND greatest(a.y, a.ny) AS s1,
  b.nx BETWEEN least(a.x, a.nx) AND greatest(a.x, a.nx) AND b.ny BETWEEN least(a.y, a.ny) AND greatest(a.y, a.ny) AS s2,
  a.x BETWEEN least(b.x, b.nx) AND greatest(b.x, b.nx) AND a.y BETWEEN least(b.y, b.ny) AND greatest(b.y, b.ny) AS s3,
  a.nx BETWEEN least(b.x, b.nx) AND greatest(b.x, b.nx) AND a.ny BETWEEN least(b.y, b.ny) AND greatest(b.y, b.ny) AS s4
  FROM i a JOIN i b ON a.path_id = b.path_id AND b.pos > a.pos + 1 AND NOT (a.pos = 0 AND b.pos = a.n - 1) AND a.n >= 4),
  x AS (SELECT DISTINCT path_id FROM j WHERE (o1 = 0 AND s1) OR (o2 = 0 AND s2) OR (o3 = 0 AND s3) OR (o4 = 0 AND s4) OR ((o1 > 0) <> (o2 > 0) AND (o3 > 0) <> (o4 > 0)))"""


@_register(f"WITH {RING}, {_INTERSECT} SELECT p.path_id, x.path_id IS NOT NULL AS crosses FROM (SELECT DISTINCT path_id FROM p) p LEFT JOIN x ON x.path_id = p.path_id")
def self_intersections(spark, sf_dir):
    return paths.self_intersections(derived.order_path(spark, sf_dir))


@_register(f"WITH {RING}, b AS (SELECT path_id, abs(sum(x * ny - nx * y)) / 2.0 AS area, max(x) - min(x) AS w, max(y) - min(y) AS h FROM g GROUP BY path_id) SELECT path_id, area <= 9 AND w <= 4 AND h <= 4 AS tiny FROM b")
def tiny_fragments(spark, sf_dir):
    return paths.tiny_fragments(derived.order_path(spark, sf_dir))


@_register(f"WITH {RING}, b AS (SELECT path_id, abs(sum(x * ny - nx * y)) / 2.0 AS area, count(*) AS n FROM g GROUP BY path_id) SELECT p.path_id, p.pos, p.x, p.y FROM p JOIN b ON b.path_id = p.path_id WHERE b.n >= 3 AND b.area >= 1000000")
def large_polygons(spark, sf_dir):
    return paths.keep_polygons(derived.order_path(spark, sf_dir), 1_000_000).select("path_id", "pos", "x", "y")


@_register(f"WITH {RING}, {_STEP_SQL}, k AS (SELECT *, n < 4 OR size = 0 OR abs(ax * bw - ay * bx) / size > 0.0002 AS keep FROM u), s AS (SELECT *, sum(keep::INT) OVER (PARTITION BY path_id) AS kept FROM k) SELECT path_id, pos, x, y FROM s WHERE keep OR kept < 3")
def remove_collinear(spark, sf_dir):
    return paths.drop_collinear(derived.order_path(spark, sf_dir), 0.0002)


#: Staircases in the unit grid, to which the order paths are mapped: steps of 0 or 1 in turn.
_STAIR = PATH.replace("CAST(l_quantity AS BIGINT) AS x", "CAST(l_linenumber // 2 AS BIGINT) AS x").replace("CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS y", "CAST((l_linenumber + 1) // 2 AS BIGINT) AS y")
_STAIR_RING = _STAIR + RING[len(PATH) :]


@_register(f"""WITH {_STAIR_RING}, t AS (SELECT *, px - ppx AS ax, py - ppy AS ay, x - px AS bx, y - py AS bw, nx - x AS cx, ny - y AS cy, nnx - nx AS dx, nny - ny AS dy FROM g),
k AS (SELECT *, n < 6 OR NOT (sqrt(bx * bx + bw * bw) <= 1.35 AND sqrt(cx * cx + cy * cy) <= 1.35 AND bx * cx + bw * cy = 0 AND (bx = 0 OR bw = 0) AND (cx = 0 OR cy = 0)
  AND ax * cy - ay * cx = 0 AND ax * cx + ay * cy > 0 AND bx * dy - bw * dx = 0 AND bx * dx + bw * dy > 0) AS keep FROM t),
s AS (SELECT *, sum(keep::INT) OVER (PARTITION BY path_id) AS kept FROM k) SELECT path_id, pos, x, y FROM s WHERE keep OR kept < 3""")
def soften_stairs(spark, sf_dir):
    from pyspark.sql.window import Window

    li = derived.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path_id"), "l_linenumber", F.expr("l_linenumber div 2").alias("x"), F.expr("(l_linenumber + 1) div 2").alias("y"))
    nodes = li.select("path_id", (F.row_number().over(Window.partitionBy("path_id").orderBy("l_linenumber", "x", "y")) - 1).alias("pos"), "x", "y")
    return paths.soften_stairs(nodes)


@_register(f"WITH {RING}, {_STEP_SQL} SELECT path_id, pos, CASE WHEN n < 4 OR pos = 0 OR pos = n - 1 OR {_ANGLE} < 40 THEN CAST(x AS DOUBLE) ELSE x * 0.75::DOUBLE + (px + nx) * 0.5::DOUBLE * 0.25::DOUBLE END AS x, CASE WHEN n < 4 OR pos = 0 OR pos = n - 1 OR {_ANGLE} < 40 THEN CAST(y AS DOUBLE) ELSE y * 0.75::DOUBLE + (py + ny) * 0.5::DOUBLE * 0.25::DOUBLE END AS y FROM u")
def smooth_points(spark, sf_dir):
    return paths.smooth(derived.order_path(spark, sf_dir), 0.25, 40)


@_register(f"""WITH {RING}, {_STEP_SQL}, v AS (SELECT *, {_ANGLE} AS a0, CAST(nnx - nx AS DOUBLE) AS cx, CAST(nny - ny AS DOUBLE) AS cy, sqrt(bx * bx + bw * bw) * sqrt(CAST((nnx - nx) * (nnx - nx) + (nny - ny) * (nny - ny) AS DOUBLE)) AS size2 FROM u),
w AS (SELECT *, n < 4 OR a0 < 60 OR CASE WHEN size2 = 0 THEN 180 ELSE degrees(acos(greatest(-1, least(1, -(bx * cx + bw * cy) / size2)))) END < 60 AS sharp FROM v),
c AS (SELECT path_id, pos, 0 AS k, CASE WHEN sharp THEN CAST(x AS DOUBLE) ELSE x * 0.75::DOUBLE + nx * 0.25::DOUBLE END AS x, CASE WHEN sharp THEN CAST(y AS DOUBLE) ELSE y * 0.75::DOUBLE + ny * 0.25::DOUBLE END AS y FROM w
  UNION ALL SELECT path_id, pos, 1, x * 0.25::DOUBLE + nx * 0.75::DOUBLE, y * 0.25::DOUBLE + ny * 0.75::DOUBLE FROM w WHERE NOT sharp)
SELECT path_id, CAST(row_number() OVER (PARTITION BY path_id ORDER BY pos, k) - 1 AS INTEGER) AS pos, x, y FROM c""")
def chaikin_once(spark, sf_dir):
    return paths.chaikin(derived.order_path(spark, sf_dir), 1, 60)


@_register(f"WITH {RING}, {_STEP_SQL} SELECT path_id, pos, CASE WHEN n < 6 OR {_ANGLE} < 30 THEN CAST(x AS DOUBLE) ELSE x * (1 - 0.28::DOUBLE) + (px + nx) * 0.5::DOUBLE * 0.28::DOUBLE END AS x, CASE WHEN n < 6 OR {_ANGLE} < 30 THEN CAST(y AS DOUBLE) ELSE y * (1 - 0.28::DOUBLE) + (py + ny) * 0.5::DOUBLE * 0.28::DOUBLE END AS y FROM u")
def relax_once(spark, sf_dir):
    return paths.relax(derived.order_path(spark, sf_dir), 0.2, 40)


@_register(f"WITH {AREA} SELECT layer, CAST(sum(area) AS BIGINT) AS area FROM s GROUP BY layer")
def layer_area(spark, sf_dir):
    return layers.layer_area(derived.order_area(spark, sf_dir))


@_register(f"WITH {AREA} SELECT layer, max(area) AS largest FROM s GROUP BY layer")
def largest_path(spark, sf_dir):
    return layers.primary_area(derived.order_area(spark, sf_dir))


@_register(f"WITH {AREA} SELECT layer, pos, area, CAST(row_number() OVER (PARTITION BY layer ORDER BY area DESC, pos) AS INTEGER) AS rank FROM s")
def rank_paths(spark, sf_dir):
    return layers.rank_paths(derived.order_area(spark, sf_dir))


def _capped(cap: int, head: int, reserve: int) -> str:
    return f"""WITH {AREA}, a AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY area DESC, pos) AS rn, count(*) OVER (PARTITION BY layer) AS n FROM s),
b AS (SELECT *, CASE WHEN rn > {head} AND area BETWEEN 8 AND 320 THEN row_number() OVER (PARTITION BY layer, rn > {head} AND area BETWEEN 8 AND 320 ORDER BY area, rn) END AS drn FROM a),
c AS (SELECT *, CASE WHEN n <= {cap} THEN 0 WHEN rn <= {head} THEN 1 WHEN drn <= {reserve} THEN 2 ELSE 3 END AS tier FROM b),
d AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY tier, CASE tier WHEN 0 THEN pos WHEN 2 THEN drn ELSE rn END, rn) AS rank FROM c)
SELECT layer, pos, area, CAST(rank AS INTEGER) AS rank FROM d WHERE tier = 0 OR rank <= {cap}"""


@_register(_capped(5, 5, 0))
def topk_light(spark, sf_dir):
    return layers.cap_paths(derived.order_area(spark, sf_dir), 5)


@_register(_capped(5, 3, 2))
def topk_dark(spark, sf_dir):
    return layers.cap_paths(derived.order_area(spark, sf_dir), 5, True)


@_register(_capped(8, 6, 2))
def topk_dark_batch(spark, sf_dir):
    return layers.cap_paths(derived.order_area(spark, sf_dir), 5, True, mode="batch")


_LAYERS = "l AS (SELECT o_custkey % 50 AS image_id, o_orderkey AS pos, CAST(floor(o_totalprice) AS BIGINT) % 1000 / 1000.0::DOUBLE AS coverage, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) % 977 AS largest, 'c' || (o_orderkey % 12) AS color FROM orders)"


def _layers(spark, sf_dir):
    o = derived.table(spark, sf_dir, "orders")
    return o.select((F.col("o_custkey") % 50).alias("image_id"), F.col("o_orderkey").alias("pos"), (F.floor("o_totalprice").cast("long") % 1000 / 1000.0).alias("coverage"), (derived.cents("o_totalprice") % 977).alias("largest"), F.concat(F.lit("c"), (F.col("o_orderkey") % 12).cast("string")).alias("color"))


@_register(f"WITH {_LAYERS}, a AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY coverage >= 0.99 DESC, coverage DESC, pos) AS rn, sum((coverage >= 0.99)::INT) OVER (PARTITION BY image_id) AS fine FROM l), b AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY coverage DESC, pos) AS rank FROM a WHERE rn <= greatest(fine, 5)) SELECT image_id, pos, coverage, CAST(rank AS INTEGER) AS rank FROM b WHERE rank <= 8")
def layer_select(spark, sf_dir):
    return layers.select_layers(_layers(spark, sf_dir), 0.99, 5, 8).select("image_id", "pos", "coverage", "rank")


@_register(f"WITH {_LAYERS} SELECT image_id, pos, CAST(row_number() OVER (PARTITION BY image_id ORDER BY largest DESC, coverage DESC, pos) AS INTEGER) AS place FROM l")
def layer_order(spark, sf_dir):
    return layers.order_layers(_layers(spark, sf_dir)).select("image_id", "pos", "place")


@_register(f"WITH {_LAYERS}, a AS (SELECT *, min(pos) OVER (PARTITION BY image_id, color) AS first FROM l) SELECT image_id, pos, color, CAST(dense_rank() OVER (PARTITION BY image_id ORDER BY first) AS INTEGER) AS layer_no FROM a")
def layer_numbering(spark, sf_dir):
    return layers.number_layers(_layers(spark, sf_dir)).select("image_id", "pos", "color", "layer_no")


_CUBIC = "u * u * u * a{0} + 3.0::DOUBLE * u * u * t * bb{0} + 3.0::DOUBLE * u * t * t * c{0} + t * t * t * d{0}"


@_register(f"WITH c AS (SELECT o_orderkey, CAST(o_orderkey % 10 AS DOUBLE) AS ax, CAST(o_orderkey % 7 AS DOUBLE) AS ay, CAST(o_orderkey % 13 AS DOUBLE) AS bbx, CAST(o_custkey % 11 AS DOUBLE) AS bby, CAST(o_custkey % 17 AS DOUBLE) AS cx, CAST(o_custkey % 5 AS DOUBLE) AS cy, CAST(o_custkey % 3 AS DOUBLE) AS dx, CAST(o_orderkey % 19 AS DOUBLE) AS dy FROM orders), s AS (SELECT *, k, k / 10.0::DOUBLE AS t, 1.0::DOUBLE - k / 10.0::DOUBLE AS u FROM c, (SELECT CAST(unnest(range(11)) AS INTEGER) AS k)) SELECT o_orderkey, k AS step, {_CUBIC.format('x')} AS x, {_CUBIC.format('y')} AS y FROM s")
def cubic_samples(spark, sf_dir):
    o = derived.table(spark, sf_dir, "orders")
    p = lambda a, m, b, n: geometry.point(F.col(a) % m, F.col(b) % n)
    s = geometry.sample_cubic(p("o_orderkey", 10, "o_orderkey", 7), p("o_orderkey", 13, "o_custkey", 11), p("o_custkey", 17, "o_custkey", 5), p("o_custkey", 3, "o_orderkey", 19))
    return o.select("o_orderkey", F.posexplode(s).alias("step", "p")).select("o_orderkey", "step", "p.x", "p.y")


@_register(f"WITH {PATH}, q AS (SELECT path_id, count(*) AS n FROM p GROUP BY path_id) SELECT path_id % 10 AS image_id, CAST(count(*) AS BIGINT) AS path_count, CAST(sum(CASE WHEN path_id % 3 > 0 THEN path_id % 3 ELSE n END) AS BIGINT) AS node_count FROM q GROUP BY path_id % 10")
def metrics(spark, sf_dir):
    p = paths.to_points(derived.order_path(spark, sf_dir))
    none = F.array().cast("array<array<struct<x:double,y:double>>>")
    return layers.metrics(p.select((F.col("path_id") % 10).alias("image_id"), "points", none.alias("holes"), (F.col("path_id") % 3).cast("int").alias("node_count")))


def _queue_events(spark, sf_dir):
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("queued", "processing", "progress", "result", "error", "retry", "delete")]), (F.col("event_id") % 7 + 1).cast("int"))
    kind = F.when((F.col("event_id") % 7 == 6) & (F.col("event_id") % 5 != 0), "progress").otherwise(kinds)
    return derived.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("id"), kind.alias("kind"), (F.col("event_id") % 100).cast("int").alias("progress"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("error"), F.concat(F.lit("p"), F.col("event_id").cast("string")).alias("payload"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))


@_register("""WITH k AS (SELECT CAST(user_id AS VARCHAR) AS id, CASE WHEN event_id % 7 = 6 AND event_id % 5 <> 0 THEN 'progress' ELSE ['queued', 'processing', 'progress', 'result', 'error', 'retry', 'delete'][event_id % 7 + 1] END AS kind,
  event_id % 100 AS progress, ts, event_id FROM events), f AS (SELECT id, arg_max(kind, (ts, event_id)) AS kind, arg_max(progress, (ts, event_id)) AS progress, arg_max(event_id, (ts, event_id)) AS last, bool_or(kind = 'delete') AS gone FROM k GROUP BY id)
SELECT id, CASE WHEN kind IN ('queued', 'retry') THEN 'queued' WHEN kind = 'result' THEN 'done' WHEN kind = 'error' THEN 'error' ELSE 'processing' END AS status,
  CAST(CASE WHEN kind IN ('queued', 'retry') THEN 0 WHEN kind = 'result' THEN 100 ELSE progress END AS INTEGER) AS progress, CASE WHEN kind = 'error' THEN 'e' || last END AS error, CASE WHEN kind = 'result' THEN 'p' || last END AS payload FROM f WHERE NOT gone""")
def queue_latest(spark, sf_dir):
    return queue.fold_queue(_queue_events(spark, sf_dir)).drop("updated_at")


@_register("SELECT c_custkey, CAST(floor(c_acctbal + 0.5) AS BIGINT) AS nearest, least(16, greatest(0, floor(c_acctbal / 500 + 0.5)))::INTEGER AS speckle, CAST((c_custkey * 1664525 + 1013904223) % 4294967296 AS BIGINT) AS lcg, (c_custkey % 5) * (c_custkey % 5) AS area FROM customer")
def scalar_functions(spark, sf_dir):
    o = settings.tracer_options({"filterSpeckle": F.col("c_acctbal") / 500})
    c = derived.table(spark, sf_dir, "customer")
    return c.select("c_custkey", numbers.round_half_up(F.col("c_acctbal")).cast("long").alias("nearest"), o["filterSpeckle"].alias("speckle"), numbers.lcg_next(F.col("c_custkey")).alias("lcg"), settings.speckle_area(F.col("c_custkey") % 5).alias("area"))


@_register("SELECT p_partkey, regexp_replace(p_name || CASE p_partkey % 3 WHEN 0 THEN '.png' WHEN 1 THEN '.PNG' ELSE '.jpg' END, '(?i)\\.png$', '') AS stem, format('COLOR_{:02d}', p_partkey % 40) AS layer FROM part")
def names(spark, sf_dir):
    from .sources.png import stem

    p = derived.table(spark, sf_dir, "part")
    ending = F.when(F.col("p_partkey") % 3 == 0, ".png").when(F.col("p_partkey") % 3 == 1, ".PNG").otherwise(".jpg")
    return p.select("p_partkey", stem(F.concat("p_name", ending)).alias("stem"), layers.layer_name(F.col("p_partkey") % 40).alias("layer"))


@_register()
def vectorized_images(spark, sf_dir):
    """The whole conversion of the rasters."""
    return vectorize.vectorize(derived.dense(spark, sf_dir), settings.BatchOptions(palette_size=6, simplify_tolerance=0.5, speckle_threshold=2)).select("image_id", "path_count", "node_count", F.to_json("layers").alias("layers"))


@_register()
def exported_documents(spark, sf_dir):
    images = vectorize.vectorize(derived.dense(spark, sf_dir), settings.BatchOptions(palette_size=6, simplify_tolerance=0.5, speckle_threshold=2))
    return export.exports(images)
