"""Queries on image files, layers, documents, stores and the queue, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import catalogue  # noqa: F401  its SQL is used here
from .catalogue_points import fixed_sql
from .functions import settings
from .functions.geometry import POINTS
from .operators import layers, masks, paths, pixels
from .plans import derived, export, vectorize
from .plans.derived import DENSE, DRAWING, DRAWN_RING, MASK, RASTER
from .registered import SQL, register
from .sources import png, store
from .sources.stages import fresh, staged
from .streaming import queue


@register(f"WITH {DENSE} SELECT image_id, width, height, x, y, r, g, b, a FROM d")
def png_pixels(spark, sf_dir):
    """The rasters as PNG files of a folder, with all filters, listed, decoded, checked, and read as pixels."""
    folder = fresh(spark, "png")
    png.write_images(derived.dense(spark, sf_dir), folder)
    return png.read_images(spark, folder)


@register(SQL["bilinear_resize"])
def png_thumbnails(spark, sf_dir):
    """The same files scaled down to 16 pixels on their longer side."""
    folder = fresh(spark, "png")
    png.write_images(derived.dense(spark, sf_dir), folder)
    return png.read_images(spark, folder, 16).select("image_id", "x", "y", "r", "g", "b", "a")


@register(f"WITH {RASTER} SELECT image_id || '.png' AS name, image_id, CASE WHEN contains(image_id, 'e_') THEN NULL ELSE 31 END AS width, contains(image_id, 'e_') AS bad FROM r GROUP BY image_id")
def png_errors(spark, sf_dir):
    """Files with a broken signature, or a buffer of another size, have an error and no pixels."""
    folder = fresh(spark, "png")
    png.write_images(derived.dense(spark, sf_dir), folder)
    files = png.scan(spark, folder)
    odd = files.withColumn("content", F.when(F.col("name").contains("e_"), F.encode(F.lit("no image"), "utf-8")).otherwise(F.col("content")))
    return png.valid(png.decoded(odd)).select(F.concat("image_id", F.lit(".png")).alias("name"), "image_id", "width", F.col("error").isNotNull().alias("bad"))


@register("SELECT p_partkey, p_name FROM part WHERE p_partkey % 3 = 0")
def uploaded_files(spark, sf_dir):
    p = derived.table(spark, sf_dir, "part").withColumn("mime", F.when(F.col("p_partkey") % 3 == 0, "image/png").when(F.col("p_partkey") % 3 == 1, "image/jpeg"))
    return png.uploads(p).select("p_partkey", "p_name")


_NAME = "CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) WHEN 2 THEN replace(p_name, 'e', 'é') ELSE replace(p_name, 'a', 'Ä') END"


@register(f"SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY icu_sort_key({_NAME}, 'und'), {_NAME}, p_partkey) AS INTEGER) AS place FROM part")
def collated_names(spark, sf_dir):
    """File names with capitals and accents in the order of readers."""
    p = derived.table(spark, sf_dir, "part").withColumn("name", F.expr(_NAME))
    return p.select("p_partkey", F.row_number().over(Window.partitionBy("p_brand").orderBy(*png.by_name("name"), "p_partkey")).alias("place"))


_HEXES = "k AS (SELECT * FROM (VALUES (0, '#fafafa'), (1, '#202020')) t(label, hex))"
_FLOODED = "f AS (SELECT image_id, label, count(*) / 744.0 > 0.25 AND bool_or(y = 0) AND bool_or(y = 23) AND bool_or(x = 0) AND bool_or(x = 30) AS flood FROM m GROUP BY image_id, label)"


@register(f"WITH {MASK}, {_HEXES}, {_FLOODED} SELECT i.image_id, k.label, k.hex FROM (SELECT DISTINCT image_id FROM r) i CROSS JOIN k LEFT JOIN f ON f.image_id = i.image_id AND f.label = k.label WHERE NOT (coalesce(f.flood, false) AND k.label = 1)")
def flooded_labels(spark, sf_dir):
    """Labels without those that flood the image, unless they are light."""
    images = derived.raster(spark, sf_dir).select("image_id").distinct()
    colors = images.select("image_id", F.explode(F.array(*[F.struct(F.lit(k).alias("label"), F.lit(h).alias("hex")) for k, h in ((0, "#fafafa"), (1, "#202020"))])).alias("c")).select("image_id", "c.*")
    return pixels.drop_flooded(colors, pixels.background_flood(derived.mask(spark, sf_dir)))


_DARK = RASTER + ", m AS (SELECT image_id, 0 AS label, x, y, width, height FROM r WHERE r < 128), c AS (SELECT image_id, x, y, CAST(y * 31 + x AS BIGINT) AS root FROM m UNION SELECT m.image_id, m.x, m.y, c.root FROM c JOIN m ON m.image_id = c.image_id AND abs(m.x - c.x) + abs(m.y - c.y) = 1), z AS (SELECT image_id, x, y, min(root) AS root FROM c GROUP BY ALL), n AS (SELECT *, count(*) OVER (PARTITION BY image_id, root) AS size FROM z), f AS (SELECT image_id, x, y FROM n WHERE size >= 16)"


@register(f"WITH RECURSIVE {_DARK}, e AS (SELECT f.image_id, (SELECT count(*) FROM (VALUES (0, -1), (1, 0), (0, 1), (-1, 0)) w(dx, dy) WHERE NOT EXISTS (SELECT 1 FROM f o WHERE o.image_id = f.image_id AND o.x = f.x + dx AND o.y = f.y + dy)) AS sides FROM f) SELECT image_id, CAST(sum(sides) AS BIGINT) AS edges, CAST(count(*) AS DOUBLE) AS area FROM e GROUP BY image_id")
def binary_outlines(spark, sf_dir):
    """The binary mode of the conversion: dark parts without small ones, as outlines, by their edges and area."""
    keys = ["image_id", "label", "path"]
    loops = vectorize.trace(derived.raster(spark, sf_dir), "binary")
    return loops.groupBy(*keys).agg(F.count("*").alias("edges")).join(paths.signed_area(loops, keys), keys).groupBy("image_id").agg(F.sum("edges").alias("edges"), F.sum("area").alias("area"))


def _drawn(spark, sf_dir) -> DataFrame:
    """Paths of the drawing: image_id, pos, color, points, holes."""
    d = derived.drawing(spark, sf_dir)
    own = paths.to_points(d, ["image_id", "path_id", "color"])
    return own.select("image_id", F.col("path_id").alias("pos"), "color", "points", F.array().cast(f"array<{POINTS}>").alias("holes"))


def _images(spark, sf_dir) -> DataFrame:
    return layers.group_layers(_drawn(spark, sf_dir)).select("image_id", F.lit(60).alias("width"), F.lit(40).alias("height"), "layers")


_LAYERED = f"{DRAWN_RING}, u AS (SELECT image_id, color, min(path_id) AS first FROM h GROUP BY ALL), v AS (SELECT image_id, color, row_number() OVER (PARTITION BY image_id ORDER BY first) AS layer_no FROM u), l AS (SELECT h.*, v.layer_no, printf('COLOR_%02d', v.layer_no) AS name FROM h JOIN v ON v.image_id = h.image_id AND v.color = h.color)"


@register(f"WITH {_LAYERED} SELECT image_id, CAST(layer_no AS INTEGER) AS layer_no, name, color, CAST(count(DISTINCT path_id) AS INTEGER) AS paths, CAST(count(*) AS BIGINT) AS points FROM l GROUP BY ALL")
def layers_by_color(spark, sf_dir):
    """Paths grouped to layers by their colour, in the order in which colours come first."""
    own = layers.group_layers(_drawn(spark, sf_dir)).select("image_id", F.explode("layers").alias("l"))
    return own.select("image_id", "l.layer_no", "l.name", "l.color", F.size("l.paths").alias("paths"), F.aggregate("l.paths", F.lit(0).cast("long"), lambda n, p: n + F.size(p["points"])).alias("points"))


@register(f"WITH {DRAWING}, q AS (SELECT path_id, count(*) AS n FROM p GROUP BY path_id) SELECT path_id // 64 AS image_id, CAST(count(*) FILTER (WHERE path_id % 5 = 0 OR n >= 3 OR path_id % 7 = 0) AS INTEGER) AS drawn, string_agg(path_id || ':' || n, chr(10) ORDER BY path_id) AS text FROM q GROUP BY path_id // 64")
def drawable_paths(spark, sf_dir):
    """How many paths an image draws: with exact data, 3 points, or a hole of 3; and its paths as one text in order."""
    own = _drawn(spark, sf_dir).withColumn("svg_path_data", F.when(F.col("pos") % 5 == 0, "M 0 0 Z"))
    hole = F.array(*[F.struct(F.lit(float(k)).alias("x"), F.lit(float(k * k)).alias("y")) for k in range(3)])
    own = own.withColumn("holes", F.when(F.col("pos") % 7 == 0, F.array(hole)).otherwise(F.col("holes")))
    drawn = own.groupBy("image_id").agg(F.collect_list(F.struct("points", "holes", "svg_path_data")).alias("paths")).select("image_id", F.size(layers.drawable(F.col("paths"))).alias("drawn"))
    text = layers.join_text(own.select("image_id", "pos", F.concat_ws(":", F.col("pos").cast("string"), F.size("points").cast("string")).alias("text")))
    return drawn.join(text, "image_id")


_HEAD = "'<?xml version=\"1.0\" encoding=\"UTF-8\" ?>' || chr(10) || '<!DOCTYPE svg PUBLIC \"-//W3C//DTD SVG 1.1//EN\" \"http://www.w3.org/Graphics/SVG/1.1/DTD/svg11.dtd\">' || chr(10) || '<svg width=\"60pt\" height=\"40pt\" viewBox=\"0 0 60 40\" version=\"1.1\" xmlns=\"http://www.w3.org/2000/svg\"{}>' || chr(10)"
_AT = lambda x, y: f"{fixed_sql(x, 2)} || ' ' || {fixed_sql(y, 2)}"
_LONG = lambda a, b: f"greatest(0.001, sqrt(CAST(({a[0]} - {b[0]}) * ({a[0]} - {b[0]}) + ({a[1]} - {b[1]}) * ({a[1]} - {b[1]}) AS DOUBLE)))"


def _corner(a, b, c) -> str:
    ax, ay, bx, by = f"({a[0]} - {b[0]})", f"({a[1]} - {b[1]})", f"({c[0]} - {b[0]})", f"({c[1]} - {b[1]})"
    size = f"(sqrt(CAST({ax} * {ax} + {ay} * {ay} AS DOUBLE)) * sqrt(CAST({bx} * {bx} + {by} * {by} AS DOUBLE)))"
    return f"CASE WHEN {size} = 0 THEN 180 ELSE degrees(acos(greatest(-1, least(1, ({ax} * {bx} + {ay} * {by}) / {size})))) END"


def _curves_sql(guarded: bool) -> str:
    """CTEs on l (nodes with two neighbours on each side) that end in `c` (image_id, layer_no, color, path_id, d): the text of each path."""
    p, q, r, s = ("px", "py"), ("x", "y"), ("nx", "ny"), ("nnx", "nny")
    least = 5 if guarded else 4
    pull = lambda k: f"CASE WHEN {k}d <= {k}m OR {k}d = 0 THEN 1.0::DOUBLE ELSE {k}m / {k}d END" if guarded else "1.0::DOUBLE"
    straight = "low < 58 OR (seg < 1.25 AND low < 38)" if guarded else "false"
    return f"""e AS (SELECT *, {_LONG(q, r)} AS seg, {_LONG(p, q)} AS before, {_LONG(r, s)} AS after, least({_corner(p, q, r)}, {_corner(q, r, s)}) AS low, (nx - px) / 6.0::DOUBLE AS ox, (ny - py) / 6.0::DOUBLE AS oy, (nnx - x) / 6.0::DOUBLE AS tx, (nny - y) / 6.0::DOUBLE AS ty FROM l),
e2 AS (SELECT *, sqrt(ox * ox + oy * oy) AS od, sqrt(tx * tx + ty * ty) AS td, 0.6::DOUBLE * least(seg, before) AS om, 0.6::DOUBLE * least(seg, after) AS tm FROM e),
e3 AS (SELECT *, {pull('o')} AS os, {pull('t')} AS ts FROM e2),
e4 AS (SELECT *, CASE WHEN n < {least} THEN CASE WHEN pos = 0 THEN 'M ' ELSE 'L ' END || {_AT('x', 'y')}
  ELSE CASE WHEN pos = 0 THEN 'M ' || {_AT('x', 'y')} || ' ' ELSE '' END || CASE WHEN {straight} THEN 'L ' ELSE 'C ' || {_AT('x + ox * os', 'y + oy * os')} || ' ' || {_AT('nx - tx * ts', 'ny - ty * ts')} || ' ' END || {_AT('nx', 'ny')} END AS piece FROM e3),
c AS (SELECT image_id, layer_no, color, path_id, string_agg(piece, ' ' ORDER BY pos) || ' Z' AS d FROM e4 WHERE n >= 3 GROUP BY ALL)"""


def _svg_sql(guarded: bool) -> str:
    return f"""WITH {_LAYERED}, {_curves_sql(guarded)},
b AS (SELECT g.image_id, g.layer_no, g.color, coalesce(string_agg('<path fill="' || g.color || '" opacity="1.00" d="' || d || '" />', chr(10) ORDER BY c.path_id), '') AS body
  FROM (SELECT DISTINCT image_id, layer_no, color FROM l) g LEFT JOIN c ON c.image_id = g.image_id AND c.layer_no = g.layer_no GROUP BY ALL)
SELECT image_id, {_HEAD.format(' shape-rendering="geometricPrecision"')} || string_agg('<g id="' || color || 'ff">' || chr(10) || body || chr(10) || '</g>', chr(10) ORDER BY layer_no) || chr(10) || '</svg>' || chr(10) AS text FROM b GROUP BY image_id"""


@register(_svg_sql(True))
def svg_documents(spark, sf_dir):
    """SVG of grouped layers, curves with bounded handles."""
    return export.to_svg(_images(spark, sf_dir))


@register(_svg_sql(False))
def svg_documents_batch(spark, sf_dir):
    """SVG of the batch form: unguarded curves, no holes."""
    return export.to_svg(_images(spark, sf_dir), "plain")


@register(f"""WITH {_LAYERED}, {_curves_sql(True)}, a AS (SELECT DISTINCT image_id FROM l)
SELECT a.image_id, {_HEAD.format('')} || coalesce(string_agg('<path fill="' || color || '" d="' || d || '" transform="translate(0.00, 0.00)" />', chr(10) ORDER BY layer_no DESC, path_id DESC), '') || chr(10) || '</svg>' || chr(10) AS text FROM a LEFT JOIN c ON c.image_id = a.image_id GROUP BY a.image_id""")  # fmt: skip
def svg_documents_flat(spark, sf_dir):
    """SVG of the tracer's form: paths alone, in reverse order."""
    return export.to_svg(_images(spark, sf_dir), "flat")


_UNIT = lambda k: f"CAST(('0x' || substr(color, {2 + 2 * k}, 2)) AS INTEGER) / 255.0::DOUBLE"


def _eps_sql(plain: bool) -> str:
    end = "'closepath fill'" if plain else "'closepath' || chr(10) || 'fill'"
    return f"""WITH {_LAYERED}, t AS (SELECT image_id, layer_no, name, color, path_id, 'newpath' || chr(10) || string_agg({_AT('x', 'y')} || CASE WHEN pos = 0 THEN ' moveto' ELSE ' lineto' END, chr(10) ORDER BY pos) || chr(10) || {end} AS body FROM l GROUP BY ALL),
b AS (SELECT image_id, layer_no, '% Layer: ' || name || chr(10) || {fixed_sql(_UNIT(0), 4)} || ' ' || {fixed_sql(_UNIT(1), 4)} || ' ' || {fixed_sql(_UNIT(2), 4)} || ' setrgbcolor' || chr(10) || string_agg(body, chr(10) ORDER BY path_id) AS body FROM t GROUP BY image_id, layer_no, name, color)
SELECT image_id, '%!PS-Adobe-3.0 EPSF-3.0' || chr(10) || '%%BoundingBox: 0 0 60 40' || chr(10) || '%%LanguageLevel: 2' || chr(10) || '%%Pages: 1' || chr(10) || '%%EndComments' || chr(10) || 'gsave' || chr(10) || '0 40 translate' || chr(10) || '1 -1 scale' || chr(10) || string_agg(body, chr(10) ORDER BY layer_no) || chr(10) || 'grestore' || chr(10) || 'showpage' || chr(10) || '%%EOF' || chr(10) AS text FROM b GROUP BY image_id"""


@register(_eps_sql(False))
def eps_documents(spark, sf_dir):
    return export.to_eps(_images(spark, sf_dir))


@register(_eps_sql(True))
def eps_documents_batch(spark, sf_dir):
    return export.to_eps(_images(spark, sf_dir), "plain")


_PAIR = lambda code, value: f"'{code}' || chr(10) || {value}"
_LINES = lambda *pairs: " || chr(10) || ".join(_PAIR(c, v) for c, v in pairs)


@register(
    f"""WITH {_LAYERED}, t AS (SELECT image_id, layer_no, path_id, {_LINES((0, "'LWPOLYLINE'"), (8, 'any_value(name)'), (90, 'count(*)'), (70, "'1'"))} || chr(10) || string_agg({_LINES((10, fixed_sql('x', 4)), (20, fixed_sql('40 - y', 4)))}, chr(10) ORDER BY pos) AS body FROM l GROUP BY image_id, layer_no, path_id),
b AS (SELECT image_id, string_agg(body, chr(10) ORDER BY layer_no, path_id) AS body FROM t GROUP BY image_id),
n AS (SELECT image_id, count(*) + 1 AS n, string_agg({_LINES((0, "'LAYER'"), (2, 'name'), (70, "'0'"), (62, 'layer_no'), (6, "'CONTINUOUS'"))}, chr(10) ORDER BY layer_no) AS body FROM (SELECT DISTINCT image_id, layer_no, name FROM l) GROUP BY image_id)
SELECT n.image_id, {_LINES((0, "'SECTION'"), (2, "'HEADER'"), (0, "'ENDSEC'"), (0, "'SECTION'"), (2, "'TABLES'"), (0, "'TABLE'"), (2, "'LAYER'"), (70, 'n.n'), (0, "'LAYER'"), (2, "'0'"), (70, "'0'"), (62, "'7'"), (6, "'CONTINUOUS'"))} || chr(10) || n.body || chr(10) || {_LINES((0, "'ENDTAB'"), (0, "'ENDSEC'"), (0, "'SECTION'"), (2, "'ENTITIES'"))} || chr(10) || b.body || chr(10) || {_LINES((0, "'ENDSEC'"), (0, "'EOF'"))} || chr(10) AS text FROM n JOIN b ON b.image_id = n.image_id"""
)
def dxf_documents(spark, sf_dir):
    return export.to_dxf(_images(spark, sf_dir))


@register(f"WITH {_LAYERED}, a AS (SELECT DISTINCT image_id FROM l) SELECT image_id, format, true AS same FROM a, (SELECT unnest(['svg', 'eps', 'dxf']) AS format)")
def written_documents(spark, sf_dir):
    """All documents written by the executors, as rows and as files, and read again: each is what was written, by digests of the bytes."""
    texts = export.exports(staged(_images(spark, sf_dir)))
    rows, files = fresh(spark, "vectors"), fresh(spark, "files")
    export.write_vectors(texts, rows)
    export.write_files(texts, files)
    names = spark.read.parquet(rows).select("image_id", "format", F.sha2(F.encode("text", "utf-8"), 256).alias("row"))
    return export.file_digests(names, files).select("image_id", "format", F.coalesce(F.col("row") == F.col("sha256"), F.lit(False)).alias("same"))


#: Documents of an archive, about.
ARCHIVED = 3000


@register(SQL["written_documents"])
def archived_documents(spark, sf_dir):
    """All documents in archives that the executors write, and read again: each is what was written, by digests of the bytes."""
    texts = staged(export.exports(_images(spark, sf_dir)))
    folder = fresh(spark, "archives")
    export.write_archives(texts, folder, max(8, texts.count() // ARCHIVED))
    digest = lambda df, name: df.select(F.col("image_id").cast("long").alias("image_id"), "format", F.sha2(F.encode("text", "utf-8"), 256).alias(name))
    both = digest(texts, "text").join(digest(export.read_archives(spark, folder), "file"), ["image_id", "format"], "full")
    return both.select("image_id", "format", F.coalesce(F.col("text") == F.col("file"), F.lit(False)).alias("same"))


@register(SQL["queue_latest"])
def queue_streamed(spark, sf_dir):
    """The state of queue items from a stream over all events, in micro-batches of a file."""
    events, folder = catalogue._queue_events(spark, sf_dir).withColumn("at", F.col("at").cast("timestamp")), fresh(spark, "queue")
    # no event is late here: they are of one month
    events.repartitionByRange(4, "at").write.parquet(f"{folder}/events")
    return queue.run_stream(spark, f"{folder}/events", events.schema, folder, "60 days").drop("updated_at")


_STORED = "WITH a AS (SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, c_custkey AS size FROM customer WHERE c_custkey % 2 = 0), b AS (SELECT CAST(c_custkey AS VARCHAR) AS id, c_mktsegment AS name, c_nationkey AS size FROM customer WHERE c_custkey % 3 = 0)"


@register(f"{_STORED} SELECT id, coalesce(b.name, a.name) AS name, CAST(coalesce(b.size, a.size) AS BIGINT) AS size FROM a FULL JOIN b USING (id) WHERE CAST(id AS BIGINT) % 5 <> 0")
def stored_rows(spark, sf_dir):
    """A keyed store after an insert, an upsert that overlaps it, and a delete."""
    c = derived.table(spark, sf_dir, "customer")
    kept = store.Store(spark, fresh(spark, "store"), "name string, size long")
    kept.put(c.where("c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.col("c_custkey").alias("size")))
    kept.put(c.where("c_custkey % 3 = 0").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_mktsegment").alias("name"), F.col("c_nationkey").cast("long").alias("size")))
    kept.delete(c.where("c_custkey % 5 = 0").select(F.col("c_custkey").cast("string").alias("id")))
    return kept.all()


@register("SELECT * FROM (VALUES ('cleared', 'none', 50.0::DOUBLE, 'system'), ('saved', 'polygon', 20.0::DOUBLE, 'dark'), ('broken', 'none', 50.0::DOUBLE, 'system'), ('older', 'none', 30.0::DOUBLE, 'system')) t(name, mode, slider, theme)")
def preferences(spark, sf_dir):
    """Preferences saved and loaded, of bad JSON, of an older form, and cleared."""
    saved = store.load_state(store.dump_state(store.DEFAULT_STATE | {"settings": settings.DEFAULTS | {"mode": "polygon"}, "sliderPosition": 20, "theme": "dark"}))
    states = {"cleared": store.cleared_state(), "saved": saved, "broken": store.load_state("{"), "older": store.load_state('{"settings": {"paletteSize": 3, "mode": "polygon"}, "sliderPosition": 30, "theme": "neon"}')}
    return spark.createDataFrame([(k, s["settings"]["mode"], float(s["sliderPosition"]), s["theme"]) for k, s in states.items()], "name string, mode string, slider double, theme string")


@register("SELECT 8 AS palette_size, 2.5::DOUBLE AS simplify_tolerance, 10 AS speckle_threshold, 8 AS max_layer_count")
def batch_flags(spark, sf_dir):
    """Options of a batch from flags: numbers where they parse; unknown ones are ignored."""
    o = settings.parse_flags(["--palette-size", "8", "--simplify-tolerance", "2.5", "--speckle-threshold", "many", "--unknown", "1"])
    return spark.createDataFrame([(o.palette_size, o.simplify_tolerance, o.speckle_threshold, o.max_layer_count)], "palette_size int, simplify_tolerance double, speckle_threshold int, max_layer_count int")


_ITEMS = "i AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS name, CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS pos, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'queued' ELSE 'processing' END AS status, o_orderdate AS created_at FROM orders WHERE o_orderkey % 2 = 0)"


def _items(spark, sf_dir) -> DataFrame:
    """A queue: the orders of even keys, each in a state."""
    o = derived.table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0")
    empty = spark.createDataFrame([], "id string, name string, pos long, status string, created_at timestamp, o_orderkey long")
    # positions follow the keys: an enqueue into an empty queue, whose time is the key
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "queued").otherwise("processing")
    rows = o.select(F.lpad(F.col("o_orderkey").cast("string"), 20, "0").alias("id"), F.col("o_orderpriority").alias("name"), F.lit(0).cast("long").alias("pos"), status.alias("status"), F.timestamp_seconds(F.lit(0)).alias("created_at"), "o_orderkey", F.col("o_orderdate").alias("when"))
    placed = queue.enqueue(empty.withColumn("when", F.lit(None).cast("timestamp_ntz")), rows)
    return placed.select(F.col("o_orderkey").cast("string").alias("id"), "name", "pos", "status", F.col("when").alias("created_at"))


@register(f"WITH {_ITEMS} SELECT id, name, pos, status FROM i")
def queue_appended(spark, sf_dir):
    """Items appended in their order, numbered without a window over all of them."""
    return _items(spark, sf_dir).select("id", "name", "pos", "status")


@register(f"WITH {_ITEMS} SELECT id, pos FROM i WHERE status = 'queued' ORDER BY pos LIMIT 1")
def queue_next(spark, sf_dir):
    return queue.next_queued(_items(spark, sf_dir)).select("id", "pos")


@register(f"WITH {_ITEMS} SELECT (SELECT bool_or(status = 'processing') FROM i) AS processing, (SELECT bool_or(status = 'done') FROM i) AS done")
def queue_flags(spark, sf_dir):
    return queue.flags(_items(spark, sf_dir))


@register(f"WITH {_ITEMS} SELECT id, pos, CASE WHEN id = '4' THEN 'canceled' ELSE status END AS status FROM i WHERE CAST(id AS BIGINT) % 3 <> 0")
def queue_removed(spark, sf_dir):
    """Items removed by id, and one row changed."""
    items = _items(spark, sf_dir)
    gone = items.where(F.col("id").cast("long") % 3 == 0)
    return queue.set_row(queue.remove(items, gone), "4", status="canceled").select("id", "pos", "status")


@register(f"WITH {_ITEMS} SELECT i.id, i.name, l.svg FROM i JOIN (SELECT CAST(l_orderkey AS VARCHAR) AS id, string_agg(l_partkey, ' ' ORDER BY l_partkey) AS svg FROM lineitem GROUP BY l_orderkey) l ON l.id = i.id WHERE i.status = 'done'")
def queue_results(spark, sf_dir):
    """Finished items with their results."""
    results = derived.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("l_partkey")), lambda x: x.cast("string")), " ").alias("svg"))
    return queue.done_results(_items(spark, sf_dir), results)


@register(f"WITH {_ITEMS} SELECT id, (SELECT arg_max(CAST(event_id AS VARCHAR), (ts, event_id)) FROM events) AS settings FROM (SELECT id FROM i WHERE status = 'queued' ORDER BY pos LIMIT 1)")
def queue_dispatched(spark, sf_dir):
    """The next item with the settings that hold when it is dispatched."""
    events = derived.table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("text"), F.struct("ts", "event_id").alias("at"))
    return queue.dispatched(_items(spark, sf_dir), events).select("id", "settings")


@register("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'Processing ' || o_orderkey % 100 || '%' WHEN 1 THEN 'Done' WHEN 2 THEN 'Failed' WHEN 3 THEN 'Canceled' ELSE 'Queued' END AS text, CAST(floor(o_totalprice / 1024 + 0.5) AS BIGINT) AS kb FROM orders")
def queue_texts(spark, sf_dir):
    o = derived.table(spark, sf_dir, "orders")
    status = F.element_at(F.array(*map(F.lit, ("processing", "done", "error", "canceled", "queued"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return o.select("o_orderkey", queue.status_text(status, F.col("o_orderkey") % 100).alias("text"), queue.size_kb(F.col("o_totalprice")).alias("kb"))


@register("SELECT p_name AS name, CAST(p_size AS BIGINT) AS size, 'queued' AS status, 0 AS progress, true AS named, true AS timed FROM part")
def queue_new_items(spark, sf_dir):
    """New items of files: each has an id of its own and the time at which it came."""
    new = store.new_items(derived.table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_size").cast("long").alias("size")))
    iso = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{3}Z$"
    return new.select("name", "size", "status", "progress", F.col("id").rlike("^[0-9a-f-]{36}$").alias("named"), (F.col("created_at").rlike(iso) & (F.col("created_at") == F.col("updated_at"))).alias("timed"))
