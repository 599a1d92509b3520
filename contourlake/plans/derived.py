"""Rasters, masks and paths derived from the star-schema tables, the same way in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WIDTH, HEIGHT = 31, 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(c: str):
    return F.floor(F.col(c) * 100 + 0.5).cast("long")


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image for each event type of each 10,000 events: day by hour, channels from counts and sums; missing cells are transparent."""
    e = table(spark, sf_dir, "events").select(F.concat("event_type", F.lit("_"), F.expr("event_id div 10000").cast("string")).alias("image_id"), (F.dayofmonth("ts") - 1).alias("x"), F.hour("ts").alias("y"), cents("value").alias("c"), "event_id")
    out = e.groupBy("image_id", "x", "y").agg(F.count("*").alias("n"), F.sum("c").alias("c"), F.sum("event_id").alias("e"))
    return out.select(
        "image_id", F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"), "x", "y", "n",
        F.least(F.lit(255), 24 * F.col("n")).cast("int").alias("r"), F.least(F.lit(255), F.expr("c div 100")).cast("int").alias("g"), (F.col("e") % 256).cast("int").alias("b"),
        F.when(F.col("e") % 5 == 0, 0).otherwise(255).alias("a"),
    )


RASTER = """r AS (SELECT event_type || '_' || CAST(event_id // 10000 AS VARCHAR) AS image_id, 31 AS width, 24 AS height, CAST(day(ts) - 1 AS INTEGER) AS x, CAST(hour(ts) AS INTEGER) AS y,
  CAST(count(*) AS BIGINT) AS n, CAST(least(255, 24 * count(*)) AS INTEGER) AS r,
  CAST(least(255, CAST(sum(CAST(floor(value * 100 + 0.5) AS BIGINT)) AS BIGINT) // 100) AS INTEGER) AS g,
  CAST(sum(event_id) % 256 AS INTEGER) AS b, CASE WHEN sum(event_id) % 5 = 0 THEN 0 ELSE 255 END AS a
  FROM events GROUP BY event_type, event_id // 10000, day(ts), hour(ts))"""


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raster with a row for every cell; missing ones are black and transparent."""
    r = raster(spark, sf_dir)
    grid = r.select("image_id").distinct().select("image_id", F.explode(F.sequence(F.lit(0), F.lit(WIDTH - 1))).alias("x")).select("image_id", "x", F.explode(F.sequence(F.lit(0), F.lit(HEIGHT - 1))).alias("y"))
    full = grid.join(r.drop("width", "height", "n"), ["image_id", "x", "y"], "left").fillna(0, ["r", "g", "b", "a"])
    return full.select("image_id", F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"), "x", "y", "r", "g", "b", "a")


DENSE = (
    RASTER
    + """, d AS (SELECT i.image_id, 31 AS width, 24 AS height, gx.x, gy.y, coalesce(r.r, 0) AS r, coalesce(r.g, 0) AS g, coalesce(r.b, 0) AS b, coalesce(r.a, 0) AS a
  FROM (SELECT DISTINCT image_id FROM r) i, (SELECT CAST(unnest(range(31)) AS INTEGER) AS x) gx, (SELECT CAST(unnest(range(24)) AS INTEGER) AS y) gy
  LEFT JOIN r ON r.image_id = i.image_id AND r.x = gx.x AND r.y = gy.y)"""
)


def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two masks an image: cells with at least its mean count (label 0), and the others (label 1)."""
    w = Window.partitionBy("image_id")
    busy = F.col("n") * F.count("*").over(w) >= F.sum("n").over(w)
    return raster(spark, sf_dir).select("image_id", F.when(busy, 0).otherwise(1).alias("label"), "x", "y", "width", "height")


MASK = (
    RASTER
    + """, m AS (SELECT image_id, CASE WHEN n * count(*) OVER w >= sum(n) OVER w THEN 0 ELSE 1 END AS label, x, y, width, height
  FROM r WINDOW w AS (PARTITION BY image_id))"""
)


def ledger(spark: SparkSession, sf_dir: str, repeated: bool = False) -> DataFrame:
    """One mask over all of lineitem: ship day by supplier, a bit where there is a line; it grows with the suppliers, over many tiles. repeated: a row a line."""
    day = F.datediff("l_shipdate", F.lit("1992-01-01").cast("date"))
    bits = table(spark, sf_dir, "lineitem").select(F.lit("ledger").alias("image_id"), F.lit(0).alias("label"), day.alias("x"), F.col("l_suppkey").cast("int").alias("y"), F.lit(LEDGER_WIDTH).alias("width"), F.lit(LEDGER_HEIGHT).alias("height"))
    return bits if repeated else bits.distinct()


#: Days that a ship date may lie after the first one, and more lines than there are suppliers.
LEDGER_WIDTH, LEDGER_HEIGHT = 2700, 100_000_000
LEDGER = f"""m AS (SELECT DISTINCT 'ledger' AS image_id, 0 AS label, CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS INTEGER) AS x, CAST(l_suppkey AS INTEGER) AS y, {LEDGER_WIDTH} AS width, {LEDGER_HEIGHT} AS height FROM lineitem)"""


def order_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of one path an order: (quantity, price in cents) of its lines."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path_id"), "l_linenumber", F.col("l_quantity").cast("long").alias("x"), cents("l_extendedprice").alias("y"))
    pos = F.row_number().over(Window.partitionBy("path_id").orderBy("l_linenumber", "x", "y")) - 1
    return li.select("path_id", pos.alias("pos"), "x", "y")


PATH = """p AS (SELECT path_id, CAST(row_number() OVER (PARTITION BY path_id ORDER BY l_linenumber, x, y) - 1 AS INTEGER) AS pos, x, y FROM
  (SELECT l_orderkey AS path_id, l_linenumber, CAST(l_quantity AS BIGINT) AS x, CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS y FROM lineitem))"""

#: Paths with their cyclic neighbours up to two steps away.
RING = (
    PATH
    + """, q AS (SELECT *, count(*) OVER (PARTITION BY path_id) AS n FROM p),
g AS (SELECT a.*, b1.x AS px, b1.y AS py, c1.x AS nx, c1.y AS ny, b2.x AS ppx, b2.y AS ppy, c2.x AS nnx, c2.y AS nny FROM q a
  JOIN p b1 ON b1.path_id = a.path_id AND b1.pos = (a.pos - 1 + a.n) % a.n JOIN p c1 ON c1.path_id = a.path_id AND c1.pos = (a.pos + 1) % a.n
  JOIN p b2 ON b2.path_id = a.path_id AND b2.pos = (a.pos - 2 + 2 * a.n) % a.n JOIN p c2 ON c2.path_id = a.path_id AND c2.pos = (a.pos + 2) % a.n)"""
)


def drawing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of closed paths on canvases of 60 by 40, one canvas for each 64 order keys: image_id, path_id, pos, x, y, color."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path_id"), "l_linenumber", F.col("l_quantity").cast("long").alias("x"), (F.col("l_partkey") % 40).alias("y"))
    pos = F.row_number().over(Window.partitionBy("path_id").orderBy("l_linenumber", "x", "y")) - 1
    color = F.element_at(F.array(*map(F.lit, DRAWN)), (F.col("path_id") % 3 + 1).cast("int"))
    return li.select(F.expr("path_id div 64").alias("image_id"), "path_id", pos.alias("pos"), "x", "y", color.alias("color"))


DRAWN = ("#30783c", "#ff0000", "#0a141e")
DRAWING = """p AS (SELECT path_id, CAST(row_number() OVER (PARTITION BY path_id ORDER BY l_linenumber, x, y) - 1 AS INTEGER) AS pos, x, y FROM
  (SELECT l_orderkey AS path_id, l_linenumber, CAST(l_quantity AS BIGINT) AS x, l_partkey % 40 AS y FROM lineitem))"""
#: The same with cyclic neighbours, images and colours.
DRAWN_RING = DRAWING + RING[len(PATH) :] + ", h AS (SELECT *, path_id // 64 AS image_id, ['#30783c', '#ff0000', '#0a141e'][path_id % 3 + 1] AS color FROM g)"


def order_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored paths: a layer for each customer, a path for each order."""
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("layer"), F.col("o_orderkey").alias("pos"), (cents("o_totalprice") % 1000).alias("area"))


AREA = "s AS (SELECT o_custkey AS layer, o_orderkey AS pos, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) % 1000 AS area FROM orders)"
