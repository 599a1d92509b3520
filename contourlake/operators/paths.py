"""Operators on paths: tables of nodes (path keys, pos, x, y) whose order closes into rings.

Neighbours come from one window over a path's nodes; every path is one window
group, and all paths are worked on at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import chord_distances, clamp_point, dist, douglas_peucker_places, interior_angle, near_hull, parallel_forward, rounding, segments_intersect, turning_angle
from ..sources.stages import small_batches, staged

KEYS = ["path_id"]


def ring(nodes: DataFrame, keys: list[str] = KEYS, reach: int = 1) -> DataFrame:
    """nodes with their cyclic neighbours: px, py, nx, ny (and ppx, ppy, nnx, nny), and n, the length of the path."""
    w = Window.partitionBy(*keys).orderBy("pos")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    back = Window.partitionBy(*keys).orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = nodes.withColumn("n", F.count("*").over(Window.partitionBy(*keys)))
    for k, (before, after) in enumerate((("p", "n"), ("pp", "nn"))[:reach], 1):
        for c in "xy":
            out = out.withColumn(before + c, F.coalesce(F.lag(c, k).over(w), _from_end(c, k, w, whole, back)))
            out = out.withColumn(after + c, F.coalesce(F.lead(c, k).over(w), _from_start(c, k, w, whole)))
    return out


def _from_start(c: str, k: int, w, whole) -> Column:
    """For one of the last k nodes: the node k steps on, past the end."""
    first = F.first(c).over(whole)
    if k == 1:
        return first
    ends = F.row_number().over(w) == F.col("n")
    return F.when(ends & (F.col("n") > 1), F.nth_value(c, 2).over(whole)).otherwise(first)


def _from_end(c: str, k: int, w, whole, back) -> Column:
    last = F.last(c).over(whole)
    if k == 1:
        return last
    starts = F.row_number().over(w) == 1
    return F.when(starts & (F.col("n") > 1), F.nth_value(c, 2).over(back)).otherwise(last)


def _step() -> tuple[Column, Column, Column, Column]:
    x, y = F.col("x"), F.col("y")
    return x - F.col("px"), y - F.col("py"), F.col("nx") - x, F.col("ny") - y


def signed_area(nodes: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(keys, area): the shoelace area, negative for clockwise rings where y points up."""
    return ring(nodes, keys).groupBy(*keys).agg((F.sum(F.col("x") * F.col("ny") - F.col("nx") * F.col("y")) / 2).alias("area"))


def polygon_area(nodes: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return signed_area(nodes, keys).withColumn("area", F.abs("area"))


def winding(nodes: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(keys, clockwise)."""
    return signed_area(nodes, keys).select(*keys, (F.col("area") < 0).alias("clockwise"))


def bounds(nodes: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(keys, min_x, min_y, max_x, max_y); a path without nodes has no row."""
    return nodes.groupBy(*keys).agg(F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y"))


def vertex_centroid(nodes: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(keys, cx, cy): the mean of the nodes."""
    return nodes.groupBy(*keys).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))


def sharp_turns(nodes: DataFrame, rad: float = 0.6, keys: list[str] = KEYS) -> DataFrame:
    """(keys, sharp): turns of more than rad; 0 for fewer than 3 nodes."""
    turn = turning_angle(*_step()) > rad
    return ring(nodes, keys).groupBy(*keys).agg(F.sum(F.when(turn & (F.col("n") >= 3), 1).otherwise(0)).alias("sharp"))


def short_edges(nodes: DataFrame, min_len: float = 0.5, keys: list[str] = KEYS) -> DataFrame:
    """(keys, short): whether any edge is shorter than min_len."""
    return ring(nodes, keys).groupBy(*keys).agg(F.bool_or(dist(F.col("x"), F.col("y"), F.col("nx"), F.col("ny")) < min_len).alias("short"))


#: Edges up to which a path's edges are compared in its row, rows that an edge of a longer path gets on average at most, and what rounding may take from a cell.
FEW, CELLS, SLACK = 64, 16, 1e-6


def _touches(n: Column, p: tuple, q: tuple) -> Column:
    """Whether edges p and q, each (i, ax, ay, bx, by) with p the earlier one, are no neighbours and have a point in common."""
    (i, pa, pb, pc, pd), (j, qa, qb, qc, qd) = p, q
    boxes = (F.least(pa, pc) <= F.greatest(qa, qc)) & (F.least(qa, qc) <= F.greatest(pa, pc)) & (F.least(pb, pd) <= F.greatest(qb, qd)) & (F.least(qb, qd) <= F.greatest(pb, pd))
    return (j > i + 1) & ~((i == 0) & (j == n - 1)) & boxes & segments_intersect((pa, pb), (pc, pd), (qa, qb), (qc, qd))


EDGE = ("i", "ax", "ay", "bx", "by")


def passed_cells(nodes: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(keys, n, i, ax, ay, bx, by, cx, cy): the edges of rings, once for each cell of their path's grid that they pass.

    Cells are as wide as edges are long: a path of n edges has sqrt(n) lines of
    cells, fewer where edges are so long that they would pass over CELLS of them
    on average. An edge along the side of a cell is in both.
    """
    w = Window.partitionBy(*keys).orderBy("pos")
    edges = ring(nodes, keys).select(*keys, "n", (F.row_number().over(w) - 1).alias("i"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("nx").alias("bx"), F.col("ny").alias("by"))
    box = Window.partitionBy(*keys)
    at = {}
    for v in "xy":
        low, side = F.min(F.least(f"a{v}", f"b{v}")).over(box), F.max(F.greatest(f"a{v}", f"b{v}")).over(box)
        edges = edges.withColumn(f"low{v}", low.cast("double")).withColumn(f"side{v}", F.greatest(side - low, F.lit(1e-300)).cast("double"))
        at[v] = [(F.col(f"{e}{v}") - F.col(f"low{v}")) / F.col(f"side{v}") for e in "ab"]
    length = F.abs(at["x"][1] - at["x"][0]) + F.abs(at["y"][1] - at["y"][0])
    lines = F.floor(F.least(F.sqrt("n"), CELLS / F.greatest(F.avg(length).over(box), F.lit(1e-9))))
    edges = edges.withColumn("lines", F.greatest(lines, F.lit(1)))
    first = at["x"][0] <= at["x"][1]
    for name, v, which in (("u0", "x", 0), ("v0", "y", 0), ("u1", "x", 1), ("v1", "y", 1)):
        edges = edges.withColumn(name, F.when(first, at[v][which]).otherwise(at[v][1 - which]) * F.col("lines"))
    cell = lambda c: F.least(F.greatest(F.floor(c), F.lit(0)), F.col("lines") - 1).cast("int")
    edges = edges.withColumn("cx", F.explode(F.sequence(cell(F.col("u0") - SLACK), cell(F.col("u1") + SLACK))))
    # the part of the edge in this column of cells
    slope = F.when(F.col("u1") - F.col("u0") > SLACK, (F.col("v1") - F.col("v0")) / (F.col("u1") - F.col("u0")))
    height = lambda u: F.col("v0") + (u - F.col("u0")) * slope
    enter, leave = height(F.greatest("u0", F.col("cx") - SLACK)), height(F.least("u1", F.col("cx") + 1 + SLACK))
    low, high = F.coalesce(F.least(enter, leave), F.least("v0", "v1")), F.coalesce(F.greatest(enter, leave), F.greatest("v0", "v1"))
    return edges.withColumn("cy", F.explode(F.sequence(cell(low - SLACK), cell(high + SLACK)))).select(*keys, "n", *EDGE, "cx", "cy")


def self_intersections(nodes: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(keys, crosses): whether two edges that are no neighbours touch; false for fewer than 4 nodes.

    Paths of up to FEW edges are compared edge by edge where their row is. Edges of longer ones are
    dealt to the cells that they pass, and meet edges of the same cell.
    """
    sized = nodes.select(*keys, "pos", "x", "y").withColumn("n", F.count("*").over(Window.partitionBy(*keys)))
    rows = sized.where(F.col("n") <= FEW).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))).alias("p"))
    n = F.size("p")
    edge = lambda v, i: F.struct(i.alias("i"), v["x"].alias("ax"), v["y"].alias("ay"), F.get("p", (i + 1) % n)["x"].alias("bx"), F.get("p", (i + 1) % n)["y"].alias("by"))
    pairs = rows.select(*keys, n.alias("n"), F.transform("p", edge).alias("e")).select(*keys, "n", "e", F.explode("e").alias("a"))
    # each edge with those from the next but one on
    pairs = pairs.select(*keys, "n", "a", F.explode_outer(F.slice("e", F.col("a.i") + 3, F.col("n"))).alias("b"))
    part = lambda v: tuple(F.col(f"{v}.{c}") for c in EDGE)
    short = pairs.groupBy(*keys).agg(F.coalesce(F.bool_or((F.col("n") >= 4) & _touches(F.col("n"), part("a"), part("b"))), F.lit(False)).alias("crosses"))
    long_ = sized.where(F.col("n") > FEW).drop("n")
    cells = passed_cells(long_, keys)
    p, q = cells.alias("p"), cells.alias("q")
    same = [F.col(f"p.{k}") == F.col(f"q.{k}") for k in (*keys, "cx", "cy")]
    side = lambda s: tuple(F.col(f"{s}.{c}") for c in EDGE)
    hit = p.join(q, [*same, _touches(F.col("p.n"), side("p"), side("q"))]).select(*[F.col(f"p.{k}") for k in keys]).distinct().withColumn("crosses", F.lit(True))
    return short.unionByName(long_.select(*keys).distinct().join(hit, keys, "left").withColumn("crosses", F.coalesce("crosses", F.lit(False))))


def join_damage(raw: DataFrame, simple: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(keys, damaged): whether a simplified path lost its shape.

    Fewer than 3 nodes, a crossing, an area that differs by over 8 %, over 2
    more sharp turns, or an edge shorter than a half.
    """
    count = simple.groupBy(*keys).agg(F.count("*").alias("n"))
    base = polygon_area(raw, keys).withColumnRenamed("area", "ra").join(sharp_turns(raw, 0.6, keys).withColumnRenamed("sharp", "rs"), keys)
    own = polygon_area(simple, keys).join(sharp_turns(simple, 0.6, keys), keys).join(short_edges(simple, 0.5, keys), keys).join(self_intersections(simple, keys), keys).join(count, keys)
    gap = F.when(F.col("ra") > 0, F.abs(F.col("area") - F.col("ra")) / F.col("ra")).otherwise(0.0)
    damaged = F.col("n").isNull() | (F.col("n") < 3) | F.col("crosses") | (gap > 0.08) | (F.col("sharp") > F.col("rs") + 2) | F.col("short")
    return base.join(own, keys, "left").select(*keys, damaged.alias("damaged"))


def tiny_fragments(nodes: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(keys, tiny): area of 9 at most in a box of 4 by 4 at most."""
    return polygon_area(nodes, keys).join(bounds(nodes, keys), keys).select(*keys, ((F.col("area") <= 9) & (F.col("max_x") - F.col("min_x") <= 4) & (F.col("max_y") - F.col("min_y") <= 4)).alias("tiny"))


def keep_polygons(nodes: DataFrame, min_area: Column | float, keys: list[str] = KEYS) -> DataFrame:
    """nodes of paths of 3 nodes or more and an area of min_area or more."""
    least = min_area if isinstance(min_area, Column) else F.lit(min_area)
    fine = polygon_area(nodes, keys).join(nodes.groupBy(*keys).agg(F.count("*").alias("n")), keys).where((F.col("n") >= 3) & (F.col("area") >= least))
    return nodes.join(fine.select(*keys), keys, "left_semi")


def _kept_or_all(flagged: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows with `keep`, or all rows of a path that would keep fewer than 3."""
    kept = F.sum(F.col("keep").cast("int")).over(Window.partitionBy(*keys))
    return flagged.withColumn("kept", kept).where((F.col("kept") < 3) | F.col("keep")).select(*columns)


def drop_collinear(nodes: DataFrame, eps: float = 0.02, keys: list[str] = KEYS) -> DataFrame:
    """nodes without those nearly on the line of their original neighbours; paths of fewer than 4 nodes stay."""
    ax, ay, bx, by = _step()
    size = F.hypot(ax.cast("double"), ay.cast("double")) * F.hypot(bx.cast("double"), by.cast("double"))
    bend = (size == 0) | (F.abs(ax * by - ay * bx) / size > eps)
    return _kept_or_all(ring(nodes, keys).withColumn("keep", (F.col("n") < 4) | bend), keys, nodes.columns)


def soften_stairs(nodes: DataFrame, max_step: float = 1.35, keys: list[str] = KEYS) -> DataFrame:
    """nodes without the inner corners of staircases of short right-angled steps; paths of fewer than 6 nodes stay."""
    wide = ring(nodes, keys, 2)
    bx, by, cx, cy = _step()
    ax, ay = F.col("px") - F.col("ppx"), F.col("py") - F.col("ppy")
    dx, dy = F.col("nnx") - F.col("nx"), F.col("nny") - F.col("ny")
    small = lambda v: F.abs(v) < 1e-6
    length = lambda x, y: F.hypot(x.cast("double"), y.cast("double"))
    step = (length(bx, by) <= max_step) & (length(cx, cy) <= max_step) & small(bx * cx + by * cy) & (small(bx) | small(by)) & (small(cx) | small(cy))
    stair = parallel_forward(ax, ay, cx, cy) & parallel_forward(bx, by, dx, dy)
    return _kept_or_all(wide.withColumn("keep", (F.col("n") < 6) | ~(step & stair)), keys, nodes.columns)


def smooth(nodes: DataFrame, strength: float, corner: float, keys: list[str] = KEYS) -> DataFrame:
    """Inner nodes moved towards the middle of their neighbours unless the corner is sharp; ends stay. Open, all at once."""
    if strength <= 0:
        return nodes
    w = Window.partitionBy(*keys).orderBy("pos")
    out = nodes.withColumn("n", F.count("*").over(Window.partitionBy(*keys)))
    for c in "xy":
        out = out.withColumn(f"p{c}", F.lag(c).over(w)).withColumn(f"n{c}", F.lead(c).over(w))
    angle = interior_angle(*(F.col(c) for c in ("px", "py", "x", "y", "nx", "ny")))
    stays = (F.col("n") < 4) | F.col("px").isNull() | F.col("nx").isNull() | (angle < corner)
    move = lambda c: F.when(stays, F.col(c).cast("double")).otherwise(F.col(c) * (1 - strength) + (F.col(f"p{c}") + F.col(f"n{c}")) * 0.5 * strength)
    return out.withColumns({"__x": move("x"), "__y": move("y")}).select(*[F.col(f"__{c}").alias(c) if c in "xy" else F.col(c) for c in nodes.columns])


def chaikin(nodes: DataFrame, iterations: int, corner: float, keys: list[str] = KEYS) -> DataFrame:
    """Corners cut at a quarter of each edge, but a node stays where it or the next one is sharp; paths of fewer than 4 nodes stay."""
    columns = nodes.columns
    for _ in range(iterations):
        wide = ring(nodes, keys, 2)
        c = lambda *names: [F.col(n) for n in names]
        sharp = (F.col("n") < 4) | (interior_angle(*c("px", "py", "x", "y", "nx", "ny")) < corner) | (interior_angle(*c("x", "y", "nx", "ny", "nnx", "nny")) < corner)
        at = lambda k, t: F.struct(F.lit(k).alias("k"), *[(F.col(v) * (1 - t) + F.col(f"n{v}") * t).alias(v) for v in "xy"])
        same = F.struct(F.lit(0).alias("k"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
        cut = wide.withColumn("c", F.explode(F.when(sharp, F.array(same)).otherwise(F.array(at(0, 0.25), at(1, 0.75)))))
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("pos", "c.k")) - 1
        nodes = cut.withColumn("__pos", place).select(*[F.col("__pos").alias("pos") if n == "pos" else F.col(f"c.{n}").alias(n) if n in "xy" else F.col(n) for n in columns])
    return nodes


def relax(nodes: DataFrame, strength: float, corner: float, keys: list[str] = KEYS) -> DataFrame:
    """Nodes of closed paths of 6 or more moved towards the middle of their neighbours, once or twice."""
    if strength <= 0:
        return nodes
    blend, least = min(0.35, 0.12 + strength * 0.8), max(14.0, corner * 0.75)
    for _ in range(2 if strength >= 0.26 else 1):
        wide = ring(nodes, keys)
        stays = (F.col("n") < 6) | (interior_angle(*(F.col(c) for c in ("px", "py", "x", "y", "nx", "ny"))) < least)
        move = lambda c: F.when(stays, F.col(c).cast("double")).otherwise(F.col(c) * (1 - blend) + (F.col(f"p{c}") + F.col(f"n{c}")) * 0.5 * blend)
        nodes = wide.withColumns({"__x": move("x"), "__y": move("y")}).select(*[F.col(f"__{c}").alias(c) if c in "xy" else F.col(c) for c in nodes.columns])
    return nodes


def expand(nodes: DataFrame, amount: float, keys: list[str] = KEYS) -> DataFrame:
    """Nodes pushed away from the mean of their path, clamped to the canvas (width, height columns) and rounded."""
    if amount <= 0:
        return nodes
    w = Window.partitionBy(*keys)
    out = nodes.withColumn("cx", F.avg("x").over(w)).withColumn("cy", F.avg("y").over(w)).withColumn("n", F.count("*").over(w))
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    size = F.hypot(dx, dy)
    ux, uy = F.when(size < 1e-6, 1.0).otherwise(dx / size), F.when(size < 1e-6, 0.0).otherwise(dy / size)
    moved = out.withColumn("p", clamp_point(F.col("x") + ux * amount, F.col("y") + uy * amount, F.col("width"), F.col("height")))
    return moved.select(*[F.when(F.col("n") < 3, F.col(c).cast("double")).otherwise(F.col(f"p.{c}")).alias(c) if c in "xy" else F.col(c) for c in nodes.columns])


def to_points(nodes: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(keys, points): one row a path, its points in order."""
    return nodes.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("points"))


def to_nodes(paths: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(keys, pos, x, y) from arrays of points."""
    return paths.select(*keys, F.posexplode("points").alias("pos", "p")).select(*keys, "pos", "p.x", "p.y")


def post_process(nodes: DataFrame, clockwise: bool, keys: list[str] = KEYS) -> DataFrame:
    """Near-duplicates and short edges go, then nearly collinear nodes; then the winding is set."""
    from ..functions.geometry import collapse_short, dedupe_near, ensure_winding

    first = to_points(nodes, keys).withColumn("points", collapse_short(dedupe_near(F.col("points"))))
    bent = to_points(drop_collinear(to_nodes(first, keys), keys=keys), keys)
    return to_nodes(bent.withColumn("points", ensure_winding(F.col("points"), F.lit(clockwise))), keys)


def simplify(nodes: DataFrame, tolerance: float, smoothing: float, corner: float, keys: list[str] = KEYS) -> DataFrame:
    """Rings simplified by distance, smoothed, and with smoothing of 0.08 or more cut and relaxed; paths of fewer than 4 nodes stay."""
    from ..functions.geometry import douglas_peucker

    strength, edge = min(0.45, max(0.0, smoothing)), max(5.0, min(170.0, corner))
    points = to_points(nodes, keys)
    split = F.slice(F.col("s"), F.lit(1), F.greatest(F.size("s") - 1, F.lit(0)))
    done = points.where(F.size("points") >= 4).withColumn("s", douglas_peucker(F.concat("points", F.slice("points", 1, 1)), F.lit(float(max(0.4, tolerance))))).withColumn("points", split).drop("s")
    kept = to_nodes(points.where(F.size("points") < 4), keys)
    smoothed = smooth(to_nodes(done, keys), strength, edge, keys)
    if strength < 0.08:
        return smoothed.unionByName(kept)
    sized = smoothed.withColumn("__n", F.count("*").over(Window.partitionBy(*keys)))
    small, large = sized.where("__n < 6").drop("__n"), sized.where("__n >= 6").drop("__n")
    rounded = relax(chaikin(large, 2 if strength >= 0.22 else 1, max(18.0, min(140.0, edge * 0.85)), keys), strength, max(16.0, edge * 0.8), keys)
    return rounded.unionByName(small).unionByName(kept)


#: Nodes of a block of a line, blocks at either end of an interval that a round sees whole, and the part of a block's extent by which a node must lie inside of its hull to be left out of the outline.
LINE, WHOLE, INSIDE = 4096, 64, 1e-8


def thinned(nodes: DataFrame, eps: float, keys: list[str] = KEYS, most: int = LINE) -> DataFrame:
    """nodes (keys, pos, x, y) kept by splitting open lines at the first farthest node while it is further off than eps; pos stays.

    Lines are cut to blocks of up to `most` nodes. The node that is farthest from
    a chord lies on the outline of its block, so a round looks at outlines, and
    at all nodes of a few blocks at the ends of an interval, where lines that go
    up and down split again and again: each interval splits as often as these
    tell where. What stays open goes to the next round, which looks at the parts
    of blocks that are left. Intervals in two blocks or one end in one task.
    """
    spark = nodes.sparkSession
    own = nodes.select(F.struct(*keys).alias("key"), "pos", *[F.col(c).cast("double").alias(c) for c in "xy"])
    blocks = staged(_blocks(own, most))
    index = blocks.select("key", "at", "first", "last")
    ends = staged(index.groupBy("key").agg(F.min("first").alias("p"), F.max("last").alias("q"), F.count("*").alias("n")))
    kept = [ends.select("key", F.explode(F.array_distinct(F.array("p", "q"))).alias("m"))]
    now, short = ends.where("n > 2").select("key", "p", "q"), [ends.where("n <= 2").select("key", "p", "q")]
    here = lambda df: index.join(df, "key").where("first.pos < q.pos and last.pos > p.pos").select("key", "at", "p", "q")
    side = lambda order: F.row_number().over(Window.partitionBy("key", "p", "q").orderBy(order)) <= WHOLE
    with small_batches(spark, 8):
        while not now.isEmpty():
            ended = here(now).withColumn("whole", side(F.col("at")) | side(F.col("at").desc()))
            parts = _outlined(blocks.join(ended, ["key", "at"])).groupBy("key", "p", "q").agg(F.array_sort(F.collect_list(F.struct("at", "far", "nodes", "all"))).alias("parts"))
            found = staged(_split(parts, eps))
            kept.append(found.where("kind = 'kept'").select("key", F.col("p").alias("m")))
            short.append(found.where("kind = 'short'").select("key", "p", "q"))
            now = found.where("kind = 'open'").select("key", "p", "q")
        inner = blocks.join(here(reduce(DataFrame.unionByName, short)), ["key", "at"])
        inner = inner.select("key", "p", "q", F.filter("nodes", lambda v: (v["pos"] > F.col("p.pos")) & (v["pos"] < F.col("q.pos"))).alias("nodes")).groupBy("key", "p", "q").agg(F.array_sort(F.flatten(F.collect_list("nodes"))).alias("inner"))
        kept.append(staged(_local(inner, eps)))
    return reduce(DataFrame.unionByName, kept).select("key.*", "m.*")


def _blocks(own: DataFrame, most: int) -> DataFrame:
    """(key, at, first, last, nodes) of nodes (key, pos, x, y): runs of up to `most` nodes of a line in order; at is the first one's pos."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            edges = [pc.run_end_encode(c).run_ends.to_numpy() for c in batch.column(0).flatten()]
            ends = np.unique(np.concatenate([*edges, [batch.num_rows]]))
            starts = np.concatenate([np.arange(a, b, most) for a, b in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True)])
            offsets = pa.array(np.append(starts, batch.num_rows).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(starts)), pa.ListArray.from_arrays(offsets, batch.column(1))], names=["key", "nodes"])

    sorted_ = own.repartitionByRange("key", "pos").sortWithinPartitions("key", "pos").select("key", F.struct("pos", "x", "y").alias("node"))
    kinds = {f.name: f.dataType.simpleString() for f in sorted_.schema}
    cut = sorted_.mapInArrow(run, f"key {kinds['key']}, nodes array<{kinds['node']}>")
    return cut.select("key", F.col("nodes")[0]["pos"].alias("at"), F.col("nodes")[0].alias("first"), F.element_at("nodes", -1).alias("last"), "nodes")


def _coordinates(nodes: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(nodes.field(k).to_numpy(zero_copy_only=False) for k in range(3))


def _listed(lists: pa.ListArray) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """The coordinates of all lists' nodes, and where each list begins, with the end of the last."""
    return _coordinates(lists.flatten()), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])


def _outlined(parts: DataFrame) -> DataFrame:
    """(key, p, q, at, far, nodes, all) of the parts of blocks that intervals have: the first farthest node from the interval's chord, the outline, and all nodes of parts that are wanted whole."""
    lists = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (p, q, nodes, whole) in enumerate(zip(*(batch.column(k).to_pylist() for k in (1, 2)), *batch.columns[4:], strict=True)):
                pos, x, y = _coordinates(nodes.values)
                inside = np.flatnonzero((pos > p["pos"]) & (pos < q["pos"]))
                if not len(inside):
                    continue
                x, y = x[inside], y[inside]
                far = int(inside[chord_distances(x, y, (p["x"], p["y"]), (q["x"], q["y"])).argmax()])
                outline = nodes.values.take(pa.array(inside[near_hull(x, y, INSIDE * max(np.ptp(x), np.ptp(y)))]))
                every = nodes.values.take(pa.array(inside if whole.as_py() else inside[:0]))
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns[:4], nodes.values.take(pa.array([far])), lists(outline), lists(every)], names=["key", "p", "q", "at", "far", "nodes", "all"])

    rows = parts.select("key", "p", "q", "at", "nodes", "whole")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"key {kinds['key']}, p {kinds['p']}, q {kinds['p']}, at {kinds['at']}, far {kinds['p']}, nodes {kinds['nodes']}, all {kinds['nodes']}")


def _split(parts: DataFrame, eps: float) -> DataFrame:
    """(key, kind, p, q) of intervals with the outlines of their parts: nodes p that are kept, and intervals that are short or still open."""
    none = {"pos": None, "x": None, "y": None}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (p, q, own) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True)):
                outline, ends = _listed(own.values.field(2))
                every, begins = _listed(own.values.field(3))
                first, starts = own.values.field(1).to_pylist(), own.values.field(0).to_numpy(zero_copy_only=False)
                spread = INSIDE * min(max(np.ptp(c[k]) for k in (1, 2)) for c in ([v[j:k] for v in outline] for j, k in zip(ends, ends[1:], strict=False))) / np.sqrt(2)
                out = []
                todo = [(p, q, 0, len(first) - 1)]
                while todo:
                    a, b, low, high = todo.pop()
                    if high - low <= 1:
                        out.append(("short", a, b))
                        continue
                    s, e = (a["x"], a["y"]), (b["x"], b["y"])
                    if a is p and b is q:
                        d = chord_distances(np.array([v["x"] for v in first]), np.array([v["y"] for v in first]), s, e)
                        at = int(d.argmax())
                        m, block, far = first[at], at, d[at]
                    else:
                        # blocks in which a split lies: all of their nodes, or else what bounds them
                        left, right = (cut and bool(begins[k + 1] > begins[k]) for k, cut in ((low, a is not p), (high, b is not q)))
                        runs = [(every, begins[low], begins[low + 1])] * left + [(outline, ends[low + left], ends[high + 1 - right])] + [(every, begins[high], begins[high + 1])] * right
                        pos, x, y = (np.concatenate([v[c][j:k] for v, j, k in runs]) for c in range(3))
                        seen = (pos > a["pos"]) & (pos < b["pos"])
                        known = seen.copy()
                        if left:
                            known[: begins[low + 1] - begins[low]] = True
                        if right:
                            known[len(pos) - (begins[high + 1] - begins[high]) :] = True
                        d = chord_distances(x, y, s, e)
                        far = d[seen].max(initial=-1.0)
                        # unless rounding may hide it, what the outlines leave out is nearer than they are
                        if 2 * rounding(x, y, s, e) >= spread or d[~known].max(initial=-1.0) > max(far, eps):
                            out.append(("open", a, b))
                            continue
                        if far > eps:
                            at = int(np.flatnonzero(seen & (d == far))[0])
                            m = {"pos": pos[at].item(), "x": x[at].item(), "y": y[at].item()}
                            block = int(np.searchsorted(starts, m["pos"], "right")) - 1
                    if far > eps:
                        out.append(("kept", m, none))
                        todo += [(a, m, low, block), (m, b, block, high)]
                if out:
                    kind = batch.schema.field(1).type
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(out), i))), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), kind, kind), strict=True))], names=["key", "kind", "p", "q"])

    rows = parts.select("key", "p", "q", "parts")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"key {kinds['key']}, kind string, p {kinds['p']}, q {kinds['p']}")


def _local(intervals: DataFrame, eps: float) -> DataFrame:
    """(key, m): the nodes kept inside of short intervals (key, p, q, inner)."""
    packed = intervals.select("key", F.concat(F.array("p"), "inner", F.array("q")).alias("nodes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, line in enumerate(batch.column(1)):
                _, x, y = _coordinates(line.values)
                places = pa.array(douglas_peucker_places(x, y, eps)[1:-1])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(places), i))), line.values.take(places)], names=["key", "m"])

    kinds = {f.name: f.dataType.simpleString() for f in packed.schema}
    return packed.mapInArrow(run, f"key {kinds['key']}, m {kinds['nodes'][6:-1]}")
