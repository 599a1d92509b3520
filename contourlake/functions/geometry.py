"""Planar geometry on columns of coordinates and on arrays of points."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import to_fixed

POINTS = "array<struct<x:double,y:double>>"


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def dist(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.hypot((ax - bx).cast("double"), (ay - by).cast("double"))


def to_radians(degrees: Column) -> Column:
    return F.radians(degrees.cast("double"))


def turning_angle(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """The angle between two steps in radians; 0 where a step has no length."""
    size = F.hypot(ax.cast("double"), ay.cast("double")) * F.hypot(bx.cast("double"), by.cast("double"))
    return F.when(size == 0, F.lit(0.0)).otherwise(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ax * bx + ay * by) / size))))


def interior_angle(px: Column, py: Column, x: Column, y: Column, nx: Column, ny: Column) -> Column:
    """The angle at (x, y) in degrees; 180 where an arm has no length."""
    ax, ay, bx, by = px - x, py - y, nx - x, ny - y
    size = F.hypot(ax.cast("double"), ay.cast("double")) * F.hypot(bx.cast("double"), by.cast("double"))
    return F.when(size == 0, F.lit(180.0)).otherwise(F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ax * bx + ay * by) / size)))))


def line_distance(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """From a point to the line through a and b; to a where both are one point."""
    dx, dy = bx - ax, by - ay
    size = F.hypot(dx.cast("double"), dy.cast("double"))
    return F.when(size == 0, dist(x, y, ax, ay)).otherwise(F.abs(dy * x - dx * y + bx * ay - by * ax) / size)


def orientation(ax, ay, bx, by, cx, cy) -> Column:
    return (by - ay) * (cx - bx) - (bx - ax) * (cy - by)


def _on_segment(ax, ay, bx, by, cx, cy) -> Column:
    return (F.least(ax, cx) <= bx) & (bx <= F.greatest(ax, cx)) & (F.least(ay, cy) <= by) & (by <= F.greatest(ay, cy))


def segments_intersect(a: tuple, b: tuple, c: tuple, d: tuple) -> Column:
    """Whether segments a-b and c-d have a point in common; a, b, c, d are pairs of columns."""
    o1, o2 = orientation(*a, *b, *c), orientation(*a, *b, *d)
    o3, o4 = orientation(*c, *d, *a), orientation(*c, *d, *b)
    touch = ((o1 == 0) & _on_segment(*a, *c, *b)) | ((o2 == 0) & _on_segment(*a, *d, *b)) | ((o3 == 0) & _on_segment(*c, *a, *d)) | ((o4 == 0) & _on_segment(*c, *b, *d))
    return touch | (((o1 > 0) != (o2 > 0)) & ((o3 > 0) != (o4 > 0)))


def parallel_forward(ax, ay, bx, by) -> Column:
    return (F.abs(ax * by - ay * bx) < 1e-6) & (ax * bx + ay * by > 0)


def clamp_point(x: Column, y: Column, width: Column, height: Column, digits: int = 2) -> Column:
    """Inside the canvas, rounded to decimals."""
    inside = lambda v, most: F.least(most.cast("double"), F.greatest(F.lit(0.0), v.cast("double")))
    return point(to_fixed(inside(x, width), digits).cast("double"), to_fixed(inside(y, height), digits).cast("double"))


def clamp_handle(ax: Column, ay: Column, cx: Column, cy: Column, most: Column) -> Column:
    """A Bezier handle no further than `most` from its anchor."""
    d = dist(cx, cy, ax, ay)
    s = most / d
    return F.when(most <= 0, point(ax, ay)).when((d <= most) | (d == 0), point(cx, cy)).otherwise(point(ax + (cx - ax) * s, ay + (cy - ay) * s))


def half_pixel(x: Column, y: Column) -> Column:
    """Coordinates of doubled integers, shifted by half a pixel."""
    return point(x / 2.0 - 0.5, y / 2.0 - 0.5)


def edge_key(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """One key for an edge and its reverse."""
    p, q = F.struct(ax.alias("x"), ay.alias("y")), F.struct(bx.alias("x"), by.alias("y"))
    return F.struct(F.least(p, q).alias("a"), F.greatest(p, q).alias("b"))


def cubic(a: Column, b: Column, c: Column, d: Column, t: Column) -> Column:
    u = F.lit(1.0) - t
    return u * u * u * a + F.lit(3.0) * u * u * t * b + F.lit(3.0) * u * t * t * c + t * t * t * d


def sample_cubic(a: Column, b: Column, c: Column, d: Column, steps: int = 10) -> Column:
    """steps + 1 points on a cubic with control points a to d (structs)."""
    return F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda k: point(cubic(a["x"], b["x"], c["x"], d["x"], k / float(steps)), cubic(a["y"], b["y"], c["y"], d["y"], k / float(steps))))


def sample_spline(points: Column, steps: int = 10) -> Column:
    """Points on a chain of cubics: windows of 4 control points, 3 apart; a cubic's first point is its forerunner's last."""
    starts = F.filter(F.transform(points, lambda p, i: i), lambda i: (i % 3 == 0) & (i + 3 < F.size(points)))
    at = lambda i, k: F.element_at(points, i + k + 1)
    pieces = F.transform(starts, lambda i: F.when(i == 0, sample_cubic(at(i, 0), at(i, 1), at(i, 2), at(i, 3), steps)).otherwise(F.slice(sample_cubic(at(i, 0), at(i, 1), at(i, 2), at(i, 3), steps), 2, steps)))
    return F.flatten(pieces)


def shift(points: Column, dx: Column, dy: Column) -> Column:
    return F.transform(points, lambda p: point(p["x"] + dx, p["y"] + dy))


def split_rings(rings: Column) -> Column:
    """points: the first ring of 3 points or more; holes: the others."""
    fine = F.filter(rings, lambda r: F.size(r) >= 3)
    return F.struct(F.coalesce(F.try_element_at(fine, F.lit(1)), F.array().cast(POINTS)).alias("points"), F.when(F.size(fine) > 1, F.slice(fine, F.lit(2), F.size(fine) - 1)).otherwise(F.array().cast(f"array<{POINTS}>")).alias("holes"))


def ring_area(points: Column) -> Column:
    """Signed shoelace area of an array of points."""
    following = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    terms = F.zip_with(points, following, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.aggregate(terms, F.lit(0.0), lambda s, v: s + v) / 2.0


def ensure_winding(points: Column, clockwise: Column) -> Column:
    return F.when((ring_area(points) < 0) == clockwise, points).otherwise(F.reverse(points))


def _greedy(points: Column, far) -> Column:
    """Points that are far from the last kept one; the last goes if near the first; the input if fewer than 3 stay."""
    empty = F.array().cast(POINTS)
    kept = F.aggregate(points, empty, lambda out, p: F.when((F.size(out) == 0) | far(F.try_element_at(out, F.lit(-1)), p), F.concat(out, F.array(p))).otherwise(out))
    closed = F.when((F.size(kept) >= 2) & ~far(F.try_element_at(kept, F.lit(1)), F.try_element_at(kept, F.lit(-1))), F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(kept)
    return F.when((F.size(points) < 3) | (F.size(closed) < 3), points).otherwise(closed)


def collapse_short(points: Column, min_len: float = 0.75) -> Column:
    return _greedy(points, lambda p, q: dist(p["x"], p["y"], q["x"], q["y"]) >= min_len)


def dedupe_near(points: Column, eps: float = 0.01) -> Column:
    return _greedy(points, lambda p, q: dist(p["x"], p["y"], q["x"], q["y"]) > eps)


def douglas_peucker_points(points: list[tuple[float, float]], eps: float) -> list[tuple[float, float]]:
    """Points kept by splitting at the first farthest point while it is further off than eps."""
    x, y = np.array(points, float).reshape(-1, 2).T
    return [points[i] for i in douglas_peucker_places(x, y, eps)]


def douglas_peucker_places(x: np.ndarray, y: np.ndarray, eps: float) -> np.ndarray:
    """The places of the points that are kept."""
    n = len(x)
    if n < 3:
        return np.arange(n)
    keep = np.zeros(n, bool)
    keep[0] = keep[-1] = True
    spans = [(0, n - 1)]
    while spans:
        a, b = spans.pop()
        if b - a < 2:
            continue
        dx, dy = x[b] - x[a], y[b] - y[a]
        size = np.sqrt(dx * dx + dy * dy)
        px, py = x[a + 1 : b], y[a + 1 : b]
        d = np.sqrt((px - x[a]) ** 2 + (py - y[a]) ** 2) if size == 0 else np.abs(dy * px - dx * py + x[b] * y[a] - y[b] * x[a]) / size
        at = int(d.argmax())
        if d[at] > eps:
            keep[a + 1 + at] = True
            spans += [(a, a + 1 + at), (a + 1 + at, b)]
    return np.flatnonzero(keep)


def chord_distances(x: np.ndarray, y: np.ndarray, a: tuple[float, float], b: tuple[float, float]) -> np.ndarray:
    """Distances of points from the line through a and b, or from the point that both are."""
    dx, dy = b[0] - a[0], b[1] - a[1]
    size = np.sqrt(dx * dx + dy * dy)
    return np.sqrt((x - a[0]) ** 2 + (y - a[1]) ** 2) if size == 0 else np.abs(dy * x - dx * y + b[0] * a[1] - b[1] * a[0]) / size


def rounding(x: np.ndarray, y: np.ndarray, a: tuple[float, float], b: tuple[float, float]) -> float:
    """By how much these distances may be off."""
    dx, dy = abs(b[0] - a[0]), abs(b[1] - a[1])
    wide, high, size = np.abs(x).max(), np.abs(y).max(), np.sqrt(dx * dx + dy * dy)
    whole = wide + high + abs(a[0]) + abs(a[1]) if size == 0 else (dy * wide + dx * high + abs(b[0] * a[1]) + abs(b[1] * a[0])) / size
    return 16 * float(np.finfo(float).eps) * whole


def _upper(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The places of the upper hull's corners, by x."""
    left, right = (int(np.lexsort((-y, k))[0]) for k in (x, -x))
    found, todo = {left, right}, [(left, right, np.arange(len(x)))]
    while todo:
        a, b, among = todo.pop()
        above = (x[b] - x[a]) * (y[among] - y[a]) - (y[b] - y[a]) * (x[among] - x[a])
        among, above = among[above > 0], above[above > 0]
        if len(among):
            m = int(among[above.argmax()])
            if m not in found:
                found.add(m)
                todo += [(a, m, among), (m, b, among)]
    out = np.array(sorted(found, key=lambda i: x[i]))
    return out


def near_hull(x: np.ndarray, y: np.ndarray, margin: float) -> np.ndarray:
    """The places of points that are not inside of the hull by more than the margin along both axes."""
    near = np.zeros(len(x), bool)
    for u, v in ((x, y), (x, -y), (y, x), (y, -x)):
        top = _upper(u, v)
        near |= np.interp(u, u[top], v[top]) - v <= margin
    return np.flatnonzero(near)


def douglas_peucker(points: Column, eps: Column) -> Column:
    """The same on arrays of points, in Arrow batches: the recursion has no built-in form."""

    @F.arrow_udf(POINTS)
    def run(rows: pa.Array, limit: pa.Array) -> pa.Array:
        flat = rows.flatten()
        x, y = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        sizes = np.array([0 if r is None else r for r in pc.list_value_length(rows).to_pylist()], np.int64)
        ends = np.cumsum(sizes)
        keep = [douglas_peucker_places(x[b - n : b], y[b - n : b], e) for b, n, e in zip(ends.tolist(), sizes.tolist(), limit.to_pylist(), strict=True)]
        at = np.concatenate([np.zeros(0, np.int64), *(k + b - n for k, b, n in zip(keep, ends, sizes, strict=True))])
        offsets = np.concatenate(([0], np.cumsum([len(k) for k in keep]))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), flat.take(pa.array(at)), mask=rows.is_null() if rows.null_count else None)

    return run(points, eps)
