"""Masks over many tiles against plain walks over the whole mask."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from contourlake.operators import graph, masks, tiles


def _mask(spark, grids):
    rows = [(name, 0, int(x), int(y), g.shape[1], g.shape[0]) for name, g in grids.items() for y, x in zip(*np.nonzero(g), strict=True)]
    return spark.createDataFrame(rows, "image_id string, label int, x int, y int, width int, height int")


def _filled(grid):
    """{(x, y): smallest place it is connected to}."""
    out, width = {}, grid.shape[1]
    for y, x in zip(*np.nonzero(grid), strict=True):
        if (x, y) in out:
            continue
        todo, place = [(x, y)], int(y) * width + int(x)
        out[x, y] = place
        while todo:
            a, b = todo.pop()
            for p in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                if 0 <= p[0] < width and 0 <= p[1] < grid.shape[0] and grid[p[1], p[0]] and p not in out:
                    out[p] = place
                    todo.append(p)
    return out


def _outlines(grid):
    """Outlines by a walk over all edges in row order, last edge first at corners."""
    set_ = lambda x, y: 0 <= x < grid.shape[1] and 0 <= y < grid.shape[0] and grid[y, x]
    leaving = {}
    for y, x in zip(*map(np.ndarray.tolist, np.nonzero(grid)), strict=True):
        for other, a, b in (((x, y - 1), (x, y), (x + 1, y)), ((x + 1, y), (x + 1, y), (x + 1, y + 1)), ((x, y + 1), (x + 1, y + 1), (x, y + 1)), ((x - 1, y), (x, y + 1), (x, y))):
            if not set_(*other):
                leaving.setdefault(a, []).append(b)
    out = []
    for start in list(leaving):
        while leaving[start]:
            loop, at = [start], leaving[start].pop()
            while at != start:
                loop.append(at)
                at = leaving[at].pop()
            out.append(loop)
    return out


def _loops(segments):
    """Undirected loops from their topmost, then leftmost vertex, to the right."""
    around = {}
    for a, b in segments:
        around.setdefault(a, []).append(b)
        around.setdefault(b, []).append(a)
    left, out = set(around), []
    for start in sorted(around, key=lambda p: (p[1], p[0])):
        if start not in left:
            continue
        loop, at = [start], max(around[start])
        left.discard(start)
        while at != start:
            loop.append(at)
            left.discard(at)
            at = next(q for q in around[at] if q != loop[-2])
        out.append(loop)
    return out


def _paths(df):
    found = {}
    for r in df.orderBy("path", "pos").collect():
        found.setdefault((r["image_id"], r["path"]), []).append((r["x"], r["y"]))
        assert r["pos"] == len(found[r["image_id"], r["path"]]) - 1
    return found


def _spiral(n):
    grid = np.zeros((n, n), bool)
    x = y = 0
    dx, dy, grid[0, 0] = 1, 0, True
    while True:
        a, b = x + dx, y + dy
        c, d = a + dx, b + dy
        if not (0 <= a < n and 0 <= b < n) or (0 <= c < n and 0 <= d < n and grid[d, c]):
            dx, dy = -dy, dx
            a, b = x + dx, y + dy
            if grid[b, a] or not (0 <= a + dx < n and 0 <= b + dy < n) or grid[b + dy, a + dx]:
                return grid
        x, y = a, b
        grid[y, x] = True


@pytest.fixture(scope="module")
def grids():
    rng = np.random.default_rng(7)
    return {"noise": rng.random((23, 29)) < 0.55, "thin": rng.random((17, 20)) < 0.4, "full": np.ones((16, 16), bool), "spiral": _spiral(21), "ring": np.pad(np.zeros((9, 9), bool), 4, constant_values=True), "diagonal": np.eye(14, dtype=bool), "cross": np.eye(14, dtype=bool) | np.eye(14, dtype=bool)[::-1]}


@pytest.mark.parametrize("side", [4, 7, 256])
def test_components_over_tiles(spark, monkeypatch, grids, side):
    monkeypatch.setattr(tiles, "TILE", side)
    got = {(r["image_id"], r["x"], r["y"]): r["component"] for r in masks.components(_mask(spark, grids).withColumn("more", F.lit(1))).collect()}
    assert got == {(name, x, y): c for name, g in grids.items() for (x, y), c in _filled(g).items()}


@pytest.mark.parametrize("side", [4, 256])
def test_outlines_over_tiles(spark, monkeypatch, grids, side):
    monkeypatch.setattr(tiles, "TILE", side)
    found = _paths(masks.trace_edges(_mask(spark, grids)))
    want = sorted((name, loop) for name, g in grids.items() for loop in _outlines(g))
    assert sorted((k[0], loop) for k, loop in found.items()) == want


@pytest.mark.parametrize("side", [5, 256])
def test_loops_over_tiles(spark, monkeypatch, grids, side):
    monkeypatch.setattr(tiles, "TILE", side)
    segments = masks.cell_segments(masks.marching_cells(_mask(spark, grids)))
    own = {}
    for r in segments.collect():
        own.setdefault(r["image_id"], []).append(((r["sx"], r["sy"]), (r["ex"], r["ey"])))
    found = _paths(masks.trace_loops(segments))
    assert sorted((k[0], loop) for k, loop in found.items()) == sorted((name, loop) for name, s in own.items() for loop in _loops(s))


def test_long_contour(spark):
    # a comb: one contour of over 100,000 edges through many tiles
    grid = np.zeros((600, 400), bool)
    grid[:, ::2] = True
    grid[0] = True
    got = masks.trace_edges(_mask(spark, {"comb": grid})).groupBy("path").agg(F.count("*").alias("n"), F.max("pos").alias("last"), F.countDistinct("pos").alias("places")).collect()
    want = _outlines(grid)
    assert len(want) == 1 and [(r["n"], r["last"], r["places"]) for r in got] == [(len(want[0]), len(want[0]) - 1, len(want[0]))] and len(want[0]) > 200_000


def test_graph_operators(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (240, 2))] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 560)]
    df = spark.createDataFrame([(k, a, b) for k in ("u", None) for a, b in pairs], "k string, a long, b long").select(F.struct("k").alias("key"), "a", "b")
    label = {v: v for p in pairs for v in p if p[0] != p[1]}
    while any(label[a] != label[b] for a, b in pairs if a != b):
        for a, b in pairs:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = graph.components(df).collect()
    assert len(got) == 2 * len(label) and all(label[r["id"]] == r["component"] for r in got)
    # lists and rings of elements of different lengths
    links = [(10, 7, 2), (7, 12, 3), (12, None, 1), (20, 31, 5), (31, 25, 1), (25, 20, 4), (40, 40, 6)]
    got = {r["id"]: (r["head"], r["before"], r["closed"]) for r in graph.ranked(spark.createDataFrame([("k", *x) for x in links], "k string, id long, next long, n long").select(F.struct("k").alias("key"), "id", "next", "n")).collect()}
    assert got == {10: (10, 0, False), 7: (10, 2, False), 12: (10, 5, False), 20: (20, 0, True), 31: (20, 5, True), 25: (20, 6, True), 40: (40, 0, True)}


def test_kmeans_of_many_blocks(spark, monkeypatch):
    from contourlake.functions.numbers import Lcg
    from contourlake.operators import kmeans

    rng = np.random.default_rng(5)
    grids = {"a": rng.integers(0, 256, (9, 11, 3)), "flat": np.full((6, 7, 3), 40), "few": rng.integers(0, 2, (8, 8, 3)) * 200}
    alpha = {name: np.where(rng.random(g.shape[:2]) < 0.2, 0, 255) for name, g in grids.items()}
    grids["clear"], alpha["clear"] = np.zeros((4, 4, 3), int), np.zeros((4, 4), int)
    rows = [(name, g.shape[1], g.shape[0], x, y, *map(int, g[y, x]), int(alpha[name][y, x])) for name, g in grids.items() for y in range(g.shape[0]) for x in range(g.shape[1])]
    df = spark.createDataFrame(rows, "image_id string, width int, height int, x int, y int, r int, g int, b int, a int")
    key = lambda r: (r["image_id"], r["y"], r["x"])
    for order in (False, True):
        whole = sorted(kmeans.quantize(df, 4, order).collect(), key=key)
        with monkeypatch.context() as m:
            m.setattr(kmeans, "BLOCK", 10)
            assert sorted(kmeans.quantize(df, 4, order).collect(), key=key) == whole
        for name, g in grids.items():
            own = [r for r in whole if r["image_id"] == name]
            seen = [r for r in own if r["a"] >= 8]
            assert all((r["label"], r["hex"]) == ((None, None) if order else (0, own[0]["hex"] if not seen else r["hex"])) for r in own if r["a"] < 8)
            if seen and not order:
                label, centers = kmeans.cluster(np.array([(r["r"], r["g"], r["b"]) for r in seen]), 4, Lcg(kmeans.seed_state(g.shape[1], g.shape[0], 4)))
                names = ["#%02x%02x%02x" % tuple(np.floor(c + 0.5).astype(int)) for c in centers]
                assert [(r["label"], r["hex"]) for r in seen] == [(int(v), names[v]) for v in label]
