"""Operators on paths of many nodes against plain loops."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from contourlake.functions.geometry import douglas_peucker_places
from contourlake.operators import paths


def _nodes(spark, lines):
    return spark.createDataFrame([(k, i, float(x), float(y)) for k, line in lines.items() for i, (x, y) in enumerate(line)], "path_id int, pos int, x double, y double")


def _meets(a, b, c, d):
    turn = lambda p, q, r: (q[1] - p[1]) * (r[0] - q[0]) - (q[0] - p[0]) * (r[1] - q[1])
    on = lambda p, q, r: min(p[0], r[0]) <= q[0] <= max(p[0], r[0]) and min(p[1], r[1]) <= q[1] <= max(p[1], r[1])
    o = [turn(a, b, c), turn(a, b, d), turn(c, d, a), turn(c, d, b)]
    return any(v == 0 and on(*t) for v, t in zip(o, ((a, c, b), (a, d, b), (c, a, d), (c, b, d)))) or ((o[0] > 0) != (o[1] > 0) and (o[2] > 0) != (o[3] > 0))


def _crosses(p):
    n = len(p)
    return n >= 4 and any(_meets(p[i], p[(i + 1) % n], p[j], p[(j + 1) % n]) for i in range(n) for j in range(i + 2, n) if not (i == 0 and j == n - 1))


def test_crossings_of_short_and_long_paths(spark):
    rng = np.random.default_rng(2)
    lines = {k: rng.integers(0, 12, (3 + k % 6, 2)).tolist() for k in range(60)}
    for k, n in ((100, 80), (101, 300), (102, 70)):
        turn = np.arange(n) / n * 2 * np.pi
        lines[k] = np.stack([np.cos(turn), np.sin(turn)], axis=1).tolist()
    # one edge of a long ring reaches over to another, a long ring of two strands that touch in a point, a thin comb, and one line there and back
    lines[101][40] = [-lines[101][40][0], -lines[101][40][1]]
    lines[103] = [[i, 0] for i in range(50)] + [[49 - i, 1 if i != 20 else 0] for i in range(50)]
    lines[104] = [[i // 2, 30 * ((i + 1) // 2 % 2)] for i in range(100)] + [[49, 40], [0, 40]]
    lines[105] = [[i, 5] for i in range(70)] + [[69, 6], [0, 6]]
    lines[106] = [[i, 5] for i in range(70)] + [[35, 5]]
    got = {r["path_id"]: r["crosses"] for r in paths.self_intersections(_nodes(spark, lines)).collect()}
    assert got == {k: _crosses([tuple(p) for p in line]) for k, line in lines.items()}
    assert {got[k] for k in range(100, 107)} == {False, True}


def test_random_chords_pass_few_cells(spark):
    rng = np.random.default_rng(3)
    chords = _nodes(spark, {1: rng.random((10_000, 2)).tolist(), 2: [(i, (i * 7) % 5) for i in range(1000)]})
    per = {r["path_id"]: r["count"] for r in paths.passed_cells(chords).groupBy("path_id").count().collect()}
    assert per[1] < 50 * 10_000 and per[2] < 20 * 1000
    assert all(r["crosses"] for r in paths.self_intersections(chords).collect())


@pytest.mark.parametrize("most", [60, 4096])
def test_thinned_in_rounds(spark, most):
    rng = np.random.default_rng(4)
    lines = {1: np.cumsum(rng.normal(size=(300, 2)), axis=0).tolist(), 2: [(0, 0), (1, 0)], 3: [(2, 2)], 4: [(i, 0) for i in range(300)], 5: [(i, i % 2) for i in range(200)], 6: rng.integers(0, 5, (90, 2)).tolist()}
    lines[6][-1] = lines[6][0]
    got = {}
    for r in paths.thinned(_nodes(spark, lines), 0.9, most=most).orderBy("path_id", "pos").collect():
        got.setdefault(r["path_id"], []).append(r["pos"])
        assert (r["x"], r["y"]) == tuple(map(float, lines[r["path_id"]][r["pos"]]))
    assert got == {k: douglas_peucker_places(*np.array(line, float).T, 0.9).tolist() for k, line in lines.items()}


def test_thinned_of_no_rows(spark):
    assert paths.thinned(_nodes(spark, {1: [(0, 0)]}).where(F.lit(False)), 1.0).count() == 0
