"""Lines whose splits are uneven: noise along a slope, where each split falls near the last one."""

import numpy as np

from contourlake.functions.geometry import chord_distances, douglas_peucker_places, near_hull
from contourlake.operators import paths


def test_noise_takes_few_rounds(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x, y = np.arange(3000) * 10.0, rng.integers(0, 500, 3000).astype(float)
    y[2000:2600] = np.tile(y[:100], 6)
    rounds = []
    once = paths.staged
    monkeypatch.setattr(paths, "staged", lambda df: rounds.append(1) or once(df))
    nodes = spark.createDataFrame([(1, k, a, b) for k, (a, b) in enumerate(zip(x.tolist(), y.tolist(), strict=True))], "path_id int, pos int, x double, y double")
    got = sorted(r["pos"] for r in paths.thinned(nodes, 100.0, most=16).collect())
    assert got == douglas_peucker_places(x, y, 100.0).tolist()
    assert len(rounds) <= 8


def test_outlines_hold_the_farthest_point_of_any_chord():
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        x, y = (rng.integers(0, 12, n).astype(float) for _ in range(2))
        near = near_hull(x, y, 1e-6)
        for _ in range(20):
            a, b = (tuple(rng.integers(-20, 30, 2).astype(float)) for _ in range(2))
            d = chord_distances(x, y, a, b)
            assert np.flatnonzero(d == d.max())[0] in near
