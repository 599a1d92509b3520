"""Sizes of outlines, which tiles sum up, against the outlines point by point."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from contourlake.operators import masks, paths, tiles


@pytest.mark.parametrize("side", [8, 256])
def test_sizes_are_those_of_traced_outlines(spark, monkeypatch, side):
    monkeypatch.setattr(tiles, "TILE", side)
    rng = np.random.default_rng(side)
    rows = [("a", k, x, y, 40, 40) for k, share in ((0, 0.2), (1, 0.5), (2, 0.8)) for x in range(40) for y in range(40) if rng.random() < share]
    # an outline around all tiles with a hole that crosses them
    rows += [("b", 0, x, y, 40, 40) for x in range(40) for y in range(40) if not (5 <= x < 30 and 7 <= y < 9)]
    mask = spark.createDataFrame(rows, "image_id string, label int, x int, y int, width int, height int")
    keys = ["image_id", "label", "path"]
    loops = masks.trace_edges(mask)
    want = loops.groupBy(*keys).agg(F.count("*").alias("edges")).join(paths.signed_area(loops, keys), keys).select(*keys, "edges", "area")
    got = masks.outline_sizes(mask.unionByName(mask.where("x % 3 = 0")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
