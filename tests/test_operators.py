import numpy as np
import pytest
from pyspark.sql import functions as F

from contourlake.operators import kmeans, layers, masks, paths, pixels
from contourlake.plans.vectorize import trace, vectorize
from contourlake.functions.settings import BatchOptions
from contourlake.sources import png, store


def _mask(spark, cells, width, height, label=0):
    return spark.createDataFrame([("i", label, x, y, width, height) for x, y in cells], "image_id string, label int, x int, y int, width int, height int")


def _cells(df):
    return {(r["x"], r["y"]) for r in df.collect()}


def test_morphology_against_arrays(spark):
    rng = np.random.default_rng(1)
    grid = rng.random((9, 11)) < 0.6
    m = _mask(spark, [(x, y) for y, x in zip(*map(np.ndarray.tolist, np.nonzero(grid)), strict=True)], 11, 9)

    def dilated(a):
        p = np.pad(a, 1)
        return np.array([[p[y : y + 3, x : x + 3].any() for x in range(a.shape[1])] for y in range(a.shape[0])])

    def eroded(a):
        p = np.pad(a, 1)
        return np.array([[p[y : y + 3, x : x + 3].all() for x in range(a.shape[1])] for y in range(a.shape[0])])

    cells = lambda a: {(int(x), int(y)) for y, x in zip(*np.nonzero(a), strict=True)}
    assert _cells(masks.dilate(m)) == cells(dilated(grid))
    assert _cells(masks.erode(m)) == cells(eroded(grid))
    assert _cells(masks.close(m)) == cells(eroded(dilated(grid)))
    assert masks.erode(m, 0) is m


def test_components_and_loops(spark):
    m = _mask(spark, [(0, 0), (1, 0), (1, 1), (3, 3), (2, 2)], 5, 5)
    assert sorted(r["size"] for r in masks.component_sizes(m).collect()) == [1, 1, 3]
    assert _cells(masks.remove_small(m, 2)) == {(0, 0), (1, 0), (1, 1)}
    single = masks.trace_loops(masks.cell_segments(masks.marching_cells(_mask(spark, [(0, 0)], 1, 1))))
    keys = ["image_id", "label", "path"]
    assert single.count() == 4 and paths.polygon_area(single.withColumn("x", F.col("x") / 2).withColumn("y", F.col("y") / 2), keys).collect()[0]["area"] == 0.5
    diagonal = masks.trace_loops(masks.cell_segments(masks.marching_cells(_mask(spark, [(0, 0), (1, 1)], 2, 2)))).collect()
    assert any(r["x"] % 2 for r in diagonal)
    edges = masks.trace_edges(m)
    assert paths.signed_area(edges, keys).agg(F.sum("area")).collect()[0][0] == 5.0


def test_full_canvas_floods_and_erodes(spark):
    m = _mask(spark, [(x, y) for x in range(4) for y in range(4)], 4, 4)
    assert pixels.background_flood(m).collect()[0]["flood"] is True
    assert _cells(masks.erode(m)) == {(1, 1), (1, 2), (2, 1), (2, 2)}


@pytest.mark.parametrize(("dark", "cap", "areas", "kept"), [(False, 2, [50, 10, 30], [50, 30]), (True, 5, [500, 400, 300, 16, 24, 40, 4], [500, 400, 300, 16, 24]), (True, 9, [1, 2], [1, 2])])
def test_cap_paths(spark, dark, cap, areas, kept):
    df = spark.createDataFrame([("l", i, a) for i, a in enumerate(areas)], "layer string, pos int, area int")
    assert [r["area"] for r in layers.cap_paths(df, cap, dark).orderBy("rank").collect()] == kept


def _nodes(spark, points):
    return spark.createDataFrame([(1, i, float(x), float(y)) for i, (x, y) in enumerate(points)], "path_id int, pos int, x double, y double")


def test_simplify_fixtures(spark):
    rect = _nodes(spark, [(0, 0), (1, 0), (2, 0), (4, 0), (4, 2), (4, 4), (2, 4), (0, 4), (0, 2), (0, 1)])
    n = paths.simplify(rect, 1.2, 0.2, 22).count()
    assert 3 <= n < 10
    stairs = _nodes(spark, [(0, 0), (2, 0), (2, 2), (4, 2), (4, 4), (6, 4), (6, 8), (0, 8)])
    plain, smooth = paths.simplify(stairs, 0.5, 0.0, 22).collect(), paths.simplify(stairs, 0.5, 0.24, 22).collect()
    assert len(smooth) > len(plain) and any(r["x"] % 1 for r in smooth)


def test_damage_and_crossings(spark):
    bow = _nodes(spark, [(0, 0), (4, 4), (4, 0), (0, 4)])
    assert paths.self_intersections(bow).collect()[0]["crosses"] is True
    square = _nodes(spark, [(0, 0), (4, 0), (4, 4), (0, 4)])
    assert paths.join_damage(square, bow).collect()[0]["damaged"] is True
    assert paths.join_damage(square, square).collect()[0]["damaged"] is False
    assert paths.winding(square).collect()[0]["clockwise"] is False


def _reference_kmeans(rgb, k, draw):
    """The plain loop: every pixel, every iteration."""
    found = [rgb[int(draw() * len(rgb))]]
    for _ in range(1, k):
        gap = [min(sum((a - b) ** 2 for a, b in zip(p, c, strict=True)) for c in found) for p in rgb]
        if sum(gap) <= 0:
            found.append(rgb[int(draw() * len(rgb))])
            continue
        target, pick = draw() * sum(gap), rgb[0]
        for p, g in zip(rgb, gap, strict=True):
            target -= g
            if target <= 0:
                pick = p
                break
        found.append(pick)
    centers = [list(map(float, c)) for c in found]
    label = []
    for _ in range(10):
        label = [min(range(k), key=lambda c, p=p: (sum((a - b) ** 2 for a, b in zip(p, centers[c], strict=True)), c)) for p in rgb]
        for c in range(k):
            own = [p for p, x in zip(rgb, label, strict=True) if x == c]
            if own:
                centers[c] = [sum(p[i] for p in own) / len(own) for i in range(3)]
    return label, centers


def test_kmeans_matches_the_plain_loop():
    from contourlake.functions.numbers import Lcg

    rgb = np.random.default_rng(3).integers(0, 255, (60, 3))
    label, centers = kmeans.cluster(rgb, 4, Lcg(5))
    want, middle = _reference_kmeans([tuple(map(int, p)) for p in rgb], 4, Lcg(5))
    assert label.tolist() == want and np.allclose(centers, middle)


def test_png_round_trip_and_vectorisation(spark, tmp_path):
    image = np.zeros((12, 16, 4), np.uint8)
    image[...] = (250, 250, 250, 255)
    image[2:9, 3:12] = (200, 20, 20, 255)
    (tmp_path / "a.PNG").write_bytes(png.encode(16, 12, image.tobytes()))
    (tmp_path / "b.png").write_bytes(b"not a png")
    (tmp_path / "c.txt").write_bytes(b"")
    files = png.scan(spark, str(tmp_path))
    decoded = png.decoded(files)
    rows = {r["image_id"]: r for r in decoded.collect()}
    assert set(rows) == {"a", "b"} and rows["b"]["error"] and bytes(rows["a"]["pixels"]) == image.tobytes()
    px = png.to_pixels(decoded)
    assert px.count() == 192 and pixels.resize_bilinear(px, 8).count() == 48
    out = vectorize(px, BatchOptions(palette_size=2, speckle_threshold=2)).collect()[0]
    assert out["path_count"] >= 1 and out["node_count"] >= 3 and {x["color"] for x in out["layers"]} <= {"#fafafa", "#c81414"}
    assert trace(px, "binary").count() == 0


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "files"), "name string")
    assert s.all().count() == 0
    s.put(spark.createDataFrame([("1", "a"), ("2", "b")], "id string, name string"))
    s.put(spark.createDataFrame([("1", "c")], "id string, name string"))
    assert {(r["id"], r["name"]) for r in s.all().collect()} == {("1", "c"), ("2", "b")}
    s.delete(s.get("2"))
    assert [r["id"] for r in s.all().collect()] == ["1"]
    s.clear()
    assert s.all().count() == 0


def test_stages_need_a_shared_folder():
    from types import SimpleNamespace

    from contourlake.sources import stages

    made = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: d), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda f: None))
    assert stages.shared_folder(made("local[4]")) and stages.shared_folder(made("local"))
    for master in ("spark://host:7077", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(ValueError):
            stages.shared_folder(made(master))


def test_png_filters_undo_each_other():
    rng = np.random.default_rng(7)
    for width, height in ((1, 1), (3, 11), (17, 10)):
        rgba = rng.integers(0, 256, (height, width, 4), dtype=np.uint8).tobytes()
        assert png.decode(png.encode_filtered(width, height, rgba)) == (width, height, rgba)
