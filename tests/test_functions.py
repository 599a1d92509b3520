import json

import pytest
from pyspark.sql import functions as F

from contourlake.functions import color, geometry, numbers, settings
from contourlake.plans import export
from contourlake.sources import store


@pytest.mark.parametrize(("value", "digits", "text"), [(1.005, 2, "1.00"), (2.675, 2, "2.67"), (0.125, 2, "0.13"), (-0.001, 2, "-0.00"), (-0.0, 2, "0.00"), (-1.5, 0, "-2")])
def test_fixed_rounds_by_the_binary_value(value, digits, text):
    assert numbers.fixed(value, digits) == text


def test_rounding_and_generator(spark):
    row = spark.range(1).select(numbers.round_half_up(F.lit(-0.5)).alias("a"), numbers.to_fixed(F.lit(1.005), 2).alias("b"), numbers.lcg_draws(F.lit(7), 3).alias("c"), numbers.halves_fixed(F.lit(-0.0)).alias("d")).collect()[0]
    draw = numbers.Lcg(7)
    assert (row["a"], row["b"], row["d"]) == (0, "1.00", "0.00")
    assert row["c"] == [draw(), draw(), draw()]


def test_colours(spark):
    df = spark.createDataFrame([("#010000",), ("#1c1817",), ("#ad6539",), ("#zz0010",)], "h string")
    rows = df.select(color.near_black(F.col("h")).alias("n"), color.hex_to_rgb(F.col("h")).alias("c"), color.rgb_to_hex(F.lit(-5), F.lit(300), F.lit(16)).alias("x"), color.alpha_hex(F.lit(1.0)).alias("a")).collect()
    assert [r["n"] for r in rows][:3] == ["#000000", "#000000", "#ad6539"]
    assert tuple(rows[2]["c"]) == (173, 101, 57) and tuple(rows[3]["c"]) == (0, 0, 16)
    assert rows[0]["x"] == "#00ff10" and rows[0]["a"] == "ff"


def test_settings(spark):
    low = {k: F.lit(v) for k, v in {"filterSpeckle": 99.0, "colorPrecision": -3.0, "layerDifference": 999.0, "cornerThreshold": -1.0, "lengthThreshold": 99.0, "spliceThreshold": 999.0, "pathPrecision": 99.0}.items()}
    o = spark.range(1).select(*[c.alias(k) for k, c in settings.tracer_options(low).items()]).collect()[0]
    assert (o["filterSpeckle"], o["colorPrecision"], o["layerDifference"], o["cornerThreshold"], o["lengthThreshold"], o["spliceThreshold"], o["pathPrecision"]) == (16, 1, 255, 0, 10.0, 180, 16)
    assert settings.merged_settings('{"paletteSize": 4}') == settings.DEFAULTS
    assert settings.merged_settings('{"mode": "polygon"}')["mode"] == "polygon"
    assert settings.parse_flags(["--palette-size", "4", "--nope", "1"]).palette_size == 4


def test_preferences():
    assert store.load_state(None) == store.DEFAULT_STATE == store.load_state("{bad")
    some = store.load_state('{"theme": "dark", "sliderPosition": 20}')
    assert some["theme"] == "dark" and some["sliderPosition"] == 20.0 and some["settings"] == settings.DEFAULTS
    assert json.loads(store.dump_state(some)) == some


def test_point_arrays(spark):
    square = [(0.0, 0.0), (0.001, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.005)]
    df = spark.createDataFrame([([{"x": x, "y": y} for x, y in square],)], f"p {geometry.POINTS}")
    row = df.select(geometry.dedupe_near(F.col("p")).alias("a"), geometry.collapse_short(F.col("p"), 0.75).alias("b"), geometry.ring_area(F.col("p")).alias("c"), F.size(geometry.sample_cubic(F.col("p")[0], F.col("p")[2], F.col("p")[3], F.col("p")[4])).alias("n")).collect()[0]
    assert len(row["a"]) == 4 and len(row["b"]) == 4 and abs(row["c"] - 4) < 0.02 and row["n"] == 11


def test_douglas_peucker_is_a_subsequence(spark):
    line = [(float(i), 0.1 * (i % 2)) for i in range(9)] + [(9.0, 5.0)]
    kept = geometry.douglas_peucker_points(line, 0.5)
    assert kept[0] == line[0] and kept[-1] == line[-1] and [p for p in line if p in kept] == kept and len(kept) < 5


SQUARE = [{"x": 0.0, "y": 0.0}, {"x": 4.0, "y": 0.0}, {"x": 4.0, "y": 4.0}, {"x": 0.0, "y": 4.0}]
HOLE = [{"x": 1.0, "y": 1.0}, {"x": 2.0, "y": 1.0}, {"x": 2.0, "y": 2.0}, {"x": 1.0, "y": 2.0}]


def _layer(*paths):
    return {"name": "COLOR_01", "color": "#ff0000", "paths": list(paths)}


def test_exports():
    one = [_layer({"points": SQUARE, "holes": [], "closed": True})]
    svg, eps, dxf = (f(8, 8, one) for f in (export.svg_text, export.eps_text, export.dxf_text))
    assert 'id="#ff0000ff"' in svg and svg.count("<path") == 1 and "stroke" not in svg
    assert "%!PS-Adobe-3.0 EPSF-3.0" in eps and "closepath\nfill" in eps
    assert "LWPOLYLINE" in dxf and "COLOR_01" in dxf and "8.0000" in dxf
    assert "eofill" in export.eps_text(8, 8, [_layer({"points": SQUARE, "holes": [HOLE], "closed": True})])
    stairs = [{"x": float(i // 2), "y": float((i + 1) // 2)} for i in range(6)] + [{"x": 0.0, "y": 3.0}]
    assert " C " in export.svg_text(8, 8, [_layer({"points": stairs, "holes": []})])
    exact = {"points": SQUARE, "holes": [], "svg_path_data": "M 0 0 Z", "tx": 5.0, "ty": 6.0}
    assert 'd="M 0 0 Z" transform="translate(5.00 6.00)"' in export.svg_text(8, 8, [_layer(exact)])
    for f in (export.svg_text, export.eps_text, export.dxf_text):
        assert f(8, 8, []) and f(8, 8, [_layer()]) and f(8, 8, [_layer({"points": [], "holes": []})])
