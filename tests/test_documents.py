"""Documents of many images, and numbers at which their text and SQL could part."""

import pytest
from pyspark.sql import functions as F

from contourlake.plans import export

#: A path with a handle that ends at x = 0.
ZERO = [(33, 7), (47, 24), (47, 32), (1, 19), (6, 9), (39, 38)]


def _points(pairs):
    return [{"x": float(x), "y": float(y)} for x, y in pairs]


def test_a_bounded_handle_that_ends_at_zero_has_no_sign():
    assert "C -4.85 15.72 0.00 6.00 6.00 9.00" in export.bezier_text(_points(ZERO))


def test_the_flat_form_has_no_signed_zero():
    layer = {"name": "COLOR_01", "color": "#ff0000", "paths": [{"points": _points(ZERO), "holes": []}]}
    assert "-0.00" not in export.svg_text(60, 40, [layer], "flat")


def _images(rows):
    """An Arrow batch of images with one path of 5 nodes each."""
    import pyarrow as pa

    layer = {"name": "COLOR_01", "color": "#ff0000", "paths": [{"points": _points(ZERO[:5]), "holes": []}]}
    return pa.RecordBatch.from_pylist([{"image_id": k, "width": 60, "height": 40, "layers": [layer]} for k in range(rows)])


class _Frame:
    """Stands for a DataFrame: keeps the function that mapInArrow gets."""

    schema = {"image_id": type("f", (), {"dataType": type("t", (), {"simpleString": staticmethod(lambda: "bigint")})})}

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):  # noqa: N802
        self.run = run
        return self


@pytest.mark.parametrize("style", ["grouped", "flat", "plain"])
@pytest.mark.parametrize("kind", ["svg", "eps", "dxf"])
def test_a_task_holds_the_texts_of_few_images(kind, style):
    frame = _Frame()
    export.exports(frame, style, (kind,))
    got = list(frame.run(iter([_images(1000)])))
    assert max(b.num_rows for b in got) <= 64
    assert [k for b in got for k in b.column(0).to_pylist()] == list(range(1000))


def test_archives_are_read_in_parts(spark, tmp_path):
    rows = [(str(k), "svg", f"text {k} " * 50) for k in range(500)]
    folder = (tmp_path / "zips").as_uri()
    export.write_archives(spark.createDataFrame(rows, "image_id string, format string, text string"), folder, 1)
    read = export.read_archives(spark, folder)
    assert sorted(map(tuple, read.collect())) == sorted(rows)
    # the archive's bytes are no column that a row holds
    assert "content" not in read._jdf.queryExecution().executedPlan().toString()


def test_files_are_compared_where_they_are(spark, tmp_path):
    rows = [(k, "eps", f"é {k}") for k in range(300)]
    folder = (tmp_path / "files").as_uri()
    texts = spark.createDataFrame(rows, "image_id long, format string, text string")
    export.write_files(texts.where("image_id != 7"), folder)
    (tmp_path / "files" / "9.eps").write_text("other")
    names = texts.select("image_id", "format", F.sha2(F.encode("text", "utf-8"), 256).alias("own"))
    got = export.file_digests(names, folder).collect()
    assert {r["image_id"] for r in got if r["own"] != r["sha256"]} == {7, 9} and len(got) == 300
    assert [r["sha256"] for r in got if r["image_id"] == 7] == [None]
