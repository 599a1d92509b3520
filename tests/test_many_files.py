"""Folders of many small files."""

from contourlake.operators import pixels
from contourlake.sources import png


def test_many_small_images_are_few_tasks(spark, tmp_path):
    small = png.encode(2, 1, bytes(range(8)))
    for k in range(300):
        (tmp_path / f"i{k}.png").write_bytes(small)
    folder = tmp_path.as_uri()
    found = png.to_pixels(png.decoded(png.listed(spark, folder)))
    assert found.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert found.count() == 600
    assert [r["name"] for r in png.scan(spark, folder).select("name").limit(2).collect()] == ["i0.png", "i1.png"]


def test_targets_of_a_resize_are_not_broadcast(spark):
    rows = [(f"i{k}", 4, 2, x, y, x, y, k, 255) for k in range(3) for x in range(4) for y in range(2)]
    images = spark.createDataFrame(rows, "image_id string, width int, height int, x int, y int, r int, g int, b int, a int")
    out = pixels.resize_bilinear(images, 1000)
    assert sorted(map(tuple, out.collect())) == sorted(rows)
    # the join by places is a merge whatever Spark takes the sizes for
    assert "SortMergeJoin [image_id" in out._jdf.queryExecution().executedPlan().toString()
