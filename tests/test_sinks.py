"""Files that tasks write: whole or not at all; archives; names in order; states of a stream that end."""

from __future__ import annotations

import datetime as dt
import io
import zipfile

import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from contourlake.plans import export
from contourlake.sources import png
from contourlake.sources.stages import put_whole
from contourlake.streaming import queue


def test_files_are_whole(tmp_path):
    store = fs.LocalFileSystem()

    def broken(out):
        out.write(b"half")
        raise OSError("lost")

    with pytest.raises(OSError):
        put_whole(store, f"{tmp_path}/a.svg", broken)
    assert list(tmp_path.iterdir()) == []
    put_whole(store, f"{tmp_path}/a.svg", lambda out: out.write(b"first"))
    with pytest.raises(OSError):
        put_whole(store, f"{tmp_path}/a.svg", broken)
    assert [(p.name, p.read_bytes()) for p in tmp_path.iterdir()] == [("a.svg", b"first")]
    put_whole(store, f"{tmp_path}/a.svg", lambda out: out.write(b"second"))
    assert [(p.name, p.read_bytes()) for p in tmp_path.iterdir()] == [("a.svg", b"second")]


def test_archives(spark, tmp_path):
    rows = [(f"i{k}.x", f, f"{f} of {k} é\n" * (1 + 900 * (k == 3))) for k in range(40) for f in ("svg", "eps")]
    texts = spark.createDataFrame(rows, "image_id string, format string, text string")
    folder = (tmp_path / "zips").as_uri()
    export.write_archives(texts, folder, 5)
    files = sorted((tmp_path / "zips").iterdir())
    assert 1 < len(files) <= 5 and all(p.name.startswith("shard-") for p in files)
    found = {}
    for p in files:
        with zipfile.ZipFile(io.BytesIO(p.read_bytes())) as z:
            assert z.testzip() is None
            found |= {n: z.read(n).decode() for n in z.namelist()}
    assert found == {f"{i}.{f}": t for i, f, t in rows}
    assert sorted(map(tuple, export.read_archives(spark, folder).collect())) == sorted(rows)
    export.write_archives(texts.where("false"), (tmp_path / "none").as_uri(), 2)


def test_names_in_order(spark):
    names = ["b.png", "a1.png", "Ä.png", "B.png", "a.png", "ä.png", "A.png", "Z.png", "z.png", "á.png"]
    got = [r["name"] for r in spark.createDataFrame([(n,) for n in names], "name string").orderBy(*png.by_name("name")).collect()]
    assert got == ["a.png", "A.png", "á.png", "ä.png", "Ä.png", "a1.png", "b.png", "B.png", "z.png", "Z.png"]


def test_states_of_deleted_items_end(spark, tmp_path):
    schema = "id string, kind string, progress int, error string, payload string, at timestamp, seq long"
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    batches = [[("a", "queued", None, None, None, at(0), 1), ("a", "delete", None, None, None, at(1), 2), ("b", "queued", None, None, None, at(1), 3)], [("a", "result", 100, None, "svg", at(0.5), 4), ("c", "queued", None, None, None, at(30), 5)], [("c", "result", 100, None, "svg", at(31), 6)], [("d", "queued", None, None, None, at(32), 7)]]
    source = str(tmp_path / "in")
    spark.createDataFrame([], schema).write.parquet(source)
    stream = queue.fold_queue_stream(spark.readStream.schema(schema).parquet(source), "2 hours")
    q = stream.writeStream.outputMode("update").format("memory").queryName("ended").option("checkpointLocation", str(tmp_path / "cp")).start()
    held = []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        q.processAllAvailable()
        held.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    q.stop()
    # a is deleted, stays while an event for it may come, and goes; b to d stay
    assert held[0] == 2 and held[-1] == 3
    last = {r["id"]: r["status"] for r in spark.table("ended").collect()}
    assert last == {"a": "deleted", "b": "queued", "c": "done", "d": "queued"}


def test_a_stream_over_files(spark, tmp_path):
    schema = "id string, kind string, progress int, error string, payload string, at timestamp, seq long"
    rows = [(f"u{k % 7}", ("queued", "processing", "progress", "result", "error", "delete")[k * k % 6 if k % 7 else k % 3], k % 100, f"e{k}", f"p{k}", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=k), k) for k in range(200)]
    events = spark.createDataFrame(rows, schema)
    events.repartition(3, "seq").write.parquet(str(tmp_path / "events"))
    got = queue.run_stream(spark, str(tmp_path / "events"), events.schema, str(tmp_path / "run"), "10 days")
    key = lambda df: sorted(map(tuple, df.select("id", "status", "progress", "error", "payload").collect()))
    assert key(got) == key(queue.fold_queue(events)) and len(list((tmp_path / "run" / "updates").glob("batch=*"))) > 1
