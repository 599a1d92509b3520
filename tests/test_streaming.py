import datetime as dt

from contourlake.streaming import queue

SCHEMA = "id string, kind string, progress int, error string, payload string, at timestamp, seq long"


def _events(spark):
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    rows = [
        ("a", "queued", None, None, None, at(1), 1), ("a", "processing", 1, None, None, at(2), 2), ("a", "result", 100, None, "svg", at(3), 3),
        ("b", "queued", None, None, None, at(1), 4), ("b", "error", None, "broken", None, at(2), 5), ("b", "retry", None, None, None, at(4), 6),
        ("c", "queued", None, None, None, at(1), 7), ("c", "delete", None, None, None, at(2), 8), ("c", "result", 100, None, "late", at(3), 9),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_batch_fold(spark):
    got = {r["id"]: (r["status"], r["progress"], r["payload"]) for r in queue.fold_queue(_events(spark)).collect()}
    assert got == {"a": ("done", 100, "svg"), "b": ("queued", 0, None)}


def test_stream_fold(spark, tmp_path):
    _events(spark).write.parquet(str(tmp_path / "in"))
    stream = queue.fold_queue_stream(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("update").format("memory").queryName("folded").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {r["id"]: (r["status"], r["progress"], r["payload"]) for r in spark.table("folded").collect()}
    assert got == {"a": ("done", 100, "svg"), "b": ("queued", 0, None), "c": ("deleted", 0, None)}


def test_queue_rows(spark):
    q = spark.createDataFrame([("x", "queued", 1), ("y", "done", 0)], "id string, status string, pos int")
    assert queue.next_queued(q).collect()[0]["id"] == "x"
    assert queue.remove(q, q.where("id = 'x'")).count() == 1
    assert queue.set_row(q, "x", status="done").where("status = 'done'").count() == 2


def test_deletes_that_come_late(spark, tmp_path):
    """A delete in a later micro-batch than newer events removes the item, as it does in the batch."""
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    batches = [[("a", "processing", 1, None, None, at(5), 5), ("b", "result", 100, None, "svg", at(6), 6)], [("a", "delete", None, None, None, at(2), 2), ("b", "progress", 40, None, None, at(3), 3)], [("a", "result", 100, None, "late", at(9), 9)]]
    source = str(tmp_path / "in")
    spark.createDataFrame(batches[0], SCHEMA).coalesce(1).write.parquet(source)
    stream = queue.fold_queue_stream(spark.readStream.schema(SCHEMA).parquet(source))
    q = stream.writeStream.outputMode("update").format("memory").queryName("late").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    for rows in batches[1:]:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        q.processAllAvailable()
    q.stop()
    last = {}
    for r in spark.table("late").collect():
        last[r["id"]] = r["status"]
    live = {r["id"]: r["status"] for r in queue.fold_queue(spark.createDataFrame(sum(batches, []), SCHEMA)).collect()}
    assert last["a"] == "deleted" and last["b"] == "done" and live == {"b": "done"}


def test_enqueue_numbers_items_in_order(spark):
    q = spark.createDataFrame([("x", 6, at) for at in [dt.datetime(2023, 1, 1)]], "id string, pos int, created_at timestamp")
    items = spark.createDataFrame([(f"n{i:03d}", 0, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i // 3)) for i in range(100)], "id string, pos int, created_at timestamp").repartition(7)
    got = queue.enqueue(q, items).orderBy("pos").collect()
    assert [(r["id"], r["pos"]) for r in got] == [("x", 6), *((f"n{i:03d}", 7 + i) for i in range(100))]
    none = spark.createDataFrame([], "status string")
    assert queue.flags(none).collect()[0].asDict() == {"processing": False, "done": False}
