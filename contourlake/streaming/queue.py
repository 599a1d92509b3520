"""The work queue: events of items folded to their state, as a batch and as a stream.

event: id, kind, progress, error, payload, at. Kinds: queued, processing,
progress, result, error, retry, delete. An item's state is that of its last
event; a deleted item is gone, and what comes later for it is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..sources.stages import staged

#: Progress that items have at the steps of a conversion (fixed values).
STEPS = {"processing": 1, "decode": 8, "trace": 18, "vectorize": 35, "export": 92, "result": 100}
STATUS = {"queued": "queued", "retry": "queued", "processing": "processing", "progress": "processing", "result": "done", "error": "error"}


def fold_queue(events: DataFrame) -> DataFrame:
    """(id, status, progress, error, payload, updated_at) of live items, from all their events."""
    order = F.struct("at", "seq")
    gone = F.coalesce(F.max(F.when(F.col("kind") == "delete", 1)), F.lit(0))
    last = events.groupBy("id").agg(
        F.max_by(F.struct("kind", "progress", "error", "at"), order).alias("e"),
        F.max_by(F.when(F.col("kind") == "result", F.col("payload")), F.when(F.col("kind") == "result", order)).alias("payload"),
        gone.alias("gone"),
    )
    kind = F.col("e.kind")
    status = F.when(kind.isin("queued", "retry"), "queued").when(kind == "result", "done").when(kind == "error", "error").otherwise("processing")
    progress = F.when(kind.isin("queued", "retry"), 0).when(kind == "result", 100).otherwise(F.coalesce("e.progress", F.lit(1)))
    return last.where("gone = 0").select("id", status.alias("status"), progress.cast("int").alias("progress"), F.when(kind == "error", F.col("e.error")).alias("error"), F.when(status == "done", F.col("payload")).alias("payload"), F.col("e.at").alias("updated_at"))


def fold_queue_stream(events: DataFrame, late: str | None = None) -> DataFrame:
    """The same as a stream of updates: a row for each item and micro-batch that changed it; deleted ones come as 'deleted' once.

    late: how long after others an event may come, as "1 hour"; what comes later
    is dropped. The state of a deleted item ends when no event for it can come
    any more; without `late` it stays, as any event may.
    """
    if late is not None:
        events = events.withWatermark("at", late)
    out = "id string, status string, progress int, error string, payload string, updated_at timestamp"
    state = "status string, progress int, error string, payload string, updated_at timestamp, seq long"

    def ends(held: GroupState, at) -> None:
        """The item's state ends once the watermark passes its last event."""
        if late is not None:
            held.setTimeoutTimestamp(max(int(pd.Timestamp(at).timestamp() * 1000), held.getCurrentWatermarkMs()) + 1)

    def run(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        now = held.get if held.exists else (None, 0, None, None, pd.Timestamp(0), -1)
        if now[0] == "deleted":
            ends(held, now[4])
            return
        for pdf in frames:
            for e in pdf.sort_values(["at", "seq"]).itertuples():
                if now[0] == "deleted":
                    continue
                if e.kind == "delete":  # also one that comes after later events
                    now = ("deleted", 0, None, None, e.at, e.seq)
                    continue
                if (e.at, e.seq) <= (now[4], now[5]):
                    continue
                status = STATUS.get(e.kind, "processing")
                progress = 0 if status == "queued" else 100 if status == "done" else int(e.progress) if pd.notna(e.progress) else 1
                now = (status, progress, e.error if status == "error" else None, e.payload if status == "done" else None, e.at, e.seq)
        held.update(now)
        if now[0] == "deleted":
            ends(held, now[4])
        yield pd.DataFrame([(key[0], *now[:5])], columns=["id", "status", "progress", "error", "payload", "updated_at"])

    return events.groupBy("id").applyInPandasWithState(run, out, state, "update", GroupStateTimeout.NoTimeout if late is None else GroupStateTimeout.EventTimeTimeout)


def run_stream(spark: SparkSession, source: str, schema: StructType, folder: str, late: str, files: int = 1) -> DataFrame:
    """The state of live items after all event files of a folder went through the stream, `files` of them in a micro-batch.

    Each micro-batch's updates are a table of its own, which a repeated batch
    replaces; the last update of an item is its state.
    """
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    keep = lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/updates/batch={n}")
    fold_queue_stream(events, late).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    updates = spark.read.parquet(f"{folder}/updates")
    row = F.struct(*[c for c in updates.columns if c not in ("id", "batch")])
    return updates.groupBy("id").agg(F.max_by(row, "batch").alias("r")).select("id", "r.*").where("status != 'deleted'")


def next_queued(queue: DataFrame) -> DataFrame:
    """The first queued item by pos."""
    return queue.where("status = 'queued'").orderBy("pos").limit(1)


def enqueue(queue: DataFrame, items: DataFrame) -> DataFrame:
    """queue with items after its last pos."""
    last = queue.agg(F.max("pos")).collect()[0][0]
    tasks = max(1, int(queue.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # ranges of the order get the number of items before them, then each its own numbers
    ranged = items.repartitionByRange(tasks, "created_at", "id").withColumn("__part", F.spark_partition_id())
    ranged = staged(ranged.withColumn("__at", F.row_number().over(Window.partitionBy("__part").orderBy("created_at", "id"))))
    before, sizes = 0 if last is None else last + 1, []
    for r in ranged.groupBy("__part").count().orderBy("__part").collect():
        sizes.append((r["__part"], before))
        before += r["count"]
    starts = queue.sparkSession.createDataFrame(sizes, "__part int, __before long")
    placed = ranged.join(F.broadcast(starts), "__part").withColumn("pos", (F.col("__before") + F.col("__at") - 1).cast(queue.schema["pos"].dataType))
    return queue.unionByName(placed.select(*queue.columns))


def flags(queue: DataFrame) -> DataFrame:
    """(processing, done): whether any item is in that state; an empty queue has neither."""
    any_ = lambda s: F.coalesce(F.bool_or(F.col("status") == s), F.lit(False))
    return queue.agg(any_("processing").alias("processing"), any_("done").alias("done"))


def dispatched(queue: DataFrame, settings: DataFrame) -> DataFrame:
    """The next queued item with `settings`, those that hold now: the latest row of settings (text, at)."""
    latest = settings.agg(F.max_by("text", F.struct("at", "text")).alias("settings"))
    return next_queued(queue).join(F.broadcast(latest))


def remove(queue: DataFrame, ids: DataFrame) -> DataFrame:
    return queue.join(ids.select("id"), "id", "left_anti").select(*queue.columns)


def set_row(queue: DataFrame, id_: str, **values) -> DataFrame:
    """queue with new values in the row of one id."""
    return queue.withColumns({k: F.when(F.col("id") == id_, F.lit(v)).otherwise(F.col(k)) for k, v in values.items()})


def done_results(queue: DataFrame, results: DataFrame) -> DataFrame:
    """Finished items with their results."""
    return queue.where("status = 'done'").select("id", "name").join(results, "id")


def status_text(status, progress):
    return F.when(status == "processing", F.concat(F.lit("Processing "), progress.cast("string"), F.lit("%"))).when(status == "done", "Done").when(status == "error", "Failed").when(status == "canceled", "Canceled").otherwise("Queued")


def size_kb(size):
    return F.floor(size / 1024 + 0.5)
