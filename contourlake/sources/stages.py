"""Tables written once in the middle of a plan, in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset a local one, but on one machine only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="contourlake-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def fresh(spark: SparkSession, name: str) -> str:
    """A path in that folder that nothing has been written to."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """df, written as Parquet and read back, so that what follows does not plan it again for each of its uses."""
    path = fresh(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Actions inside hand Python so many rows at once: for rows that are large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def put_whole(store, path: str, write) -> None:
    """A file that is there as a whole or not at all: `write` fills a hidden one beside it, which then gets the name.

    store: a pyarrow file system. A task that fails or runs twice leaves no part
    of a file under the name.
    """
    folder, _, name = path.rpartition("/")
    hidden = f"{folder}/_{uuid.uuid4().hex}-{name}"
    try:
        with store.open_output_stream(hidden) as out:
            write(out)
        store.move(hidden, path)
    except BaseException:
        with contextlib.suppress(OSError):
            store.delete_file(hidden)
        raise
