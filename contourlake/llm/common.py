"""What the operators of this subpackage share: table access, lineage cuts and Arrow text buffers."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stages import fresh

#: Bytes of text that a Python worker holds in numpy form at once.
PIECE = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """df, written once as Parquet to the shared folder and read back: a lineage cut that outlives lost executors."""
    spark = df.sparkSession
    path = fresh(spark, "stage")
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._written_to = path
    return back


def forget(*tables: DataFrame, shuffles: bool = False) -> None:
    """Delete what written() wrote for these, once nothing reads it any more; `shuffles`: let Spark look for shuffle files that are of no use now."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        if shuffles:
            jvm.System.gc()


def met(rows: DataFrame, groups: DataFrame, keys: list[str], by: list[str], n: str = "n") -> DataFrame:
    """rows joined with groups, which have one row for each key; `n` is how many of `rows` have the key, or more.

    A key with more rows than a task's share is dealt over several tasks by the
    hash of the columns `by`, and its row in groups goes to each of these. There
    are fewer such keys than tasks, so their list is broadcast. groups should be
    cheap to read again. The column `n` is left out.
    """
    total, most = groups.agg(F.sum(n), F.max(n)).collect()[0]
    share = max(1, (total or 0) // shuffle_width(rows.sparkSession))
    if (most or 0) <= share:
        return rows.join(groups.drop(n), keys)
    slots = F.ceil(F.col(n) / share).cast("int")
    hot = groups.where(F.col(n) > share).select(*keys, slots.alias("__slots"))
    left = rows.join(F.broadcast(hot), keys, "left").withColumn("__slot", F.coalesce(F.pmod(F.xxhash64(*by), F.col("__slots")), F.lit(0)).cast("int")).drop("__slots")
    right = groups.withColumn("__slot", F.explode(F.sequence(F.lit(0), F.greatest(slots, F.lit(1)) - 1))).drop(n)
    return left.join(right, [*keys, "__slot"]).drop("__slot")


WHOLE = ("tinyint", "smallint", "int", "bigint")


def numbered(rows: DataFrame, id_col: str, name: str) -> tuple[DataFrame, DataFrame | None]:
    """rows with `name`, a whole number in the order of the ids, and the table (id, number) that gives them back.

    Ids that are whole numbers stand for themselves and need no table (None).
    Others are sorted in ranges, so that numbers keep their order; null stays null.
    """
    if rows.schema[id_col].dataType.simpleString() in WHOLE:
        return rows.withColumn(name, F.col(f"`{id_col}`").cast("long")), None
    ids = rows.select(F.col(f"`{id_col}`").alias("id")).where("id is not null").distinct()
    table_ = written(ids.repartitionByRange(shuffle_width(rows.sparkSession), "id").sortWithinPartitions("id").withColumn("number", F.monotonically_increasing_id()))
    numbers = table_.select(F.col("id").alias("__theirs"), F.col("number").alias(name))
    return rows.join(numbers, F.col(f"`{id_col}`") == F.col("__theirs"), "left").drop("__theirs"), table_


def renamed(out: DataFrame, columns: list[str], table_: DataFrame | None) -> DataFrame:
    """out with the numbers in these columns replaced by the ids that numbered() gave them for."""
    if table_ is None:
        return out
    order = out.columns
    for c in columns:
        out = out.join(table_.select(F.col("number").alias(c), F.col("id").alias("__theirs")), c, "left").drop(c).withColumnRenamed("__theirs", c)
    return out.select(*order)


@contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """While open, Arrow batches of what is planned and run hold at most so many rows: for rows that are large themselves."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if offsets is None or n == 0:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def row_groups(offsets: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most `most` bytes, or of one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = j


def mix64(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over 64-bit words."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def ascii_lower(column):
    """A-Z to a-z; other letters stay."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
