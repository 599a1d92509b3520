"""Keyed stores as Parquet: point reads, upserts, deletes; and preferences as JSON."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.settings import DEFAULTS, merged_settings

STORES = ("files", "results")
DEFAULT_STATE = {"settings": DEFAULTS, "sliderPosition": 50.0, "theme": "system"}
THEMES = ("system", "light", "dark")


class Store:
    """Rows under an id in versions of a Parquet folder; a write makes a new version of the changed rows only.

    Each write appends rows with a version; a read takes each id's last row, so
    nothing is rewritten in place and a lost executor leaves the old state.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder = spark, folder
        self.schema = T.StructType.fromDDL(f"id string, {schema}, _version long, _gone boolean")
        self.values = [f.name for f in self.schema.fields][1:-2]

    def _log(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.schema).parquet(self.folder)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], self.schema)

    def _append(self, rows: DataFrame, gone: bool) -> None:
        version = (self._log().agg(F.max("_version")).collect()[0][0] or 0) + 1
        full = rows.select("id", *[F.col(c) if c in rows.columns else F.lit(None).cast(self.schema[c].dataType).alias(c) for c in self.values])
        full.withColumns({"_version": F.lit(version).cast("long"), "_gone": F.lit(gone)}).sortWithinPartitions("id").write.mode("append").parquet(self.folder)

    def all(self) -> DataFrame:
        last = self._log().groupBy("id").agg(F.max_by(F.struct(*self.values, "_gone"), "_version").alias("r"))
        return last.where("not r._gone").select("id", *[F.col(f"r.{c}").alias(c) for c in self.values])

    def get(self, key: str) -> DataFrame:
        """The row of one id; the test goes to the scans, whose files are sorted by id."""
        return self.all().where(F.col("id") == key)

    def put(self, rows: DataFrame) -> None:
        """Insert or replace; of several rows with one id, any one."""
        self._append(rows.dropDuplicates(["id"]), False)

    def delete(self, ids: DataFrame) -> None:
        self._append(ids.select("id").distinct(), True)

    def clear(self) -> None:
        self.delete(self.all())


def new_items(files: DataFrame) -> DataFrame:
    """Queue items of files (name, size): an id, the state queued, and when they came."""
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return files.select(F.expr("uuid()").alias("id"), "name", "size", F.lit("queued").alias("status"), F.lit(0).alias("progress"), now.alias("created_at"), now.alias("updated_at"))


def load_state(text: str | None) -> dict:
    """Preferences from JSON over defaults, field by field; the defaults for bad JSON."""
    try:
        own = json.loads(text) if text else {}
    except ValueError:
        own = {}
    if not isinstance(own, dict):
        own = {}
    slider, theme = own.get("sliderPosition"), own.get("theme")
    return {
        "settings": merged_settings(json.dumps(own.get("settings") or {})),
        "sliderPosition": float(slider) if isinstance(slider, (int, float)) and not isinstance(slider, bool) else DEFAULT_STATE["sliderPosition"],
        "theme": theme if theme in THEMES else DEFAULT_STATE["theme"],
    }


def dump_state(state: dict) -> str:
    """The three fields that are kept."""
    return json.dumps({k: state[k] for k in DEFAULT_STATE})


def cleared_state() -> dict:
    """Preferences once they are cleared: the defaults."""
    return load_state(None)


def job_id() -> str:
    return str(uuid.uuid4())
