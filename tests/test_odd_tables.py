"""Queries against DuckDB on tables that are unlike the given ones."""

import datetime

import duckdb
import pytest

from contourlake import catalogue


@pytest.fixture
def against_sql(spark, tmp_path):
    def run(name, **tables):
        duck = duckdb.connect()
        for table, (schema, rows) in tables.items():
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
            duck.execute(f"create view {table} as select * from read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
        got = catalogue.queries()[name](spark, str(tmp_path))
        want = duck.execute(catalogue.oracle_sql()[name])
        columns = [d[0] for d in want.description]
        return sorted(map(tuple, got.select(*columns).collect())), sorted(want.fetchall())

    return run


def test_images_without_opaque_pixels_have_no_palette(against_sql):
    at = datetime.datetime(2024, 1, 3, 5)
    rows = [(5, at, "click", 1.0), (10_001, at, "click", 2.0), (20_003, at, "view", 3.0)]
    got, want = against_sql("quantized_palette", events=("event_id long, ts timestamp_ntz, event_type string, value double", rows))
    assert got == want
    assert {r[0] for r in got} == {"click_1", "view_2"}
