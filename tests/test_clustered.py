"""Lookups on the clustered change table: exact rows, few files."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from linecdc.operators import query
from linecdc.operators.clustered import ClusteredTable, write_clustered
from linecdc.session import scratch_path

COLS = "event_id string, file_name string, event_type string, event_timestamp timestamp, loaded_at timestamp, new_value string"


@pytest.fixture(scope="module")
def table(spark):
    rng, t0 = random.Random(3), dt.datetime(2024, 1, 1)
    rows = []
    for i in range(6000):
        at = t0 + dt.timedelta(minutes=rng.randint(0, 40_000))
        rows.append((f"e{i}", f"logs/user_{rng.randint(0, 99):02d}.txt", rng.choice(["INSERT", "UPDATE", "UPDATE", "DELETE"]), at,
                     at + dt.timedelta(seconds=rng.randint(0, 3)), "x" * rng.randint(0, 9)))
    df = spark.createDataFrame(rows, COLS)
    path = scratch_path(spark, "clustered")
    write_clustered(df, path, files=48)
    return df, ClusteredTable(spark, path)


def ids(df):
    return sorted(r["event_id"] for r in df.select("event_id").collect())


def test_by_operation(table):
    df, t = table
    got = t.by_operation("DELETE")
    assert ids(got.rows) == ids(query.changes_by_operation(df, "DELETE")) and 3 * got.opened <= t.files
    day = t.by_operation("DELETE", "2024-01-05", "2024-01-06")
    want = df.where("event_type = 'DELETE' and event_timestamp >= '2024-01-05' and event_timestamp < '2024-01-06'")
    assert ids(day.rows) == ids(want) and day.opened < got.opened


def test_of_a_file_and_in_a_range(table):
    df, t = table
    got = t.of_file("logs/user_37.txt")
    assert ids(got.rows) == ids(df.where("file_name = 'logs/user_37.txt'")) and 2 * got.opened <= t.files
    got = t.in_range("2024-01-10", "2024-01-11")
    assert ids(got.rows) == ids(query.changes_in_range(df, "2024-01-10", "2024-01-11")) and 3 * got.opened <= 2 * t.files
    assert t.of_file("elsewhere").rows.count() == 0 and t.of_file("elsewhere").opened == 0


def test_newest_rows_stop_early(table):
    df, t = table
    got = t.newest(20)
    assert [r["event_id"] for r in got.rows.collect()] == [r["event_id"] for r in query.recent_changes(df, 20).collect()]
    assert 2 * got.opened <= t.files


def test_empty_table_and_nulls(spark):
    path = scratch_path(spark, "clustered")
    write_clustered(spark.createDataFrame([], COLS), path)
    t = ClusteredTable(spark, path)
    assert t.newest(5).rows.count() == 0 and t.by_operation("DELETE").rows.count() == 0
    odd = spark.createDataFrame([("a", None, "INSERT", None, None, None), ("b", "f", None, dt.datetime(2024, 1, 1), None, "v")], COLS)
    path = scratch_path(spark, "clustered")
    write_clustered(odd, path, files=2)
    t = ClusteredTable(spark, path)
    assert ids(t.by_operation("INSERT").rows) == ["a"] and ids(t.of_file("f").rows) == ["b"] and t.newest(5).rows.count() == 2


def test_every_row_once(table):
    df, t = table
    assert t.manifest.agg(F.sum("n")).first()[0] == df.count()
