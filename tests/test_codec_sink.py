"""Lines, codec, first-wins and the idempotent sink (the reference's sink cases)."""

import json

import pytest
from pyspark.sql import functions as F

from linecdc.functions.text import splitlines
from linecdc.operators import codec, sink
from linecdc.schema import EVENT_COLUMNS
from linecdc.session import scratch_path

SPLIT_CASES = ["", "a", "a\n", "a\nb", "a\r\nb\n", "a\rb", "\n", "a\n\nb", "x\x0by\x0cz", "p q\x85r",
               "a\x1cb\x1dc\x1ed", "\r\n\r\n"]


def test_splitlines_matches_python(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(SPLIT_CASES)], "i int, t string")
    got = {r.i: r.l for r in df.select("i", splitlines(F.col("t")).alias("l")).collect()}
    for i, t in enumerate(SPLIT_CASES):
        assert got[i] == t.splitlines(), repr(t)


EV = [("e1", "f.txt", None, "c", "INSERT", 3, "2024-01-01T00:00:00.000000+00:00")]
SCHEMA = ("event_id string, file_name string, old_value string, new_value string, event_type string, "
          "line_number int, event_timestamp string")


def test_encode_writes_nulls_and_round_trips(spark):
    df = spark.createDataFrame(EV, SCHEMA)
    rec = codec.publish_frame(df).withColumn("partition", F.lit(0)).withColumn("offset", F.lit(0).cast("long"))
    text = rec.select(F.col("value").cast("string")).first()[0]
    assert json.loads(text)["old_value"] is None and '"old_value":null' in text
    back = codec.decode(rec).select(*EVENT_COLUMNS).collect()
    assert [tuple(r) for r in back] == EV


def test_route_every_row_once(spark):
    good = '{"event_id":"a","file_name":"f","event_type":"UPDATE","event_timestamp":"2024-01-01T00:00:00+00:00"}'
    rows = [(b"k", None, 0, 0), (b"k", b"\xff\xfe", 0, 1), (b"k", b'{"event_id":"x', 0, 2),
            (b"k", good.replace("UPDATE", "MOVE").encode(), 0, 3), (b"k", good.encode(), 0, 4),
            (b"k", good.replace('"event_id":"a",', "").encode(), 0, 5),
            (b"k", good.replace("2024-01-01T00:00:00+00:00", "yesterday").encode(), 0, 6)]
    df = spark.createDataFrame(rows, "key binary, value binary, partition int, offset long")
    valid, dlq = codec.route(codec.decode(df))
    reasons = {r.offset: r.reason for r in dlq.collect()}
    assert [r.offset for r in valid.collect()] == [4]
    assert reasons == {0: "null_value", 1: "bad_utf8", 2: "malformed_json", 3: "bad_event_type",
                       5: "missing_event_id", 6: "bad_timestamp"}


def test_first_wins_keeps_earliest(spark):
    rows = [("a", "v2", 0, 5), ("a", "v1", 0, 3), ("b", "w", 1, 9), ("a", "v0", 1, 0)]
    df = spark.createDataFrame(rows, "event_id string, new_value string, partition int, offset long")
    got = {r.event_id: r.new_value for r in sink.first_wins(df).collect()}
    assert got == {"a": "v1", "b": "w"}


@pytest.fixture()
def table(spark):
    return scratch_path(spark, "test-table")


def _valid(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("partition", F.lit(0)).withColumn(
        "offset", F.monotonically_increasing_id())


def test_write_and_fetch(spark, table):
    c = sink.insert_if_absent(_valid(spark, EV), table, "r", 0)
    assert c["inserted"] == 1
    got = sink.read_table(spark, table).select(*EVENT_COLUMNS[:-1]).collect()
    assert [tuple(r) for r in got] == [EV[0][:-1]]


def test_duplicate_id_ignored(spark, table):
    sink.insert_if_absent(_valid(spark, EV), table, "r", 0)
    dup = [("e1", "f.txt", None, "other", "INSERT", 3, "2024-01-02T00:00:00.000000+00:00")]
    c = sink.insert_if_absent(_valid(spark, dup), table, "r", 1)
    assert c == {"offered": 1, "inserted": 0, "duplicate": 1}
    assert [r.new_value for r in sink.read_table(spark, table).collect()] == ["c"]
    # Replaying batch 0 rewrites its own partition: still one row.
    sink.insert_if_absent(_valid(spark, EV), table, "r", 0)
    assert sink.read_table(spark, table).count() == 1


def test_empty_batch_noop(spark, table):
    c = sink.insert_if_absent(_valid(spark, []), table, "r", 0)
    assert c["offered"] == 0


def test_target_by_name(spark, table):
    targets = {"dev": {"format": "parquet", "path": table}, "odd": {"format": "sqlite"}}
    write = sink.sink_writer("dev", targets)
    assert write(_valid(spark, EV), "r", 0)["inserted"] == 1 and write(_valid(spark, EV), "r", 1)["inserted"] == 0
    assert sink.read_table(spark, table).count() == 1
    for name in ("prod", "odd"):
        with pytest.raises(ValueError):
            sink.sink_writer(name, targets)


def test_merge_statement_inserts_what_is_absent():
    """The statement, run by a database that knows MERGE."""
    import duckdb

    db = duckdb.connect()
    cols = ", ".join(f"{c} {'integer' if c == 'line_number' else 'varchar'}" for c in EVENT_COLUMNS)
    for name in ("change_events", "change_events_staging"):
        db.execute(f"create table {name} ({cols}, loaded_at varchar)")
    row = lambda i, v: (f"e{i}", "f.txt", None, v, "INSERT", i, "2024-01-01", "now")
    put = "insert into {} values (?, ?, ?, ?, ?, ?, ?, ?)"
    db.executemany(put.format("change_events"), [row(1, "first"), row(2, "kept")])
    db.executemany(put.format("change_events_staging"), [row(2, "later"), row(3, "new")])
    for _ in range(2):  # a replay changes nothing
        db.execute(sink.merge_sql("change_events", "change_events_staging"))
    assert db.execute("select event_id, new_value from change_events order by 1").fetchall() == [
        ("e1", "first"), ("e2", "kept"), ("e3", "new")]


def test_first_wins_keeps_ids_without_a_position(spark):
    rows = [("a", "x", None, 1), ("b", "y", 0, 2), ("c", "z", 0, None), ("d", "later", None, 0), ("d", "first", 3, 9)]
    df = spark.createDataFrame(rows, "event_id string, new_value string, partition int, offset long")
    assert {r.event_id: r.new_value for r in sink.first_wins(df).collect()} == {"a": "x", "b": "y", "c": "z", "d": "first"}


def test_first_wins_has_one_exchange(spark, tmp_path):
    spark.range(100).selectExpr("cast(id % 7 as string) event_id", "id offset", "0 partition").write.parquet(str(tmp_path / "t"))
    plan = sink.first_wins(spark.read.parquet(str(tmp_path / "t")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hash") == 1 and "WindowGroupLimit" in plan


def test_snapshot_advance_and_compaction(spark):
    from conftest import lines_df

    path, out = scratch_path(spark, "snap"), scratch_path(spark, "snap-c")
    sink.advance_snapshots(lines_df(spark, {"a": ["1", "2"], "b": ["x"]}, version=1), path, "r", 0)
    sink.advance_snapshots(lines_df(spark, {"a": ["1", "3", "4"]}, version=2), path, "r", 1)
    # Replay of batch 1 rewrites its own rows only.
    sink.advance_snapshots(lines_df(spark, {"a": ["1", "3", "4"]}, version=2), path, "r", 1)
    c = sink.compact_snapshots(spark, path, out)
    got = sorted((r.file_name, r.version, r.line_number, r.line) for r in c.collect())
    assert got == [("a", 2, 1, "1"), ("a", 2, 2, "3"), ("a", 2, 3, "4"), ("b", 1, 1, "x")]


def test_order_columns_are_required(spark, table):
    with pytest.raises(ValueError):
        sink.insert_if_absent(spark.createDataFrame(EV, SCHEMA), table, "r", 0)


def test_first_wins_counts_a_record_offered_twice_once(spark):
    rows = [("a", "v", 0, 1), ("a", "v", 0, 1), ("b", "w", 2, 0)]
    df = spark.createDataFrame(rows, "event_id string, new_value string, partition int, offset long")
    assert sorted(tuple(r)[:2] for r in sink.first_wins(df).collect()) == [("a", "v"), ("b", "w")]


def test_delivery_runs_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def deliver(records):
        def touch(rows):
            calls.add(1)
            return rows
        return spark.createDataFrame(records.rdd.coalesce(1).mapPartitions(touch), records.schema).where("key != cast('b' as binary)")

    rec = spark.createDataFrame([(b"a", b"1"), (b"b", b"2"), (b"c", None)], "key binary, value binary")
    sent, failed = sink.redrive(rec, deliver)
    assert sent.count() == 2 and [bytes(r.key) for r in failed.collect()] == [b"b"] and calls.value == 1
