"""The findings of round 4."""

from conftest import lines_df
from linecdc import session
from linecdc.operators import codec, diff, sink
from linecdc.streaming import pipelines
from pyspark.sql import functions as F


def test_rebuilding_sends_no_lines_through_the_driver(spark, monkeypatch):
    """The target positions come from a row a file, so Spark takes them for a few and would
    broadcast one a line."""
    plans, write = [], session.materialize
    shown = lambda df: df._jdf.queryExecution().executedPlan().toString()
    old = [str(i) for i in range(300)]
    new = ["first"] + [x + "!" if k % 7 == 0 else x for k, x in enumerate(old) if k % 3] + old[5:60]
    files = {"f": old, "g": old[:9], "h": ["only"], "k": ["x"]}, {"f": new, "g": old[:9][::-1], "h": [], "k": ["y", "x"]}
    events = session.materialize(diff.diff_lines(lines_df(spark, files[0]), lines_df(spark, files[1])))
    before = session.materialize(lines_df(spark, files[0]))
    monkeypatch.setattr(diff, "materialize", lambda df, *name: (plans.append(shown(df)), write(df, *name))[1])
    got = diff.apply_changes(before, events)
    rows = sorted(got.collect())
    plans.append(shown(got))
    # Files without a change have no event, their lines stay as they are.
    assert rows == sorted((f, 2, i + 1, x) for f, lines in files[1].items() for i, x in enumerate(lines))
    assert not any("Broadcast" in p for p in plans), plans


def _batches(spark, n: int) -> list:
    """Stored log batches: batch b has two ids of its own, one of the batch before, one twice
    and a dead letter."""
    good = '{"event_id":"%s","file_name":"f","event_type":"UPDATE","new_value":"%s","event_timestamp":"2024-01-01T00:00:00+00:00"}'
    rows = [(b, f"k{b}".encode(), v if v is None else v.encode(), 0, 10 * b + k) for b in range(n) for k, v in enumerate(
        [good % (f"a{b}", b), good % (f"b{b}", "first"), good % (f"b{b}", "later"), good % (f"a{b - 1}", "again"), None])]
    df = spark.createDataFrame(rows, "b int, key binary, value binary, partition int, offset long").withColumn(
        "topic", F.lit("t")).withColumn("timestamp", F.timestamp_seconds("offset"))
    return [session.materialize(df.where(F.col("b") == b).drop("b").coalesce(1)) for b in range(n)]


def test_a_small_batch_has_few_jobs_however_many_came_before(spark):
    n, jobs = 20, []
    batches, tracker = _batches(spark, n), spark.sparkContext.statusTracker()
    table, dlq, audit = (session.scratch_path(spark, x) for x in ("table", "dlq", "audit"))
    early = spark.createDataFrame([("a7", "f", None, None, "UPDATE", 1, "2024-01-01T00:00:00+00:00", 0, 0)], (
        "event_id string, file_name string, old_value string, new_value string, event_type string, line_number int, "
        "event_timestamp string, partition int, offset long"))
    sink.insert_if_absent(early, table, "other", 0)  # another run has stored it
    write = pipelines.table_batch_writer(table, dlq, "run", audit)
    for b, batch in enumerate(batches):
        spark.sparkContext.setJobGroup(f"small-{b}", "batch")
        write(batch, b)
        jobs.append(len(tracker.getJobIdsForGroup(f"small-{b}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

    def stored():
        return sorted(tuple(r) for r in sink.read_table(spark, table).select("run_id", "batch_id", "event_id", "new_value").collect())

    want = sorted([("other", 0, "a7", None), ("run", 0, "a-1", "again")] + [
        ("run", b, *r) for b in range(n) for r in ((f"a{b}", str(b)), (f"b{b}", "first")) if r[0] != "a7"])
    assert stored() == want
    write(batches[3], 3)  # replayed
    write(batches[n - 1], n - 1)
    assert stored() == want
    assert pipelines.table_batch_writer(table, dlq, "run")(batches[5], n) is None and stored() == want  # after a restart
    counts = {(r.batch_id, r.offered, r.invalid, r.duplicate, r.inserted) for r in spark.read.parquet(audit).collect()}
    assert counts == {(b, 5, 1, 1 if b == 0 else 3 if b == 7 else 2, 3 if b == 0 else 1 if b == 7 else 2) for b in range(n)}
    assert spark.read.parquet(dlq).where("batch_id < 20").count() == n
    # Merging ids takes one more now and then.
    assert max(jobs[2:]) <= 9 and sorted(jobs)[n // 2] <= 7, jobs


def test_stored_ids_are_read_from_few_files(spark):
    table, dlq = session.scratch_path(spark, "table"), session.scratch_path(spark, "dlq")
    ids = sink.StoredIds(table, "run")
    for b, batch in enumerate(_batches(spark, 18)):
        sink.write_batch(batch, table, dlq, "run", b, ids=ids)
    found = ids.before(spark, 99)
    assert sorted(r.event_id for r in found.collect()) == sorted(r.event_id for r in sink.read_table(spark, table).collect())
    assert len(found.inputFiles()) <= 9


def test_an_observed_stream_is_decoded_once(spark, monkeypatch):
    table, dlq = session.scratch_path(spark, "table"), session.scratch_path(spark, "dlq")
    batch = _batches(spark, 1)[0]
    want = {"offered": 5, "inserted": 3, "duplicate": 1, "invalid": 1}
    assert sink.write_batch(batch, table, dlq, "run", 0) == want
    tagged = codec.validate(codec.decode(batch, keep=tuple(batch.columns)))
    monkeypatch.setattr(sink, "decode", None)
    assert sink.write_batch(tagged, table + "2", dlq + "2", "run", 0) == want
    same = lambda a, b: sorted(map(str, spark.read.parquet(a).drop("loaded_at").collect())) == sorted(
        map(str, spark.read.parquet(b).drop("loaded_at").collect()))
    assert same(table, table + "2") and same(dlq, dlq + "2")
