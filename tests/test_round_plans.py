"""What the driver holds of a round: one step's plan at a time."""

from difflib import SequenceMatcher

from conftest import lines_df
from linecdc import session
from linecdc.operators import matching
from linecdc.operators.diff import to_sides


def test_a_step_of_a_round_has_a_small_plan(spark, monkeypatch):
    """The driver sends each scan and each stage of a job to the tasks and plans the job anew
    after each of its stages: a plan of many joins takes its memory many times."""
    a = ["x", "y", "x", "a", "b", "y", "x", "c", "x", "x"] * 3
    b = ["y", "x", "x", "c", "b", "y", "x", "a", "y", "x"] * 3
    plans, write = [], session.materialize
    conf = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(conf)

    def seen(df, *name):
        plan = df._jdf.queryExecution().executedPlan().toString()
        plans.append((plan.count("Exchange "), plan.count("FileScan")))
        return write(df, *name)

    L = session.materialize(to_sides(lines_df(spark, {"f": a, "g": b}), lines_df(spark, {"f": b, "g": a})))
    monkeypatch.setattr(matching, "materialize", seen)
    spark.conf.set(conf, "-1")
    try:
        m = matching.match_lines(L)
    finally:
        spark.conf.set(conf, before)
    want = [("f", *o[1:]) for o in SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if o[0] != "equal"]
    assert sorted((r.file_name, r.i1, r.i2, r.j1, r.j2) for r in m.opcodes.where("file_name = 'f'").collect()) == sorted(want)
    assert m.rounds >= 2
    # The last one gathers what all rounds wrote.
    assert max(n for n, _ in plans[:-1]) <= 16 and max(n for _, n in plans[:-1]) <= 8, plans


def test_a_stored_table_is_read_without_a_job(spark):
    """Its columns are known; types and nullability are those a look into the files would give."""
    df = spark.sql("select id, cast(id as int) i, array(id) a, struct(id, 'x' as s) t, timestamp_ntz'2024-01-01' n from range(3)")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("stored", "stored")
    try:
        df.write.parquet(path := session.scratch_path(spark, "plain"))
        wrote = len(tracker.getJobIdsForGroup("stored"))
        got = session.materialize(df)
        assert len(tracker.getJobIdsForGroup("stored")) == 2 * wrote
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got.schema == spark.read.parquet(path).schema
    assert sorted(got.collect()) == sorted(df.collect())
