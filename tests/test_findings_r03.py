"""Small tests of the round's fixes: each failed before."""

import pytest
from conftest import lines_df
from difflib import SequenceMatcher
from linecdc import session
from linecdc.operators import deltas, diff, matching, sink
from linecdc.operators.diff import to_sides
from linecdc.session import materialize, true_sizes
from linecdc.sources import versions as V
from linecdc.streaming import pipelines


def test_small_ranges_share_a_task_and_stay_ranges():
    plan = V.plan_ranges([("a", 0, 95, 1)], 10, 40)
    assert [[(x.start, x.end) for x in p.pieces][::3] for p in plan] == [[(0, 10), (30, 40)], [(40, 50), (70, 80)], [(80, 90)]]
    assert sum(len(p.pieces) for p in plan) == 10


def test_a_range_reads_little_past_its_end(tmp_path):
    (tmp_path / "f").write_bytes(b"line\n" * 100_000)
    with open(tmp_path / "f", "rb") as f:
        assert len(list(V.lines_of_range(f, 0, 1000))) == 200
        assert f.tell() < 10_000


def test_tables_are_broadcast_by_the_size_of_their_rows(spark):
    t = materialize(spark.range(40_000).selectExpr("id", "id * 7919 % 40009 x"))
    size = lambda df: int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    plain = size(t)
    with true_sizes(spark):
        assert size(materialize(t)) > 8 * plain
    assert spark.conf.get("spark.sql.sources.fileCompressionFactor") == "1.0"


@pytest.mark.parametrize("large", [1 << 17, 4])
def test_chain_of_small_steps(spark, monkeypatch, large):
    """One job a round where a segment fits a task; jobs of WALK starts where it does not."""
    a, b = ["x", "y"] * 20 + ["a"] + ["x"] * 5, ["x"] * 12 + ["b"] + ["y", "x"] * 18
    jobs, step = [], matching._walk_step
    monkeypatch.setattr(matching, "WALK", large)
    monkeypatch.setattr(matching, "_walk_step", lambda *x: jobs.append(1) or step(*x))
    m = matching.match_lines(to_sides(lines_df(spark, {"f": a}), lines_df(spark, {"f": b})), strategy="rounds", walk=2)
    want = [o for o in SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if o[0] != "equal"]
    assert sorted((r.tag, r.i1, r.i2, r.j1, r.j2) for r in m.opcodes.collect()) == sorted(want)
    assert large == 4 or len(jobs) == m.rounds


def test_rebuilt_ranges_and_lines_meet_in_small_blocks():
    assert deltas.BLOCK_BITS <= 8  # all of a block's ranges meet all of its lines


def test_chunks_are_packed_whole():
    import pandas as pd
    from linecdc.streaming import stateful as S
    frames = [pd.DataFrame({"file_name": "f", "version": 1, "n_lines": 6, "chunk": 0, "line_number": [i, i + 3], "line": [f"l{i}", f"l{i + 3}"]}) for i in (1, 2, 3)]
    assert [(r.n, len(r.lines) > 50) for p in S._pack(iter(frames)) for r in p.itertuples()] == [(6, True)]


def _aligned(blocks, a, b):
    got = sorted((r["i"], r["j"], r["n"]) for r in blocks.collect())
    return got == [tuple(m) for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if m.size]


REPEATED = (list("abcabdxaby"), list("abdabcabxa"))


def test_no_round_leaves_a_join_to_the_last_plan(spark, monkeypatch):
    plans = []
    write = matching._checkpoint
    monkeypatch.setattr(matching, "_checkpoint", lambda df: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), write(df))[1])
    sides = to_sides(lines_df(spark, {"f": REPEATED[0]}, 2), lines_df(spark, {"f": REPEATED[1]}, 2))
    m = matching.match_lines(sides, strategy="rounds")
    assert m.rounds > 1 and "Join" not in plans[-1]
    assert _aligned(m.blocks, *REPEATED)


def test_many_files_are_not_broadcast(spark):
    conf = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(conf)
    with session.few_broadcasts(spark, session.BROADCAST_ROWS + 1):
        assert spark.conf.get(conf) == "-1"
    with session.few_broadcasts(spark, session.BROADCAST_ROWS):
        assert spark.conf.get(conf) == before
    assert spark.conf.get(conf) == before


def test_chain_files_are_matched_by_one_shuffle_of_the_text(spark, monkeypatch):
    monkeypatch.setattr(matching, "DEFAULT_BLOCK_BITS", 2)  # runs go over several blocks
    monkeypatch.setattr(matching, "prepare", None)  # lines are not tagged one by one
    a = [str(i) for i in range(40)]
    b = a[:9] + ["x", "y"] + a[9:17] + a[20:] + ["z"]
    assert _aligned(matching.match_lines(to_sides(lines_df(spark, {"f": a}, 2), lines_df(spark, {"f": b}, 2))).blocks, a, b)


def test_whole_versions_shuffle_no_row_a_line(spark):
    rows = [("f", 1, 3, 1), ("f", 1, 3, 2), ("f", 1, 3, 2), ("g", 1, 2, 1), ("g", 1, 2, 1), ("h", 1, 0, None), ("k", 1, 40_000, 40_000)]
    df = spark.createDataFrame(rows + [("f", 1, 3, 3)], "file_name string, version long, n_lines long, line_number int")
    found = pipelines.whole_versions(df)
    assert sorted(map(tuple, found.collect())) == [("f", 1, True), ("h", 1, False)]
    assert "line_number" not in found._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0].split("Aggregate")[1]


def test_a_batch_is_decoded_by_all_cores(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "t"))
    one = spark.read.parquet(str(tmp_path / "t"))
    assert one.rdd.getNumPartitions() == 1
    assert sink.spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_many_changed_files_are_diffed_without_a_join(spark, monkeypatch):
    old = lines_df(spark, {"f": list("abc"), "g": list("ab"), "h": list("abcde")})
    new = lines_df(spark, {"f": list("axc"), "g": list("ab"), "h": list("abde")})
    pick = ("file_name", "event_type", "line_number", "old_value", "new_value")
    want = sorted(map(str, diff.diff_lines(old, new).select(*pick).collect()))
    monkeypatch.setattr(diff, "BROADCAST_FILES", 0)
    got = diff.diff_per_file(old, new, max_lines=100)
    assert sorted(map(str, got.select(*pick).collect())) == want
    assert "LeftSemi" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(str, diff.diff_per_file(old, new, max_lines=4).select(*pick).collect())) == want


def test_rebuilding_meets_each_line_once(spark, tmp_path):
    versions = [[str(i) for i in range(30)]]
    versions.append([x for k, x in enumerate(versions[0]) if k % 3] + ["new"])
    versions.append(["first"] + [x + "!" if k % 4 == 0 else x for k, x in enumerate(versions[1])])
    lines = lines_df(spark, {"f": versions[0]}, 1)
    for v, x in enumerate(versions[1:], 2):
        lines = lines.unionByName(lines_df(spark, {"f": x}, v))
    deltas.write_deltas(lines, diff.diff_versions(lines), str(tmp_path / "h"), every=3)
    out = deltas.rebuild(spark, str(tmp_path / "h"), spark.createDataFrame([("f", 3)], "file_name string, version long"))
    assert [r["line"] for r in out.orderBy("line_number").collect()] == versions[2]
    joins = [x for x in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x]
    assert joins and not any(">=" in x or "<=" in x for x in joins)
