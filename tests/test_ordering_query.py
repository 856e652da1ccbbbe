"""Block-distributed ranks, debounce, audit."""

import datetime as dt

from pyspark.sql import functions as F

from linecdc.operators.ordering import prefix_sum, rank_within
from linecdc.operators.query import debounce


def test_rank_and_prefix_sum_across_blocks(spark):
    rows = [("a", p, p % 3) for p in range(0, 200, 3)] + [("b", p, 1) for p in range(50)]
    df = spark.createDataFrame(rows, "k string, pos long, v long")
    r = rank_within(df, ["k"], "pos", "rk", block_bits=3)
    s = prefix_sum(df, ["k"], "pos", F.col("v"), "ps", block_bits=3, inclusive=True)
    got_r = {(x.k, x.pos): x.rk for x in r.collect()}
    got_s = {(x.k, x.pos): x.ps for x in s.collect()}
    for k in ("a", "b"):
        ks = sorted(p for kk, p, _ in rows if kk == k)
        acc = 0
        for i, p in enumerate(ks):
            acc += [v for kk, pp, v in rows if kk == k and pp == p][0]
            assert got_r[(k, p)] == i
            assert got_s[(k, p)] == acc


def test_debounce_breaks_only_after_gap(spark):
    t0 = dt.datetime(2024, 1, 1)
    mins = [0, 5, 15, 30, 41, 300]
    rows = [("f", t0 + dt.timedelta(minutes=m), i) for i, m in enumerate(mins)]
    df = spark.createDataFrame(rows, "file_name string, ts timestamp, version long")
    got = sorted((r.n_saves, r.version) for r in debounce(df, 600).collect())
    # 0,5,15 (gap exactly 10 merges) | 30 | 41 | 300
    assert got == [(1, 3), (1, 4), (1, 5), (3, 2)]
