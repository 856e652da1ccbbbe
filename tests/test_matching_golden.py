"""Golden alignment against stdlib difflib; strategies must agree; round-trip."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from conftest import lines_df
from linecdc.operators.diff import apply_changes, diff_lines, to_sides
from linecdc.operators.matching import match_lines


def _pairs(seed, n):
    rnd = random.Random(seed)
    out = {}
    for f in range(n):
        alpha = rnd.randint(2, 6)
        a = [f"l{rnd.randrange(alpha)}" for _ in range(rnd.randint(0, 25))]
        b = [f"l{rnd.randrange(alpha)}" for _ in range(rnd.randint(0, 25))]
        if f % 4 == 0:
            a = [f"u{i}" for i in range(15)]
            b = [x for x in a if rnd.random() > 0.3] + ["new"]
        out[f"f{f}"] = (a, b)
    return out


@pytest.fixture(scope="module")
def data(spark):
    pairs = _pairs(11, 24)
    old = lines_df(spark, {k: v[0] for k, v in pairs.items()})
    new = lines_df(spark, {k: v[1] for k, v in pairs.items()})
    return pairs, old, new


def _expected(pairs):
    return {f: sorted((t, i1, i2, j1, j2) for t, i1, i2, j1, j2 in
                      SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if t != "equal")
            for f, (a, b) in pairs.items()}


@pytest.mark.parametrize("strategy,walk", [("auto", 1 << 17), ("rounds", 1 << 17), ("rounds", 1)])
def test_opcodes_equal_difflib(spark, data, strategy, walk):
    pairs, old, new = data
    m = match_lines(to_sides(old, new), strategy=strategy, walk=walk)
    got = {}
    for r in m.opcodes.collect():
        got.setdefault(r.file_name, []).append((r.tag, r.i1, r.i2, r.j1, r.j2))
    exp = _expected(pairs)
    assert {f: sorted(got.get(f, [])) for f in exp} == exp


def test_apply_round_trip(spark, data):
    pairs, old, new = data
    ev = diff_lines(old, new)
    rebuilt = apply_changes(old, ev)
    got = {}
    for r in rebuilt.collect():
        got.setdefault(r.file_name, []).append((r.line_number, r.line))
    for f, (a, b) in pairs.items():
        assert [x for _, x in sorted(got.get(f, []))] == b, f


def test_event_count_is_sum_of_max(spark, data):
    pairs, old, new = data
    n = diff_lines(old, new).count()
    exp = sum(max(i2 - i1, j2 - j1) for ops in _expected(pairs).values() for _, i1, i2, j1, j2 in ops)
    assert n == exp


def test_repeated_lines_hot_value(spark):
    """Many copies of one line on both sides: no pair explosion, exact result."""
    a = ["x"] * 300 + ["a"] + ["x"] * 50
    b = ["x"] * 120 + ["b"] + ["x"] * 260
    old, new = lines_df(spark, {"hot": a}), lines_df(spark, {"hot": b})
    for walk in (1 << 17, 20):
        m = match_lines(to_sides(old, new), strategy="rounds", walk=walk)
        got = sorted((r.tag, r.i1, r.i2, r.j1, r.j2) for r in m.opcodes.collect())
        exp = sorted(o for o in SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if o[0] != "equal")
        assert got == exp, walk


@pytest.mark.parametrize("n", [40, 400])
def test_rounds_do_not_grow_with_lines(spark, n):
    """All payload lines change, the brackets around them repeat: one round takes them all."""
    a = [x for i in range(n) for x in ("{", f"old {i}")]
    b = [x for i in range(n) for x in ("{", f"new {i}")]
    m = match_lines(to_sides(lines_df(spark, {"f": a}), lines_df(spark, {"f": b})))
    assert m.rounds == 1
    assert sorted((r.i, r.j, r.n) for r in m.blocks.collect()) == [(2 * i, 2 * i, 1) for i in range(n)]
