import numpy as np
import pytest
from pyspark.sql import functions as F

from linecdc.llm import vector_codes as V

KIND = "vec_id long, embedding array<double>, label int"


def brute(rows, parts, entries, rounds, scale):
    """The rule in plain Python integers."""
    ints = [[(lambda a, b: a * scale // b)(*float(x).as_integer_ratio()) for x in v] for _, v, _ in rows]
    cut = [[list(map(int, a)) for a in np.array_split(np.array(v, object), parts)] for v in ints]
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))[:entries]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    books = [[cut[i][p] for i in first] for p in range(parts)]
    pick = lambda p: [min(range(len(books[p])), key=lambda e: (far(c[p], books[p][e]), e)) for c in cut]
    for _ in range(rounds):
        for p in range(parts):
            own = pick(p)
            books[p] = [[sum(col) // own.count(e)
                         for col in zip(*(cut[i][p] for i in range(len(rows)) if own[i] == e))] if e in own else books[p][e]
                        for e in range(len(books[p]))]
    codes = [pick(p) for p in range(parts)]
    return ["".join(f"{codes[p][i]:02x}" for p in range(parts)) for i in range(len(rows))], \
           [sum(far(cut[i][p], books[p][codes[p][i]]) for p in range(parts)) for i in range(len(rows))], books


def run(spark, rows, kind=KIND, **kw):
    c = V.compress(spark.createDataFrame(rows, kind).repartition(3), **kw)
    return c.rows.collect(), c.books


@pytest.mark.parametrize("spread, length", [(1.0, 16), (3000.0, 11), (1e30, 8)])
def test_as_brute_force(spark, spread, length):
    """Small values, several limbs with uneven parts, and values beyond int64."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=length) * spread], i % 3) for i in range(120)]
    rows += [(200 + i, rows[i][1], None) for i in range(10)]  # equal vectors
    got, books = run(spark, rows, parts=4, entries=6, rounds=3, scale=4096)
    code, error, want = brute(rows, 4, 6, 3, 4096)
    assert books == want
    assert {r["vec_id"]: (r["code"], r["error"]) for r in got} == {
        r[0]: (c, min(e, V.LONG_MAX)) for r, c, e in zip(rows, code, error)}


def test_exact_dots_of_many_limbs():
    rng = np.random.default_rng(5)
    a, b = (rng.integers(-2 ** 26, 2 ** 26, size=(n, 64)) for n in (50, 7))
    assert (V.exact_dots(a, b, 27) == a @ b.T).all()


def test_ties_go_to_the_lower_index_and_unused_entries_stay(spark):
    rows = [(0, [0.0, 0.0], 0), (1, [2.0, 2.0], 0), (2, [0.0, 0.0], 1), (3, [1.0, 1.0], 1)]
    got, books = run(spark, rows, parts=1, entries=3, rounds=1, scale=1)
    # Entry 2 equals entry 0 and gets nothing; (1, 1) is as far from 0 as from 1.
    assert books == [[[0, 0], [2, 2], [0, 0]]]
    assert sorted((r["vec_id"], r["code"], r["error"]) for r in got) == [(0, "00", 0), (1, "01", 0), (2, "00", 0), (3, "00", 2)]


def test_floors_go_down(spark):
    _, books = run(spark, [(0, [-0.3], 0), (1, [-0.7], 0), (2, [0.1], 0)], parts=1, entries=1, rounds=1, scale=4)
    assert books == [[[-2]]]  # -2, -3, 0 sum to -5; -5 / 3 goes down


def test_nulls_lengths_repeats_and_few_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], None), (1, [1.0, 2.0], None), (None, [3.0, 4.0], 7), (4, None, 1), (5, [1.0, None], 1),
            (6, [nan, 1.0], 1), (7, [inf, 1.0], 1), (8, [1.0], 1), (9, [], 1)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], KIND + ", code string, _label int")
    got = V.op12_query(df).collect()
    assert sorted((r["vec_id"] or -1, r["code"], r["error"], r["label_error"]) for r in got) == [
        (-1, "0202" + "00" * 6, 0, 0), (1, "0000" + "00" * 6, 0, 0), (1, "0000" + "00" * 6, 0, 0)]
    assert V.op12_query(df.where("false")).count() == 0
    assert V.op12_query(df.where("vec_id = 9")).select("code", "error").collect() == [("00" * 8, 0)]


def test_label_errors_add_up(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.normal(size=16)], None if i % 4 == 0 else i % 4) for i in range(60)]
    got = V.op12_query(spark.createDataFrame(rows, KIND))
    want = {r["label"]: r["e"] for r in V.compress(spark.createDataFrame(rows, KIND)).rows.groupBy("label").agg(
        F.sum("error").alias("e")).collect()}
    assert {r["vec_id"]: r["label_error"] for r in got.collect()} == {r[0]: want[r[2]] for r in rows}
