import numpy as np
import pytest

from linecdc.llm import curve_search as C


def brute(ids, x, q, k):
    d = np.sqrt(((x - x[q]) ** 2).sum(1))
    d[q] = np.inf
    best = np.lexsort((ids, d))[:k]
    return [(int(ids[i]), float(d[i])) for i in best if np.isfinite(d[i])]


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids, x)], "vec_id long, embedding array<float>")


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6000, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[100:140] = x[7]  # copies
    ids = np.arange(6000)
    rows = C.op8_query(frame(spark, ids, x)).collect()
    hit = total = 0
    for q in range(0, 6000, 100):
        want = brute(ids, x.astype(float), q, 10)
        got = sorted((r["rank"], r["vec_id"], r["score"]) for r in rows if r["query_id"] == q)
        assert [g[0] for g in got] == list(range(1, 11))
        true = np.sqrt(((x.astype(float)[[g[1] for g in got]] - x[q].astype(float)) ** 2).sum(1))
        assert np.allclose(true, [g[2] for g in got], rtol=0, atol=1e-12)
        hit += len({g[1] for g in got} & {w[0] for w in want})
        total += 10
    assert hit / total >= 0.9
    hundred = [(r["rank"], r["vec_id"]) for r in rows if r["query_id"] == 100]
    assert [v for _, v in sorted(hundred)] == [7, *range(101, 110)]  # ties go to the smaller id


def test_recall_of_a_sampled_fit(spark, monkeypatch):
    monkeypatch.setattr(C, "SAMPLE", 600)  # a tenth of the table
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6000, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = C.op8_query(frame(spark, np.arange(6000), x)).collect()
    hit = 0
    for q in range(0, 6000, 100):
        got = {r["vec_id"] for r in rows if r["query_id"] == q}
        hit += len(got & {w[0] for w in brute(np.arange(6000), x.astype(float), q, 10)})
    assert hit / 600 >= 0.9


def test_edge_cases(spark):
    rows = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (100, [1.0, 0.0]), (200, [0.0, 0.0]), (300, None), (400, [float("nan"), 1.0]),
            (500, [1.0, None]), (600, [1.0, 2.0, 3.0]), (700, []), (5, [0.0, 2.0]), (None, [1.0, 1.0]), (800, [float("inf"), 0.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, cell int")
    got = {(r["query_id"], r["rank"], r["vec_id"]): r["score"] for r in C.op8_query(df).collect()}
    assert got == {(0, 1, 100): 0.0, (0, 2, 5): pytest.approx(5**0.5), (100, 1, 0): 0.0, (100, 2, 5): pytest.approx(5**0.5)}
    assert C.op8_query(df.limit(0)).collect() == []
    assert C.op8_query(df.where("vec_id = 300")).collect() == []


def test_hot_cells_are_split_not_dropped(spark, monkeypatch):
    monkeypatch.setattr(C, "CELL_ROWS", 50)
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(1, 8)), 900, axis=0) + rng.normal(size=(900, 8)) * 1e-9
    x = x.astype(np.float64)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    rows = C.search(df, lambda c: c % 300 == 0).collect()
    assert len(rows) == 30


def test_hilbert_order_is_a_walk():
    grid = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)], np.uint32)
    key = C.hilbert_keys(grid, 3)
    assert sorted(key) == list(range(512))
    walk = grid[np.argsort(key)].astype(int)
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_vectors_far_from_the_origin(spark):
    """The rerank chooses among neighbours whose squares cancel: all in one cell."""
    rng = np.random.default_rng(2)
    x = 1e8 + rng.normal(size=(600, 16))
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in C.search(df, lambda c: c % 20 == 0, k=5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    for q, found in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        assert [v for _, v in sorted(found)] == np.argsort(d, kind="stable")[:5].tolist()
