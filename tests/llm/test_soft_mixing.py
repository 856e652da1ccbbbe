import numpy as np
import pytest
from pyspark.sql import functions as F

from linecdc.llm import soft_mixing as M


def data(spark, n=300):
    kinds = {"a": "alpha beta gamma delta", "b": "one two three four", "c": "alpha beta three four"}
    rows = []
    for i in range(n):
        k = "a" if i % 10 < 6 else "b" if i % 10 < 9 else "c"
        w = kinds[k].split()
        rows.append((i, " ".join(w[(i * 7 + j) % 4] for j in range(5 + i % 40)), k))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, k) for i, _, k in rows if i % 2], "doc_id long, domain string")
    return docs, labels


def test_rates_match_a_brute_force_fit(spark):
    docs, labels = data(spark)
    m = M.mix(docs, labels, weights={"a": 1.0, "b": 1.0, "c": 1.0})
    assert m.domains == ["a", "b", "c"] and np.allclose(m.reached, m.targets, rtol=5e-3)
    rows = m.table.orderBy("doc_id").collect()
    n = np.array([r["n"] for r in rows], float)
    p = np.array([[r[f"p{k}"] for k in range(3)] for r in rows])
    assert np.allclose(p.sum(1), 1) and n.sum() == sum(len(r["text"].split()) for r in docs.collect())
    r = np.ones(len(n))
    c, t = p.T @ n, np.array(m.targets)
    for _ in range(m.steps):
        r = np.maximum(0, r - p @ ((p.T @ (n * r) - t) / c))
    assert np.allclose(r, [x["rate"] for x in rows], atol=1e-6)
    right = docs.join(labels, "doc_id").count()
    best = {x["doc_id"]: "abc"[int(np.argmax(q))] for x, q in zip(rows, p)}
    assert sum(best[r["doc_id"]] == r["domain"] for r in labels.collect()) / right > 0.9


def test_floor_keeps_every_document(spark):
    docs, labels = data(spark)
    m = M.mix(docs, labels, power=0.5, floor=1.0)
    rates = [r["rate"] for r in m.table.collect()]
    assert min(rates) >= 1.0 and np.allclose(m.reached, m.targets, rtol=0.02)
    copies = m.table.select(M.copies(F.col("rate"), "doc_id", "h").alias("c"), "rate").collect()
    assert all(int(r["rate"]) <= r["c"] <= int(r["rate"]) + 1 for r in copies)


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (2, "", 1.0), (3, "x y", 1.0), (3, "x y", 1.0), (None, "z", 1.0)], "doc_id long, text string, rate double")
    none = spark.createDataFrame([], "doc_id long, domain string")
    m = M.mix(docs, none)
    rows = m.table.collect()
    assert m.domains == ["all"] and len(rows) == 5 and {r["rate"] for r in rows} == {1.0}
    odd = spark.createDataFrame([(1, "p"), (3, "q"), (3, "r"), (None, "s"), (9, None)], "doc_id long, domain string")
    m = M.mix(docs, odd)
    assert len(m.table.collect()) == 5 and m.domains == ["q"]
    assert M.mix(docs.limit(0), odd).table.collect() == []


def test_budget(spark):
    docs, labels = data(spark, 100)
    m = M.mix(docs, labels, budget=4000.0)
    assert sum(m.reached) == pytest.approx(4000, rel=0.01)
