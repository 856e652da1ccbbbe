import json
import random

import numpy as np

from linecdc.llm import toxicity as T
from linecdc.llm.common import id_mod, table


def rows(n=600, seed=2):
    rng = random.Random(seed)
    plain, bad = [f"word{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(100)], ["idiot", "moron", "vequan", "vequte", "vequson"]
    out = []
    for i in range(n):
        w = rng.choices(plain, k=30)
        toxic = rng.random() < 0.15
        if toxic:
            w[3], w[9] = rng.choices(bad, k=2)
        out.append((i, " ".join(w), int(toxic)))
    return out


def test_held_out_accuracy_and_stems(spark):
    data = rows()
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in T.op3_query(docs, labels).collect()}
    held = [(got[i]["predicted"], y) for i, _, y in data if got[i]["held_out"]]
    assert np.mean([p == y for p, y in held]) > 0.97 and 100 < len(held) < 300
    index = T.fit(docs, labels.where(id_mod("doc_id", 3) != 1).withColumnRenamed("toxic", "label"))
    assert index.score("a vequzzz here and a vequyyy")[0] > 0.5  # unseen forms of a stem
    evidence = json.loads(next(r["evidence"] for r in got.values() if r["predicted"] == 1))
    assert all(e["label"] in (0, 1) and 0 < e["cosine"] <= 1 + 1e-9 for e in evidence)


def test_nearest_is_exact():
    data = rows(900, 5)
    terms = sorted({w for _, t, _ in data for w in t.split()})
    index = T.build([(i, y, t, i) for i, t, y in data], terms, {0: 800, 1: 100})
    assert len(index.blocks) > 10
    vectors = [index.vector(t) for _, t, _ in data]
    dense = np.zeros((len(data), len(terms)))
    for row, (t, w) in zip(dense, vectors):
        row[t] = w
    for q in range(0, 900, 45):
        e, c = index.nearest(*vectors[q], k=7)
        cos = dense @ dense[q]
        assert np.allclose(sorted(c, reverse=True), np.sort(cos)[::-1][:7])
        assert np.allclose(cos[e], c)


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 0.1), (2, "", 0.2), (2, "", 0.2), (3, "x", 0.3)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = T.op3_query(docs, none).collect()
    assert len(got) == 4 and {r["score"] for r in got} == {0.5} and {r["predicted"] for r in got} == {0}
    odd = spark.createDataFrame([(1, None), (None, 1), (2, 0), (2, 1), (77, 1)], "doc_id long, toxic int")
    assert len(T.op3_query(docs, odd).collect()) == 4
    assert T.op3_query(docs.limit(0), odd).collect() == []


def test_score_ignores_ids_and_order(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    labels = table(spark, "/root/testdata/sf0.001", "labels")
    a = {r["doc_id"]: r["score"] for r in T.op3_query(docs, labels).collect()}
    b = {r["doc_id"]: r["score"] for r in T.op3_query(docs.repartition(7), labels.repartition(3)).collect()}
    assert a == b and all(0 <= s <= 1 for s in a.values())
