import random
import re

import numpy as np
import pytest

from linecdc.llm import chosen_path as C
from linecdc.llm.components import components


def brute(rows, threshold=0.8, n=5):
    words = [re.findall(r"\w+", (t or "").lower()) for _, t in rows]
    sets = [{tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else {("text", t or "")} for w, (_, t) in zip(words, rows)]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both / (len(sets[i]) + len(sets[j]) - both) >= threshold:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, least[find(i)], links[i]) for i, (d, _) in enumerate(rows))


def corpus(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = " ".join(rng.choices(vocabulary, k=40))
    rows, at = [], 0
    for group in range(40):
        base = rng.choices(vocabulary, k=rng.choice([3, 8, 40, 200, 900]))
        for copy in range(rng.choice([1, 1, 2, 5, 12])):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, max(1, len(w) // 60)])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            text = " ".join(w)
            if group % 3 == 0:
                text += ". " + passage
            rows.append((at, text.upper() if copy == 1 else text))
            at += 1
    rows += [(at, None), (at + 1, ""), (at + 2, "###"), (at + 3, "###"), (at + 4, "one"), (at + 5, "One."), (7, rows[7][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("limits", [{}, {"leaf": 4, "block": 5, "block_tokens": 300}])
def test_classes_and_links_match_brute_force(spark, limits):
    rows = corpus()
    docs = spark.createDataFrame([(*r, b"x", 1) for r in rows], "doc_id long, text string, sid binary, n int")
    got = sorted(tuple(r) for r in C.join_sets(docs, **limits).collect())
    assert got == brute(rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert C.op5_query(docs).collect() == []


def test_hashes_do_not_depend_on_place(spark):
    alone = [C.tokens_of(C.word_hashes([t])[0]) for t in ("a b c d e f", "x y", "")]
    together = list(C.token_sets(["junk text", "a b c d e f", "x y", None, "a b c d e f"]))
    assert (together[1] == alone[0]).all() and (together[2] == alone[1]).all() and len(together[3]) == 0
    assert C.set_id(together[1], "") == C.set_id(together[4], "")


def test_intersections():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 400, rng.integers(1, 300)).astype(np.uint64)) for _ in range(70)]
    got = C.intersections(sets)
    for i in range(70):
        for j in range(70):
            if i != j:
                assert got[i, j] == len(np.intersect1d(sets[i], sets[j]))


def test_recall_of_the_paths():
    """Pairs at the threshold meet in a leaf at the last depth at least as often as aimed at."""
    rng = np.random.default_rng(1)
    met, runs = 0, C.runs_for(C.TARGET)
    for _ in range(300):
        shared = C.mix(rng.integers(0, 2**63, 160).astype(np.uint64))
        x, y = (np.sort(np.r_[shared, C.mix(rng.integers(0, 2**63, 20).astype(np.uint64))]) for _ in range(2))
        a, b = C.paths_of(x, runs, 0.8)[-1][1], C.paths_of(y, runs, 0.8)[-1][1]
        met += len(np.intersect1d(a, b)) > 0
    assert met >= 297


def test_recall_of_contained_sets():
    """As above where one set holds the other, against the target."""
    rng = np.random.default_rng(2)
    n, missed, runs = 6000, 0, C.runs_for(C.TARGET)
    for _ in range(n):
        x = C.mix(rng.integers(0, 2**63, 200).astype(np.uint64))
        a, b = C.paths_of(x, runs, 0.8)[-1][1], C.paths_of(x[:160], runs, 0.8)[-1][1]
        missed += len(np.intersect1d(a, b)) == 0
    allowed = n * (1 - C.TARGET)
    assert missed <= allowed + 2 * allowed**0.5


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 90), (90, 95), (200, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(61)}, 90: 90, 95: 90, 100: 90}


def test_rows_that_share_an_id_or_have_none(spark):
    """Each text meets its own set only: links and classes as with ids of their own."""
    texts = [" ".join(f"w{i}x{j}" for j in range(40)) + (" tail" if k else "") for i in range(150) for k in (0, 1)]
    for ids in ([None] * len(texts), [7] * len(texts)):
        df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
        rows = C.join_rows(df).collect()
        assert len(rows) == 300 and {r["n_links"] for r in rows} == {1} and len({r["root"] for r in rows}) == 150
        kept = C.heads(df).collect()
        assert len(kept) == 150 and {r["copies"] for r in kept} == {1}
