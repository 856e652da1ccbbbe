from collections import Counter

import numpy as np
import pytest

from linecdc.llm import language_id as L
from linecdc.llm.common import table

SF = "/root/testdata/sf0.001"


def test_held_out_accuracy(spark):
    docs = table(spark, SF, "documents")
    rows = L.op9_query(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"] and r["lang"] is not None]
    assert len(rows) == docs.count() and np.mean([r["lang"] == r["lang_pred"] for r in held]) >= 0.95


def test_edge_cases(spark):
    train = [(i, "the cat and the dog", "en") for i in range(20)] + [(i, "der hund und die katze", "de") for i in range(20, 40)]
    model = L.train(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    docs = spark.createDataFrame([(1, None, 5), (2, "", 6), (3, "12 %%% !!", 7), (4, "der hund", 8), (4, "der hund", 8), (5, "the " * 300_000, 9)],
                                 "doc_id long, text string, _lid long")
    rows = L.predict(docs.withColumnRenamed("_lid", "extra"), model).collect()
    got = [(r["doc_id"], r["lang_pred"], r["score"] > 0.5, r["extra"]) for r in sorted(rows, key=lambda r: r["doc_id"])]
    assert got == [(1, "und", False, 5), (2, "und", False, 6), (3, "und", False, 7), (4, "de", True, 8), (4, "de", True, 8), (5, "en", True, 9)]
    empty = L.train(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {(r["lang_pred"], r["score"]) for r in L.predict(docs, empty).collect()} == {("und", 0.0)}
    assert L.predict(docs.limit(0), model).collect() == []


def test_ngrams_do_not_cross_texts():
    b1, of1 = L.ngrams(["abc", "def"])
    assert len(b1) == len(L.ngrams(["abc"])[0]) + len(L.ngrams(["def"])[0]) and set(of1) == {0, 1}


def plain_ngrams(text):
    """Bigrams and trigrams of the whole stream, counted by a plain loop."""
    c = [ord(x.lower()[0]) if x.isalpha() else 32 for x in f" {text} "]
    c = [x for i, x in enumerate(c) if i == 0 or x != 32 or c[i - 1] != 32]
    return Counter([tuple(c[i:i + k]) for k in (2, 3) for i in range(len(c) - k + 1)])


def bucket(gram):
    pad = np.array([*gram, *([0] * (3 - len(gram)))], np.uint32)
    two, three = L._buckets(pad, L.BUCKETS)
    return int(two[0] if len(gram) == 2 else three[0])


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1 << 19])
@pytest.mark.parametrize("text", ["", "a", "  ", "ab", "Hello, wide world 12 of été", "x  -  y" * 9, "   lead and trail   ", "word" * 40, "a b"])
def test_pieces_count_every_ngram_once(text, size):
    want = Counter()
    for g, n in plain_ngrams(text).items():
        want[bucket(g)] += n
    got = Counter()
    for b, of in L._batches([text], size):
        assert set(of.tolist()) <= {0}
        got.update(b.tolist())
    assert got == want or len(text.strip()) == 0 and sum(got.values()) <= 1


def test_a_cut_changes_no_score(monkeypatch):
    rng = np.random.default_rng(4)
    model = L.Model(["p", "q"], np.log([0.5, 0.5]), rng.normal(size=(L.BUCKETS, 2)).astype(np.float32))
    texts = ["Some words of a text, élan " * 30, "", "short", "other words " * 50]
    whole = L.score_texts(model, texts)
    monkeypatch.setattr(L, "SLICE", 100)
    cut = L.score_texts(model, texts)
    assert whole[0] == cut[0] and np.allclose(whole[1], cut[1])


def test_scores_against_a_plain_version(spark):
    """Training counts and posteriors of a small table, by plain loops."""
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr"), ("der hund", "de"),
                                                        ("the end", "en"), ("la fin", "fr")])]
    model = L.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    n = {lang: Counter() for lang in model.langs}
    for _, t, lang in rows:
        for g, k in plain_ngrams(t).items():
            n[lang][bucket(g)] += k
    for text in ("the dog", "le chien", "hund und", "fin"):
        logs = []
        for j, lang in enumerate(model.langs):
            total = sum(n[lang].values())
            p = lambda b: (n[lang][b] + 0.5) / (total + 0.5 * L.BUCKETS)  # noqa: E731,B023
            logs.append(model.prior[j] + sum(k * np.log(p(bucket(g))) for g, k in plain_ngrams(text).items()))
        post = np.exp(np.array(logs) - max(logs))
        (lang,), (score,) = L.score_texts(model, [text])
        assert lang == model.langs[int(np.argmax(logs))] and score == pytest.approx(post.max() / post.sum(), rel=1e-4)
