import hashlib
from collections import Counter

import corpus_pipeline as P
import __spark_entry__ as E
from linecdc.llm import chosen_path
from linecdc.llm.common import table
from test_chosen_path import brute

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    assert [n for n, _ in P.STAGES] == ["language_id", "near_duplicates", "secrets", "mixing", "tokens"]
    out, seen = {}, docs
    for name, stage in P.STAGES:
        path = P.scratch_path(spark, "test")
        stage(spark, seen, SF).write.parquet(path)
        seen = out[name] = spark.read.parquet(path)
        if name != "tokens":
            assert seen.columns == columns
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {r["doc_id"]: r["text"] for r in out["language_id"].collect()}
    assert set(before) - set(kept) == {i for i, t in before.items() if not any(map(str.isalpha, t or ""))}
    stay = {d for d, c, _ in brute(list(kept.items())) if d == c}
    assert {r["doc_id"] for r in out["near_duplicates"].collect()} == stay
    masked = {r["doc_id"]: r for r in out["secrets"].collect()}
    assert set(masked) == stay and all(len(r["text"]) == r["n_chars"] for r in masked.values())
    assert all(r["text"] == kept[i] or "[secret]" in r["text"] for i, r in masked.items())
    copies = Counter(r["doc_id"] for r in out["mixing"].collect())
    assert set(copies) == stay and max(copies.values()) >= 1
    final = out["tokens"].collect()
    assert Counter(r["doc_id"] for r in final) == copies
    assert all(r["decoded_sha256"] == hashlib.sha256(masked[r["doc_id"]]["text"].encode()).hexdigest() for r in final)


def test_nulls_repeats_and_empty(spark):
    text = "one two three four five six seven eight nine ten eleven"
    rows = [(1, text, "en"), (1, text, "en"), (2, text.upper(), "en"), (3, None, None), (4, "", "en"), (5, "### 12", "en"),
            (6, "token=abcdefabcdefabcdef " + text[::-1], None), (7, "der hund und die katze gehen heute nach hause", "de")]
    docs = spark.createDataFrame([(*r, "s", 1, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, _found string")
    near = P.near_duplicate_stage(spark, P.language_stage(spark, docs, SF), SF)
    assert sorted(r["doc_id"] for r in near.collect()) == [1, 6, 7]
    clean = P.secret_stage(spark, docs, SF)
    assert clean.columns == docs.columns and clean.count() == 8
    assert [r["text"][:9] for r in clean.where("doc_id = 6").collect()] == ["[secret] "]
    assert P.mixing_stage(spark, docs, SF).columns == docs.columns
    for _, stage in P.STAGES:
        assert stage(spark, docs.limit(0), SF).collect() == []


def test_near_copies_under_one_id_and_null_ids(spark):
    words = [f"w{i}" for i in range(100)]
    near = lambda *at: " ".join("x" if i in at else w for i, w in enumerate(words))
    other = " ".join(f"o{i}" for i in range(100))
    rows = [(5, near()), (5, near(0)), (5, other), (9, other + " end"), (5, other), (3, "three " + near()),
            (None, "alone " + other[::-1]), (None, other[::-1]), (None, other[::-1]), (None, "own text"), (7, None), (7, "")]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, n long")
    got = P.near_duplicate_stage(spark, docs, SF).collect()
    assert [r["text"] for r in got if r["doc_id"] == 3] == ["three " + near()]
    assert [r["text"] for r in got if r["doc_id"] == 5] == [other]
    nulls = [r["text"] for r in got if r["doc_id"] is None]
    assert len(nulls) == 2 and "own text" in nulls
    assert sorted(r["doc_id"] or 0 for r in got) == [0, 0, 3, 5, 7]


def test_registered():
    names = list(E.queries())
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and chosen_path.THRESHOLD == 0.8 and chosen_path.NGRAM == 5
