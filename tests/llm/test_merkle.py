import hashlib
import re

import pytest
from pyspark.sql import functions as F

from linecdc.llm import merkle as M

ROWS = [(3, "Alpha beta, gamma.\nDelta epsilon zeta eta.\n\nNew section here"), (1, None), (7, ""), (5, "x"),
        (9, "One two three four five six seven eight nine ten.\nAnd more words follow. " * 50), (9, "tie"), (9, "tie"), (2, "ünï cödé 😀 " * 9)]


def expected(rows):
    order = sorted(((i, t or "") for i, t in rows))
    out = []
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        q = len(t) // 4
        out.append((i, len(t), hashlib.sha256((t[:len(t) - q] + nxt[:q]).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("ranges", [1, 2, 40])
def test_next_document_across_ranges(spark, ranges):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    got = [(r["doc_id"], r["text"], r["next_text"]) for r in M.with_next(docs, ranges).collect()]
    order = sorted((i, t or "") for i, t in ROWS)
    assert sorted(got) == sorted((i, t, order[(k + 1) % len(order)][1]) for k, (i, t) in enumerate(order))


def test_digest_matches_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "c", 1) for i, t in ROWS], "doc_id long, text string, range string, key int")
    rows = M.op2_query(docs).collect()
    assert sorted((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows) == expected(ROWS)
    for r in rows:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert M.op2_query(docs.limit(0)).collect() == []
    long = next(r for r in rows if r["n_chars"] > 1000)
    assert long["near_edited"] > 0.4
    ties = [r for r in rows if r["n_chars"] == 3]
    assert len({r["fingerprint"] for r in ties}) == 1 and {r["near_next"] for r in ties} == {1.0, 0.0}


def test_null_ids_come_first(spark):
    docs = spark.createDataFrame([(None, "n"), (1, "a"), (2, "b")], "doc_id long, text string")
    assert {r["text"]: r["next_text"] for r in M.with_next(docs, 3).collect()} == {"n": "a", "a": "b", "b": "n"}


def test_differing_branches_locate_edits(spark):
    old = spark.createDataFrame([(1, "a\nb\n\nc\nd"), (2, "same\ntext")], "doc_id long, text string")
    new = spark.createDataFrame([(1, "a\nB\n\nc"), (2, "same\ntext")], "doc_id long, text string")
    got = {tuple(r) for r in M.differing(M.tree(old), M.tree(new)).collect()}
    assert got == {(1, 0, 1, "changed"), (1, 1, 1, "removed")}


def test_differing_aligns_by_hash(spark):
    pairs = [("a\nb\nc\n\nd\ne", "x\n\na\nnew\nb\nC\n\nd\ne"), ("a\n\nb\n\nc", "c\n\na\n\nb"), ("a\na\nb", "a\nb"),
             ("p\nq\nr\n\ns", "p\nnew\nq\nr\n\nt\n\ns"), ("a\nb", "a\n\nb"), ("u\n\nk", "k\n\nv")]
    old, new = (spark.createDataFrame([(i, p[side]) for i, p in enumerate(pairs)], "doc_id long, text string") for side in (0, 1))
    got = {tuple(r) for r in M.differing(M.tree(old), M.tree(new)).collect()}
    of = lambda i: {g[1:] for g in got if g[0] == i}
    assert of(0) == {(0, 0, "added"), (1, 1, "added"), (0, 2, "changed")}
    assert of(1) == {(0, None, "moved"), (2, None, "moved")}
    assert of(2) == {(0, 1, "removed")}
    assert of(3) == {(0, 1, "added"), (1, 0, "added")}
    assert of(4) == {(0, 1, "moved")}
    assert of(5) == {(0, 0, "removed"), (1, 0, "added")}


def test_near_copies_of_lists_and_spaceless_texts(spark):
    """Of trees, and of the query's own columns: the next document as near copy."""
    lines = "\n".join(f"item {i} of the list" for i in range(500))
    code = "\n".join(f"    x{i} = f(y{i}, {i * i})  # step" for i in range(300))
    spaceless = "".join(chr(0x4E00 + i * 7919 % 20000) for i in range(4000))
    pairs = [(lines, "word\n" + lines), (spaceless, spaceless[:3000] + "".join(chr(0xAC00 + i) for i in range(1000))),
             (code, code.replace("    x7 = ", "    z7 = ").replace("x100 ", "x100  ")), ("a b", "c d"), ("", None)]
    old, new = (spark.createDataFrame([(i, p[side]) for i, p in enumerate(pairs)], "doc_id long, text string") for side in (0, 1))
    got = {r["doc_id"]: r["likeness"] for r in M.alike(M.tree(old), M.tree(new)).collect()}
    assert got[0] == 500 / 501 and 0.55 < got[1] < 0.65 and got[2] > 0.95 and (got[3], got[4]) == (0.0, 1.0)
    docs = spark.createDataFrame([(2 * i + side, t) for i, p in enumerate(pairs) for side, t in enumerate(p)], "doc_id long, text string")
    near = {r["doc_id"]: r["near_next"] for r in M.op2_query(docs).collect()}
    assert {i: near[2 * i] for i in range(5)} == got


def leaves_of(text):
    """The leaves in plain Python."""
    out = set()
    for line in (text or "").split("\n"):
        for run in re.findall(M.RUN, line):
            word = run.strip(" ")
            out |= {word[i:i + M.WINDOW] for i in range(len(word) - M.WINDOW + 1)} if re.search("[^ ]{25}", run) else {word}
    return out - {""}


def test_leaves_against_a_plain_version(spark):
    texts = [t for _, t in ROWS] + ["", " \n  \n\n ", "a  b   c. d\n" * 3, "q" * 30 + " end. " + "é" * 24 + "\n" + "z" * 25, "one, two; three: four\n\n\nfive"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    trees = M.tree(docs).join(docs, "doc_id").select("doc_id", "root", F.size("leaves").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in trees} == {i: len(leaves_of(t)) for i, t in enumerate(texts)}
    near = {r["doc_id"]: r for r in M.op2_query(docs).collect()}
    for i in range(len(texts) - 1):
        a, b = leaves_of(texts[i]), leaves_of(texts[i + 1])
        want = 1.0 if (texts[i] or "") == (texts[i + 1] or "") else len(a & b) / len(a | b) if a | b else 0.0
        assert near[i]["near_next"] == pytest.approx(want)
    same = spark.createDataFrame([(0, "a b\nc"), (1, "a b\n c"), (2, "a  b\nc"), (3, "a b\n\nc"), (4, "a b c"), (5, "a b\nc ")], "doc_id long, text string")
    assert M.tree(same).select("root").distinct().count() == 6  # the cuts lose nothing
