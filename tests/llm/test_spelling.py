import zlib
from collections import Counter

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from linecdc.llm import spelling as S

LOWER = str.maketrans(S.UPPER, S.LOWER)


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def count(docs):
    words = Counter()
    for doc, text in docs:
        for run in regex.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            words[run] += 1
    return {w: n for w, n in words.items() if len(w) >= 7 and n >= 2}


def brute(words):
    out = {}
    near = {w: [v for v in words if one_apart(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words.get(form[w]))
    return out


def rows(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.text("abc", max_size=5)), min_size=1, max_size=60), st.integers(1, 4),
       st.sampled_from([1, 7, 400_000]))
def test_scan_of_lists(items, length, states):
    """Every pair one edit apart, of gaps with ``length`` and one more letter, once from each side."""
    S.STATES = states
    items = sorted({(k, t) for k, t in items if len(t) in (length, length + 1)})
    if not items:
        return
    gaps, group = [t for _, t in items], np.array([k for k, _ in items])
    a, b = S.one_edit(gaps, group, np.full(len(gaps), length))
    got = sorted(zip(a.tolist(), b.tolist()))
    assert got == sorted((i, j) for i, x in enumerate(items) for j, y in enumerate(items)
                         if x[0] == y[0] and len(x[1]) == length and one_apart(x[1], y[1]))


def some_words(n, letters, seed):
    rng = np.random.default_rng(seed)
    base = ["".join(rng.choice(list(letters), size=rng.integers(7, 12))) for _ in range(n)]
    out = set(base)
    for w in base:
        for _ in range(3):
            i, c = int(rng.integers(0, len(w))), str(rng.choice(list(letters)))
            out |= {w[:i] + c + w[i + 1:], w[:i] + w[i + 1:], w[:i] + c + w[i:]}
    return {w: int(rng.choice([2, 3, 20, 250, 3000])) for w in sorted(out) if len(w) >= 7}


@pytest.mark.parametrize("most, chunk, letters", [(8192, 65536, "abé"), (4, 50, "ab"), (30, 10, "aÿ"), (2, 4, "ab")])
def test_grouping_against_brute_force(spark, monkeypatch, most, chunk, letters):
    """Also with hot lists, which halve down to one letter, and chunks smaller than lists."""
    # (A list of one place may hold two letters and their pairs here: it must fit.)
    monkeypatch.setattr(S, "MOST", max(most, 6))
    monkeypatch.setattr(S, "CHUNK", chunk)
    words = some_words(60, letters, 4)
    words |= {"a" * 500: 7, "a" * 499 + "b": 80, "a" * 501: 2}
    vocab = spark.createDataFrame([(i, w, n) for i, (w, n) in enumerate(sorted(words.items()))], "wid long, word string, n long")
    assert rows(S.group(vocab.repartition(3))) == brute(words)


def test_whole_texts(spark):
    rng = np.random.default_rng(2)
    vocab = [w for w in some_words(40, "aeinrstéÀ", 8) if "×" not in w]
    docs = [(i, " ".join(rng.choice(vocab, size=300)) + " Ab" + "c" * 9 + "! x7abcdefg_hijklmn") for i in range(40)]
    docs += [(None, "Lorance " * 40), (7, "Lorance " * 40), (7, "Lorance " * 40), (900, None), (901, ""), (902, "Lorenc3e 12 -"),
             (903, "z" * 4000 + " " + "Z" * 4000 + " " + "z" * 4001 + " " + "z" * 4001)]
    df = spark.createDataFrame([(*d, "w", 1) for d in docs], "doc_id long, text string, word string, n int").repartition(4)
    got = rows(S.op11_query(df))
    assert got == brute(count(docs))
    assert any(f for f, *_ in got.values()) and "lorance" in got


def test_chains_and_ties(spark):
    words = {"abcdefg": 2, "abcdefgh": 20, "abcdefghi": 200, "abcdefghij": 3000, "bbcdefg": 20, "tttttttx": 5, "ttttttty": 50, "tttttttz": 50}
    vocab = spark.createDataFrame([(i, w, n) for i, (w, n) in enumerate(sorted(words.items()))], "wid long, word string, n long")
    got = rows(S.group(vocab))
    assert got == brute(words)
    assert got["abcdefg"][:2] == ("abcdefgh", "abcdefghij") and got["tttttttx"][0] == "ttttttty"


def test_no_words(spark):
    for docs in ([], [(1, None), (2, "short words only"), (3, "onlyonce")]):
        assert S.op11_query(spark.createDataFrame(docs, "doc_id long, text string")).collect() == []
