import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from linecdc.llm import fit_packing as K

PATH = P.path("word_bpe_49k.json")
MODEL = open(PATH, encoding="utf-8").read()
LIBRARY = Tokenizer.from_file(PATH)
LIBRARY.encode_special_tokens = True


def library(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [0]


def check(rows, docs, capacity=2048):
    """Every piece of every document once, whole, and sequences gapless and within capacity."""
    want = defaultdict(list)
    for doc, text in docs:
        ids = library(text)
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[at:at + capacity], "<u4")
            want[doc].append((k, at, len(part), zlib.crc32(part.tobytes())))
    got, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        got[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="aAΣσ İßéÉéǰJ̌'sS2²\x1c\x85\xa0 ,.!<|endoftext|>漢字ͅ", max_size=40))
def test_ids_as_the_library(text):
    assert np.frombuffer(K._words(MODEL).ids(text), "<u4").tolist() == library(text)[:-1]


def test_every_character_alone_and_in_a_word():
    words = K._words(MODEL)
    for c in range(0x500):
        for text in (chr(c), f"Ab{chr(c)}c 1{chr(c)}{chr(c)}"):
            assert np.frombuffer(words.ids(text), "<u4").tolist() == library(text)[:-1], hex(c)


def test_slices_of_a_long_text(monkeypatch):
    monkeypatch.setattr(K, "SLICE", 100)
    text = "It's one of 12 words, isn't it? Élan\n" * 50
    assert np.frombuffer(K._words(MODEL).ids(text), "<u4").tolist() == library(text)[:-1]


def fewest(sizes, capacity):
    """Fewest bins, by trying every bin for every document."""
    best = [len(sizes)]
    sizes = sorted(sizes, reverse=True)

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for b in {g: b for b, g in enumerate(bins)}.values():
            if bins[b] >= sizes[i]:
                bins[b] -= sizes[i]
                go(i + 1, bins)
                bins[b] += sizes[i]
        go(i + 1, bins + [capacity - sizes[i]])

    go(0, [])
    return best[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=9))
def test_bound_and_search_against_all_packings(sizes):
    s = np.array(sizes, np.int64)
    first = K.best_fit(s, 30)
    of = K.improve(s, first, 30)
    assert np.bincount(of, s).max() <= 30
    least = fewest(sizes, 30)
    assert K.bound(s, 30) <= least <= len(set(of.tolist())) <= len(set(first.tolist())) <= least + 1


@pytest.mark.parametrize("sizes, start", [
    ([5, 3, 6, 3, 2, 1], [0, 0, 1, 1, 2, 2]),  # moves
    ([6, 2, 5, 3, 4], [0, 0, 1, 1, 2]),  # one for one, then the last bin is empty
    ([4, 4, 7, 3, 2], [0, 0, 1, 2, 1]),
])
def test_exchanges_empty_bins(sizes, start):
    s = np.array(sizes, np.int64)
    of = K.improve(s, np.array(start), 10)
    assert np.bincount(of, s).max() <= 10 and len(set(of.tolist())) == -(-sum(sizes) // 10)


def test_search_beats_best_fit():
    s = np.random.default_rng(0).integers(300, 800, 1500)
    first = K.best_fit(s, 2048)
    of = K.improve(s, first, 2048)
    assert len(set(of.tolist())) < len(set(first.tolist())) and np.bincount(of, s).max() <= 2048


def test_packing_of_a_table(spark):
    rng = np.random.default_rng(1)
    docs = [(i, "word " * int(n)) for i, n in enumerate(rng.integers(0, 900, 400))]
    docs += [(900, "token " * 5000), (901, ""), (902, None), (None, "no id"), (903, "x " * 2047), (903, "x " * 2047), (904, "x " * 2048)]
    df = spark.createDataFrame([(*d, 1, "y") for d in docs], "doc_id long, text string, gap int, piece string").repartition(4)
    rows = K.pack(df, PATH, group=64).collect()
    total = sum(len(library(t)) for _, t in docs)
    assert check(rows, docs) <= -(-total // 2048) + 1
    # Gaps are what the sequences have left, also after a later level.
    fill = defaultdict(int)
    for r in rows:
        fill[r["sequence_id"]] += r["length"]
    assert all(r["gap"] == 2048 - fill[r["sequence_id"]] for r in rows)


def test_documents_that_no_search_can_pair(spark):
    docs = [(i, "word " * 1300) for i in range(60)]
    assert check(K.pack(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), PATH, group=8).collect(), docs) == 60


def test_empty_table_and_query_columns(spark):
    got = K.op13_query(spark.createDataFrame([], "doc_id long, text string"))
    assert got.count() == 0
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
