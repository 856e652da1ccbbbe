"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

*Terms* are words and their first 4, 5 and 6 letters (so unseen forms of a known
stem still match), lower-cased; one that a text holds two or three times also
gives the terms ``t x2`` and ``t x3`` (a stem that chance brings up once in a long
clean text is seldom there twice). Candidates are the terms that toxic training examples hold
significantly more often, by a z test and a least ratio; their document
frequencies are counted in Spark. Of these the vocabulary takes, one by one, the
term that tells most about the toxic examples not yet covered ``COVER`` times, as
long as that is significant: words that are only frequent because of a few copied
documents don't get in.

*Index.* The examples' TF-IDF vectors over that vocabulary form an inverted
index whose postings are cut into blocks of ``BLOCK`` examples, each term with its
greatest weight per block. A query adds up these maxima: the sum bounds the
cosine with every example of a block. Blocks are scored exactly in order of
their bound until the bound falls below the k-th best, so the k nearest are exact.
The index has at most ``PER_LABEL`` examples of either label and ``MAX_TERMS``
terms (documented bounds; the examples are chosen by a hash of their id), and is
broadcast; all documents are scored against it where they lie, without a shuffle.

*Score.* The neighbours vote with their cosine, weighted so that both labels
count as in the training table, and smoothed by the base rate of a document
without any term. A map fitted on the examples themselves (each scored without
itself and its copies), by pooling adjacent violators, turns the vote into a
calibrated probability. ``evidence`` lists the neighbours.

Nulls and edge cases: null and empty texts, and texts without a known term, get
the base rate of such examples; without any labelled example the score is 0.5;
ties between neighbours go to the smaller id; repeated label rows of one document
count as toxic if any says so; rows with a null label or id are not learned from;
repeated documents are scored each; extra columns are not looked at.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linecdc.llm.common import id_mod

PER_LABEL = 6000
MAX_TERMS = 4096
MIN_DF, MIN_Z, MIN_RATIO, COVER = 3, 4.0, 4.0, 4
BLOCK, NEAREST = 64, 15
PREFIXES = (4, 5, 6)
THRESHOLD = 0.7

WORD = re.compile(r"[^\W\d_]+")


def forms(word: str) -> tuple[str, ...]:
    return (word, *(word[:p] + "*" for p in PREFIXES if len(word) >= p))


def bases(terms) -> frozenset[str]:
    return frozenset(t.split(" ")[0] for t in terms)


def term_counts(text: str | None, vocabulary: dict[str, int] | None = None, known: frozenset[str] | None = None) -> Counter:
    """Terms of a text with their counts; with a vocabulary (and its ``bases``) only
    its terms, by number."""
    if vocabulary is not None and known is None:
        known = bases(vocabulary)
    base: Counter = Counter()
    for w, n in Counter(WORD.findall((text or "").lower())).items():
        for t in forms(w):
            if known is None or t in known:
                base[t] += n
    out: Counter = Counter()
    for t, n in base.items():
        for term in (t, t + " x2", t + " x3")[:n]:
            if vocabulary is None:
                out[term] = n
            elif (i := vocabulary.get(term)) is not None:
                out[i] = n
    return out


def _document_frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for label, g in pdf.groupby("label"):
            df = Counter()
            for t in g["text"]:
                df.update(term_counts(t).keys())
            yield pd.DataFrame({"label": label, "term": list(df), "n": list(df.values())})


def examples(documents: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, label, text) of the chosen examples, and each label's number of
    labelled ids. ``labels`` has (doc_id, label)."""
    one = labels.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull()).groupBy("doc_id").agg(
        F.max(F.col("label").cast("int")).alias("label"))
    count = {int(r["label"]): r["n"] for r in one.groupBy("label").agg(F.count("*").alias("n")).collect() if r["label"] in (0, 1)}
    share = F.when(F.col("label") == 1, min(1.0, per_label / max(1, count.get(1, 0)))).otherwise(
        min(1.0, per_label / max(1, count.get(0, 0))))
    luck = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(3)), F.lit(1 << 20)) / float(1 << 20)
    few = one.where(F.col("label").isin(0, 1) & (luck < share))  # about 2 x per_label ids
    return documents.select("doc_id", "text").join(F.broadcast(few), "doc_id"), count


def _z(d1, n1, d0, n0):
    p = (d1 + d0 + 0.5) / (n1 + n0 + 1)
    return ((d1 + 0.5) / (n1 + 1) - (d0 + 0.5) / (n0 + 1)) / (p * (1 - p) * (1 / n1 + 1 / n0)) ** 0.5


def candidate_terms(chosen: DataFrame, totals: dict[int, int]) -> dict[str, int]:
    """Terms that toxic examples hold more often, with the number of other
    examples that hold them; the most telling MAX_TERMS."""
    n0, n1 = max(1, totals.get(0, 0)), max(1, totals.get(1, 0))
    df = (chosen.select("label", "text").mapInPandas(_document_frequencies, "label int, term string, n long")
          .groupBy("term").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("d1"),
                               F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("d0")))
    ratio = ((F.col("d1") + 0.5) / (n1 + 1)) / ((F.col("d0") + 0.5) / (n0 + 1))
    told = df.withColumn("z", _z(F.col("d1"), n1, F.col("d0"), n0)).where(
        (F.col("d1") >= MIN_DF) & (F.col("z") >= MIN_Z) & (ratio >= MIN_RATIO))
    return {r["term"]: r["d0"] for r in told.orderBy(F.desc("z"), "term").limit(MAX_TERMS).select("term", "d0").collect()}


def cover_terms(candidates: dict[str, int], toxic: list[str], n0: int) -> list[str]:
    """The candidates that cover the toxic texts, most telling first."""
    terms = list(candidates)
    if not terms or not toxic:
        return []
    number = {t: i for i, t in enumerate(terms)}
    known = bases(terms)
    held = np.zeros((len(terms), len(toxic)), np.float32)
    for j, text in enumerate(toxic):
        held[list(term_counts(text, number, known)), j] = 1
    d0 = np.array([candidates[t] for t in terms], float)
    need, free, out = np.full(len(toxic), COVER), np.ones(len(terms), bool), []
    while (open_ := need > 0).any():
        d1 = held @ open_.astype(np.float32)
        z = np.where(free & (d1 >= MIN_DF), _z(d1, int(open_.sum()), d0, max(1, n0)), -1.0)
        best = int(z.argmax())
        if z[best] < MIN_Z:
            break
        out.append(terms[best])
        free[best] = False
        need -= held[best] > 0
    return out


@dataclass
class Index:
    """Postings in blocks: for block b the rows ``start[b]:start[b+1]`` of
    (term, example, weight); ``maxima`` is blocks x terms."""

    vocabulary: dict[str, int]
    idf: np.ndarray
    ids: np.ndarray
    label: np.ndarray
    copies: np.ndarray  # number of the text, equal for equal texts
    blocks: list[np.ndarray]  # BLOCK x terms, dense per block over the block's own terms
    block_terms: list[np.ndarray]
    maxima: np.ndarray
    weight: tuple[float, float]  # of a neighbour of label 0, 1
    base: float
    steps: tuple[np.ndarray, np.ndarray]  # raw vote -> probability

    def __post_init__(self):
        self.known = bases(self.vocabulary)

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        n = term_counts(text, self.vocabulary, self.known)
        if not n:
            return np.empty(0, np.int64), np.empty(0)
        t = np.array(sorted(n))
        w = (1 + np.log(np.array([n[i] for i in t]))) * self.idf[t]
        return t, w / math.sqrt(float(w @ w))

    def nearest(self, t: np.ndarray, w: np.ndarray, k: int = NEAREST, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the k nearest with a cosine over 0, exact;
        examples whose text is copy number ``skip`` don't count."""
        bound = self.maxima[:, t] @ w
        got_e, got_c, kth = [], [], 0.0
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] <= 0 or bound[b] < kth - 1e-12:
                break
            own = self.block_terms[b]
            at = np.minimum(np.searchsorted(own, t), len(own) - 1)
            hit = own[at] == t
            cos = self.blocks[b][:, at[hit]] @ w[hit]
            e = np.flatnonzero(cos > 0)
            if skip >= 0:
                e = e[self.copies[b * BLOCK + e] != skip]
            got_e.append(b * BLOCK + e)
            got_c.append(cos[e])
            if sum(map(len, got_c)) > k:
                e, c = np.concatenate(got_e), np.concatenate(got_c)
                best = np.lexsort((e, -c))[:k]
                got_e, got_c, kth = [e[best]], [c[best]], c[best[-1]]
        if not got_e:
            return np.empty(0, np.int64), np.empty(0)
        e, c = np.concatenate(got_e), np.concatenate(got_c)
        best = np.lexsort((e, -c))[:k]
        return e[best], c[best]

    def vote(self, e: np.ndarray, c: np.ndarray) -> float:
        toxic = self.label[e] == 1
        a, b = self.weight[1] * c[toxic].sum(), self.weight[0] * c[~toxic].sum()
        return float((a + 0.05 * self.base) / (a + b + 0.05))

    def score(self, text: str | None) -> tuple[float, np.ndarray, np.ndarray]:
        t, w = self.vector(text)
        e, c = self.nearest(t, w) if len(t) else (np.empty(0, np.int64), np.empty(0))
        if not len(e):
            return self.base, e, c
        x, y = self.steps
        return float(np.interp(self.vote(e, c), x, y)) if len(x) else self.vote(e, c), e, c


def _monotone(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators with one observation of each label added to a pool."""
    pools: list[list[float]] = []
    order = np.argsort(x, kind="stable")
    for xi, yi, wi in zip(x[order], y[order], w[order]):
        if pools and pools[-1][3] == xi:
            pools[-1][0] += yi * wi
            pools[-1][1] += wi
        else:
            pools.append([yi * wi, wi, xi, xi])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            b = pools.pop()
            pools[-1] = [pools[-1][0] + b[0], pools[-1][1] + b[1], pools[-1][2], b[3]]
    xs, ys = [], []
    for s, n, lo, hi in pools:
        p = (s + 0.5) / (n + 1)
        xs += [lo, hi] if hi > lo else [lo]
        ys += [p, p] if hi > lo else [p]
    return np.array(xs), np.maximum.accumulate(np.array(ys)) if ys else np.array(ys)


def build(rows: list[tuple[int, int, str | None, int]], terms: list[str], totals: dict[int, int]) -> Index:
    """The index of examples (doc_id, label, text, hash that equal texts share)."""
    rows = sorted(rows, key=lambda r: (r[0], r[1], r[2] or "", r[3]))
    vocabulary = {t: i for i, t in enumerate(terms)}
    known_bases = bases(terms)
    counts = [term_counts(r[2], vocabulary, known_bases) for r in rows]
    label = np.array([r[1] for r in rows], int)
    held = {k: max(1, int((label == k).sum())) for k in (0, 1)}
    weight = tuple(totals.get(k, 0) / held[k] if (label == k).any() else 0.0 for k in (0, 1))
    known = np.array([bool(c) for c in counts], bool)
    blank = [weight[k] * float(((label == k) & ~known).sum()) for k in (0, 1)]
    rate = sum(totals.values()) and totals.get(1, 0) / sum(totals.values())
    base = (blank[1] + rate) / (blank[0] + blank[1] + 1) if len(rows) else 0.5
    keep = np.flatnonzero(known)
    df = Counter(i for c in counts for i in c)
    idf = np.array([math.log((len(rows) + 1) / (df[i] + 1)) + 1 for i in range(len(terms))])
    texts: dict[int, int] = {}
    copies = np.array([texts.setdefault(rows[i][3], len(texts)) for i in keep], int)
    index = Index(vocabulary, idf, np.array([rows[i][0] for i in keep], np.int64), label[keep], copies, [], [],
                  np.zeros((0, len(terms)), np.float64), weight, float(base), (np.empty(0), np.empty(0)))
    vectors = [index.vector(rows[i][2]) for i in keep]
    maxima = np.zeros((-(-len(keep) // BLOCK), len(terms)))
    for b in range(len(maxima)):
        part = vectors[b * BLOCK:(b + 1) * BLOCK]
        own = np.unique(np.concatenate([t for t, _ in part]))
        dense = np.zeros((len(part), len(own)))
        for i, (t, w) in enumerate(part):
            dense[i, np.searchsorted(own, t)] = w
        index.blocks.append(dense)
        index.block_terms.append(own)
        maxima[b, own] = dense.max(0)
    index.maxima = maxima
    # Calibration: every example by its neighbours among the others.
    votes = []
    for (t, w), copy in zip(vectors, copies):
        e, c = index.nearest(t, w, skip=int(copy))
        votes.append(index.vote(e, c) if len(e) else np.nan)
    v = np.array(votes)
    ok = ~np.isnan(v)
    if ok.any():
        each = np.where(index.label == 1, weight[1], weight[0])
        index.steps = _monotone(v[ok], index.label[ok].astype(float), each[ok])
    return index


def fit(documents: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Index:
    """Index from the labelled rows given; (doc_id, label) in ``labels``."""
    chosen, totals = examples(documents, labels, per_label)
    sampled = {r["label"]: r["n"] for r in chosen.groupBy("label").agg(F.count("*").alias("n")).collect()}
    candidates = candidate_terms(chosen, sampled)
    vocabulary = documents.sparkSession.sparkContext.broadcast(bases(candidates))

    @F.pandas_udf("string")
    def telling(text: pd.Series) -> pd.Series:
        """The words that carry a term: all of a text that the index needs."""
        v = vocabulary.value
        has = lambda w: not v.isdisjoint(forms(w))
        return text.map(lambda t: " ".join(w for w in WORD.findall((t or "").lower()) if has(w)))

    rows = chosen.select("doc_id", "label", telling("text").alias("words"), F.xxhash64("text").alias("copy")).collect()
    toxic = {r["copy"]: r["words"] for r in rows if r["label"] == 1}  # copies count once
    terms = cover_terms(candidates, [toxic[k] for k in sorted(toxic, key=str)], sampled.get(0, 0))
    return build([(r["doc_id"], r["label"], r["words"], r["copy"]) for r in rows], terms, totals)  # about 2 x per_label


def score_documents(documents: DataFrame, index: Index) -> DataFrame:
    """(doc_id, score, evidence): evidence is the neighbours' (doc_id, label, cosine)."""
    shared = documents.sparkSession.sparkContext.broadcast(index)

    @F.pandas_udf("score double, evidence array<struct<doc_id:bigint,label:int,cosine:double>>")
    def score(text: pd.Series) -> pd.DataFrame:
        ix, out = shared.value, []
        for t in text:
            s, e, c = ix.score(t if isinstance(t, str) else None)
            out.append((s, [{"doc_id": int(ix.ids[i]), "label": int(ix.label[i]), "cosine": float(x)} for i, x in zip(e, c)]))
        return pd.DataFrame(out, columns=["score", "evidence"])

    return documents.select("doc_id", score(F.col("text").cast("string")).alias("x")).select("doc_id", "x.score", "x.evidence")


def op3_query(documents: DataFrame, labels: DataFrame) -> DataFrame:
    train = labels.where(id_mod("doc_id", 3) != 1).select("doc_id", F.col("toxic").alias("label"))
    index = fit(documents, train)
    return score_documents(documents.select("doc_id", "text"), index).select(
        "doc_id", (id_mod("doc_id", 3) == 1).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.to_json("evidence").alias("evidence"))
