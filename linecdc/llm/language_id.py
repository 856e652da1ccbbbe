"""Language ID: multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased, everything else counts as one space between words; the
features are bigrams and trigrams of that stream, hashed into ``BUCKETS``
columns. Training sums n-gram counts per (language, bucket) in Spark over a
sample of at most about ``PER_LANG`` labelled documents for each language (a
documented bound; the sample is chosen by a hash of id and text, so it does not
depend on the order or partitioning of the rows). The matrix of log
probabilities, languages x buckets, has a size fixed by these parameters and is
broadcast; every text is scored whole, in slices of a batch, by gathering its
n-grams' rows and summing them per document in numpy.

Nulls and edge cases: a null text or one without a letter is ``und`` with score
0.0; a model without any language (an empty training set) says ``und`` for all;
a text longer than ``SLICE`` characters is read in pieces that hand on their last two
symbols, so every n-gram counts once, as in one piece; ties go to the language that sorts first; rows with a null
language are scored but not learned from; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linecdc.llm.common import id_mod

BUCKETS = 1 << 16
PER_LANG = 4000
MAX_LANGS = 1000
SLICE = 1 << 19  # characters scored at once


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point -> its lower-case letter, or a space for what is no letter."""
    low = np.full(0x110000, 32, dtype=np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low[c] = ord(s.lower()[0])
    return low


def _stream(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all texts, each text between spaces, runs of spaces as one;
    and the number of the text that each belongs to."""
    joined = "".join(f" {t} " for t in texts)
    codes = _letters()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    of = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])
    space = codes == 32
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = ~(space[1:] & space[:-1] & (of[1:] == of[:-1]))
    return codes[keep], of[keep]


def _buckets(c: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the bigram and of the trigram that starts at each symbol."""
    two = c[:-1] * np.uint32(0x9E3779B1) ^ c[1:] * np.uint32(0x85EBCA77)
    three = (two[:-1] ^ c[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
    shift = np.uint32(32 - int(buckets).bit_length() + 1)
    return two * np.uint32(0x165667B1) >> shift, three >> shift


def ngrams(texts: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text number) of every bigram and trigram, as a sparse batch."""
    c, of = _stream(texts)
    if len(c) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    two, three = _buckets(c, buckets)
    ok2, ok3 = of[:-1] == of[1:], of[:-2] == of[2:]
    b = np.concatenate([two[ok2], three[ok3]])
    return b.astype(np.int64), np.concatenate([of[:-1][ok2], of[:-2][ok3]])


def _of_long(text: str, size: int, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """Buckets of every bigram and trigram of a long text, piece by piece."""
    held = np.array([32], np.uint32)
    for at in range(0, len(text), size):
        piece = text[at:at + size] + " " * (at + size >= len(text))
        c = np.r_[held, _letters()[np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)]]
        c = c[np.r_[True, (c[1:] != 32) | (c[:-1] != 32)]]
        if len(c) > 1:
            two, three = _buckets(c, buckets)
            yield np.concatenate([two[len(held) - 1:], three]).astype(np.int64)  # what lies in ``held`` has been counted
        held = c[-2:]


def _batches(texts: list[str], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``ngrams`` of all texts, by about ``size`` characters; numbers are those in ``texts``."""
    part: list[int] = []
    n = 0
    for i, t in enumerate(texts):
        if len(t) > size:
            for b in _of_long(t, size):
                yield b, np.full(len(b), i)
            continue
        part.append(i)
        n += len(t) + 2
        if n >= size or i == len(texts) - 1:
            b, of = ngrams([texts[j] for j in part])
            yield b, np.asarray(part)[of]
            part, n = [], 0
    if part:
        b, of = ngrams([texts[j] for j in part])
        yield b, np.asarray(part)[of]


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for lang, g in pdf.groupby("lang"):
            total = np.zeros(BUCKETS, dtype=np.int64)
            for b, _ in _batches(g["text"].tolist(), SLICE):
                total += np.bincount(b, minlength=BUCKETS)
            hit = np.flatnonzero(total)
            yield pd.DataFrame({"lang": lang, "bucket": hit, "n": total[hit]})


class Model:
    """langs, log prior (L), log probabilities (BUCKETS x L)."""

    def __init__(self, langs: list[str], prior: np.ndarray, logp: np.ndarray):
        self.langs, self.prior, self.logp = langs, prior, logp


def train(labelled: DataFrame, per_lang: int = PER_LANG, alpha: float = 0.5) -> Model:
    """Fit on rows (doc_id, text, lang) with non-null text and lang."""
    rows = labelled.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where(
        F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGS + 1).collect()}
    if len(counts) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    langs = sorted(counts)
    if not langs:
        return Model([], np.zeros(0), np.zeros((BUCKETS, 0), np.float32))
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, per_lang / counts[k]))])
    luck = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) / float(1 << 20)
    sample = rows.where(luck < F.element_at(share, F.col("lang"))).select("lang", "text")
    sums = sample.mapInPandas(_count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    n = np.zeros((BUCKETS, len(langs)))
    got = sums.toPandas()  # at most BUCKETS rows a language
    n[got["bucket"].to_numpy(int), got["lang"].map(langs.index).to_numpy(int)] = got["n"]
    logp = np.log((n + alpha) / (n.sum(0) + alpha * BUCKETS))
    prior = np.log(np.array([counts[k] for k in langs], float) / sum(counts.values()))
    return Model(langs, prior, logp.astype(np.float32))


def score_texts(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Predicted language and its posterior for each text."""
    texts = [t or "" for t in texts]
    k = len(model.langs)
    if not k:
        return ["und"] * len(texts), np.zeros(len(texts))
    total = np.tile(model.prior, (len(texts), 1))
    for b, of in _batches(texts, SLICE):
        order = np.argsort(of, kind="stable")
        b, of = b[order], of[order]
        if len(of):
            starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            sums = np.add.reduceat(model.logp[b], starts, axis=0, dtype=np.float64)
            np.add.at(total, of[starts], sums)
    best = total.argmax(1)
    top = total[np.arange(len(texts)), best]
    post = 1.0 / np.exp(total - top[:, None]).sum(1)
    known = np.array([any(map(str.isalpha, t)) for t in texts], dtype=bool)
    return [model.langs[i] if ok else "und" for i, ok in zip(best, known)], np.where(known, post, 0.0)


def scorer(spark, model: Model):
    """A function of a text column: struct of lang_pred and score."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def score(text: pd.Series) -> pd.DataFrame:
        lang, p = score_texts(shared.value, [t if isinstance(t, str) else None for t in text])
        return pd.DataFrame({"lang_pred": lang, "score": p})

    return score


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with columns lang_pred and score (instead of any that it has)."""
    said = "_lid" + "_" * sum(c.startswith("_lid") for c in docs.columns)
    return (docs.withColumn(said, scorer(docs.sparkSession, model)(F.col("text").cast("string")))
            .withColumn("lang_pred", F.col(said)["lang_pred"]).withColumn("score", F.col(said)["score"]).drop(said))


def train_split(documents: DataFrame) -> DataFrame:
    return documents.where(id_mod("doc_id", 5) != 0)


def op9_query(documents: DataFrame) -> DataFrame:
    docs = documents.select("doc_id", "text", "lang")
    model = train(train_split(docs))
    return predict(docs.select("doc_id", "text"), model).select(
        "doc_id", (id_mod("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
