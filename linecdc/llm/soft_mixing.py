"""Mixing sources to target weights by soft membership.

1. A naive Bayes classifier over hashed words is fitted on a labelled table
   (doc_id, domain), from at most about ``PER_DOMAIN`` documents of each domain.
   Its log weights, against those of the first domain, are a table of ``BUCKETS`` rows,
   broadcast to all texts; each document gets a posterior p over the domains. The evidence of a text counts as
   that of ``EVIDENCE`` words at most, so long mixed texts stay soft.
2. A document of n words that is taken at rate r brings n * r * p[k] expected
   words to domain k. Rates r >= floor are fitted by projected gradient descent on
   the least squares  sum_k (T[k] - t[k])^2 / c[k], where T are the expected
   totals, t the targets and c the totals at rate 1. In the metric of n the
   step 1 is safe: the scaled Gram matrix is row-stochastic, its largest
   eigenvalue 1. A step is one aggregation over the documents; only the K totals
   reach the driver. Rates stay with the documents, written every few steps.
3. Copies are the whole part of the rate plus one more with the chance of the
   rest, by a hash of the document.

Nulls and edge cases: a null text is the empty text; a text without a word has the
prior as its posterior, no words, and its rate stays at the start value 1 (or the
floor); an unlabelled table (or one whose labels match no document) gives one
domain ``all``, so that rates are budget / words; label rows with a null id or
domain are not used; of several labels of one document the least counts; repeated
rows get equal rates; extra columns are not looked at. An empty table gives no
rows. Only DataFrame functions run on the data.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linecdc.llm.common import text_or_empty
from linecdc.session import materialize

BUCKETS = 1 << 13
PER_DOMAIN = 3000
MAX_DOMAINS = 256
ALPHA, EVIDENCE = 0.5, 40
STEPS, CUT, TOLERANCE = 60, 6, 1e-3


def words_of(text: Column) -> Column:
    return F.split(text, "[ \n\t\r]")


def bucket_of(word: Column) -> Column:
    """1 .. BUCKETS; 0 for the empty word, which weighs nothing."""
    return F.when(word == "", 0).otherwise(F.pmod(F.xxhash64(word), F.lit(BUCKETS)) + 1).cast("int")


@dataclass
class Classifier:
    domains: list[str]
    prior: list[float]  # log
    weights: DataFrame | None  # b (0 .. BUCKETS), w1 .. wK-1: log weights against the first domain's


def fit(docs: DataFrame, labelled: DataFrame, per_domain: int = PER_DOMAIN) -> Classifier:
    """Classifier from (doc_id, text) and (doc_id, domain)."""
    spark = docs.sparkSession
    one = labelled.where(F.col("doc_id").isNotNull() & F.col("domain").isNotNull()).groupBy("doc_id").agg(
        F.min("domain").alias("domain"))
    held = {r["domain"]: r["n"] for r in one.groupBy("domain").agg(F.count("*").alias("n")).limit(MAX_DOMAINS + 1).collect()}
    if len(held) > MAX_DOMAINS:
        raise ValueError(f"more than {MAX_DOMAINS} domains")
    share = F.lit(0.0)
    for d, n in held.items():
        share = F.when(F.col("domain") == d, min(1.0, per_domain / n)).otherwise(share)
    luck = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(5)), F.lit(1 << 20)) / float(1 << 20)
    few = one.where(luck < share)  # about per_domain ids of each domain
    sample = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(few), "doc_id")
    counts = materialize(
        sample.select("domain", F.explode(words_of(F.col("text"))).alias("w")).where("w != ''")
        .groupBy("domain", bucket_of(F.col("w")).alias("bucket")).agg(F.count("*").alias("n")), "mix-counts")
    totals = {r["domain"]: r["n"] for r in counts.groupBy("domain").agg(F.sum("n").alias("n")).collect()}
    domains = sorted(totals)
    if not domains:
        return Classifier(["all"], [0.0], None)
    per = counts.groupBy(F.col("bucket").alias("b")).agg(*[F.sum(F.when(F.col("domain") == d, F.col("n"))).alias(f"n{k}")
                                                           for k, d in enumerate(domains)])
    logp = lambda k: F.log((F.coalesce(F.col(f"n{k}"), F.lit(0)) + ALPHA) / (totals[domains[k]] + ALPHA * BUCKETS))
    weights = spark.range(BUCKETS + 1).select(F.col("id").cast("int").alias("b")).join(per, "b", "left").select(
        "b", *[F.when(F.col("b") == 0, 0.0).otherwise(logp(k) - logp(0)).alias(f"w{k}") for k in range(1, len(domains))])
    return Classifier(domains, [log(held[d] / sum(held[x] for x in domains)) for d in domains], materialize(weights, "mix-weights"))


def posteriors(docs: DataFrame, c: Classifier) -> DataFrame:
    """(doc_id, h, n, p0 .. pK-1) of every row of (doc_id, text); h is a hash of the text."""
    text = text_or_empty()
    # The text's hash is taken below the explode: beside it, it would be taken for every word.
    rows = (docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("row"))
            .select("doc_id", "h", "row", F.explode(words_of(F.col("text"))).alias("w"))
            .select("doc_id", "h", "row", bucket_of(F.col("w")).alias("b")))
    if c.weights is not None:
        rows = rows.join(F.broadcast(c.weights), "b")  # BUCKETS rows
    sums = rows.groupBy("row", "doc_id", "h").agg(
        F.count_if(F.col("b") > 0).alias("n"), *[F.sum(f"w{k}").alias(f"s{k}") for k in range(1, len(c.domains))])
    ks = range(len(c.domains))
    evidence = F.least(F.col("n"), F.lit(EVIDENCE)) / F.greatest(F.col("n"), F.lit(1))
    logits = sums.select("doc_id", "h", "n", F.lit(0.0).alias("l0"), *[
        (F.lit(c.prior[k] - c.prior[0]) + F.col(f"s{k}") * evidence).alias(f"l{k}") for k in ks[1:]])
    top = F.greatest(*[F.col(f"l{k}") for k in ks]) if len(c.domains) > 1 else F.col("l0")
    e = logits.select("doc_id", "h", "n", *[F.exp(F.col(f"l{k}") - top).alias(f"e{k}") for k in ks])
    z = sum((F.col(f"e{k}") for k in ks), F.lit(0.0))
    return e.select("doc_id", "h", "n", *[(F.col(f"e{k}") / z).alias(f"p{k}") for k in ks])


def expected(table: DataFrame, k: int, rate: Column) -> list[float]:
    """Expected words of each domain."""
    r = table.agg(*[F.sum(F.col("n") * F.col(f"p{i}") * rate).alias(f"t{i}") for i in range(k)]).first()
    return [float(x or 0.0) for x in r]


def tempered(totals: list[float], power: float) -> list[float]:
    """Target weights: shares to a power under 1, which lifts small domains."""
    w = [t**power if t > 0 else 0.0 for t in totals]
    return [x / sum(w) if sum(w) else 0.0 for x in w]


@dataclass
class Mix:
    table: DataFrame  # doc_id, h, n, p0 .. pK-1, rate
    domains: list[str]
    totals: list[float]  # at rate 1
    targets: list[float]  # words
    reached: list[float]
    steps: int

    @property
    def residual(self) -> float:
        """The largest distance of a domain from its target, as a share of all words wanted."""
        return max((abs(a - b) for a, b in zip(self.reached, self.targets)), default=0.0) / max(1.0, sum(self.targets))


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float] | None = None, power: float = 0.5,
        floor: float = 0.0, budget: float | None = None) -> Mix:
    """Rates for (doc_id, text). ``weights`` are the domains' target shares (default:
    their present shares to ``power``); ``budget`` is the number of words wanted
    (default: as many as there are; with a floor of 1, the least that lets every
    domain reach its share without dropping a document)."""
    c = fit(docs, labelled)
    k = len(c.domains)
    table = materialize(posteriors(docs, c), "mix-posteriors").withColumn("rate", F.lit(float(max(1.0, floor))))
    totals = expected(table, k, F.lit(1.0))
    shares = [weights.get(d, 0.0) for d in c.domains] if weights else tempered(totals, power)
    if budget is None:
        budget = sum(totals)
        if floor >= 1:
            budget = max([budget, *(t / s for t, s in zip(totals, shares) if s > 0)])
    targets = [s * budget / (sum(shares) or 1.0) for s in shares]
    rate, reached, steps = F.col("rate"), expected(table, k, F.col("rate")), 0
    active = [i for i in range(k) if totals[i] > 0]
    while steps < STEPS and any(abs(reached[i] - targets[i]) > TOLERANCE * max(targets[i], 1.0) for i in active):
        step = sum((F.col(f"p{i}") * ((reached[i] - targets[i]) / totals[i]) for i in active), F.lit(0.0))
        # The rate stands here once: a plan of several steps grows with their number only.
        rate = F.greatest(F.lit(float(floor)), rate - F.when(F.col("n") > 0, step).otherwise(0.0))
        steps += 1
        if steps % CUT == 0:
            table = materialize(table.withColumn("rate", rate), "mix-rates")
            rate = F.col("rate")
        was, reached = reached, expected(table, k, rate)
        if max(abs(a - b) for a, b in zip(was, reached)) <= 1e-6 * max(1.0, budget):
            break  # the constraints hold it back
    return Mix(table.withColumn("rate", rate), c.domains, totals, targets, reached, steps)


def copies(rate: Column, *key: str) -> Column:
    """Whole copies whose expectation is the rate."""
    luck = F.pmod(F.xxhash64(*key, F.lit(9)), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(rate) + (luck < rate - F.floor(rate)).cast("long")).cast("int")


def op7_query(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Domains are language x quality, as far as the labelled documents tell them."""
    m = mix(documents.select("doc_id", "text"), lang_quality(documents, labels))
    p = [F.col(f"p{i}") for i in range(len(m.domains))]
    best = F.array_max(F.array(*[F.struct(x.alias("p"), F.lit(-i).alias("i"), F.lit(d).alias("domain"))
                                 for i, (d, x) in enumerate(zip(m.domains, p))]))
    return m.table.select(
        "doc_id", F.col("n").alias("n_words"), best["domain"].alias("domain"), best["p"].alias("p_domain"),
        F.to_json(F.struct(*[F.round(x, 6).alias(d) for d, x in zip(m.domains, p)])).alias("posterior"),
        "rate", copies(F.col("rate"), "doc_id", "h").alias("copies"),
        F.lit(m.steps).alias("steps"), F.lit(float(m.residual)).alias("residual"))


def lang_quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled table (doc_id, domain): ``lang/quality`` of documents with both."""
    return (documents.select("doc_id", "lang").join(labels.select("doc_id", "quality"), "doc_id")
            .where(F.col("lang").isNotNull() & F.col("quality").isNotNull())
            .select("doc_id", F.concat_ws("/", F.col("lang").cast("string"), F.col("quality").cast("string")).alias("domain")))
