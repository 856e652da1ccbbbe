"""A corpus pipeline of five of the operators in ``linecdc.llm``.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and
returns a table; ``run`` writes it as Parquet under the shared checkpoint folder
and reads it again as the next stage's input, so a lost executor repeats at most
one stage. A stage's scratch tables are dropped when another stage starts, as its
result has been written by then. All stages but the last return the columns of
``documents``.

1. ``language_id`` drops documents in which no language can be told (no letter, no
   text, or a posterior under ``MIN_SCORE``).
2. ``near_duplicates`` keeps of each class of near copies (Jaccard of word 5-grams
   of 0.8 or more) one row: the document with the least doc_id (null last), of
   several texts under that id one. Rows that repeat a document count once.
3. ``secrets`` masks the secrets that the blob ledger finds; no document goes.
4. ``mixing`` repeats documents so that the domains' expected words reach shares to
   the power ``POWER``: every document stays at least once, those of rare domains
   come again (rates of 1 or more).
5. ``tokens`` encodes every text to ids and decodes them again.

A null text leaves at stage 1; extra columns pass through to stage 4.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linecdc.llm import byte_bpe, chosen_path, language_id, secret_scan, soft_mixing
from linecdc.llm.common import table
from linecdc.session import drop_scratch, prepare_session, scratch_path, scratch_scope

MIN_SCORE = 0.5
POWER = 0.8
BROADCAST_ROWS = 1_000_000  # ids or finding lists (under 100 bytes each) up to which they go to the texts


def _stage(fn: Callable) -> Callable:
    """Runs a stage with a scratch folder of its own and drops the previous stage's."""
    @wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        prepare_session(spark)
        sc = spark.sparkContext
        if old := getattr(sc, "_corpus_stage", None):
            drop_scratch(spark, old)
        sc._corpus_stage = f"stage-{uuid.uuid4().hex}"
        with scratch_scope(sc._corpus_stage):
            return fn(spark, docs, sf_dir)
    return run_stage


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return name


def _small(df: DataFrame) -> DataFrame:
    """A broadcast if the table is known to be small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


@_stage
def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.train(language_id.train_split(docs))
    said = _free(docs, "said")
    known = docs.withColumn(said, language_id.scorer(spark, model)(F.col("text").cast("string")))
    return known.where((F.col(said)["lang_pred"] != "und") & (F.col(said)["score"] >= MIN_SCORE)).select(docs.columns)


@_stage
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    one, key = _free(docs, "kept"), _free(docs, "text_key")
    path = scratch_path(spark, "kept-rows")
    chosen_path.heads(docs.select("doc_id", "text")).select(
        F.col("doc_id").alias(one), F.col("h").alias(key), F.col("copies").alias("n")).write.parquet(path)
    kept = spark.read.parquet(path)
    rows = kept.drop("n")
    text_key = chosen_path.text_key(docs["text"])
    out = docs.join(_small(rows), docs["doc_id"].cast("long").eqNullSafe(rows[one]) & (text_key == rows[key]), "left_semi")
    if not kept.where("n > 1").isEmpty():  # rows that repeat a document
        out = out.withColumn(key, chosen_path.text_key(F.col("text"))).dropDuplicates(["doc_id", key])
    return out.select(docs.columns)


@_stage
def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ledger = secret_scan.Ledger(spark, scratch_path(spark, "secret-ledger"))
    ledger.scan(docs.select(F.col("doc_id").alias("path"), F.lit(0).alias("version"), "text"))
    spans, blob = _free(docs, "spans"), _free(docs, "blob")
    found = secret_scan.by_blob(ledger.findings()).select(F.col("blob").alias(blob), F.col("found").alias(spans))
    out = docs.join(_small(found), F.sha2(F.coalesce(F.col("text"), F.lit("")), 256) == F.col(blob), "left")
    hit = F.col(spans).isNotNull()
    out = out.withColumn("text", F.when(hit, secret_scan.redact(F.col("text"), F.col(spans))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        now = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(hit, now).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


@_stage
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labelled = soft_mixing.lang_quality(docs, table(spark, sf_dir, "labels"))
    m = soft_mixing.mix(docs.select("doc_id", "text"), labelled, power=POWER, floor=1.0)
    own, text_hash, n, copy = (_free(docs, x) for x in ("own", "text_hash", "copies", "copy"))
    rates = (m.table.select(F.col("doc_id").alias(own), F.col("h").alias(text_hash),
                            soft_mixing.copies(F.col("rate"), "doc_id", "h").alias(n))
             .groupBy(own, text_hash).agg(F.max(n).alias(n)))  # repeated rows have one rate
    same = docs["doc_id"].eqNullSafe(rates[own]) & (F.xxhash64(F.coalesce(F.col("text"), F.lit(""))) == rates[text_hash])
    return docs.join(rates, same).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n)))).select(docs.columns)


@_stage
def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.op10_query(docs)


STAGES = [
    ("language_id", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("secrets", secret_stage),
    ("mixing", mixing_stage),
    ("tokens", token_stage),
]

# Trained scores, sampled paths and merges are no SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    prepare_session(spark)
    docs, root = table(spark, sf_dir, "documents"), scratch_path(spark, "corpus-pipeline")
    for name, stage in STAGES:
        path = f"{root}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
