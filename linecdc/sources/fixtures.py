"""Inputs derived from the benchmark tables (deterministic, same rules as the
DuckDB oracle SQL in ``linecdc.plans.oracle``).

O — order lines: 16 files of unique lines, three versions.
D — document lines: old/new line lists per document with repeated lines,
    deletions, edits, doubled lines and moves.
E — log records shaped like a Kafka topic, with malformed, null, extra-key
    records and redeliveries.
N — save notifications (file, time, version) for debounce.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linecdc.functions.text import ISO_FORMAT
from linecdc.operators.ordering import rank_within
from linecdc.session import materialize

# Fixed values of the fixture rules.
N_ORDER_FILES = 16
V2_MULTIPLIER = 7919
V3_MULTIPLIER = 104729
HASH_MOD = 101
DOC_MULT_ID = 31
DOC_MULT_LINE = 7
DOC_MOD = 23
TOPIC = "file-changes"
N_LOG_PARTITIONS = 4
REDELIVERY_OFFSET = 1_000_000
REDELIVERED_VALUE = "sent again"
TYPE_MAP = {"signup": "INSERT", "purchase": "UPDATE", "view": "UPDATE", "click": "DELETE"}
OUT_OF_DOMAIN_TYPE = "BAD"
MALFORMED_MOD = 37
MALFORMED_LEN = 20
NULL_VALUE_MOD = 211
EXTRA_KEY_MOD = 53
REDELIVERY_MOD = 10
N_LOG_FILES = 20
VERSION_EPOCH = "2024-02-01 00:00:00"
# Line ends of written files (of those of str.splitlines, all but a lone \r, which
# would join with a following text's \n).
TERMINATORS = ("\n", "\r\n", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def version_time(version_col):
    """Detection time of fixture version v: VERSION_EPOCH + (v - 1) days."""
    return F.timestamp_add("DAY", (version_col - 1).cast("int"), F.to_timestamp(F.lit(VERSION_EPOCH)))


def save_files(pieces: DataFrame, folder: str) -> None:
    """Files of (file_name, ord, piece): the pieces of a file one after the other, written
    by one task a file and put in place whole."""
    from linecdc.sources.versions import filesystem

    def write(rows):
        fs, root = filesystem(folder)
        fs.create_dir(root)
        out, name = None, None

        def close():
            if out is not None:
                out.close()
                fs.move(f"{root}/.{name}.new", f"{root}/{name}")

        for r in rows:
            if r["file_name"] != name:
                close()
                name = r["file_name"]
                out = fs.open_output_stream(f"{root}/.{name}.new")
            out.write(r["piece"].encode())
        close()

    pieces.repartition("file_name").sortWithinPartitions("file_name", "ord").foreachPartition(write)


def in_order(spark: SparkSession, path: str, column: str) -> None:
    """Sets the modification times of a table's files by its partition column, so that a
    file stream reads its partitions in that order."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [f.getPath() for f in fs.globStatus(jvm.org.apache.hadoop.fs.Path(root, f"{column}=*/part-*"))]
    base = jvm.java.lang.System.currentTimeMillis() - 86_400_000
    for f in found:
        fs.setTimes(f, base + 1000 * int(f.getParent().getName().split("=")[1]), -1)


# ---------------------------------------------------------------- O

def _line(k, status, cents=None):
    return F.concat_ws(" ", F.concat(F.lit("#"), k.cast("string")), status, *([] if cents is None else [cents.cast("string")]))


def order_lines(spark: SparkSession, sf_dir: str, versions=(1, 2, 3)) -> DataFrame:
    """``lines(file_name, version, line_number, line)`` of fixture O."""
    o = table(spark, sf_dir, "orders")
    base = o.select(
        F.col("o_orderkey").alias("k"), (F.col("o_custkey") % N_ORDER_FILES).alias("f"),
        F.col("o_orderstatus").alias("st"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("c"),
        ((F.col("o_orderkey") * V2_MULTIPLIER) % HASH_MOD).alias("h2"),
        ((F.col("o_orderkey") * V3_MULTIPLIER) % HASH_MOD).alias("h3"),
    )
    k, f, h2, h3 = F.col("k"), F.col("f"), F.col("h2"), F.col("h3")
    parts = []
    if 1 in versions:
        parts.append(base.where(f != 2).select("f", "k", F.lit(1).alias("v"), F.lit(0).alias("sub"),
                                               _line(k, F.col("st"), F.col("c")).alias("line")))
    st2 = F.when((h2 >= 5) & (h2 < 15) & (f != 0), F.lit("X")).otherwise(F.col("st"))
    in2 = (f != 1) & ((h2 >= 5) | (f == 0))
    if 2 in versions:
        parts.append(base.where(in2).select("f", "k", F.lit(2).alias("v"), F.lit(0).alias("sub"),
                                            _line(k, st2, F.col("c")).alias("line")))
        parts.append(base.where(~f.isin(0, 1) & (h2 >= 15) & (h2 < 20)).select(
            "f", "k", F.lit(2).alias("v"), F.lit(1).alias("sub"), _line(k, F.lit("NEW")).alias("line")))
    if 3 in versions:
        b3 = base.where(in2)
        st3 = F.when((h3 >= 5) & (h3 < 15) & (f != 0), F.lit("X")).otherwise(st2)
        parts.append(b3.where((h3 >= 5) | (f == 0)).select(
            "f", "k", F.lit(3).alias("v"), F.lit(0).alias("sub"), _line(k, st3, F.col("c")).alias("line")))
        parts.append(b3.where(~f.isin(0, 1) & (h3 >= 15) & (h3 < 20)).select(
            "f", "k", F.lit(3).alias("v"), F.lit(1).alias("sub"), _line(k, F.lit("NEW")).alias("line")))
    allv = parts[0]
    for p in parts[1:]:
        allv = allv.unionByName(p)
    allv = allv.select(
        F.concat(F.lit("orders_"), F.col("f").cast("string"), F.lit(".txt")).alias("file_name"),
        F.col("v").cast("long").alias("version"), (F.col("k") * 2 + F.col("sub")).alias("ord"), "line")
    # Line numbers per (file, version) without gathering a file in one task.
    numbered = rank_within(allv, ["file_name", "version"], "ord", "line_number", one_based=True)
    out = numbered.select("file_name", "version", F.col("line_number").cast("int").alias("line_number"), "line")
    # Derived once, written to the shared folder: later plans read a table.
    return materialize(out, "order-lines")


# ---------------------------------------------------------------- D

def document_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Fixture D as ``(old, new)`` line tables keyed ``file_name='doc_<id>', version=2``.

    Each document is one row, so the new list is built inside the row with
    array functions — no shuffle and no window."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    lines = F.split(F.col("text"), "\n", -1)
    items = F.transform(lines, lambda x, i: F.struct((i + 1).alias("n"), x.alias("line")))
    h = lambda e: (F.col("doc_id") * DOC_MULT_ID + e["n"] * DOC_MULT_LINE) % DOC_MOD

    def item(o, n, sub, line):
        return F.struct(o.cast("double").alias("o"), n.alias("n"), F.lit(sub).alias("sub"), line.alias("line"))

    def emit(e):
        return (F.when(h(e) == 0, F.array().cast("array<struct<o:double,n:int,sub:int,line:string>>"))
                .when(h(e) == 1, F.array(item(e["n"], e["n"], 0, F.concat(e["line"], F.lit(" *")))))
                .when(h(e) == 2, F.array(item(e["n"], e["n"], 0, e["line"]), item(e["n"], e["n"], 1, e["line"])))
                .when(h(e) == 3, F.array(item(e["n"] + 3.5, e["n"], 0, e["line"])))
                .otherwise(F.array(item(e["n"], e["n"], 0, e["line"]))))

    newarr = F.array_sort(F.flatten(F.transform(items, emit)))
    fname = F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("file_name")
    old = d.select(fname, F.lit(2).cast("long").alias("version"), F.posexplode(lines).alias("p", "line")).select(
        "file_name", "version", (F.col("p") + 1).cast("int").alias("line_number"), "line")
    new = d.select(fname, F.lit(2).cast("long").alias("version"), F.posexplode(newarr).alias("p", "e")).select(
        "file_name", "version", (F.col("p") + 1).cast("int").alias("line_number"), F.col("e.line").alias("line"))
    return old, new


# ---------------------------------------------------------------- E

def _event_type(src):
    e = F.when(src == "signup", TYPE_MAP["signup"])
    for k in ("purchase", "view", "click"):
        e = e.when(src == k, TYPE_MAP[k])
    return e.otherwise(OUT_OF_DOMAIN_TYPE)


def event_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event columns derived from ``events`` (before encoding), plus the source id."""
    ev = table(spark, sf_dir, "events")
    et = _event_type(F.col("event_type"))
    cents = F.round(F.col("value") * 100).cast("long").cast("string")
    return ev.select(
        F.col("event_id").alias("src_id"),
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("event_id"),
        F.concat(F.lit("user_"), (F.col("user_id") % N_LOG_FILES).cast("string"), F.lit(".log")).alias("file_name"),
        F.when(et != "INSERT", cents).alias("old_value"),
        F.when(et != "DELETE", cents).alias("new_value"),
        et.alias("event_type"),
        F.get_json_object("props", "$.k").cast("int").alias("line_number"),
        F.date_format(F.col("ts").cast("timestamp"), ISO_FORMAT).alias("event_timestamp"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


def log_records(spark: SparkSession, sf_dir: str, redeliveries: bool = True) -> DataFrame:
    """Fixture E: Kafka-shaped rows ``key, value, topic, partition, offset, timestamp``."""
    from linecdc.operators.codec import encode_value

    f = event_fields(spark, sf_dir)
    sid = F.col("src_id")
    js = encode_value(f)
    value = (F.when(sid % NULL_VALUE_MOD == 0, F.lit(None).cast("string"))
             .when(sid % MALFORMED_MOD == 0, F.substring(js, 1, MALFORMED_LEN))
             .when(sid % EXTRA_KEY_MOD == 0, F.concat(F.expr("substring(" + "_js" + ", 1, length(_js) - 1)"),
                                                     F.lit(',"extra":1}')))
             .otherwise(js))
    base = f.withColumn("_js", js).select(
        F.encode("event_id", "UTF-8").alias("key"),
        F.encode(value, "UTF-8").alias("value"),
        F.lit(TOPIC).alias("topic"),
        (sid % N_LOG_PARTITIONS).cast("int").alias("partition"),
        F.floor(sid / N_LOG_PARTITIONS).cast("long").alias("offset"),
        F.col("ts").alias("timestamp"),
    )
    if not redeliveries:
        return materialize(base, "log-records")
    again = f.where(sid % REDELIVERY_MOD == 0).withColumn("new_value", F.lit(REDELIVERED_VALUE))
    again = again.select(
        F.encode("event_id", "UTF-8").alias("key"),
        F.encode(encode_value(again), "UTF-8").alias("value"),
        F.lit(TOPIC).alias("topic"),
        (sid % N_LOG_PARTITIONS).cast("int").alias("partition"),
        (F.floor(sid / N_LOG_PARTITIONS) + REDELIVERY_OFFSET).cast("long").alias("offset"),
        F.col("ts").alias("timestamp"),
    )
    return materialize(base.unionByName(again), "log-records")


# ---------------------------------------------------------------- N

def notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture N: ``(file_name, ts, version)`` save notifications."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.concat(F.lit("user_"), (F.col("user_id") % N_LOG_FILES).cast("string")).alias("file_name"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").cast("long").alias("version"),
    )
