"""Read-side queries on the change table and counts (A6, C10, C13, F1,
H1) and the batch form of debounce (K5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linecdc.operators.ordering import prefix_sum
from linecdc.schema import ALT_VOCABULARY


def recent_changes(table: DataFrame, n: int = 20) -> DataFrame:
    """H1: most recent N changes by load time, then event time, then id
    (a top-k: TakeOrderedAndProject, no global sort)."""
    return table.orderBy(F.desc("loaded_at"), F.desc("event_timestamp"), F.asc("event_id")).limit(n)


def changes_for_file(table: DataFrame, file_name: str) -> DataFrame:
    """Changes of one file (pushed down to the Parquet scan)."""
    return table.where(F.col("file_name") == file_name)


def changes_in_range(table: DataFrame, start, end) -> DataFrame:
    """Changes with ``start <= event_timestamp < end``, newest first."""
    ts = F.col("event_timestamp")
    return table.where((ts >= F.lit(start).cast("timestamp")) & (ts < F.lit(end).cast("timestamp"))).orderBy(F.desc(ts))


def changes_by_operation(table: DataFrame, event_type: str) -> DataFrame:
    """Changes of one operation."""
    return table.where(F.col("event_type") == event_type)


def rename_vocabulary(table: DataFrame) -> DataFrame:
    """The second column vocabulary."""
    return table.withColumnsRenamed({k: v for k, v in ALT_VOCABULARY.items() if k in table.columns})


def change_summary(events: DataFrame, by: tuple[str, ...] = ("file_name", "event_type")) -> DataFrame:
    """number of changes per key (partial aggregation map-side)."""
    return events.groupBy(*by).agg(F.count("*").alias("n_changes"))


# Rows of one file per ordering block: 2**26 microseconds is about 67 seconds,
# so even a hot file's burst is cut into many small window partitions.
DEBOUNCE_BLOCK_BITS = 26


def debounce(notes: DataFrame, gap_seconds: int, key: str = "file_name") -> DataFrame:
    """K5, batch: a burst of notifications of one file becomes one, with the
    last version. A session breaks where ``ts - previous ts > gap``.

    Distributed: the previous time is found inside time blocks of a file and,
    for the first row of a block, from the previous block's last time; the
    session number is a running sum of breaks over the same blocks."""
    us = F.unix_micros(F.col("ts"))
    d = notes.withColumn("_us", us).withColumn("_blk", F.shiftright("_us", DEBOUNCE_BLOCK_BITS))
    from pyspark.sql import Window
    w = Window.partitionBy(key, "_blk").orderBy("_us", "version")
    d = d.withColumn("_prev", F.lag("_us").over(w))
    last = d.groupBy(key, "_blk").agg(F.max("_us").alias("_last"))
    wl = Window.partitionBy(key).orderBy("_blk")
    last = last.withColumn("_prev_blk_last", F.lag("_last").over(wl)).select(key, "_blk", "_prev_blk_last")
    d = d.join(last, [key, "_blk"]).withColumn("_prev", F.coalesce("_prev", "_prev_blk_last"))
    gap_us = gap_seconds * 1_000_000
    d = d.withColumn("_brk", F.when(F.col("_prev").isNull() | (F.col("_us") - F.col("_prev") > gap_us), 1).otherwise(0))
    d = prefix_sum(d, [key], "_us", F.col("_brk"), "_sess", order=("version",),
                   block_bits=DEBOUNCE_BLOCK_BITS, inclusive=True)
    return d.groupBy(key, "_sess").agg(
        F.min("ts").alias("session_start"), F.max("ts").alias("session_end"),
        F.count("*").alias("n_saves"),
        F.max_by("version", F.struct("ts", "version")).alias("version"),
    ).drop("_sess")
