"""A clustered copy of the change table with a manifest of its files.

Rows are ordered along a Z curve over file, time and operation, so each file of the
table holds a small box of all three, and a lookup by any of them has few boxes to open.
The manifest has one row a file: least and greatest file name, event time, operation and
load time, and the row count. A lookup first asks the manifest, then reads only the files
that may hold an answer; the newest rows are found from the files that end latest.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linecdc.schema import EVENT_TYPES

Z_BITS = 8  # of each of file and time: 256 intervals
NAME_BYTES = 6  # of a file name, behind the prefix that all share
BOUNDED = ("file_name", "event_timestamp", "event_type", "loaded_at")


def _name_number(name: Column, prefix: int) -> Column:
    """A number that orders like the bytes of ``name`` behind its first ``prefix``."""
    raw = F.substring(F.encode(name, "UTF-8"), prefix + 1, NAME_BYTES)
    return F.conv(F.rpad(F.hex(raw), 2 * NAME_BYTES, "0"), 16, 10).cast("long")


def _scaled(value: Column, low: int, high: int) -> Column:
    """0 .. 2**Z_BITS - 1 over [low, high]; nulls count as least."""
    width = max(1, high - low + 1)
    return F.coalesce(F.least(F.lit((1 << Z_BITS) - 1), F.floor((value - low) / width * (1 << Z_BITS))), F.lit(0)).cast("long")


def z_key(table: DataFrame) -> Column:
    """The place of a row on the curve: the bits of file and time in turn, below those of
    the operation, of which there are three."""
    us = F.unix_micros("event_timestamp")
    ends = table.agg(F.min("file_name").alias("a"), F.max("file_name").alias("b"), F.min(us).alias("t0"), F.max(us).alias("t1")).first()
    a, b = ((x or "").encode() for x in (ends["a"], ends["b"]))
    prefix = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    number = lambda x: int.from_bytes(x[prefix:prefix + NAME_BYTES].ljust(NAME_BYTES, b"\0"), "big")
    name = _scaled(_name_number(F.col("file_name"), prefix), number(a), number(b))
    time = _scaled(us, ends["t0"] or 0, ends["t1"] or 0)
    z = sum((F.shiftleft(F.shiftright(name, k).bitwiseAND(F.lit(1)), 2 * k + 1) + F.shiftleft(F.shiftright(time, k).bitwiseAND(F.lit(1)), 2 * k)
             for k in range(Z_BITS)), F.lit(0).cast("long"))
    operation = sum((F.when(F.col("event_type") == t, F.lit(i)).otherwise(F.lit(0)) for i, t in enumerate(EVENT_TYPES)), F.lit(0))
    return F.shiftleft(operation.cast("long"), 2 * Z_BITS) + z


def write_clustered(table: DataFrame, path: str, files: int = 64) -> None:
    """``table`` at ``path``/rows in about ``files`` files along the curve, and their manifest."""
    spark = table.sparkSession
    rows = table.withColumn("_z", z_key(table))
    (rows.repartitionByRange(files, "_z", "file_name", "event_timestamp").sortWithinPartitions("_z", "event_timestamp").drop("_z")
     .write.mode("overwrite").parquet(f"{path}/rows"))
    ends = [f(c).alias(f"{name}_{c}") for c in BOUNDED for name, f in (("min", F.min), ("max", F.max))]
    (spark.read.parquet(f"{path}/rows").groupBy(F.col("_metadata.file_path").alias("path")).agg(*ends, F.count("*").alias("n"))
     .coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest"))


@dataclass
class Lookup:
    rows: DataFrame
    opened: int
    files: int


class ClusteredTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.manifest = spark.read.parquet(f"{path}/manifest")
        self.files = self.manifest.count()

    def _read(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.read.parquet(f"{self.path}/rows").limit(0)
        return self.spark.read.parquet(*paths)

    def _where(self, may: Column, exact: Column) -> Lookup:
        paths = [r["path"] for r in self.manifest.where(may).select("path").collect()]  # names of the files that will be read
        return Lookup(self._read(paths).where(exact), len(paths), self.files)

    def of_file(self, name: str) -> Lookup:
        return self._where(F.lit(name).between(F.col("min_file_name"), F.col("max_file_name")), F.col("file_name") == name)

    def in_range(self, start, end) -> Lookup:
        """``start <= event_timestamp < end``."""
        a, b = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
        return self._where((F.col("min_event_timestamp") < b) & (F.col("max_event_timestamp") >= a),
                           (F.col("event_timestamp") >= a) & (F.col("event_timestamp") < b))

    def by_operation(self, event_type: str, start=None, end=None) -> Lookup:
        may = F.lit(event_type).between(F.col("min_event_type"), F.col("max_event_type"))
        exact = F.col("event_type") == event_type
        if start is not None:
            a, b = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
            may = may & (F.col("min_event_timestamp") < b) & (F.col("max_event_timestamp") >= a)
            exact = exact & (F.col("event_timestamp") >= a) & (F.col("event_timestamp") < b)
        return self._where(may, exact)

    def newest(self, n: int) -> Lookup:
        """H1: the last ``n`` rows by load time, then event time, then id. The files that end
        latest and hold ``n`` rows together give a bound; a file that ends before it has
        none of the answer."""
        ends = ("max_loaded_at", "max_event_timestamp")
        order = [F.desc("loaded_at"), F.desc("event_timestamp"), F.asc("event_id")]
        first, held = [], 0
        for r in self.manifest.orderBy(*[F.desc_nulls_last(c) for c in ends]).select("path", "n").limit(n).collect():
            if held >= n:
                break
            first.append(r["path"])
            held += r["n"]
        top = self._read(first).orderBy(*order).limit(n)
        bound = top.agg(F.min(F.struct("loaded_at", "event_timestamp")).alias("b")).first()["b"]
        if bound is None:
            return Lookup(top, len(first), self.files)
        last = F.struct(F.lit(bound["loaded_at"]).alias("l"), F.lit(bound["event_timestamp"]).alias("t"))
        more = self.manifest.where(~F.col("path").isin(first)).where(
            F.struct(F.col(ends[0]).alias("l"), F.col(ends[1]).alias("t")) >= last)
        paths = first + [r["path"] for r in more.select("path").collect()]
        return Lookup(self._read(paths).orderBy(*order).limit(n), len(paths), self.files)
