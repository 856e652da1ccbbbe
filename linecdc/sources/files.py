"""Text files that fit a row, as ordered line rows, through Spark's binary file
source (A1, C9, J1, J11): for stores that only Spark's readers open. A landing folder
holds immutable file versions; each file read is one version whose number is its
modification time (microseconds). ``sources.versions`` reads files of any size, and
new versions of a path as a stream.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linecdc.functions.text import extension, splitlines


def read_versions(spark: SparkSession, path: str, extensions: Sequence[str] | None = None,
                  glob: str | None = None, file_key=None) -> tuple[DataFrame, DataFrame]:
    """Read every file under ``path`` (non-recursive) as one version.

    Returns ``(lines, rejected)``: ``lines(file_name (the path), file_path, version,
    detected_at, line_number, line)`` and files that are not valid UTF-8
    ``(file_path, reason)``. ``extensions`` filters by lower-case extension
    (C9); ``glob`` is Spark's ``pathGlobFilter``.

    ``file_name`` is the key by which versions are compared: the whole path (equal
    base names in two folders are two files), or ``file_key`` of the path column,
    for landing folders that give each save a path of its own.
    """
    r = spark.read.format("binaryFile")
    if glob:
        r = r.option("pathGlobFilter", glob)
    files = r.load(path).select(
        F.col("path").alias("file_path"), "content",
        F.col("modificationTime").alias("detected_at"))
    files = files.withColumn("file_name", (file_key or (lambda path: path))(F.col("file_path")))
    if extensions:
        files = files.where(extension(F.col("file_path")).isin(*[e.lower() for e in extensions]))
    ok = F.is_valid_utf8(F.col("content"))
    rejected = files.where(~ok).select("file_path", F.lit("bad_utf8").alias("reason"))
    good = files.where(ok).select(
        "file_name", "file_path", F.unix_micros("detected_at").alias("version"), "detected_at",
        splitlines(F.col("content").cast("string")).alias("lines"))
    lines = good.select("file_name", "file_path", "version", "detected_at",
                        F.posexplode("lines").alias("p", "line")).select(
        "file_name", "file_path", "version", "detected_at",
        (F.col("p") + 1).cast("int").alias("line_number"), "line")
    return lines, rejected
