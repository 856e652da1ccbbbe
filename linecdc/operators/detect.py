"""Detect changes of many files against their snapshots."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linecdc.operators.diff import diff_lines


@dataclass
class Detection:
    old: DataFrame
    new: DataFrame
    detected_at: DataFrame | Column | None
    strategy: str
    baseline: DataFrame    # (file_name, version, n_lines): first sight, no events
    snapshot: DataFrame    # line rows that become the new snapshot

    @property
    def events(self) -> DataFrame:
        """Change events of the compared files (runs the alignment jobs)."""
        return diff_lines(self.old, self.new, self.detected_at, strategy=self.strategy)


def detect_changes(current: DataFrame, snapshot: DataFrame, detected_at: DataFrame | Column | None = None,
                   missing_as_empty: bool = False, strategy: str = "auto") -> Detection:
    """Current line rows vs the latest snapshot line rows, by file (E4 full outer):

    * in both: diff (equal lists give nothing, C11);
    * current only: the baseline — stored as snapshot, no event (A2);
    * snapshot only: nothing, or with ``missing_as_empty`` every line DELETEd
      (comparison version = snapshot version + 1).
    """
    cur_v = current.select("file_name", "version").distinct()
    snap_v = snapshot.select("file_name", F.col("version").alias("snap_version")).distinct()
    files = cur_v.join(snap_v, "file_name", "full_outer")
    both = files.where(F.col("version").isNotNull() & F.col("snap_version").isNotNull())
    pairs = both.select("file_name", "version", "snap_version")
    if missing_as_empty:
        gone = files.where(F.col("version").isNull()).select(
            "file_name", (F.col("snap_version") + 1).alias("version"), "snap_version")
        pairs = pairs.unionByName(gone)
    old = snapshot.withColumnRenamed("version", "snap_version").join(pairs, ["file_name", "snap_version"]).select(
        "file_name", "version", "line_number", "line")
    new = current.join(pairs.select("file_name", "version"), ["file_name", "version"], "left_semi")
    first = files.where(F.col("snap_version").isNull()).select("file_name", "version")
    baseline = current.join(first, ["file_name", "version"], "left_semi").groupBy("file_name", "version").agg(
        F.count("*").alias("n_lines"))
    return Detection(old, new, detected_at, strategy, baseline,
                     current.select("file_name", "version", "line_number", "line"))
