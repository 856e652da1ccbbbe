"""Snapshots as keyframes and change sets.

Every ``every``-th version of a file is stored whole, the others as their change events
only. A version is rebuilt from the keyframe before it by one small step a version in between: change
sets become maps of positions, the maps are composed, and the lines are joined to the
result once.

*Position maps.* Lines that a change set neither deletes nor inserts keep their order.
Among them, by rank, the distance between old and new position only changes where a
line was deleted or inserted. So a change set is a few runs ``(old_lo, old_hi, shift)``,
as many as it has such places, however long the file.

*Composition.* What a version holds is a set of ranges ``(lo, hi)`` with the place that
their lines come from: the keyframe, or the event that inserted or updated a line.
Stepping to the next version cuts the ranges by its runs and shifts them, and adds its
own events. An update is a range of one line that lies over an older one; the latest
wins when lines are joined. Ranges and runs meet by equal blocks of positions; the lines
of the last ranges meet the stored ones by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linecdc.operators.ordering import prefix_sum, rank_within
from linecdc.schema import DELETE, INSERT
from linecdc.session import materialize

VERSION = ["file_name", "version"]
# Ranges and runs of one block all meet, so their pairs grow with the square of a block's
# changes: a block of few positions keeps them below the lines however dense the changes.
BLOCK_BITS = 4
# Lines that one range gives before it is cut, so that a long one is many tasks' work.
EXPLODE_CHUNK = 1 << 16
# Versions (names and numbers) up to which they go to the lines' tasks.
BROADCAST_VERSIONS = 500_000


def number_saves(lines: DataFrame) -> DataFrame:
    """``file_name, version, save, n_lines``: 0 for a file's first version, then 1, 2, ..."""
    v = lines.groupBy(*VERSION).agg(F.count("line_number").alias("n_lines"))
    return v.withColumn("save", F.row_number().over(Window.partitionBy("file_name").orderBy("version")) - 1)


def write_deltas(lines: DataFrame, events: DataFrame, path: str, every: int) -> None:
    """The history at ``path``: ``versions``, the lines of every ``every``-th version of a
    file, and the change events of the others. ``lines(file_name, version, line_number,
    line)``; ``events`` as ``diff_lines`` gives them (their ``file_path`` is the file)."""
    spark = lines.sparkSession
    number_saves(lines).withColumn("step", F.col("save") % every).write.parquet(f"{path}/versions")
    versions = spark.read.parquet(f"{path}/versions")
    whole, rest = (versions.where(c).select(*VERSION) for c in (F.col("step") == 0, F.col("step") > 0))
    small = F.broadcast if versions.count() <= BROADCAST_VERSIONS else (lambda df: df)
    kept = lines.where(F.col("line_number").isNotNull()).select(*VERSION, "line_number", "line")
    kept.join(small(whole), VERSION, "left_semi").write.parquet(f"{path}/keyframes")
    name = F.col("file_path" if "file_path" in events.columns else "file_name").alias("file_name")
    changes = events.select(name, "version", "event_type", F.col("line_number").cast("long").alias("line_number"),
                            F.col("new_value").alias("line"))
    changes.join(small(rest), VERSION, "left_semi").write.parquet(f"{path}/changes")


def position_runs(changes: DataFrame) -> DataFrame:
    """``VERSION, old_lo, old_hi, shift``: where the kept lines of the version before lie
    in a version. A version without deletes and inserts has no row. ``old_hi`` of the
    last run is open (null)."""
    dels = rank_within(changes.where(F.col("event_type") == DELETE).select(*VERSION, "line_number"), VERSION, "line_number", "r")
    ins = rank_within(changes.where(F.col("event_type") == INSERT).select(*VERSION, "line_number"), VERSION, "line_number", "r")
    # The number of kept lines before a deleted or inserted one: position less those like it.
    places = (dels.select(*VERSION, (F.col("line_number") - 1 - F.col("r")).alias("rho"), F.lit(1).alias("d"), F.lit(0).alias("i"))
              .unionByName(ins.select(*VERSION, (F.col("line_number") - 1 - F.col("r")).alias("rho"), F.lit(0).alias("d"), F.lit(1).alias("i"))))
    places = materialize(places, "places")  # each running sum below reads what it is made of twice
    first = places.select(*VERSION).distinct().select(*VERSION, F.lit(0).cast("long").alias("rho"), F.lit(0).alias("d"), F.lit(0).alias("i"))
    cuts = places.unionByName(first).groupBy(*VERSION, "rho").agg(F.sum("d").alias("d"), F.sum("i").alias("i"))
    cuts = prefix_sum(materialize(cuts, "cut-places"), VERSION, "rho", "d", "cd", inclusive=True)
    cuts = materialize(prefix_sum(cuts, VERSION, "rho", "i", "ci", inclusive=True), "cut-sums")
    cuts = materialize(rank_within(cuts, VERSION, "rho", "k"), "cuts")
    after = cuts.select(*VERSION, (F.col("k") - 1).alias("k"), F.col("rho").alias("end"))
    return cuts.join(after, [*VERSION, "k"], "left").select(
        *VERSION, (F.col("rho") + 1 + F.col("cd")).alias("old_lo"), (F.col("end") + F.col("cd")).alias("old_hi"),
        (F.col("ci") - F.col("cd")).alias("shift"))


def _by_block(df: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """A row per block of positions that lo .. hi touches; ``blo`` and ``bhi`` are the part in it."""
    cut = df.withColumn("block", F.explode(F.sequence(F.shiftright(lo, BLOCK_BITS), F.shiftright(hi, BLOCK_BITS))))
    start = F.shiftleft(F.col("block"), BLOCK_BITS)
    return cut.withColumn("blo", F.greatest(lo, start)).withColumn("bhi", F.least(hi, start + (1 << BLOCK_BITS) - 1))


RANGE = ["file_name", "target", "lo", "hi", "src_version", "src_lo"]


def _step(ranges: DataFrame, runs: DataFrame, moved: DataFrame) -> DataFrame:
    """``ranges`` as they lie one version later. ``moved(file_name, target)`` with its
    runs; targets of that version without runs keep their ranges."""
    r = _by_block(ranges, F.col("lo"), F.col("hi")).drop("hi")
    m = _by_block(runs, F.col("old_lo"), F.col("old_hi")).select(
        "file_name", "target", "block", F.col("blo").alias("mlo"), F.col("bhi").alias("mhi"), "shift")
    cut = r.join(m, ["file_name", "target", "block"]).withColumn("a", F.greatest("blo", "mlo")).withColumn("b", F.least("bhi", "mhi"))
    cut = cut.where(F.col("a") <= F.col("b")).select(
        "file_name", "target", (F.col("a") + F.col("shift")).alias("lo"), (F.col("b") + F.col("shift")).alias("hi"), "src_version",
        (F.col("src_lo") + F.col("a") - F.col("lo")).alias("src_lo"))
    still = ranges.join(moved, ["file_name", "target"], "left_anti")
    return cut.unionByName(still.select(*RANGE))


def rebuild(spark: SparkSession, path: str, targets: DataFrame) -> DataFrame:
    """``file_name, version, line_number, line`` of the versions ``targets(file_name, version)``."""
    versions = spark.read.parquet(f"{path}/versions")
    changes, keyframes = spark.read.parquet(f"{path}/changes"), spark.read.parquet(f"{path}/keyframes")
    wanted = materialize(versions.join(targets.select(*VERSION).distinct(), VERSION, "left_semi"), "wanted")
    steps = wanted.agg(F.max("step")).first()[0] or 0
    # For each target: its keyframe, and the versions up to it, one a step.
    path_of = materialize(wanted.select("file_name", F.col("version").alias("target"), F.col("save").alias("at"), F.col("step").alias("n"))
                          .join(versions.select(*VERSION, "save", "step", "n_lines"), "file_name")
                          .where((F.col("save") <= F.col("at")) & (F.col("save") >= F.col("at") - F.col("n"))), "path")
    ranges = path_of.where("step = 0 and n_lines > 0").select(
        "file_name", "target", F.lit(1).cast("long").alias("lo"), F.col("n_lines").cast("long").alias("hi"),
        F.col("version").alias("src_version"), F.lit(1).cast("long").alias("src_lo"))
    needed = changes.join(path_of.select(*VERSION).distinct(), VERSION, "left_semi")
    all_runs = materialize(position_runs(needed), "runs") if steps else None
    for k in range(1, steps + 1):
        now = path_of.where(F.col("step") == k).select("file_name", "target", "version")
        before = path_of.where(F.col("step") == k - 1).select("file_name", "target", F.col("n_lines").alias("n_before"))
        runs = all_runs.join(now, VERSION).join(before, ["file_name", "target"]).select(
            "file_name", "target", "old_lo", F.coalesce("old_hi", "n_before").cast("long").alias("old_hi"), "shift")
        moved = runs.select("file_name", "target").distinct()
        born = changes.where(F.col("event_type") != DELETE).join(now, VERSION).select(
            "file_name", "target", F.col("line_number").alias("lo"), F.col("line_number").alias("hi"),
            F.col("version").alias("src_version"), F.col("line_number").alias("src_lo"))
        # Read twice by the next step.
        ranges = materialize(_step(ranges, runs.where(F.col("old_lo") <= F.col("old_hi")), moved).unionByName(born), "ranges")
    values = keyframes.select("file_name", F.col("version").alias("src_version"), F.col("line_number").cast("long").alias("n"), "line").unionByName(
        changes.where(F.col("event_type") != DELETE).select(
            "file_name", F.col("version").alias("src_version"), F.col("line_number").alias("n"), "line"))
    # A range is as many lines as it is long: they meet the values one to one.
    chunks = ranges.withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright(F.col("hi") - F.col("lo"), 16))))
    at = F.explode(F.sequence(F.col("c") * EXPLODE_CHUNK, F.least(F.col("hi") - F.col("lo"), (F.col("c") + 1) * EXPLODE_CHUNK - 1)))
    wanted_lines = chunks.repartition("file_name", "target", "lo", "c").select("file_name", "target", "lo", "src_version", "src_lo", at.alias("d")).select(
        "file_name", "src_version", (F.col("src_lo") + F.col("d")).alias("n"), "target", (F.col("lo") + F.col("d")).alias("line_number"))
    lines = wanted_lines.join(values, ["file_name", "src_version", "n"]).select(
        "file_name", F.col("target").alias("version"), "line_number", F.struct("src_version", "line").alias("v"))
    # An update lies over the line that it replaced.
    return lines.groupBy("file_name", "version", "line_number").agg(F.max("v").alias("v")).select(
        "file_name", "version", "line_number", F.col("v.line").alias("line"))
