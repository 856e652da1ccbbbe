"""Change events from aligned line lists.

Lines tables have the columns ``file_name, version, line_number (1-based),
line``. ``old`` rows carry the version of the *new* side they are compared
with, so ``(file_name, version)`` keys one comparison.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linecdc.functions.text import base_name, event_id, iso_timestamp
from linecdc.operators.matching import KEYS, MatchResult, match_lines
from linecdc.operators.ordering import prefix_sum
from linecdc.schema import DELETE, INSERT, UPDATE
from linecdc.session import BROADCAST_ROWS, materialize, small_table, true_sizes

# Rows one opcode is cut into before the per-line explode, so a huge opcode
# (a whole file deleted) is spread over many tasks.
EXPLODE_CHUNK = 1 << 16
# Changed files (a name and a number each) up to which they go to the lines' tasks.
BROADCAST_FILES = BROADCAST_ROWS
# Two independent hashes of a digest.
DIGEST_SEEDS = (1, 2)


def to_sides(old: DataFrame, new: DataFrame) -> DataFrame:
    """Stack old/new lines as ``file_name, version, side, pos, line`` (pos 0-based)."""
    def side(df, s):
        return df.select(*KEYS, F.lit(s).alias("side"), (F.col("line_number") - 1).cast("long").alias("pos"), "line")
    return side(old, 0).unionByName(side(new, 1))


def expand_opcodes(opcodes: DataFrame) -> DataFrame:
    """One row per emitted change: ``k`` runs 1..max(na, nb) over each opcode.

    The k-th old line pairs with the k-th new line (UPDATE); the surplus of the
    longer side is DELETE (old) or INSERT (new). UPDATE/INSERT carry the new
    1-based position ``j1 + k``, DELETE the old one ``i1 + k``.
    """
    ops = opcodes.withColumn("na", F.col("i2") - F.col("i1")).withColumn("nb", F.col("j2") - F.col("j1")) \
        .withColumn("cnt", F.greatest("na", "nb"))
    # change order inside the version: events of earlier opcodes first.
    ops = prefix_sum(ops, KEYS, "i1", F.col("cnt"), "seq0")
    chunks = ops.withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"),
                                                       F.floor((F.col("cnt") - 1) / EXPLODE_CHUNK).cast("long"))))
    # Spread chunks of large opcodes before expanding them line by line.
    chunks = chunks.repartition(*KEYS, "i1", "c")
    k = F.explode(F.sequence(F.col("c") * EXPLODE_CHUNK + 1,
                             F.least(F.col("cnt"), (F.col("c") + 1) * EXPLODE_CHUNK)))
    ev = chunks.select(*KEYS, "i1", "j1", "na", "nb", "seq0", k.alias("k"))
    etype = (F.when(F.col("k") <= F.least("na", "nb"), F.lit(UPDATE))
             .when(F.col("k") > F.col("nb"), F.lit(DELETE)).otherwise(F.lit(INSERT)))
    ev = ev.withColumn("event_type", etype)
    is_del = F.col("event_type") == DELETE
    is_ins = F.col("event_type") == INSERT
    return ev.select(
        *KEYS, "event_type",
        F.when(is_del, F.col("i1") + F.col("k")).otherwise(F.col("j1") + F.col("k")).cast("int").alias("line_number"),
        F.when(~is_ins, F.col("i1") + F.col("k") - 1).alias("old_pos"),
        F.when(~is_del, F.col("j1") + F.col("k") - 1).alias("new_pos"),
        (F.col("seq0") + F.col("k")).alias("change_seq"),
    )


def attach_values(changes: DataFrame, L: DataFrame) -> DataFrame:
    """Positional zip (E2): fetch the old and new text of every change."""
    old = L.where(F.col("side") == 0).select(*KEYS, F.col("pos").alias("old_pos"), F.col("line").alias("old_value"))
    new = L.where(F.col("side") == 1).select(*KEYS, F.col("pos").alias("new_pos"), F.col("line").alias("new_value"))
    return changes.join(old, [*KEYS, "old_pos"], "left").join(new, [*KEYS, "new_pos"], "left")


def events_from_changes(changes: DataFrame, detected_at: DataFrame | Column | None = None) -> DataFrame:
    """Final event rows: EVENT columns + version + change_seq + file_path.

    Files are told apart by their whole name; a reader gives the path. The event
    shows its last component (J11), its id is made from all of it."""
    if isinstance(detected_at, DataFrame):
        changes = changes.join(small_table(detected_at.select(*KEYS, "detected_at"), "detected"), KEYS, "left")
        ts = F.col("detected_at")
    elif detected_at is None:
        ts = F.current_timestamp()
    else:
        ts = detected_at
    return changes.select(
        event_id(F.col("file_name"), F.col("version"), F.col("event_type"), F.col("line_number")).alias("event_id"),
        base_name(F.col("file_name")).alias("file_name"), "old_value", "new_value", "event_type", "line_number",
        iso_timestamp(ts).alias("event_timestamp"),
        F.col("version"), F.col("change_seq"), F.col("file_name").alias("file_path"),
    )


def diff_lines(old: DataFrame, new: DataFrame, detected_at: DataFrame | Column | None = None,
               strategy: str = "auto",
               match: MatchResult | None = None) -> DataFrame:
    """Events turning ``old`` into ``new`` for every (file_name, version).

    Identical line lists produce no event (their alignment has no gap). A row without a
    line number says that a version has no lines.
    """
    old, new = (side.where(F.col("line_number").isNotNull()) for side in (old, new))
    if match is None:
        # C11 ahead of matching: lines of unchanged files leave before any shuffle.
        changed = materialize(compare_versions(old, new).where(F.col("changed")).select(*KEYS), "changed")
        if changed.count() <= BROADCAST_FILES:
            changed = F.broadcast(changed)
        old = old.join(changed, KEYS, "left_semi")
        new = new.join(changed, KEYS, "left_semi")
    L = to_sides(old, new)
    if match is None:
        # The comparison's lines are read by every matching step and by the
        # value lookup: write them once (also cuts the input lineage).
        with true_sizes(L.sparkSession):
            L = materialize(L, "cmp-lines")
    m = match or match_lines(L, strategy=strategy)
    changes = attach_values(expand_opcodes(m.opcodes), L)
    return events_from_changes(changes, detected_at)


CHANGES = ("file_name string, version long, event_type string, line_number int, old_value string, new_value string, "
           "change_seq long")


def _changes_of_file(key: tuple, a: list, b: list) -> list[tuple]:
    """The changes of one file's two line lists, in order."""
    rows = []
    if a == b:
        return rows
    for tag, i1, i2, j1, j2 in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        for k in range(0 if tag == "equal" else max(i2 - i1, j2 - j1)):
            i, j = i1 + k, j1 + k
            kind = UPDATE if i < i2 and j < j2 else DELETE if i < i2 else INSERT
            rows.append((*key, kind, (i if kind == DELETE else j) + 1, a[i] if i < i2 else None, b[j] if j < j2 else None, len(rows) + 1))
    return rows


def _changes_of_files(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """mapInPandas body over lines sorted by file, version, side and number. A file that a
    batch cuts is carried over, so a task holds a batch and one file's lists."""
    columns = ["file_name", "version", "event_type", "line_number", "old_value", "new_value", "change_seq"]
    key, sides = None, ([], [])
    for pdf in frames:
        if not len(pdf):
            continue
        name, version, side = (pdf[c].to_numpy() for c in ("file_name", "version", "side"))
        line, rows = pdf["line"].tolist(), []
        start = np.ones(len(pdf), bool)
        start[1:] = (name[1:] != name[:-1]) | (version[1:] != version[:-1]) | (side[1:] != side[:-1])
        at = [*np.flatnonzero(start), len(pdf)]
        for s, e in zip(at[:-1], at[1:]):
            own = (name[s], int(version[s]))
            if own != key:
                if key is not None:
                    rows += _changes_of_file(key, *sides)
                key, sides = own, ([], [])
            sides[side[s]].extend(line[s:e])
        yield pd.DataFrame(rows, columns=columns)
    if key is not None:
        yield pd.DataFrame(_changes_of_file(key, *sides), columns=columns)


def diff_per_file(old: DataFrame, new: DataFrame, detected_at: DataFrame | Column | None = None,
                  max_lines: int = 20_000) -> DataFrame:
    """L2: the events of ``diff_lines`` by a function of one file's two line lists, for
    many small files: one job instead of rounds of jobs. A task holds the lists of one
    file, so files with more than ``max_lines`` on a side go through ``diff_lines``."""
    old, new = (side.where(F.col("line_number").isNotNull()) for side in (old, new))
    changed = materialize(compare_versions(old, new).where("changed"), "changed")
    fits = F.greatest("old_lines", "new_lines") <= max_lines
    named_few = changed.count() <= BROADCAST_FILES
    few = F.broadcast if named_few else (lambda df: df)
    own = lambda df, which: df.join(few(changed.where(which).select(*KEYS)), KEYS, "left_semi").select(*KEYS, "line_number", "line")
    if named_few:
        both = to_sides(own(old, fits), own(new, fits))
    else:
        # So many names would shuffle all lines to be met, and these are shuffled by file anyway:
        # a file's own task passes it over if its lists are equal.
        named = F.col(KEYS[0]).isNotNull() & F.col(KEYS[1]).isNotNull()
        large = small_table(changed.where(~fits).select(*KEYS), "large")
        both = to_sides(old, new).where(named).join(large, KEYS, "left_anti")
    changes = both.repartition(*KEYS).sortWithinPartitions(*KEYS, "side", "pos").drop("pos").mapInPandas(_changes_of_files, CHANGES)
    events = events_from_changes(changes, detected_at)
    if changed.where(~fits).isEmpty():
        return events
    return events.unionByName(diff_lines(own(old, ~fits), own(new, ~fits), detected_at))


def version_pairs(lines: DataFrame) -> DataFrame:
    """Each version of a file with the previous version (null for the first).

    The window runs over distinct versions of one file (one row per save), not
    over lines."""
    v = lines.select("file_name", "version").distinct()
    w = Window.partitionBy("file_name").orderBy("version")
    return v.withColumn("prev_version", F.lag("version").over(w))


def sequence_digest(lines: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """``keys, n, d1, d2``: the number of lines and two sums, over independent
    64-bit hashes of (position, line). A line's place is part of its hash, so the sums
    can be added up in any order and in parts: every task sends one row a list, however
    long, and digests of parts of a list add up to that of the whole."""
    h = [F.xxhash64(F.lit(seed), F.col("line_number").cast("long"), "line").cast("decimal(38,0)") for seed in DIGEST_SEEDS]
    return lines.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(h[0]).alias("d1"), F.sum(h[1]).alias("d2"))


def compare_versions(old: DataFrame, new: DataFrame, proof: bool = False) -> DataFrame:
    """Per (file_name, version) present on either side, whether the two line
    lists differ. A newline-style change alone (same lines) is no change. Digests decide
    (two different lists agree with a chance of about 2^-128); no line is shuffled. With
    ``proof``, lists of equal digests are also compared line by line."""
    d = sequence_digest(old.select(*KEYS, "line_number", "line", F.lit(0).alias("side")).unionByName(
        new.select(*KEYS, "line_number", "line", F.lit(1).alias("side"))), [*KEYS, "side"])
    own = lambda c, side: F.max(F.when(F.col("side") == side, F.col(c)))
    sizes = [F.coalesce(own("n", side), F.lit(0)).cast("long").alias(name) for side, name in ((0, "old_lines"), (1, "new_lines"))]
    differ = ~(own("d1", 0).eqNullSafe(own("d1", 1)) & own("d2", 0).eqNullSafe(own("d2", 1)) & own("n", 0).eqNullSafe(own("n", 1)))
    both = d.groupBy(*KEYS).agg(*sizes, differ.alias("changed"))
    if not proof:
        return both
    both = materialize(both, "digests")
    same = both.where(~F.col("changed")).select(*KEYS)
    o = old.join(same, KEYS, "left_semi").select(*KEYS, "line_number", F.col("line").alias("ol"))
    n = new.join(same, KEYS, "left_semi").select(*KEYS, "line_number", F.col("line").alias("nl"))
    wrong = (o.join(n, [*KEYS, "line_number"], "full_outer").where(~F.col("ol").eqNullSafe(F.col("nl")))
             .select(*KEYS, F.lit(True).alias("wrong")).distinct())
    return both.join(wrong, KEYS, "left").select(
        *KEYS, "old_lines", "new_lines", (F.col("changed") | F.coalesce("wrong", F.lit(False))).alias("changed"))


def pair_versions(lines: DataFrame, missing_as_empty: bool = False) -> tuple[DataFrame, DataFrame]:
    """Build (old, new) line tables for every version that has a predecessor.

    Returns ``(old, new)`` keyed by the new version. First versions are the
    baseline: they produce no events."""
    pairs = small_table(version_pairs(lines).where(F.col("prev_version").isNotNull()), "pairs")
    new = lines.join(pairs.select("file_name", "version"), ["file_name", "version"], "left_semi")
    old = lines.withColumnRenamed("version", "prev_version").join(
        pairs, ["file_name", "prev_version"]).select("file_name", "version", "line_number", "line")
    return old, new


def diff_versions(lines: DataFrame, detected_at: DataFrame | Column | None = None,
                  strategy: str = "auto") -> DataFrame:
    """D11 over a history: every version against the previous one, all files and
    versions in the same jobs."""
    old, new = pair_versions(lines)
    return diff_lines(old, new, detected_at, strategy=strategy)


def apply_changes(old: DataFrame, events: DataFrame) -> DataFrame:
    """Rebuild the new line list from the old one and the (unordered)
    events of one comparison.

    Survivors of the old list (not DELETEd) keep their relative order; the new
    positions not taken by an INSERT are filled by the survivors in order; an
    UPDATE overrides the text at its new position. Ranks are computed per
    position block, so a huge file is not gathered.

    Positions come from a table of a row a file, which is all that Spark knows of their
    number: it would send every one through the driver to be joined. So both ranked sides
    are stored, and tables of a row a line are joined by merging.
    """
    name = F.col("file_path" if "file_path" in events.columns else "file_name").alias("file_name")
    # Read by each of the steps below.
    ev = materialize(events.select(name, "version", "event_type", "line_number", "new_value"), "changes")
    dels = ev.where(F.col("event_type") == DELETE).select("file_name", "version", "line_number")
    ins = ev.where(F.col("event_type") == INSERT).select(
        "file_name", "version", F.col("line_number"), F.col("new_value").alias("line"))
    upd = ev.where(F.col("event_type") == UPDATE).select(
        "file_name", "version", F.col("line_number"), F.col("new_value").alias("upd"))
    survivors = old.join(dels.hint("merge"), ["file_name", "version", "line_number"], "left_anti")
    survivors = materialize(prefix_sum(survivors, KEYS, "line_number", F.lit(1), "rank").select(
        *KEYS, "rank", "line"), "survivors")
    n_surv = survivors.groupBy(*KEYS).agg(F.count("*").alias("ns"))
    n_ins = ins.groupBy(*KEYS).agg(F.count("*").alias("ni"))
    sizes = n_surv.join(n_ins, KEYS, "full_outer").select(
        *KEYS, (F.coalesce("ns", F.lit(0)) + F.coalesce("ni", F.lit(0))).alias("total"))
    # Target positions 1..total, spread in chunks before the per-line explode.
    chunks = sizes.withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"),
                                                         F.floor((F.col("total") - 1) / EXPLODE_CHUNK).cast("long"))))
    chunks = chunks.where(F.col("total") > 0).repartition(*KEYS, "c")
    slots = chunks.select(*KEYS, F.explode(F.sequence(F.col("c") * EXPLODE_CHUNK + 1,
                                                      F.least(F.col("total"), (F.col("c") + 1) * EXPLODE_CHUNK)))
                          .alias("line_number")).withColumn("line_number", F.col("line_number").cast("int"))
    free = slots.join(ins.select(*KEYS, "line_number").hint("merge"), [*KEYS, "line_number"], "left_anti")
    free = materialize(prefix_sum(free, KEYS, "line_number", F.lit(1), "rank"), "free")
    kept = free.join(survivors.hint("merge"), [*KEYS, "rank"]).select(*KEYS, "line_number", "line")
    kept = kept.join(upd.hint("merge"), [*KEYS, "line_number"], "left").select(
        *KEYS, "line_number", F.coalesce("upd", "line").alias("line"))
    return kept.unionByName(ins.select(*KEYS, "line_number", "line"))
