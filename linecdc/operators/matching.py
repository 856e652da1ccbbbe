"""Exact sequence alignment of two line lists per (file_name, version), as
Spark jobs over all files at once (D1-D3, E1, F4, G1, G2).

Alignment rule (``difflib.SequenceMatcher`` without junk): take the longest
block of consecutive equal lines, ties to the smallest old index, then the
smallest new index; recurse on the part left of it and the part right of it.
Gaps between blocks become opcodes.

Input ``L``: ``file_name, version, side (0 old / 1 new), pos (0-based), line``.

Two exact ways, picked per file by the form of its matches, not by its size:

* **chain** — every common line is unique on both sides and the matches are
  in the same order: every match is kept, blocks are the diagonal runs, no
  recursion. Typical for record-like files.
* **rounds** — each round, all open segments of all files at once find the
  length of their longest common block and *all* their blocks of that length.
  No block of the greatest length lies left of the first one chosen, so the
  recursion takes blocks of that length as one greedy chain: the least old
  start from where the last block ended that has a new start there or later,
  with the least such new start. Between the chain's blocks only shorter ones
  remain, so lengths fall strictly from round to round: a file of n lines needs
  at most about sqrt(2n) rounds, in practice a handful.

Match pairs are never materialised: windows of ``2**k`` lines get exact content
names by doubling (name = least position with the same content), and a block of
any length is named by two of them. Names are kept for open positions only, and
only for levels that a segment can still use, so a round's work falls with them.

The greedy chain walks a segment in steps of at most ``walk`` old starts; the state that
a step reaches is where the next one starts. A segment of up to ``5 * WALK`` starts goes
to one task, which hands the state from step to step itself. Longer ones are walked in
jobs of ``WALK`` old starts with, for each of their contents, a bounded run of the next
new starts. A task holds one job's rows of a segment, however long the file.

Output: ``pieces(file_name, version, kind, i1, i2, j1, j2)`` with kind ``B``
(matched block) or ``G`` (gap between blocks, may be empty).
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linecdc import ship_by_value
from linecdc.functions.text import line_hash
from linecdc.operators.ordering import DEFAULT_BLOCK_BITS, rank_within
from linecdc.session import BROADCAST_ROWS, few_broadcasts, materialize, true_sizes

ship_by_value(__name__)

KEYS = ["file_name", "version"]
# Position code: side in the high bits, so one long names a line occurrence.
SIDE_SHIFT = 40
SEG = [*KEYS, "sid"]
# Old starts that one job of the greedy chain walks; its steps may be shorter.
WALK = 1 << 17
# Positions of a content that lie in one list: those of one range of 2**12 lines.
PAIR_BLOCK_BITS = 12
# Rows that a segment is cut into before its positions are listed.
EXPLODE_CHUNK = 1 << 16

PIECES_SCHEMA = T.StructType([
    T.StructField("file_name", T.StringType(), False),
    T.StructField("version", T.LongType(), False),
    T.StructField("kind", T.StringType(), False),
    T.StructField("i1", T.LongType(), False),
    T.StructField("i2", T.LongType(), False),
    T.StructField("j1", T.LongType(), False),
    T.StructField("j2", T.LongType(), False),
])


@dataclass
class MatchResult:
    pieces: DataFrame
    rounds: int = 0

    @property
    def blocks(self) -> DataFrame:
        """Matched blocks ``(file_name, version, i, j, n)``."""
        return self.pieces.where(F.col("kind") == "B").select(
            *KEYS, F.col("i1").alias("i"), F.col("j1").alias("j"),
            (F.col("i2") - F.col("i1")).alias("n"))

    @property
    def opcodes(self) -> DataFrame:
        """Non-equal opcodes ``(file_name, version, tag, i1, i2, j1, j2)`` (D3)."""
        g = self.pieces.where((F.col("kind") == "G") & ((F.col("i2") > F.col("i1")) | (F.col("j2") > F.col("j1"))))
        tag = (F.when((F.col("i2") > F.col("i1")) & (F.col("j2") > F.col("j1")), "replace")
               .when(F.col("j2") == F.col("j1"), "delete").otherwise("insert"))
        return g.select(*KEYS, tag.alias("tag"), "i1", "i2", "j1", "j2")


def _checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage: write the rows as a table in the session's shared checkpoint
    folder and read it back (survives executor loss; the re-read relation starts
    a fresh plan)."""
    return materialize(df)


def _pow2(k):
    return F.pow(F.lit(2), k).cast("long")


def _code(side, pos):
    return F.shiftleft(side.cast("long"), SIDE_SHIFT) + pos.cast("long")


# ---------------------------------------------------------------- preparation

def prepare(L: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tag each line with an exact value id and count values per side.

    Returns ``(tagged, values, ext)``:
    tagged ``(file_name, version, side, pos, vid, ca, cb)`` (per-side counts of
    the line's value); values ``(…, vid, ca, cb)``;
    ext ``(file_name, version, la, lb)``.
    """
    L = L.select(*KEYS, F.col("side").cast("int").alias("side"), F.col("pos").cast("long").alias("pos"),
                 "line").withColumn("h", line_hash(F.col("line")))
    # One group per distinct (hash, text): text equality is part of the key, so
    # a hash collision never matches. min() is partially aggregated map-side,
    # so a hugely repeated line does not gather in one task.
    values = L.groupBy(*KEYS, "h", "line").agg(
        F.min(_code(F.col("side"), F.col("pos"))).alias("vid"),
        F.sum(F.when(F.col("side") == 0, 1).otherwise(0)).alias("ca"),
        F.sum(F.when(F.col("side") == 1, 1).otherwise(0)).alias("cb"),
    )
    tagged = L.join(values.select(*KEYS, "h", "line", "vid", "ca", "cb"), [*KEYS, "h", "line"]).select(
        *KEYS, "side", "pos", "vid", "ca", "cb")
    ext = L.groupBy(*KEYS).agg(
        F.sum(F.when(F.col("side") == 0, 1).otherwise(0)).cast("long").alias("la"),
        F.sum(F.when(F.col("side") == 1, 1).otherwise(0)).cast("long").alias("lb"),
    )
    return tagged, values.drop("h", "line"), ext


def factorised_pairs(tagged: DataFrame) -> DataFrame:
    """All match pairs of every file, as position lists: ``KEYS, vid, side, block,
    positions`` for every content that both sides have. Any old and any new position of
    one content are a pair, so the table has one entry a line, not one a pair; lists are
    cut by position block, so a line repeated through a huge file fills many rows."""
    common = tagged.where((F.col("ca") > 0) & (F.col("cb") > 0))
    return common.groupBy(*KEYS, "vid", "side", F.shiftright("pos", PAIR_BLOCK_BITS).alias("block")).agg(
        F.sort_array(F.collect_list("pos")).alias("positions"))


def pair_counts(factors: DataFrame) -> DataFrame:
    """``KEYS, n_pairs, n_contents``, from list lengths alone."""
    n = lambda side: F.sum(F.when(F.col("side") == side, F.size("positions")).otherwise(0))
    per = factors.groupBy(*KEYS, "vid").agg(n(0).alias("na"), n(1).alias("nb"))
    return per.groupBy(*KEYS).agg(F.sum(F.col("na").cast("decimal(38,0)") * F.col("nb")).cast("decimal(38,0)").alias("n_pairs"),
                                  F.count("*").alias("n_contents"))


def pairs_in_range(factors: DataFrame, i1: int, i2: int, j1: int, j2: int) -> DataFrame:
    """``KEYS, i, j``: the pairs with old position in [i1, i2) and new in [j1, j2), as
    zero-based positions. Blocks outside are skipped unopened; the old positions are
    expanded and joined to the new lists, so no more than the asked-for rectangle is made."""
    def side(s, lo, hi):
        block = F.col("block").between(lo >> PAIR_BLOCK_BITS, (hi - 1) >> PAIR_BLOCK_BITS)
        inside = F.filter("positions", lambda x: (x >= lo) & (x < hi))
        return factors.where((F.col("side") == s) & block).select(*KEYS, "vid", inside.alias("p")).where(F.size("p") > 0)

    old = side(0, i1, i2).select(*KEYS, "vid", F.explode("p").alias("i"))
    new = side(1, j1, j2)
    return old.join(new, [*KEYS, "vid"]).select(*KEYS, "i", F.explode("p").alias("j"))


def unique_pairs(tagged: DataFrame) -> DataFrame:
    """Match pairs of lines that occur exactly once on each side (1:1, bounded).

    This is D1 restricted to what can be emitted without a quadratic blow-up:
    repeated lines are never expanded into all their pairs.
    """
    t = tagged.where((F.col("ca") == 1) & (F.col("cb") == 1))
    a = t.where(F.col("side") == 0).select(*KEYS, "vid", F.col("pos").alias("i"))
    b = t.where(F.col("side") == 1).select(*KEYS, "vid", F.col("pos").alias("j"))
    return a.join(b, [*KEYS, "vid"]).select(*KEYS, "i", "j")


def line_values(L: DataFrame) -> DataFrame:
    """One row per distinct line of a comparison, by one shuffle of the text and without it:
    ``KEYS, ca, cb`` (its occurrences on each side), ``i, j`` (the last of them) and ``known``,
    false where the line or a key is null, which match nothing."""
    own = lambda side, value: F.when(F.col("side") == side, value)
    per = L.select(*KEYS, "side", F.col("pos").cast("long").alias("pos"), "line").groupBy(*KEYS, line_hash(F.col("line")).alias("h"), "line").agg(
        F.count(own(0, F.lit(1))).alias("ca"), F.count(own(1, F.lit(1))).alias("cb"),
        F.max(own(0, F.col("pos"))).alias("i"), F.max(own(1, F.col("pos"))).alias("j"))
    known = F.col("line").isNotNull() & F.col(KEYS[0]).isNotNull() & F.col(KEYS[1]).isNotNull()
    return per.select(*KEYS, "ca", "cb", "i", "j", known.alias("known"))


def chain_runs(pairs: DataFrame) -> DataFrame:
    """Diagonal runs inside blocks of old positions: ``KEYS, b, c0, n, i1, j1, pi, pj, bad``
    with the number of pairs before it in the block, the end of the run before (null: the
    block's first) and the number of pairs that lie before their predecessor on the new side."""
    d = pairs.select(*KEYS, "i", "j", F.shiftright("i", DEFAULT_BLOCK_BITS).alias("b"))
    w = Window.partitionBy(*KEYS, "b").orderBy("i", "j")
    d = d.withColumn("rk", F.row_number().over(w)).withColumn("pi", F.lag("i").over(w) + 1).withColumn("pj", F.lag("j").over(w) + 1)
    fresh = F.col("pi").isNull() | (F.col("i") != F.col("pi")) | (F.col("j") != F.col("pj"))
    d = d.withColumn("run", F.sum(fresh.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # Same partitions as the window's: no further shuffle, and a run leaves its task as one row.
    return d.groupBy(*KEYS, "b", "run").agg(
        (F.min("rk") - 1).cast("long").alias("c0"), F.count("*").alias("n"), F.min("i").alias("i1"),
        F.min_by("j", "rk").alias("j1"), F.min_by("pi", "rk").alias("pi"), F.min_by("pj", "rk").alias("pj"),
        F.sum(F.when(F.col("pj") > F.col("j"), 1).otherwise(0)).alias("bad")).drop("run")


def classify(values: DataFrame):
    """Per file: does it form a chain (unique lines, same order)?

    Returns ``(runs, cls)``: the runs of its unique matches as ``KEYS, r0, n, i1, j1, pi, pj``
    (``r0``: the matches before), and cls with ``file_name, version, la, lb, path``.
    """
    runs = _checkpoint(chain_runs(values.where(F.col("known") & (F.col("ca") == 1) & (F.col("cb") == 1))))
    # One row a block: its pairs, where its first run starts and its last one ends.
    blocks = runs.groupBy(*KEYS, "b").agg(
        F.sum("n").alias("bn"), F.min(F.struct("c0", "i1", "j1")).alias("first"), F.sum("bad").alias("bad"),
        F.max(F.struct("c0", (F.col("i1") + F.col("n")).alias("i"), (F.col("j1") + F.col("n")).alias("j"))).alias("end"))
    w = Window.partitionBy(*KEYS).orderBy("b")
    before = F.sum("bn").over(w.rowsBetween(Window.unboundedPreceding, -1))
    blocks = _checkpoint(blocks.select(*KEYS, "b", F.coalesce(before, F.lit(0)).alias("off"), F.lag("end.i").over(w).alias("li"),
                                       F.lag("end.j").over(w).alias("lj"), F.col("first.j1").alias("fj"), "bad"))
    # Every known value counts: none (0) unless it is common and repeated on a side.
    multi = F.col("known") & (F.col("ca") > 0) & (F.col("cb") > 0) & (F.col("ca") + F.col("cb") > 2)
    ext = values.groupBy(*KEYS).agg(F.sum("ca").alias("la"), F.sum("cb").alias("lb"), F.max(multi).alias("multi"))
    disorder = blocks.groupBy(*KEYS).agg(F.sum(F.col("bad") + F.when(F.col("lj") > F.col("fj"), 1).otherwise(0)).alias("bad"))
    cls = (ext.join(disorder, KEYS, "left")
           .withColumn("path", F.when(~F.col("multi") & (F.coalesce("bad", F.lit(0)) == 0), "chain").otherwise("rounds"))
           .select(*KEYS, "la", "lb", "path"))
    at = runs.join(blocks.drop("bad", "fj"), [*KEYS, "b"])
    return at.select(*KEYS, (F.col("off") + F.col("c0")).alias("r0"), "n", "i1", "j1",
                     F.coalesce("pi", "li").alias("pi"), F.coalesce("pj", "lj").alias("pj")), cls


# ---------------------------------------------------------------- chain path

def chain_pieces(runs: DataFrame, bounds: DataFrame) -> DataFrame:
    """Blocks and gaps of files whose matches form a chain.

    ``bounds`` has ``KEYS`` + ``alo, ahi, blo, bhi``; ``runs`` is that of ``classify``. Runs
    that a block border has cut go on along the same diagonal: along one, both ``i - rank``
    and ``j - rank`` stay constant. The gap in front of a run starts where the run before
    ends; the last gap goes to the end of both sides.
    """
    p = runs.join(bounds.select(*KEYS, "alo", "blo"), KEYS)
    blocks = p.groupBy(*KEYS, (F.col("i1") - F.col("r0")).alias("di"), (F.col("j1") - F.col("r0")).alias("dj")).agg(
        F.min("i1").alias("i1"), F.min("j1").alias("j1"), F.sum("n").alias("n"),
        F.min(F.struct("r0", F.coalesce("pi", "alo").alias("i"), F.coalesce("pj", "blo").alias("j"))).alias("end"))
    pieces = blocks.select(*KEYS, F.explode(F.array(
        _piece("B", F.col("i1"), F.col("i1") + F.col("n"), F.col("j1"), F.col("j1") + F.col("n")),
        _piece("G", F.col("end.i"), F.col("i1"), F.col("end.j"), F.col("j1")))).alias("p")).select(*KEYS, "p.*")
    last = p.groupBy(*KEYS).agg(F.max(F.struct("r0", (F.col("i1") + F.col("n")).alias("i"), (F.col("j1") + F.col("n")).alias("j"))).alias("m"))
    return pieces.unionByName(bounds.join(last, KEYS, "left").select(
        *KEYS, F.lit("G").alias("kind"), F.coalesce("m.i", "alo").alias("i1"), F.col("ahi").alias("i2"),
        F.coalesce("m.j", "blo").alias("j1"), F.col("bhi").alias("j2")))


def _piece(kind, i1, i2, j1, j2):
    return F.struct(F.lit(kind).alias("kind"), i1.alias("i1"), i2.alias("i2"), j1.alias("j1"), j2.alias("j2"))


# ---------------------------------------------------------------- rounds

def window_names(tagged: DataFrame, ext: DataFrame, max_level: int) -> DataFrame:
    """Exact content names of windows of ``2**k`` lines, ``k = 0..max_level``.

    Level 0 name is the value id. Level k: two halves of level k-1; the name
    is the smallest position code holding the same pair of halves. Only content
    that both sides have is kept: nothing else can be in a common block.
    """
    common = lambda g: (F.max(F.when(F.col("side") == 0, 1)) + F.max(F.when(F.col("side") == 1, 1))).alias(g)
    lvl = tagged.where((F.col("ca") > 0) & (F.col("cb") > 0)).select(*KEYS, "side", "pos", F.col("vid").alias("n"))
    out = [lvl.withColumn("k", F.lit(0))]
    for k in range(1, max_level + 1):
        half = 1 << (k - 1)
        nxt = lvl.select(*KEYS, "side", (F.col("pos") - half).alias("pos"), F.col("n").alias("n2"))
        both = lvl.join(nxt, [*KEYS, "side", "pos"])
        names = both.groupBy(*KEYS, "n", "n2").agg(
            F.min(_code(F.col("side"), F.col("pos"))).alias("nk"), common("sides")).where(F.col("sides").isNotNull())
        lvl = _checkpoint(both.join(names, [*KEYS, "n", "n2"]).select(*KEYS, "side", "pos", F.col("nk").alias("n")))
        if lvl.isEmpty():
            break
        out.append(lvl.withColumn("k", F.lit(k)))
    return _union_all(out)


def _fits(length_col):
    return F.when(F.col("side") == 0, F.col("pos") + length_col <= F.col("ahi")).otherwise(
        F.col("pos") + length_col <= F.col("bhi"))


# Lowest bits of the block length that are settled in one job, instead of one
# job per bit.
FINAL_BITS = 3


def _candidates(mk: DataFrame, state: DataFrame, offsets) -> DataFrame:
    """Composite names of windows of length ``cur + d`` for ``d`` in ``offsets``
    (an array column), for every member position whose window fits.

    For ``2**k <= len < 2**(k+1)`` the content of ``[p, p+len)`` is named exactly
    by the pair of level-k names at ``p`` and ``p + len - 2**k``.
    """
    m = mk.join(state.select(*SEG, "ahi", "blo", "bhi", "k", "cur"), SEG)
    m = m.select("*", F.explode(offsets).alias("d")).withColumn("len", F.col("cur") + F.col("d"))
    m = m.where((F.col("len") < 2 * _pow2(F.col("k"))) & _fits(F.col("len")))
    m = m.withColumn("pos2", F.col("pos") + F.col("len") - _pow2(F.col("k")))
    shifted = mk.select(*SEG, "side", F.col("pos").alias("pos2"), F.col("nk").alias("n2"))
    return m.join(shifted, [*SEG, "side", "pos2"]).select(*SEG, "len", "blo", "side", "pos", "nk", "n2")


def _common(comp: DataFrame) -> DataFrame:
    """(segment, length, content) that both sides of the segment hold."""
    return comp.groupBy(*SEG, "len", "nk", "n2").agg(
        F.count(F.when(F.col("side") == 0, 1)).alias("na"), F.count(F.when(F.col("side") == 1, 1)).alias("nb"),
    ).where((F.col("na") > 0) & (F.col("nb") > 0))


def _union_all(dfs: list[DataFrame]) -> DataFrame | None:
    if not dfs:
        return None
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out


WALKED = T.StructType([
    *[T.StructField(c, t) for c, t in (("file_name", T.StringType()), ("version", T.LongType()), ("sid", T.LongType()))],
    *[T.StructField(c, T.LongType()) for c in ("i", "j", "pi", "pj", "len")],
    T.StructField("kind", T.StringType()),
])


def _walk_segment(length, i0, j0, starts, contents, news, cut, more):
    """The greedy chain over one step. ``starts``/``contents``: old starts in order;
    ``news``: content -> its next new starts in order; ``cut``: contents with
    further new starts; ``more``: further old starts follow. Returns the blocks
    (i, j, end of the block before) and the state to go on from (None: done)."""
    out = []
    for i, c in zip(starts, contents):
        if i < i0:
            continue
        at = news.get(c, ())
        k = bisect_left(at, j0)
        if k == len(at):
            if c in cut:  # its next new starts are not here: go on from this place
                return out, (i0, j0, i)
            continue
        out.append((i, at[k], i0, j0))
        i0, j0 = i + length, at[k] + length
    return out, (i0, j0, starts[-1] + 1) if more and starts else None


def _walk_steps(length, i0, j0, starts, contents, news, cut, more, walk):
    """``_walk_segment`` in steps of ``walk`` old starts, each from the state of the one before."""
    out, at = [], 0
    while True:
        end = min(len(starts), at + walk)
        blocks, state = _walk_segment(length, i0, j0, starts[at:end], contents[at:end], news, cut, more or end < len(starts))
        out += blocks
        if state is None or end == len(starts):
            return out, state
        i0, j0, i = state
        if i <= starts[end - 1]:  # a content's next new starts are not here
            return out, state
        at = max(end, bisect_left(starts, i0))
        if at == len(starts):
            return out, state if more else None


def _walk(batches, walk=WALK):
    """mapInPandas body over rows sorted by segment, side and position; a segment
    cut by a batch boundary is carried over. Rows of kind B are blocks with the end
    of the one before; kind S is the state in which a step ended (pi, pj) and the
    old position (i) to look on from; kind E the state at the end of the chain."""
    import numpy as np

    cols = ["file_name", "version", "sid", "i", "j", "pi", "pj", "len", "kind"]

    def run(pdf):
        out = []
        key = [pdf[c].to_numpy() for c in ("file_name", "version", "sid")]
        change = np.ones(len(pdf), bool)
        change[1:] = (key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1]) | (key[2][1:] != key[2][:-1])
        side, pos = pdf["side"].to_numpy(), pdf["pos"].to_numpy()
        nk, n2, cut = pdf["nk"].to_numpy(), pdf["n2"].to_numpy(), pdf["cut"].to_numpy()
        length, i0, j0, more = (pdf[c].to_numpy() for c in ("len", "i0", "j0", "more"))
        at = [*np.flatnonzero(change), len(pdf)]
        for s, e in zip(at[:-1], at[1:]):
            name = list(zip(nk[s:e].tolist(), n2[s:e].tolist()))
            old = [(p, c) for p, c, d in zip(pos[s:e].tolist(), name, side[s:e].tolist()) if d == 0]
            news, cuts = {}, set()
            for p, c, d, x in zip(pos[s:e].tolist(), name, side[s:e].tolist(), cut[s:e].tolist()):
                if d == 1:
                    news.setdefault(c, []).append(p)
                if x:
                    cuts.add(c)
            head, n = (key[0][s], int(key[1][s]), int(key[2][s])), int(length[s])
            blocks, state = _walk_steps(n, int(i0[s]), int(j0[s]), [p for p, _ in old], [c for _, c in old], news, cuts,
                                        bool(more[s]), walk)
            out += [(*head, i, j, pi, pj, n, "B") for i, j, pi, pj in blocks]
            if state is not None:
                out.append((*head, state[2], None, state[0], state[1], n, "S"))
            else:
                pi, pj = (blocks[-1][0] + n, blocks[-1][1] + n) if blocks else (int(i0[s]), int(j0[s]))
                out.append((*head, None, None, pi, pj, n, "E"))
        res = pd.DataFrame(out, columns=cols)
        return res.astype({"i": "Int64", "j": "Int64"})

    carry = None
    for pdf in batches:
        if carry is not None:
            pdf = pd.concat([carry, pdf], ignore_index=True)
        if not len(pdf):
            continue
        last = np.ones(len(pdf), bool)
        for c in ("file_name", "version", "sid"):
            v = pdf[c].to_numpy()
            last &= v == v[-1]
        first = int(np.argmin(last[::-1]))
        first = len(pdf) - first if first else 0
        carry = pdf.iloc[first:].reset_index(drop=True)
        if first:
            yield run(pdf.iloc[:first])
    if carry is not None and len(carry):
        yield run(carry)


def _walk_step(rows: DataFrame, walk: int) -> DataFrame:
    return (rows.select(*SEG, "side", "pos", "nk", "n2", "cut", "len", "i0", "j0", "more")
            .repartition(*SEG).sortWithinPartitions(*SEG, "side", "pos").mapInPandas(lambda b: _walk(b, walk), WALKED))


def greedy_chain(cand: DataFrame, walk: int = WALK, per_job: int | None = None) -> DataFrame:
    """Blocks and end state of the greedy chain of every segment, in steps of ``walk`` old
    starts, ``per_job`` (default: ``WALK``) of them a job.

    ``cand``: ``SEG, len, blo, side, pos, nk, n2`` — all starts of common blocks of
    the segment's greatest length. Returns WALKED rows of kinds B and E."""
    size = _checkpoint(cand.groupBy(*SEG).agg(
        F.count(F.when(F.col("side") == 0, 1)).alias("na"), F.count("*").alias("n")))
    job = max(walk, per_job or WALK)
    here = F.col("n") <= 5 * job
    large = size.where(~here).select(*SEG)
    all_here = large.isEmpty()
    whole = (cand if all_here else cand.join(size.where(here).select(*SEG), SEG, "left_semi")).select(
        "*", F.lit(False).alias("cut"), F.lit(False).alias("more"), F.col("sid").alias("i0"), F.col("blo").alias("j0"))
    done = [_checkpoint(_walk_step(whole, walk))]
    if all_here:
        return done[0]
    big = cand.join(large, SEG, "left_semi")
    old = _checkpoint(rank_within(big.where(F.col("side") == 0), SEG, "pos", "r"))
    new = _checkpoint(rank_within(big.where(F.col("side") == 1), [*SEG, "nk", "n2"], "pos", "r"))
    state = big.select(*SEG, F.col("sid").alias("i0"), F.col("blo").alias("j0"), F.col("sid").alias("at")).distinct()
    while True:
        # The job's old starts ...
        o = old.join(state, SEG).where(F.col("pos") >= F.greatest("at", "i0"))
        first = o.groupBy(*SEG).agg(F.min("r").alias("r0"), F.max("r").alias("r9"))
        o = o.join(first, SEG).where(F.col("r") < F.col("r0") + job).withColumn("more", F.col("r9") >= F.col("r0") + job)
        # ... and for each of their contents a bounded run of the next new starts.
        want = o.groupBy(*SEG, "nk", "n2").agg((4 * F.count("*") + 16).alias("limit"))
        n = new.join(want, [*SEG, "nk", "n2"]).join(state, SEG).where(F.col("pos") >= F.col("j0"))
        run = n.groupBy(*SEG, "nk", "n2").agg(F.min("r").alias("r0"), F.max("r").alias("r9"))
        n = n.join(run, [*SEG, "nk", "n2"]).where(F.col("r") < F.col("r0") + F.col("limit"))
        more = o.select(*SEG, "more").distinct()
        cols = [*SEG, "side", "pos", "nk", "n2", "len", "i0", "j0"]
        rows = o.select(*cols, F.lit(False).alias("cut"), "more").unionByName(
            n.withColumn("cut", F.col("r9") >= F.col("r0") + F.col("limit")).join(more, SEG).select(*cols, "cut", "more"))
        got = _checkpoint(_walk_step(rows, walk))
        # Segments without any old start left end where they are.
        ended = state.join(first.select(*SEG), SEG, "left_anti").join(big.select(*SEG, "len").distinct(), SEG)
        done += [got.where(F.col("kind") != "S"), ended.select(
            *SEG, F.lit(None).cast("long").alias("i"), F.lit(None).cast("long").alias("j"), F.col("i0").alias("pi"),
            F.col("j0").alias("pj"), "len", F.lit("E").alias("kind"))]
        state = _checkpoint(got.where(F.col("kind") == "S").select(
            *SEG, F.col("pi").alias("i0"), F.col("pj").alias("j0"), F.col("i").alias("at")))
        if state.isEmpty():
            return _checkpoint(_union_all(done))


def _positions(seg: DataFrame) -> DataFrame:
    """(KEYS, side, pos) of all positions of the segments, with the segment's bounds."""
    sides = seg.select("*", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("sid").alias("lo"), F.col("ahi").alias("hi")),
        F.struct(F.lit(1).alias("side"), F.col("blo").alias("lo"), F.col("bhi").alias("hi")))).alias("s")).select(
        *SEG, "ahi", "blo", "bhi", "top", "s.*")
    chunks = sides.withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("hi") - F.col("lo") - 1) / EXPLODE_CHUNK))))
    return chunks.select(*SEG, "ahi", "blo", "bhi", "top", "side", F.explode(F.sequence(
        F.col("lo") + F.col("c") * EXPLODE_CHUNK,
        F.least(F.col("hi"), F.col("lo") + (F.col("c") + 1) * EXPLODE_CHUNK) - 1)).alias("pos"))


def relational_rounds(tagged: DataFrame, ext: DataFrame, walk: int = WALK) -> tuple[DataFrame, int]:
    """Rounds over the whole files in ``ext``, whose lines ``tagged`` holds; returns
    ``(pieces, rounds)``.

    Each round, for all open segments of all files at once: (1) the largest ``k``
    with a common window of ``2**k`` lines inside the segment; (2) the exact length
    by descending the bits of ``[2**k, 2**(k+1))``; (3) the greedy chain of blocks of
    that length; (4) the segments between them, with their names. Every step writes
    its small result to the shared checkpoint folder, so a job's plan holds the joins
    of one step only: the driver plans each job anew at every stage's end, and what
    that takes of its memory grows with the joins times the stages.
    """
    mx = ext.agg(F.max(F.least("la", "lb")).alias("m")).first()["m"] or 0
    names = _checkpoint(window_names(tagged, ext, max(0, int(mx).bit_length() - 1)))
    zero = F.lit(0).cast("long")
    seg = ext.select(*KEYS, zero.alias("sid"), F.col("la").alias("ahi"), zero.alias("blo"), F.col("lb").alias("bhi"),
                     F.least("la", "lb").alias("top"))
    opened = (F.col("ahi") > F.col("sid")) & (F.col("bhi") > F.col("blo"))
    gap = lambda d: d.select(*KEYS, F.lit("G").alias("kind"), F.col("sid").alias("i1"), F.col("ahi").alias("i2"),
                             F.col("blo").alias("j1"), F.col("bhi").alias("j2"))
    pieces = [gap(seg.where(~opened & ((F.col("ahi") > F.col("sid")) | (F.col("bhi") > F.col("blo")))))]
    seg = seg.where(opened)
    rounds = 0
    final_offsets = F.array(*[F.lit(d).cast("long") for d in range(1 << FINAL_BITS)])
    # Names of the open positions whose window fits and is not too long to matter.
    usable = _fits(_pow2(F.col("k"))) & (_pow2(F.col("k")) <= F.col("top"))
    while True:
        mn = _checkpoint(names.join(_positions(seg), [*KEYS, "side", "pos"]).where(usable)
                         .select(*SEG, "ahi", "blo", "bhi", "side", "pos", "k", "n"))
        names = mn.select(*KEYS, "side", "pos", "k", "n")
        # 1. Largest power of two with a common window inside the segment.
        lv = (mn.groupBy(*SEG, "ahi", "blo", "bhi", "k", "n").agg(
            F.max(F.when(F.col("side") == 0, 1)).alias("ha"), F.max(F.when(F.col("side") == 1, 1)).alias("hb"))
            .where(F.col("ha").isNotNull() & F.col("hb").isNotNull())
            .groupBy(*SEG, "ahi", "blo", "bhi").agg(F.max("k").alias("k")))
        state = _checkpoint(lv.withColumn("cur", _pow2(F.col("k"))))
        top = state.agg(F.max("k")).first()[0]
        # Segments with no common line are finished: one gap each.
        finished = gap(seg.join(state.select(*SEG), SEG, "left_anti"))
        if top is None:
            pieces.append(_checkpoint(finished))
            break
        rounds += 1
        # Read twice by every step below.
        mk = _checkpoint(mn.join(state.select(*SEG, "k"), [*SEG, "k"]).select(*SEG, "side", "pos", F.col("n").alias("nk")))
        # 2. Exact length: high bits one job each, the low ones together.
        for m in range(top - 1, FINAL_BITS - 1, -1):
            trial = state.where(F.col("k") > m)
            ok = (_common(_candidates(mk, trial, F.array(F.lit(1 << m).cast("long"))))
                  .select(*SEG).distinct().withColumn("hit", F.lit(1 << m)))
            state = _checkpoint(state.join(ok, SEG, "left")
                                .withColumn("cur", F.col("cur") + F.coalesce("hit", F.lit(0))).drop("hit"))
        longest = _common(_candidates(mk, state, final_offsets)).groupBy(*SEG).agg(F.max("len").alias("cur"))
        state = _checkpoint(state.drop("cur").join(longest, SEG))
        comp = _candidates(mk, state, F.array(zero))
        cand = _checkpoint(comp.join(_common(comp).select(*SEG, "len", "nk", "n2"), [*SEG, "len", "nk", "n2"], "left_semi"))
        # 3. All blocks of that length that the recursion takes.
        won = greedy_chain(cand, walk)
        blocks = won.where(F.col("kind") == "B")
        found = blocks.select(*KEYS, F.lit("B").alias("kind"), F.col("i").alias("i1"), (F.col("i") + F.col("len")).alias("i2"),
                              F.col("j").alias("j1"), (F.col("j") + F.col("len")).alias("j2"))
        # 4. What lies before each block and after the last; shorter blocks only.
        before = blocks.select(*KEYS, F.col("pi").alias("sid"), F.col("i").alias("ahi"), F.col("pj").alias("blo"),
                               F.col("j").alias("bhi"), "len")
        after = won.where(F.col("kind") == "E").join(state.select(*SEG, "ahi", "bhi"), SEG).select(
            *KEYS, F.col("pi").alias("sid"), "ahi", F.col("pj").alias("blo"), "bhi", "len")
        kids = _checkpoint(before.unionByName(after).withColumn("top", F.least(
            F.col("len") - 1, F.col("ahi") - F.col("sid"), F.col("bhi") - F.col("blo"))).drop("len"))
        open_kid = opened & (F.col("top") > 0)
        closed = gap(kids.where(~open_kid & ((F.col("ahi") > F.col("sid")) | (F.col("bhi") > F.col("blo")))))
        # A round's joins run here: in one plan over all rounds, all of their broadcasts
        # would lie in the driver at once.
        pieces.append(_checkpoint(finished.unionByName(found).unionByName(closed)))
        seg = kids.where(open_kid)
    return _union_all(pieces), rounds


# ---------------------------------------------------------------- driver

def match_lines(L: DataFrame, strategy: str = "auto", walk: int = WALK) -> MatchResult:
    """Align old and new lines of every (file_name, version).

    ``strategy``: ``auto`` (files whose matches form a chain by ranks, all others
    by rounds) or ``rounds`` (all files by rounds).
    """
    if strategy not in ("auto", "rounds"):
        raise ValueError(f"unknown strategy {strategy!r}")
    with true_sizes(L.sparkSession):
        return _match(L, strategy, walk)


def _match(L: DataFrame, strategy: str, walk: int) -> MatchResult:
    if strategy == "auto":
        runs, cls = classify(_checkpoint(line_values(L)))
        cls = _checkpoint(cls)
    else:
        tagged, _, ext = prepare(L)
        cls = _checkpoint(ext.withColumn("path", F.lit("rounds")))
    parts, rounds = [], 0
    with few_broadcasts(L.sparkSession, cls.count()):
        if strategy == "auto":
            parts.append(chain_pieces(_checkpoint(runs), cls.where(F.col("path") == "chain").select(
                *KEYS, F.lit(0).cast("long").alias("alo"), F.col("la").alias("ahi"),
                F.lit(0).cast("long").alias("blo"), F.col("lb").alias("bhi"))))
        ext = cls.where(F.col("path") == "rounds").select(*KEYS, "la", "lb")
        files = ext.count()
        if files:
            if strategy == "auto":
                rest = ext.select(*KEYS)
                tagged = prepare(L.join(F.broadcast(rest) if files <= BROADCAST_ROWS else rest, KEYS, "left_semi"))[0]
            done, rounds = relational_rounds(_checkpoint(tagged), ext, walk)
            parts.append(done)
        # Blocks and gaps (one row each, far fewer than lines) are read by several
        # later steps: write them once.
        out = _union_all(parts)
        if out is None:
            out = L.sparkSession.createDataFrame([], PIECES_SCHEMA)
        return MatchResult(_checkpoint(out), rounds)
