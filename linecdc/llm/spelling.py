"""Spelling variant grouping: dynamic programming over sorted lists.

1. *Words.* Runs of letters are counted by a map-side combined aggregation; words of
   ``min_length`` or more with ``min_count`` or more are the vocabulary, sorted and
   numbered in that order by a range partitioning (so a smaller number is a smaller word).
2. *Lists.* Two words one edit apart share what is before and after the edit. Let m be
   the shorter length: the places 0 .. m - 1 are cut into ``SEGMENTS``, and a word goes,
   for its own length and for one less, into one list per segment: the words with the
   same letters before and after the segment. What it has inside is its gap. A pair is
   found in the list of the segment where its first difference lies, and in no other.
3. *Scan.* Lists are dealt by key and sorted by gap, so neighbours share prefixes. The
   edit matrix of a word against a list is banded (one cell on either side of the
   diagonal is enough for one edit). A row belongs to a prefix: all gaps with that
   prefix use the row computed once, and children of the prefix start from it. The
   starts of prefixes are where the LCP of neighbours is shorter than the depth. When
   all cells of a row pass one edit, the whole range of that prefix is left. The scan goes
   depth by depth, for all lists and words of a chunk at once, in numpy.
4. *Hot lists.* A list with more than ``MOST`` gaps is not scanned: its rows leave again
   and go into the lists of the two halves of its segment, until it fits. A segment of
   one place has at most 90 + 90^2 gaps (the alphabet has 90 letters), which is less than
   ``MOST``, so every list ends up scanned and no task holds more than a chunk.
5. *Forms.* Pairs are summed to the count of near words and the near word of largest
   n; roots by pointer doubling: n grows tenfold with every form, so a chain has at most
   log10(n) links, and the number of joins is known beforehand.

Nulls and edge cases: a null text has no runs; a null doc_id counts as the empty
text before the colon; repeated rows count each; ties of n go to the smaller word;
words may be of any length; an empty table, or one without words, gives no rows; extra
columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linecdc.llm.common import shuffle_parts
from linecdc.session import materialize, scratch_path

LETTERS = "A-Za-z\\u00C0-\\u00FF"  # after lower-casing A-Z: 26 + 64 letters
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_LENGTH, MIN_COUNT, DROP_EVERY, TIMES = 7, 2, 31, 10
SEGMENTS, MOST = 3, 8192
CHUNK, STATES = 65_536, 400_000  # rows scanned at once, and states of the scan
LISTS = "m int, lo int, hi int, key string, gap string, wid long, n long"


def words(docs: DataFrame, min_length: int = MIN_LENGTH, every: int = DROP_EVERY) -> DataFrame:
    """One row per word of ``min_length`` or more in (doc_id, text), spelled as the rule says."""
    runs = F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{min_length},}}"), F.lit(0))
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.select(doc.alias("doc"), F.explode(runs).alias("run")).select("doc", F.translate("run", UPPER, LOWER).alias("run"))
    h = F.crc32(F.concat_ws(":", "doc", "run").cast("binary"))
    rows = rows.select("run", h.alias("h"), F.char_length("run").alias("len"))
    at = (F.col("h") % F.col("len")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.col("len")))
    word = F.when(F.col("h") % every == 0, cut).otherwise(F.col("run"))
    return rows.select(word.alias("word")).where(F.char_length("word") >= min_length)


def vocabulary(rows: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """(wid, word, n) of (word): numbers rise with the words' order."""
    counted = rows.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)
    counted = materialize(counted, "word-counts")
    ordered = counted.repartitionByRange(shuffle_parts(rows.sparkSession), "word").sortWithinPartitions("word")
    return materialize(ordered.select(F.monotonically_increasing_id().alias("wid"), "word", "n"), "vocabulary")


def _in_list(lo: Column, hi: Column, m: Column) -> list[Column]:
    """Key and gap of ``word`` in the list of places lo .. hi - 1 for shorter length m."""
    size = F.char_length("word")
    inner = size - (m - hi) - lo
    before, after = F.substring(F.col("word"), F.lit(1), lo), F.substring(F.col("word"), lo + inner + 1, m - hi)
    return [F.concat(before, after).alias("key"), F.substring(F.col("word"), lo + 1, inner).alias("gap")]


def lists(vocab: DataFrame) -> DataFrame:
    """Every word in its first lists."""
    size = F.char_length("word")
    rows = vocab.select("wid", "word", "n", F.explode(F.array(size, size - 1)).alias("m"))
    rows = rows.select("*", F.explode(F.array(*map(F.lit, range(SEGMENTS)))).alias("s"))
    cut = lambda i: F.floor(F.col("m") * i / SEGMENTS).cast("int")
    rows = rows.select("wid", "word", "n", "m", cut(F.col("s")).alias("lo"), cut(F.col("s") + 1).alias("hi"))
    rows = rows.where(F.col("hi") > F.col("lo"))
    return rows.select("m", "lo", "hi", *_in_list(F.col("lo"), F.col("hi"), F.col("m")), "wid", "n")


def halved(hot: DataFrame) -> DataFrame:
    """Rows of hot lists in the lists of both halves of their segments."""
    word = F.concat(F.substring(F.col("key"), F.lit(1), F.col("lo")), F.col("gap"),
                    F.substring(F.col("key"), F.col("lo") + 1, F.col("m") - F.col("hi")))
    mid = ((F.col("lo") + F.col("hi")) / 2).cast("int")
    halves = F.array(F.struct(F.col("lo").alias("lo"), mid.alias("hi")), F.struct(mid.alias("lo"), F.col("hi").alias("hi")))
    rows = hot.select("wid", "n", "m", word.alias("word"), F.explode(halves).alias("s"))
    rows = rows.select("wid", "n", "m", "word", F.col("s.lo").alias("lo"), F.col("s.hi").alias("hi"))
    return rows.select("m", "lo", "hi", *_in_list(F.col("lo"), F.col("hi"), F.col("m")), "wid", "n")


def one_edit(gaps: list[str], group: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (word, other) of row numbers whose gaps are one edit apart, in the same
    group: the word's gap has the group's length g, the other's has g or g + 1 letters.
    Rows are sorted by group, then gap; gaps of a group are distinct."""
    size = np.fromiter(map(len, gaps), np.int64, len(gaps))
    flat = np.frombuffer("".join(gaps).encode("utf-32-le"), np.uint32)
    start = np.cumsum(size) - size
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    end_of = np.r_[first[1:], len(gaps)][np.cumsum(np.r_[True, group[1:] != group[:-1]]) - 1]
    first_of = first[np.cumsum(np.r_[True, group[1:] != group[:-1]]) - 1]
    lcp = _lcp(flat, start, size, group)
    asking = np.flatnonzero((size == g) & (end_of - first_of > 1))
    out = _scan(asking, flat, start, size, g, lcp, first_of, end_of) if len(asking) else []
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*out))


def _lcp(flat: np.ndarray, start: np.ndarray, size: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Letters that each gap shares with the one before it; -1 at a group's first."""
    lcp = np.zeros(len(size), np.int64)
    lcp[0] = -1
    lcp[1:][group[1:] != group[:-1]] = -1
    live, d = np.flatnonzero(lcp == 0), 0
    while len(live):
        live = live[(size[live] > d) & (size[live - 1] > d)]
        live = live[flat[start[live] + d] == flat[start[live - 1] + d]]
        d += 1
        lcp[live] = d
    return lcp


def _scan(asking, flat, start, size, g, lcp, first_of, end_of) -> list[tuple[np.ndarray, np.ndarray]]:
    """The words ``asking`` against their lists, depth by depth. A state is a word, the
    range of gaps with the same first d letters, and the row's cells d - 1, d, d + 1.
    States that would lead to more than ``STATES`` at once are taken one half after the other."""
    row = np.empty((len(asking), 3), np.int8)
    row[:] = (9, 0, 1)
    todo, out = [(asking, first_of[asking], end_of[asking], row, 0, np.arange(len(size)))], []
    while todo:
        q, low, high, row, d, live = todo.pop()
        while len(q):
            live = live[size[live] > d]  # gaps with a letter at d
            heads = live[lcp[live] <= d]  # the first gap of every longer prefix
            a = np.searchsorted(heads, low)
            n = np.searchsorted(heads, high) - a
            upto = np.cumsum(n)
            if upto[-1] > STATES and len(q) > 1:
                h = min(max(1, int(np.searchsorted(upto, upto[-1] // 2))), len(q) - 1)
                todo.append((q[h:], low[h:], high[h:], row[h:], d, live))
                q, low, high, row = q[:h], low[:h], high[:h], row[:h]
                continue
            if not upto[-1]:
                break
            pick = np.repeat(np.arange(len(q)), n)
            child = a[pick] + np.arange(len(pick)) - (upto - n)[pick]
            here, asked, old = heads[child], q[pick], row[pick]
            stop = np.minimum(np.r_[heads, len(size)][child + 1], high[pick])
            x, length, base = flat[start[here] + d], g[asked], start[asked]
            letter = lambda j: flat[base + np.clip(j, 0, length - 1)]  # noqa: E731  (cells outside are never below 2)
            new = np.empty((len(pick), 3), np.int8)
            new[:, 0] = np.minimum(old[:, 0] + (letter(d - 1) != x), old[:, 1] + 1)
            new[:, 1] = np.minimum(np.minimum(old[:, 1] + (letter(d) != x), old[:, 2] + 1), new[:, 0] + 1)
            new[:, 2] = np.minimum(old[:, 2] + (letter(d + 1) != x), new[:, 1] + 1)
            for k in range(3):
                new[d + k > length, k] = 9
            d += 1
            keep = new.min(1) <= 1
            q, low, high, row = asked[keep], here[keep], stop[keep], new[keep]
            # A gap that ends here is the first of its range (gaps are distinct).
            done = (size[low] == d) & ((g[q] == d) & (row[:, 1] == 1) | (g[q] == d - 1) & (row[:, 0] == 1))
            if done.any():
                out.append((q[done], low[done]))
    return out


def _pairs() -> Callable:
    """Rows sorted by list and gap become pairs (wid, n, other, other_n); rows of hot
    lists leave as they came."""
    names = ["m", "lo", "hi", "key", "gap", "wid", "n", "other", "other_n"]

    def emit(t: pa.Table) -> pa.RecordBatch | None:
        m, lo, hi, wid, n = (t[c].to_numpy() for c in ("m", "lo", "hi", "wid", "n"))
        gaps = t["gap"].to_pylist()
        a, b = one_edit(gaps, np.cumsum(_new_list(t)), (hi - lo).astype(np.int64))
        # Words of one length meet from both sides: once is enough. A pair that differs
        # only behind the gap belongs to the next segment.
        ok = [i < j if len(gaps[i]) == len(gaps[j]) else hi[i] == m[i] or not gaps[j].startswith(gaps[i]) for i, j in zip(a, b)]
        a, b = a[np.array(ok, bool)], b[np.array(ok, bool)]
        if not len(a):
            return None
        none = lambda kind: pa.nulls(len(a), kind)
        return pa.RecordBatch.from_arrays([none(pa.int32())] * 3 + [none(pa.string())] * 2 + [
            pa.array(c, pa.int64()) for c in (wid[a], n[a], wid[b], n[b])], names=names)

    def hot(rows: pa.RecordBatch) -> pa.RecordBatch:
        none = pa.nulls(rows.num_rows, pa.int64())
        return pa.RecordBatch.from_arrays([*(rows.column(c) for c in names[:7]), none, none], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, passing = [], 0, None  # whole lists and the begun one; the hot list that passes through
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            first = _list_of(t, 0)
            starts = np.flatnonzero(_new_list(t))
            if passing is not None:
                same = first == passing
                upto = (int(starts[1]) if len(starts) > 1 else batch.num_rows) if same else 0
                if upto:
                    yield hot(batch.slice(0, upto))
                if upto == batch.num_rows:
                    continue
                passing, batch = None, batch.slice(upto)
            held.append(batch)
            count += batch.num_rows
            if count < CHUNK:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            last = int(np.flatnonzero(_new_list(t))[-1])
            for out in _split(t.slice(0, last), emit, hot):
                yield out
            rest = t.slice(last).combine_chunks()
            held, count = rest.to_batches(), rest.num_rows
            if count > MOST:  # the begun list is hot already
                passing = _list_of(rest, 0)
                for b in held:
                    yield hot(b)
                held, count = [], 0
        if held:
            yield from _split(pa.Table.from_batches(held).combine_chunks(), emit, hot)
    return run


def _list_of(t: pa.Table, i: int) -> tuple:
    return tuple(t[c][i].as_py() for c in ("m", "lo", "hi", "key"))


def _new_list(t: pa.Table) -> np.ndarray:
    """Where a row's list is another than the row's before."""
    import pyarrow.compute as pc

    new = np.zeros(t.num_rows, bool)
    new[:1] = True
    for c in ("m", "lo", "hi", "key"):
        col = t[c].combine_chunks()
        new[1:] |= pc.not_equal(col.slice(1), col.slice(0, len(col) - 1)).to_numpy(zero_copy_only=False) if len(col) else False
    return new


def _split(t: pa.Table, emit: Callable, hot: Callable) -> Iterator[pa.RecordBatch]:
    """Scans the lists of ``t``; rows of those with more than ``MOST`` gaps pass."""
    if not t.num_rows:
        return
    starts = np.flatnonzero(_new_list(t))
    sizes = np.diff(np.r_[starts, t.num_rows])
    big = np.repeat(sizes > MOST, sizes)
    if big.any():
        yield from map(hot, t.filter(pa.array(big)).to_batches())
        t = t.filter(pa.array(~big)).combine_chunks()
    if t.num_rows and (out := emit(t)) is not None:
        yield out


def near_pairs(vocab: DataFrame) -> DataFrame:
    """(wid, n, other, other_n): every two words that are one edit apart, once."""
    spark = vocab.sparkSession
    rows, out, root = lists(vocab), None, scratch_path(spark, "near-words")
    schema = LISTS + ", other long, other_n long"
    for level in range(64):  # a segment halves each time, and a text has fewer than 2^31 letters
        dealt = rows.repartition("m", "lo", "hi", "key").sortWithinPartitions("m", "lo", "hi", "key", "gap")
        dealt.mapInArrow(_pairs(), schema).write.parquet(f"{root}/{level}")
        done = spark.read.parquet(f"{root}/{level}")
        pairs = done.where(F.col("other").isNotNull()).select("wid", "n", "other", "other_n")
        out = pairs if out is None else out.unionByName(pairs)
        hot = done.where(F.col("other").isNull()).drop("other", "other_n")
        if hot.isEmpty():
            return out
        rows = halved(hot)
    raise AssertionError("a list did not halve")


def group(vocab: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of (wid, word, n)."""
    pairs = near_pairs(vocab)
    both = pairs.select("wid", "other", F.col("other_n").alias("on")).unionByName(
        pairs.select(F.col("other").alias("wid"), F.col("wid").alias("other"), F.col("n").alias("on")))
    near = both.groupBy("wid").agg(F.count("*").alias("n_near"), F.max(F.struct("on", -F.col("other"))).alias("best"))
    near = near.select("wid", "n_near", F.col("best.on").alias("on"), (-F.col("best.col2")).alias("other"))
    with_near = materialize(vocab.join(near, "wid", "left"), "near")
    is_form = F.col("on") >= times * F.col("n")
    forms = materialize(with_near.where(is_form).select("wid", F.col("other").alias("to")), "forms")
    most = with_near.agg(F.max("n")).first()[0]
    links = int(math.log(max(most or 1, 1), times)) + 1  # n of a form is `times` its word's at least
    roots = forms
    for _ in range(max(0, links - 1).bit_length()):
        step = roots.select(F.col("wid").alias("to"), F.col("to").alias("next"))
        roots = materialize(roots.join(step, "to", "left").select("wid", F.coalesce("next", "to").alias("to")), "roots")
    spell = lambda name, key: vocab.select(F.col("wid").alias(key), F.col("word").alias(name))
    linked = (forms.withColumnRenamed("to", "f").join(roots.withColumnRenamed("to", "r"), "wid")
              .join(spell("form", "f"), "f").join(spell("root", "r"), "r").select("wid", "form", "root"))
    return with_near.join(linked, "wid", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("form").isNotNull(), F.col("on")).alias("form_n"))


def op11_query(documents: DataFrame) -> DataFrame:
    return group(vocabulary(words(documents.select("doc_id", F.col("text").cast("string").alias("text")))))


OP11_SQL = f"""
with recursive tbl as (select list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda a, b: case when a & 1 = 1 then xor(3988292384, a >> 1) else a >> 1 end)) t),
runs as (select coalesce(cast(doc_id as varchar), '') d, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{{MIN_LENGTH},}}')),
    '{UPPER}', '{LOWER}') run from documents),
per as (select d, run, count(*) k, hex(encode(d || ':' || run)) h from runs group by d, run),
crc as (select run, k, xor(list_reduce(list_prepend(4294967295,
    list_transform(range(length(h) // 2), lambda i: cast('0x' || substr(h, 2 * i + 1, 2) as bigint))),
    lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) c from per, tbl),
spelled as (select case when c % {DROP_EVERY} = 0 then substr(run, 1, c % length(run)) || substr(run, c % length(run) + 2) else run end word, k
    from crc),
vocab as materialized (select word, cast(sum(k) as bigint) n from spelled where length(word) >= {MIN_LENGTH}
    group by word having sum(k) >= {MIN_COUNT}),
less as materialized (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) cut
    from (select word, n, unnest(range(1, length(word) + 1)) i from vocab)),
pairs as (select a.word, b.word other, b.n from less a join less b on a.cut = b.cut and a.i = b.i and a.word <> b.word
    union select l.word, v.word, v.n from less l join vocab v on l.cut = v.word
    union select v.word, l.word, l.n from less l join vocab v on l.cut = v.word),
near as (select word, count(*) n_near, max(n) most, min(other) filter (where n = m) best
    from (select *, max(n) over (partition by word) m from pairs) group by word),
forms as materialized (select word, v.n, n_near, case when most >= {TIMES} * v.n then best end form, case when most >= {TIMES} * v.n then most end form_n
    from vocab v left join near using (word)),
walk as (select word, word here, 0 steps from forms
    union all select w.word, f.form, steps + 1 from walk w join forms f on w.here = f.word where f.form is not null)
select word, form, (select arg_max(here, steps) from walk w where w.word = forms.word) root, n,
    cast(coalesce(n_near, 0) as bigint) n_near, form_n from forms"""
