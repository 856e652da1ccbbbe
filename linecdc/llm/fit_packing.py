"""Best-fit packing of documents into sequences by swap-based local search.

1. *Pieces.* Each Arrow batch is tokenised where it lies. A document's ids, with the
   end id behind them, are cut only if they are longer than a sequence: into whole
   sequences and a last piece.
2. *First groups.* A task gathers its pieces in groups of ``GROUP``, deals each group
   best fit in order of falling length, and improves it by local search: the emptiest
   bin gives, the others take. Moves are a document into a gap, one document for a
   shorter one, two for one and one for two; each raises the sum of squared fill, and
   one that empties the bin soonest is taken. The search ends when the bins are as few
   as a lower bound, or when no bin can give any more.
3. *Further levels.* Bins with a gap of more than ``SLACK`` tokens are open. They are
   kept whole, dealt by a hash into groups of about ``GROUP`` pieces of other tasks,
   and searched again, so leftovers of all tasks meet. It ends with one group, or when
   a level leaves most of its bins open as they were (bins that no document fits).

The text is read and tokenised once and not shuffled; only pieces of open bins are. A
task holds one group and one batch. Tables between levels are Parquet in the shared
folder, and a bin's number is its task's and its place there, so a task that is run
again writes the same. The input should be a stored table for that.

The words of a text are encoded once per worker, which keeps the last ones and
the runs without white space that they come in. Texts with characters of which libraries of other Unicode versions may differ (from U+0500 on) go through the
tokenizer whole. Long texts are encoded in slices of words.

Nulls and edge cases: a null or empty text is the end id alone; special tokens'
strings are ordinary text; repeated rows are each packed; a null doc_id stays null;
extra columns are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linecdc.session import scratch_path

CAPACITY, END_ID = 2048, 0
GROUP, SLACK = 16_384, 16
KNOWN, KEPT_CHARS = 500_000, 128  # words and runs that a worker keeps (at most twice as many), and their length
SLICE = 1_000_000  # characters from which a text is encoded in slices of words
SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, gap int"


class _Kept(dict):
    """A dict that makes what it lacks. It keeps the last ``KNOWN`` to twice as many
    short keys: when full, it starts anew and takes over what is asked for again."""

    def __init__(self, make: Callable[[str], bytes]):
        self.make, self.before = make, {}

    def __missing__(self, key: str) -> bytes:
        out = self.before.get(key)
        if out is None:
            out = self.make(key)
            if len(key) > KEPT_CHARS:
                return out
        if len(self) >= KNOWN:
            self.before = dict(self)
            self.clear()
        self[key] = out
        return out


class Words:
    """A tokenizer file's ids of whole texts. No token spans white space, so a text is
    split there, and a run without white space by the file's own pattern."""

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.odd = regex.compile(r"[\x1c-\x1f]")  # white space for str.split, not for the tokenizer
        self.other = regex.compile(r"[^\x00-\u04ff]")
        self.run = regex.compile(r"\S+")
        self.whole = Tokenizer.from_str(model)
        self.whole.encode_special_tokens = True
        one = Tokenizer.from_str(model)
        one.encode_special_tokens = True
        one.normalizer = normalizers.Sequence([])
        one.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        find = regex.compile(json.loads(model)["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall

        def make(run: str) -> bytes:
            if run.isalpha() or len(parts := find(run)) == 1:
                return array("I", one.encode(run, add_special_tokens=False).ids).tobytes()
            return b"".join(map(self.known.__getitem__, parts))

        self.known = _Kept(make)

    def _join(self, runs: list[str]) -> bytes:
        return b"".join(map(self.known.__getitem__, runs))

    def ids(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if text.isascii():
            text = text.lower()
        elif self.other.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        else:
            # The tokenizer lower-cases character by character, without Python's rule for a last sigma.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        if len(text) < SLICE:
            return self._join(self.run.findall(text) if self.odd.search(text) else text.split())
        found, out = (m.group() for m in self.run.finditer(text)), bytearray()
        while part := list(islice(found, SLICE // 8)):
            out += self._join(part)
        return bytes(out)


@lru_cache(maxsize=2)
def _words(model: str) -> Words:
    return Words(model)


def bound(sizes: np.ndarray, capacity: int) -> int:
    """A number of bins that no packing goes below: for every k, documents over
    capacity - k are alone, those over half have a bin each, and what is left of k
    or more has to go into the gaps of the latter."""
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=capacity + 1)[:capacity + 1]
    n, total = np.r_[np.cumsum(count[::-1])[::-1], 0], np.r_[np.cumsum((count * np.arange(capacity + 1))[::-1])[::-1], 0]
    k = np.arange(capacity // 2 + 1)
    alone, half = n[capacity - k + 1], n[capacity // 2 + 1]
    middle, room = total[capacity // 2 + 1] - total[capacity - k + 1], (half - alone) * capacity
    small = total[k] - total[capacity // 2 + 1]
    return int((half + np.maximum(0, -(-(small - (room - middle)) // capacity))).max())


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each document: longest first, into the bin that it leaves fullest."""
    of = np.empty(len(sizes), np.int64)
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    there, bins = 0, 0  # bit g: a bin with gap g
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fit = there >> s
        if fit:
            gap = s + (fit & -fit).bit_length() - 1
            b = by_gap[gap].pop()
            if not by_gap[gap]:
                there ^= 1 << gap
        else:
            gap, b, bins = capacity, bins, bins + 1
        of[i] = b
        if gap - s:
            by_gap[gap - s].append(b)
            there |= 1 << (gap - s)
    return of


def improve(sizes: np.ndarray, of: np.ndarray, capacity: int) -> np.ndarray:
    """Local search from a packing: bins of documents with as many bins or fewer."""
    of = of.copy()
    n = int(of.max()) + 1 if len(of) else 0
    gap = capacity - np.bincount(of, sizes, n).astype(np.int64)
    used, least = len(np.unique(of)), bound(sizes, capacity)
    while used > least:
        # One pass over the bins, emptiest first; documents in full bins are out of it.
        item = np.flatnonzero(gap[of] > 0)
        size, own = sizes[item], of[item]
        givers = np.unique(own)
        first, gave = used, False
        for a in givers[np.argsort(-gap[givers], kind="stable")].tolist():
            while used > least:
                mine = np.flatnonzero(own == a)
                if not len(mine):
                    used -= 1
                    break
                done = _exchange(size, own, gap, a, mine, capacity)
                if not done:
                    break
                gave = True
            of[item] = own
            if used <= least:
                break
        if used == first or not gave:  # a whole pass emptied nothing
            break
    return of


def _exchange(size: np.ndarray, own: np.ndarray, gap: np.ndarray, a: int, mine: np.ndarray, capacity: int) -> bool:
    """One step that takes documents (``mine``) out of bin ``a``, if there is one."""
    room = gap[own]
    room = np.where(own == a, -1, room)
    # Move: the longest document that fits, into the least gap that takes it.
    for x in mine[np.argsort(-size[mine], kind="stable")].tolist():
        fit = np.flatnonzero(room >= size[x])
        if len(fit):
            to = int(own[fit[room[fit].argmin()]])
            gap[to] -= size[x]
            gap[a] += size[x]
            own[x] = to
            return True
    best, pick = 0, None

    def offer(xs: tuple[int, ...], give: int) -> None:
        """``give`` tokens of bin a for one shorter document of a bin that then has room
        and ends fuller than bin a was: squared fill rises."""
        nonlocal best, pick
        ok = np.flatnonzero((size < give) & (size + room >= give) & (room - (give - size) < gap[a]) & (room >= 0))
        if len(ok):
            y = int(ok[size[ok].argmin()])
            if give - size[y] > best:
                best, pick = int(give - size[y]), (xs, (y,))

    few = mine[np.argsort(-size[mine], kind="stable")][:64]  # the longest; the others are moved in their turn
    for x in few.tolist():
        offer((x,), int(size[x]))
    for x, z in combinations(few[:12].tolist(), 2):
        offer((x, z), int(size[x] + size[z]))
    # One for two: neighbours in the list of a bin.
    order = np.argsort(own, kind="stable")
    pair = np.flatnonzero(own[order[:-1]] == own[order[1:]])
    y, z = order[pair], order[pair + 1]
    both, space = size[y] + size[z], room[y]
    for x in few.tolist():
        s = int(size[x])
        ok = np.flatnonzero((both < s) & (both + space >= s) & (space - (s - both) < gap[a]) & (space >= 0))
        if len(ok):
            i = int(ok[both[ok].argmin()])
            if s - both[i] > best:
                best, pick = int(s - both[i]), ((x,), (int(y[i]), int(z[i])))
    if pick is None:
        return False
    b = int(own[pick[1][0]])
    own[list(pick[0])], own[list(pick[1])] = b, a
    gap[a] += best
    gap[b] -= best
    return True


def _place(sizes: np.ndarray, of: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Offset of each document in its bin (in order of the documents), and the bin's gap."""
    order = np.argsort(of, kind="stable")
    ends = np.cumsum(sizes[order])
    first = np.r_[True, np.diff(of[order]) > 0] if len(of) else np.empty(0, bool)
    base = (ends - sizes[order])[first][np.cumsum(first) - 1] if len(of) else ends
    offset = np.empty(len(of), np.int64)
    offset[order] = ends - sizes[order] - base
    fill = np.bincount(of, sizes).astype(np.int64) if len(of) else np.empty(0, np.int64)
    return offset, capacity - fill[of]


NAMES = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "gap"]
TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]


def _rows(pieces: list[tuple], of: np.ndarray, ids: np.ndarray, capacity: int) -> pa.RecordBatch:
    """Rows of pieces (doc_id, piece, start, length, crc) in bins ``of`` numbered ``ids``."""
    cols = list(zip(*pieces))
    offset, gap = _place(np.array(cols[3], np.int64), of, capacity)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*cols, ids[of], offset, gap], TYPES)], names=NAMES)


def _first_groups(model, capacity: int, end_id: int, group: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, end = _words(model.value), np.array([end_id], "<u4").tobytes()
        bins = TaskContext.get().partitionId() << 40  # the next bin's number
        waiting: list[tuple] = []
        for batch in batches:
            whole = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = words.ids(text.as_py() or "") + end
                n = len(raw) // 4
                for k, at in enumerate(range(0, n, capacity)):
                    size = min(capacity, n - at)
                    row = (doc, k, at, size, zlib.crc32(memoryview(raw)[4 * at:4 * (at + size)]))
                    (whole if size == capacity else waiting).append(row)
            if whole:
                yield _rows(whole, np.arange(len(whole)), np.arange(bins, bins + len(whole)), capacity)
                bins += len(whole)
            while len(waiting) >= group:
                part, waiting = waiting[:group], waiting[group:]
                yield (out := _packed(part, bins, capacity))[0]
                bins += out[1]
        if waiting:
            yield _packed(waiting, bins, capacity)[0]
    return run


def _packed(pieces: list[tuple], bins: int, capacity: int) -> tuple[pa.RecordBatch, int]:
    sizes = np.array([p[3] for p in pieces], np.int64)
    of = improve(sizes, best_fit(sizes, capacity), capacity)
    _, of = np.unique(of, return_inverse=True)
    n = int(of.max()) + 1
    return _rows(pieces, of, np.arange(bins, bins + n), capacity), n


def _again(capacity: int) -> Callable:
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.select(NAMES).combine_chunks().sort_by([(c, "ascending") for c in ("sequence_id", "offset")])
        sizes = rows["length"].to_numpy()
        ids, of = np.unique(rows["sequence_id"].to_numpy(), return_inverse=True)
        of = improve(sizes, of, capacity)
        offset, gap = _place(sizes, of, capacity)
        return pa.table([*(rows[c] for c in NAMES[:5]), *(pa.array(c, t) for c, t in zip([ids[of], offset, gap], TYPES[5:]))],
                        names=NAMES)
    return run


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, group: int = GROUP,
         slack: int = SLACK) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset, gap) of (doc_id, text)
    with the tokenizer file at ``path``; ``gap`` is what the sequence has left."""
    spark = docs.sparkSession
    with open(path, encoding="utf-8") as f:
        model = spark.sparkContext.broadcast(f.read())  # a file of a few MB, whatever the table
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    root, level, most = scratch_path(spark, "packing"), 0, None
    rows.mapInArrow(_first_groups(model, capacity, end_id, group), SCHEMA).write.parquet(f"{root}/0")
    out = None
    while True:
        at = spark.read.parquet(f"{root}/{level}")
        open_rows = at.where(F.col("gap") > slack)
        n = open_rows.count()
        last = n == 0 or (most is not None and (most[0] == 1 or n > 0.7 * most[1]))
        done = at if last else at.where(F.col("gap") <= slack)
        out = done if out is None else out.unionByName(done)
        if last:
            return out
        groups = -(-n // group)
        key = F.pmod(F.xxhash64("sequence_id", F.lit(level)), F.lit(groups)).alias("g")
        level, most = level + 1, (groups, n)
        (open_rows.select(key, *NAMES).groupBy("g").applyInArrow(_again(capacity), SCHEMA)
         .write.parquet(f"{root}/{level}"))


def op13_query(documents: DataFrame) -> DataFrame:
    import public_tokenizers as P

    return pack(documents.select("doc_id", "text"), P.path("word_bpe_49k.json")).drop("gap")
