"""N-gram Jaccard join by chosen paths.

A document is the set of its runs of ``NGRAM`` words (lower-cased; a shorter text
is one run). Documents with equal sets are one member with a count.

1. *Chosen paths.* In each of a number of runs a set picks tokens at random, but
   by hashes that all sets share: token t of x is picked at node p if
   ``h(p, t) < 1 / (threshold * |x|)``, about 1.25 of them; each pick leads to a
   child node, where the set picks again. Two sets over the threshold share at
   least one pick per node on average, others share few. A node that one set
   reaches alone is dropped; one with up to ``LEAF`` sets is a leaf; larger ones
   split again, down to ``DEPTH``, but for those whose children would hold the same
   sets again (near copies): they are leaves too. ``runs_for`` gives the runs for a target recall.
2. *Candidates.* In a leaf all pairs are compared by their sketches (64 minima of
   16 bits each) and the connected ones go on. A leaf that is large is cut into
   blocks, and all pairs of blocks are compared.
3. *Brute force.* Components of candidates are the buckets in which all pairs are
   compared exactly, over whole sets, by a product of 0/1 matrices; large ones
   again in pairs of blocks. Each set is shuffled once (times its bucket's blocks).
   Each pair lies in one bucket, so links are counted once, and only sums and
   spanning trees leave a task, never the pairs.
4. Components of the exact links are the classes.

Results: one row per input row: doc_id, class_id (the least doc_id of its
class) and n_links, the number of other rows with a similarity over the threshold,
copies included. An exact link can be missed only if no run brings its two sets
together (probability at most 1 - target) or the sketch is off by four standard
deviations.

Nulls and edge cases: a null text is the empty text; texts without a word have no
token and link only to rows with the same text; rows that repeat an id count as
copies; a null doc_id takes part like any other value of doc_id and is the class
id only if all of its class are null; extra columns are not looked at; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linecdc.llm.components import components
from linecdc.session import materialize

NGRAM, THRESHOLD = 5, 0.8
TARGET, DEPTH, LEAF = 0.999, 3, 512
SOME = 16  # one member in so many tells whether a large node divides
BLOCK, BLOCK_TOKENS = 1024, 2_000_000  # members and tokens of a block in pairwise comparisons
SKETCH = 64
SLICE = 1 << 20  # characters hashed at once
BROADCAST_ROWS = 500_000  # candidates (about 50 bytes each) up to which they go to the texts

_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _stream(seed: int, n: int) -> np.ndarray:
    return mix(_U(seed) + np.arange(1, n + 1, dtype=_U) * _ODD)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point -> random number of its lower-case letter or digit; 0 for others."""
    low = np.zeros(0x110000, np.uint64)
    for c in range(0x110000):
        s = chr(c)
        if s.isalnum() or s == "_":
            low[c] = ord(s.lower()[0])
    return np.where(low > 0, mix(low * _ODD + _U(1)) | _U(1), _U(0))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    p = 0xD1342543DE82EF95
    inverse = pow(p, -1, 1 << 64)
    up = lambda b: np.cumprod(np.r_[_U(1), np.full(n, b, np.uint64)], dtype=np.uint64)
    return up(_U(p)), up(_U(inverse))


def word_hashes(texts: list[str]) -> list[np.ndarray]:
    """64-bit hashes of the words of each text."""
    joined = "\n".join(texts) + "\n"
    c = _letters()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    power, inverse = _powers(1 << max(20, len(c).bit_length()))
    upto = np.r_[_U(0), np.cumsum(c * power[:len(c)], dtype=np.uint64)]
    is_word = np.r_[False, c != 0, False]
    start = np.flatnonzero(is_word[1:] & ~is_word[:-1])
    end = np.flatnonzero(~is_word[1:] & is_word[:-1])
    h = mix((upto[end] - upto[start]) * inverse[start])
    cuts = np.cumsum([len(t) + 1 for t in texts])
    return np.split(h, np.searchsorted(start, cuts[:-1]))


def tokens_of(words: np.ndarray, n: int = NGRAM) -> np.ndarray:
    """The sorted distinct hashes of a text's word runs."""
    k = len(words)
    if not k:
        return np.empty(0, np.uint64)
    m = min(n, k)
    odd = _stream(11, n) | _U(1)
    h = np.full(k - m + 1, mix(np.array([m], np.uint64))[0], np.uint64)
    for i in range(m):
        h += words[i:k - m + 1 + i] * odd[i]
    return np.unique(mix(h))


def token_sets(texts: list[str | None], n: int = NGRAM) -> Iterator[np.ndarray]:
    """Token set of each text; texts are hashed in slices of about SLICE characters."""
    part: list[str] = []
    size = 0
    for t in texts:
        part.append(t or "")
        size += len(part[-1]) + 1
        if size >= SLICE:
            yield from (tokens_of(w, n) for w in word_hashes(part))
            part, size = [], 0
    if part:
        yield from (tokens_of(w, n) for w in word_hashes(part))


def set_id(tokens: np.ndarray, text: str | None) -> bytes:
    """128 bits, equal for equal sets (or, without tokens, equal texts)."""
    if not len(tokens):
        return hashlib.md5((text or "").encode("utf-8", "surrogatepass")).digest()
    a, b = mix(tokens ^ _U(0x5851F42D4C957F2D)).sum(dtype=np.uint64), mix(tokens * _ODD).sum(dtype=np.uint64)
    return np.array([a, b]).tobytes()


def sketch_of(tokens: np.ndarray, k: int = SKETCH) -> np.ndarray:
    least = np.full(k, ~_U(0), np.uint64)
    mult = _stream(23, k) | _U(1)
    for at in range(0, len(tokens), 4096):
        least = np.minimum(least, (tokens[at:at + 4096, None] * mult[None]).min(0))
    return (mix(least) >> _U(48)).astype(np.uint16)


def share(depth: int) -> float:
    """Least chance that one run brings two sets at the threshold together at ``depth``:
    survival of a branching process with one child on average, as where one set holds
    the other (sets of equal size share 2 / (1 + threshold) picks)."""
    gone = 0.0
    for _ in range(depth):
        gone = math.exp(gone - 1)
    return 1 - gone


def runs_for(target: float, depth: int = DEPTH) -> int:
    return math.ceil(math.log(1 - target) / math.log(1 - share(depth)))


def _picks(tokens: np.ndarray, nodes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(index of node, child node) of all picks of a set at the given nodes."""
    limit = _U(min(2**64 - 1, int(2.0**64 / (threshold * len(tokens)))))
    up, child = [], []
    step = max(1, 1_000_000 // len(tokens))
    for at in range(0, len(nodes), step):
        part = nodes[at:at + step]
        h = (tokens[None] ^ part[:, None]) * _U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> _U(32))) * _U(0x94D049BB133111EB)
        i, j = np.nonzero(h < limit)
        up.append(i + at)
        child.append(mix(part[i] * _ODD + tokens[j]))
    return np.concatenate(up), np.concatenate(child)


def paths_of(tokens: np.ndarray, runs: int, threshold: float, depth: int = DEPTH) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each depth: (parent node, node) of every path of the set."""
    nodes = _stream(37, runs)
    out = []
    for _ in range(depth):
        if not len(nodes) or not len(tokens):
            out.append((np.empty(0, np.uint64),) * 2)
            continue
        up, child = _picks(tokens, nodes, threshold)
        out.append((nodes[up], child))
        nodes = child
    return out


SIGNED = ("doc_id long, h long, sid binary, n int, sketch binary, "
          "paths array<struct<depth:int,up:bigint,node:bigint>>")


def _sign(runs: int, threshold: float, n: int, depth: int) -> Callable:
    path_type = pa.struct([("depth", pa.int32()), ("up", pa.int64()), ("node", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                texts = batch.column(1).to_pylist()
                sids, sizes, sketches, length, flat = [], [], [], [0], []
                for t, tok in zip(texts, token_sets(texts, n)):
                    sids.append(set_id(tok, t))
                    sizes.append(len(tok))
                    sketches.append(sketch_of(tok).tobytes() if len(tok) else b"")
                    levels = paths_of(tok, runs, threshold, depth) if len(tok) else []
                    flat += [(d, up, node) for d, (up, node) in enumerate(levels, 1)]
                    length.append(length[-1] + sum(len(x[1]) for x in levels))
                depths = np.repeat([x[0] for x in flat], [len(x[1]) for x in flat]).astype(np.int32) if flat else np.empty(0, np.int32)
                col = lambda i: np.concatenate([x[i] for x in flat]).view(np.int64) if flat else np.empty(0, np.int64)  # noqa: E731,B023
                values = pa.StructArray.from_arrays([pa.array(depths), pa.array(col(1)), pa.array(col(2))], fields=list(path_type))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.array(sids, pa.binary()), pa.array(sizes, pa.int32()), pa.array(sketches, pa.binary()),
                     pa.ListArray.from_arrays(pa.array(length, pa.int32()), values)],
                    names=["doc_id", "h", "sid", "n", "sketch", "paths"])
    return run


def cohesive(deeper: DataFrame, large: DataFrame) -> DataFrame:
    """(node) of large nodes that a split would not divide, as in a group of near copies:
    of the picks of their members (one in ``SOME``, by a hash; the finding decides on the
    way only), four in five go to children that hold at least half of the members."""
    some = deeper.where(F.pmod(F.xxhash64("sid"), F.lit(SOME)) == 0).select("sid", F.col("up").alias("of"), "node")
    kids = some.join(large.select(F.col("node").alias("of"), "size"), "of").groupBy("of", "size", "node").agg(F.count("*").alias("n"))
    held = F.sum(F.when(2 * SOME * F.col("n") >= F.col("size"), F.col("n")).otherwise(0))
    return kids.groupBy("of").agg((held >= 0.8 * F.sum("n")).alias("alike")).where("alike").select(F.col("of").alias("node"))


def leaves(members: DataFrame, depth: int = DEPTH, leaf: int = LEAF) -> DataFrame:
    """(node, size, sid) of all leaves with at least two members."""
    paths = members.select("sid", F.explode("paths").alias("p")).select("sid", "p.*")
    found, above = [], None
    for d in range(1, depth + 1):
        here = paths.where(F.col("depth") == d)
        if above is not None:
            here = here.join(above, "up", "left_semi")
        # Sets that reach a node twice (by hash collision) count once.
        here = here.select("sid", "node").distinct()
        if d > 1:  # few by now, and read twice
            here = materialize(here, "path-nodes")
        size = materialize(here.groupBy("node").agg(F.count("*").alias("size")).where(F.col("size") > 1), "path-sizes")
        ends = size
        if d < depth:
            large = size.where(F.col("size") > leaf)
            alike = materialize(cohesive(paths.where(F.col("depth") == d + 1), large), "path-alike")
            above = large.join(alike, "node", "left_anti").select(F.col("node").alias("up"))
            ends = size.join(above, size["node"] == above["up"], "left_anti")
        found.append(here.join(ends, "node"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 1) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by ``keys``: one or more groups
    each, at least ``rows`` rows together (the last may have fewer)."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n < rows:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        change = np.zeros(t.num_rows - 1, bool)
        for k in keys:
            c = t[k].to_numpy()
            change |= c[1:] != c[:-1]
        at = np.flatnonzero(change)
        if not len(at):
            held = t.to_batches()
            continue
        yield t.slice(0, at[-1] + 1)
        held = t.slice(at[-1] + 1).combine_chunks().to_batches()
        n = t.num_rows - at[-1] - 1
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _starts(t: pa.Table, keys: list[str]) -> np.ndarray:
    change = np.ones(t.num_rows, bool)
    change[1:] = False
    for k in keys:
        c = t[k].to_numpy()
        change[1:] |= c[1:] != c[:-1]
    return np.r_[np.flatnonzero(change), t.num_rows]


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least number of each one's component in the graph of pairs (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _candidates(threshold: float) -> Callable:
    """Rows (node, i, j, sid, n, sketch) sorted by (node, i, j) -> (sid, root): trees
    over the pairs of a group whose sketches are alike enough."""
    need = math.floor(SKETCH * (threshold - 4 * math.sqrt(threshold * (1 - threshold) / SKETCH)))

    def pairs(sizes: np.ndarray, sk: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        d = 1
        left = np.arange(len(sizes))
        last = np.repeat(end, end - start)
        while len(left := left[left + d < last[left]]):
            a, b = left, left + d
            near = (np.minimum(sizes[a], sizes[b]) >= threshold * np.maximum(sizes[a], sizes[b]))
            a, b = a[near], b[near]
            for at in range(0, len(a), 20_000):
                x, y = a[at:at + 20_000], b[at:at + 20_000]
                ok = (sk[x] == sk[y]).sum(1) >= need
                if ok.any():
                    yield x[ok], y[ok]
            d += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["node", "i", "j"]
        for t in groups(batches, keys, 5000):
            cut = _starts(t, keys)
            sizes = t["n"].to_numpy()
            sk = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint16).reshape(-1, SKETCH)
            root = np.arange(len(sizes))
            for a, b in pairs(sizes, sk, cut[:-1], cut[1:]):
                # Joined at once: pairs of a group are never held together.
                a, b = root[a], root[b]
                if (a != b).any():
                    root = _roots(len(sizes), a, b)[root]
            linked = np.flatnonzero(root != np.arange(len(sizes)))
            sid = t["sid"].to_pylist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([sid[i] for i in linked], pa.binary()), pa.array([sid[i] for i in root[linked]], pa.binary())],
                names=["sid", "root"])
    return run


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """|x & y| of all pairs. Tokens of many sets count by a product of 0/1 matrices,
    those of few by their pairs."""
    m = len(sets)
    tok, inv, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    of = np.repeat(np.arange(m), [len(s) for s in sets])
    out = np.full((m, m), float((df == m).sum()), np.float32) if m > 1 else np.zeros((m, m), np.float32)
    few = max(2, min(32, m // 8))
    order = np.argsort(inv, kind="stable")
    of = of[order]
    start = np.cumsum(df) - df
    for k in range(2, few + 1):
        at = start[(df == k) & (k < m)]
        for s in range(0, len(at), 20_000):
            g = of[at[s:s + 20_000, None] + np.arange(k)[None]]
            flat = (g[:, :, None] * m + g[:, None, :]).ravel()
            out += np.bincount(flat, minlength=m * m).reshape(m, m).astype(np.float32)
    many = np.flatnonzero((df > few) & (df < m))
    for s in range(0, len(many), 2048):
        part = many[s:s + 2048]
        x = np.zeros((m, len(part)), np.float32)
        for c, i in enumerate(part):
            x[of[start[i]:start[i] + df[i]], c] = 1
        out += x @ x.T
    return out


def _roots_of(link: np.ndarray) -> np.ndarray:
    """As _roots, for a symmetric matrix."""
    root = np.arange(len(link))
    while True:
        new = np.array([min(root[i], root[r].min()) if r.any() else root[i] for i, r in enumerate(link)])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _exact(threshold: float) -> Callable:
    """Rows (cluster, i, j, sid, block, copies, tokens) sorted by (cluster, i, j) ->
    (sid, root, links): exact links in the group; of two blocks only those between them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["cluster", "i", "j"]
        for t in groups(batches, keys):
            cut = _starts(t, keys)
            for a, b in zip(cut[:-1], cut[1:]):
                g = t.slice(a, b - a)
                sets = [np.frombuffer(x, np.uint64) for x in g["tokens"].to_pylist()]
                n = np.array([len(s) for s in sets], np.float64)
                block, copies, sid = g["block"].to_numpy(), g["copies"].to_numpy(), g["sid"].to_pylist()
                both = intersections(sets)
                link = np.empty(both.shape, bool)
                for r in range(0, len(sets), 256):
                    part = both[r:r + 256].astype(np.float64)
                    link[r:r + 256] = part * (1 + threshold) >= threshold * (n[r:r + 256, None] + n[None]) - 1e-9
                np.fill_diagonal(link, False)
                if g["i"][0].as_py() != g["j"][0].as_py():
                    link &= block[:, None] != block[None]
                root = _roots_of(link)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sid, pa.binary()), pa.array([sid[r] for r in root], pa.binary()),
                     pa.array((link @ copies.astype(np.float64)).astype(np.int64), pa.int64())], names=["sid", "root", "links"])
    return run


def _blocks(rows: DataFrame, key: str, blocks) -> DataFrame:
    """Deals each group of ``key`` into ``blocks`` parts by a hash of sid; a member
    goes to every pair (i <= j) that its part is in."""
    r = rows.withColumn("block", F.pmod(F.xxhash64("sid"), blocks).cast("int"))
    other = F.explode(F.sequence(F.lit(0), blocks.cast("int") - 1)).alias("other")
    return (r.select("*", other).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
            .drop("other"))


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def join_sets(docs: DataFrame, **limits) -> DataFrame:
    """(doc_id, class_id, n_links) of (doc_id, text)."""
    return join_rows(docs, **limits).select("doc_id", "class_id", "n_links")


def heads(docs: DataFrame, **limits) -> DataFrame:
    """(doc_id, h, copies): one text of each class, by its least doc_id (null last) and
    then its least text_key h, and the number of rows that have both."""
    alike = join_rows(docs, **limits).groupBy("root", "doc_id", "h").agg(F.count("*").alias("copies"))
    return alike.groupBy("root").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("none"), "doc_id", "h", "copies")).alias("x")).select("x.doc_id", "x.h", "x.copies")


def join_rows(docs: DataFrame, threshold: float = THRESHOLD, n: int = NGRAM, target: float = TARGET,
              depth: int = DEPTH, leaf: int = LEAF, block: int = BLOCK, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_id, h, root, class_id, n_links) of (doc_id, text): h is text_key, root names the class."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = materialize(rows.withColumn("h", text_key(F.col("text"))).mapInArrow(_sign(runs_for(target, depth), threshold, n, depth), SIGNED), "path-sets")
    members = materialize(
        signed.groupBy("sid").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("first"),
                                  F.count("*").alias("copies"), F.first("n").alias("n"),
                                  F.first("sketch").alias("sketch"), F.first("paths").alias("paths"))
        .withColumns({"rep": F.col("first.doc_id"), "rep_h": F.col("first.h")}).drop("first"), "path-members")
    small = members.select("sid", "rep", "rep_h", "copies", "n")

    in_leaves = leaves(members, depth, leaf).join(members.select("sid", "n", "sketch"), "sid")
    pairs = _blocks(in_leaves, "node", F.when(F.col("size") > leaf, F.ceil(F.col("size") / block)).otherwise(F.lit(1)))
    trees = (pairs.repartition("node", "i", "j").sortWithinPartitions("node", "i", "j")
             .select("node", "i", "j", "sid", "n", "sketch").mapInArrow(_candidates(threshold), "sid binary, root binary"))
    clusters = materialize(components(trees, "sid", "root").withColumnRenamed("node", "sid")
                           .withColumnRenamed("root", "cluster").join(small, "sid"), "path-clusters")
    sizes = clusters.groupBy("cluster").agg(F.greatest(
        F.ceil(F.count("*") / block), F.ceil(F.sum("n") / block_tokens)).cast("int").alias("blocks"))
    wanted = clusters.join(sizes, "cluster").select("sid", "cluster", "blocks", "copies", "rep", "rep_h")

    # The texts of the candidates: they go to the texts while they are known to be few.
    wanted = materialize(wanted, "path-wanted")
    few = wanted.count() <= BROADCAST_ROWS
    by_doc = wanted.select("rep", "rep_h", F.col("sid").alias("want"))
    keyed = rows.withColumn("h", text_key(F.col("text")))
    # By id and text: rows that share an id, or have none, meet the one set that is theirs.
    same = (keyed["h"] == by_doc["rep_h"]) & keyed["doc_id"].eqNullSafe(by_doc["rep"])
    texts = keyed.join(F.broadcast(by_doc) if few else by_doc, same).select("text", "want")
    sets = (texts.mapInArrow(_tokens(n), "sid binary, tokens binary").groupBy("sid").agg(F.first("tokens").alias("tokens")))
    dealt = _blocks(sets.join(wanted, "sid"), "cluster", F.col("blocks"))
    exact = materialize(
        dealt.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
        .select("cluster", "i", "j", "sid", "block", "copies", "tokens")
        .mapInArrow(_exact(threshold), "sid binary, root binary, links long"), "path-links")

    links = exact.groupBy("sid").agg(F.sum("links").alias("links"))
    label = components(exact, "sid", "root")
    classes = (small.join(links, "sid", "left").join(label.withColumnRenamed("node", "sid"), "sid", "left")
               .select("sid", "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                       F.coalesce("root", "sid").alias("root")))
    least = classes.groupBy("root").agg(F.min("rep").alias("class_id"))
    return (signed.select("doc_id", "h", "sid").join(classes.join(least, "root").select("sid", "root", "class_id", "n_links"), "sid")
            .select("doc_id", "h", "root", "class_id", "n_links"))


def _tokens(n: int) -> Callable:
    """(text, want) -> (sid, tokens) where the text's set is the wanted one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                texts, want = b.column(0).to_pylist(), b.column(1).to_pylist()
                sid, out = [], []
                for t, w, tok in zip(texts, want, token_sets(texts, n)):
                    if set_id(tok, t) == w:
                        sid.append(w)
                        out.append(tok.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(sid, pa.binary()), pa.array(out, pa.binary())], names=["sid", "tokens"])
    return run


def op5_query(documents: DataFrame) -> DataFrame:
    return join_sets(documents.select("doc_id", "text"))
