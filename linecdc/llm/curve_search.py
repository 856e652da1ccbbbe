"""Approximate nearest neighbours: shifted space-filling curves.

``CURVES`` times the vectors are projected on a few random orthonormal axes,
shifted at random and put in order along a Hilbert curve. Vectors that are near
in space are mostly near on some of the curves. Each curve is cut into cells at
quantiles of its keys; a query visits its own cell and the neighbouring cells
that its window touches, is compared there with all vectors by exact distance in
double precision, and the best of all curves are merged and ranked.

The axes, shifts, cell bounds and the width of the window are fitted on a sample
of at most ``SAMPLE`` distinct vectors: the window is the least part of a curve
with which ``TARGET`` of the sample's true neighbours are met on some curve. (In
the sample neighbours are farther apart than in the whole table, so the window
errs on the wide side.) Every row is indexed. A cell with more than ``CELL_ROWS``
vectors, however it came about, is dealt by a hash into parts that each of its
queries visits, so no task holds more and nothing is left out.

Equal vectors are searched once: a group of copies is one vector with its
``k + 1`` smallest ids, which is all that a list of ``k`` can show of it.

Nulls and edge cases: vectors that are null, zero, empty, hold a null or a
non-finite component, or have another length than most, take no part, neither as
query nor as candidate. Ties in distance go to the smaller id. Rows that repeat
an id count once. With fewer candidates than ``k`` all are returned. Extra
columns are not looked at. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linecdc.session import materialize

CURVES, DIMS, BITS = 24, 10, 4
SAMPLE, TARGET, CELL_ROWS = 8192, 0.96, 8192
SAMPLE_QUERIES = 256


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of grid points (n, dims), after Skilling's
    transform of coordinates (AIP Conf. Proc. 707, 2004), for all rows at once."""
    x = cells.astype(np.uint32).copy()
    dims = x.shape[1]
    for b in range(bits - 1, 0, -1):
        q, low = np.uint32(1 << b), np.uint32((1 << b) - 1)
        for i in range(dims):
            on = (x[:, i] & q) != 0
            swap = np.where(on, np.uint32(0), (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(on, low, swap)
            x[:, i] ^= swap
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(len(x), np.uint32)
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[:, -1] & np.uint32(1 << b)) != 0, np.uint32((1 << b) - 1), np.uint32(0))
    x ^= flip[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | ((x[:, i] >> np.uint32(b)) & np.uint32(1)).astype(np.int64)
    return key


@dataclass
class Index:
    axes: np.ndarray  # curves x length x dims
    low: np.ndarray  # curves x dims
    scale: np.ndarray
    bounds: np.ndarray  # curves x (cells - 1)
    reach: int  # cells on either side that a query visits

    def keys(self, vectors: np.ndarray, curve: int) -> np.ndarray:
        p = (vectors @ self.axes[curve] - self.low[curve]) * self.scale[curve]
        return hilbert_keys(np.clip(p, 0, (1 << BITS) - 1).astype(np.uint32), BITS)

    def cells(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last cell (n, curves) that a vector's key may lie in; they
        differ where a key is a bound, that is, where many vectors share it."""
        k = [self.keys(vectors, c) for c in range(len(self.axes))]
        side = lambda s: np.stack([np.searchsorted(b, x, s) for b, x in zip(self.bounds, k)], 1)
        return side("left"), side("right")


def _brute(q: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    d = (q * q).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * (q @ x.T)
    return np.argpartition(d, min(k, len(x) - 1), axis=1)[:, :k + 1]


def fit(sample: np.ndarray, k: int, curves: int = CURVES, target: float = TARGET, seed: int = 7) -> Index:
    """Axes, shifts, bounds and window from a sample of distinct vectors."""
    rng = np.random.default_rng(seed)
    n, length = sample.shape
    dims = min(DIMS, length)
    axes = np.stack([np.linalg.qr(rng.normal(size=(length, length)))[0][:, :dims] for _ in range(curves)])
    low, scale = np.empty((curves, dims)), np.empty((curves, dims))
    for c in range(curves):
        p = sample @ axes[c]
        lo, hi = np.quantile(p, [0.002, 0.998], axis=0)
        width = np.maximum(hi - lo, 1e-12) * 1.5
        scale[c] = (1 << BITS) / width
        low[c] = lo - rng.random(dims) * width / 3  # a random shift of the grid
    index = Index(axes, low, scale, np.empty((curves, 0), np.int64), 0)
    if n <= 64 * (k + 1):  # one cell, so one curve
        return Index(axes[:1], low[:1], scale[:1], index.bounds[:1], 0)
    at = np.stack([index.keys(sample, c) for c in range(curves)])
    rank = np.argsort(np.lexsort((np.broadcast_to(np.arange(n), at.shape), at), axis=-1), axis=-1) / n
    q = rng.permutation(n)[:SAMPLE_QUERIES]
    near = _brute(sample[q], sample, k)
    gap = np.abs(rank[:, near] - rank[:, q][:, :, None]).min(0)
    window = np.quantile(gap[near != q[:, None]], target)
    cells = int(np.clip(math.ceil(2 / max(window, 1e-9)), 1, n // 8))
    index.bounds = np.sort(at, axis=1)[:, (np.arange(1, cells) * n) // cells]
    index.reach = math.ceil(window * cells)
    return index


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): the rows that take part."""
    good = (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) \
        & F.exists("embedding", lambda x: x != 0)
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & good).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    most = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (most["n"] if most else 0))


def representatives(rows: DataFrame, k: int) -> DataFrame:
    """(rid, v, ids): each distinct vector with its k + 1 smallest ids; rid is the least."""
    first = Window.partitionBy("h", "v").orderBy("vec_id")
    few = (rows.distinct().withColumn("h", F.xxhash64("v")).withColumn("rn", F.row_number().over(first))
           .where(F.col("rn") <= k + 1))
    return few.groupBy("h", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(
        F.element_at("ids", 1).alias("rid"), "v", "ids")


def _matrix(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1)


def _add_cells(index) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            lo, hi = index.value.cells(_matrix(b.column("v")))
            # A vector whose key spans several cells goes to one of them by its id.
            rid = b.column("rid").to_numpy()
            own = lo + (rid[:, None] * 2654435761 >> 8) % (hi - lo + 1)
            lists = lambda a: pa.array(list(a.astype(np.int32)), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists(own), lists(lo), lists(hi)],
                                             names=[*b.schema.names, "own", "lo", "hi"])
    return run


def _rerank(k: int) -> callable:
    def run(key: tuple, base: pa.Table, queries: pa.Table) -> pa.Table:
        out = []
        if base.num_rows and queries.num_rows:
            x, rid = _matrix(base["v"]), base["rid"].to_numpy()
            order = np.argsort(rid)
            x, rid = x[order], rid[order]
            base_v = x
            want = min(len(rid), 2 * (k + 1))
            # Distances from the cell's mean: a cell is small, so squares hardly cancel
            # however far from the origin it lies.
            middle = x.mean(0)
            x = x - middle
            for a in range(0, queries.num_rows, 512):
                part = queries.slice(a, 512)
                own, qid = _matrix(part["v"]), part["rid"].to_numpy()
                q = own - middle
                near = np.sort(_brute(q, x, want - 1)[:, :want], axis=1)
                d = np.sqrt(((base_v[near] - own[:, None, :]) ** 2).sum(2))  # of the vectors as they are
                best = np.argsort(d, axis=1, kind="stable")[:, :k + 1]
                out.append((np.repeat(qid, best.shape[1]), rid[np.take_along_axis(near, best, 1)].ravel(),
                            np.take_along_axis(d, best, 1).ravel()))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64)] * 2 + [np.empty(0)]
        return pa.table({"qrid": pa.array(cols[0], pa.int64()), "rid": pa.array(cols[1], pa.int64()),
                         "score": pa.array(cols[2], pa.float64())})
    return run


def search(vectors: DataFrame, is_query, k: int = 10, curves: int = CURVES) -> DataFrame:
    """(query_id, rank, vec_id, score) for rows (vec_id, embedding) where the
    condition ``is_query`` on vec_id holds."""
    spark = vectors.sparkSession
    rows = valid(vectors)
    reps = representatives(rows, k)
    queries = (rows.where(is_query(F.col("vec_id"))).distinct().withColumnRenamed("vec_id", "query_id")
               .join(reps.select("rid", "v"), "v").select("query_id", "rid"))
    reps = materialize(reps, "curve-reps")
    n = reps.count()
    out_schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], out_schema)
    share = min(1.0, 1.2 * SAMPLE / n)
    taken = reps.where(F.pmod(F.xxhash64("rid"), F.lit(1 << 30)) < int(share * (1 << 30))).select("v").limit(SAMPLE)
    index = spark.sparkContext.broadcast(fit(np.array([r["v"] for r in taken.collect()] or [reps.first()["v"]]), k, curves))
    cells = index.value.bounds.shape[1] + 1
    asked = materialize(queries, "curve-queries")
    placed = materialize(
        reps.mapInArrow(_add_cells(index), "rid long, v array<double>, ids array<long>, own array<int>, lo array<int>, hi array<int>")
        .join(asked.select("rid").distinct().withColumn("asked", F.lit(True)), "rid", "left"), "curve-cells")
    base = placed.select("rid", "v", F.posexplode("own").alias("curve", "cell"))
    # curves x cells rows: both are bounded by parameters (cells by the sample's size)
    parts = base.groupBy("curve", "cell").agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("parts"))
    base = base.join(F.broadcast(parts), ["curve", "cell"]).select(
        "curve", "cell", F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int").alias("part"), "rid", "v")
    visits = (placed.where("asked").select("rid", "v", F.posexplode(F.arrays_zip("lo", "hi")).alias("curve", "w"))
              .select("rid", "v", "curve", F.explode(F.sequence(
                  F.greatest(F.col("w.lo") - index.value.reach, F.lit(0)),
                  F.least(F.col("w.hi") + index.value.reach, F.lit(cells - 1)))).alias("cell"))
              .join(F.broadcast(parts), ["curve", "cell"])
              .select("curve", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "rid", "v"))
    visits = visits.toDF("curve", "cell", "part", "rid", "v")  # columns of its own, as both come from one table
    keys = ["curve", "cell", "part"]
    found = (base.groupBy(*keys).cogroup(visits.groupBy(*keys))
             .applyInArrow(_rerank(k), "qrid long, rid long, score double").distinct())
    best = Window.partitionBy("qrid").orderBy("score", "rid")
    found = found.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= k + 1)
    answers = found.join(placed.select("rid", "ids"), "rid").select(
        "qrid", "score", F.explode("ids").alias("vec_id"))
    last = Window.partitionBy("query_id").orderBy("score", "vec_id")
    per_query = asked.withColumnRenamed("rid", "qrid").join(answers, "qrid").where(F.col("query_id") != F.col("vec_id"))
    return (per_query.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def op8_query(embeddings: DataFrame) -> DataFrame:
    return search(embeddings.select("vec_id", "embedding"), lambda c: c % 100 == 0)


