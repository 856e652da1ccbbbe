"""Vector code compression: integer codebooks by an exact, limb-split GEMM.

Every component becomes ``floor(scale * x)``; a vector is cut into ``parts`` equal
consecutive parts, and each part gets the index of the nearest entry of its own
small codebook. Nearest means least ``|c|^2 - 2 x.c``, and the dot products are
exact although BLAS computes them:

* integers are broken into limbs of so many bits that a sum of ``width`` products
  of two limbs stays at or below 2^53, so every float64 product matrix is exact;
* the products are shifted and added in int64 (the survey below proves that they
  fit), and the first argmin is taken, so ties go to the lower index;
* distances are then summed from the integer differences, which cancel nothing.

As Spark jobs: one survey of the table (usual length, largest component), one job a
round, and one that writes codes and errors. A round's tasks hold one Arrow batch
and ``parts * entries`` sums; the sums of a task leave as limbs, are added by a
group-by and reach the driver as one codebook, whose size does not depend on the
table. Nothing else is collected. Codebooks go to the tasks inside the closure.

Range: if the survey finds components so large that squared distances of a whole
vector could pass 2^62, the same steps run on Python integers, exactly; an error
beyond a long is then given as the largest long.

Nulls and edge cases: rows whose vector is null or holds null, NaN or infinite
components take no part, nor do those of another length than most (ties: the
shorter), as one codebook needs one length. A length that the parts do not divide
gives the first parts one component more; an empty part has distance 0 to every
entry. A null vec_id is kept and counts as largest; rows that repeat a vec_id are
each coded, and each may be a first entry (equal ids in order of their vectors).
With fewer rows than entries the codebook has as many entries as rows. Null labels
form one group. Extra columns are not looked at. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linecdc.session import materialize

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
SUM_BITS = 40  # limbs of the sums that tasks hand on
MOST_LABELS = 100_000  # label sums up to which they are broadcast (two values each)
LONG_MAX = (1 << 63) - 1


@dataclass(frozen=True)
class Plan:
    """What the survey proves of a table: ``bits`` holds every integer component,
    ``wide`` says that int64 does not hold the distances."""
    length: int
    bits: int
    wide: bool
    scale: int
    cuts: tuple[int, ...]

    def part(self, x: np.ndarray, p: int) -> np.ndarray:
        return x[:, self.cuts[p]:self.cuts[p + 1]]

    @property
    def parts(self) -> int:
        return len(self.cuts) - 1


def _plan(length: int, largest: float, parts: int, scale: int) -> Plan:
    bits = max(1, (int(largest) * scale + scale).bit_length())
    wide = 2 * bits + 2 + max(length - 1, 0).bit_length() > 62
    cuts = np.cumsum([0] + [length // parts + (p < length % parts) for p in range(parts)])
    return Plan(length, bits, wide, scale, tuple(int(c) for c in cuts))


def integers(x: np.ndarray, plan: Plan) -> np.ndarray:
    """floor(scale * x), exactly; Python integers where int64 may be too small."""
    if plan.wide:
        return np.frompyfunc(lambda v: (lambda a, b: a * plan.scale // b)(*v.as_integer_ratio()), 1, 1)(x).astype(object)
    return np.floor(x * plan.scale).astype(np.int64) if plan.scale & (plan.scale - 1) == 0 else \
        np.frompyfunc(lambda v: (lambda a, b: a * plan.scale // b)(*v.as_integer_ratio()), 1, 1)(x).astype(np.int64)


def _limbs(a: np.ndarray, size: int, n: int) -> list[np.ndarray]:
    """a = sum of limb i << (size * i); all but the last limb are in 0 .. 2^size - 1."""
    out = [((a >> (size * i)) & ((1 << size) - 1)).astype(np.float64) for i in range(n - 1)]
    return [*out, (a >> (size * (n - 1))).astype(np.float64)]


def exact_dots(x: np.ndarray, book: np.ndarray, bits: int) -> np.ndarray:
    """x @ book.T of integers under 2^bits in size, in int64."""
    width = x.shape[1]
    size = (53 - max(width - 1, 0).bit_length()) // 2  # width * 2^(2 size) <= 2^53
    n = -(-bits // size)
    out = np.zeros((len(x), len(book)), np.int64)
    right = _limbs(book, size, n)
    for i, a in enumerate(_limbs(x, size, n)):
        for j, b in enumerate(right):
            out += (a @ b.T).astype(np.int64) << (size * (i + j))
    return out


def nearest(x: np.ndarray, book: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (the first of equally near ones) and its squared distance."""
    if not x.shape[1]:
        return np.zeros(len(x), np.int64), np.zeros(len(x), x.dtype)
    dots = x @ book.T if plan.wide else exact_dots(x, book, plan.bits)
    code = np.asarray(((book * book).sum(1)[None] - 2 * dots).argmin(1), np.int64)
    gap = x - book[code]
    return code, (gap * gap).sum(1)


def _vectors(batch: pa.RecordBatch, plan: Plan) -> np.ndarray:
    return integers(batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, plan.length)
                    if plan.length else np.empty((batch.num_rows, 0)), plan)


def _count(books: list[np.ndarray], plan: Plan) -> Callable:
    """Per task: how many parts each entry got, and their componentwise sums, as limbs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = object if plan.wide else np.int64
        sums = [np.zeros((len(b), b.shape[1] + 1), kind) for b in books]  # the last column counts
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _vectors(batch, plan)
            for p, book in enumerate(books):
                own = plan.part(x, p)
                code, _ = nearest(own, book, plan)
                order = np.argsort(code, kind="stable")
                first = np.flatnonzero(np.r_[True, np.diff(code[order]) > 0])
                ones = np.ones((len(own), 1), kind)
                sums[p][code[order][first]] += np.add.reduceat(np.hstack([own, ones])[order], first, axis=0)
        rows = []
        for p, s in enumerate(sums):
            for e, entry in enumerate(s.tolist()):
                if not entry[-1]:
                    continue
                for i, v in enumerate(entry):
                    sign, v, k = (-1 if v < 0 else 1), abs(v), 0
                    while v or not k:
                        rows.append((p, e, i, k, sign * (v & ((1 << SUM_BITS) - 1))))
                        v, k = v >> SUM_BITS, k + 1
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)],
                                             names=["part", "entry", "pos", "limb", "value"])
    return run


def _code(books: list[np.ndarray], plan: Plan) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _vectors(batch, plan)
            error, codes = 0, []
            for p, book in enumerate(books):
                code, far = nearest(plan.part(x, p), book, plan)
                codes.append(code)
                error = error + far
            text = np.stack(codes, 1).astype(np.uint8).tobytes().hex()
            step = 2 * len(books)
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id"), batch.column("label"),
                pa.array([text[i:i + step] for i in range(0, len(text), step)], pa.string()),
                pa.array([min(int(e), LONG_MAX) for e in error], pa.int64())], names=["vec_id", "label", "code", "error"])
    return run


def valid(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, v): the rows whose vectors are finite throughout."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return embeddings.where(v.isNotNull() & finite).select(F.col("vec_id").cast("long").alias("vec_id"), "label", v.alias("v"))


@dataclass
class Compressed:
    rows: DataFrame  # vec_id, label, code, error
    books: list[list[list[int]]]  # part, entry, component

    @property
    def sha256(self) -> str:
        flat = ",".join(str(v) for book in self.books for entry in book for v in entry)
        return hashlib.sha256(flat.encode()).hexdigest()


def compress(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
             scale: int = SCALE) -> Compressed:
    """Codes and errors of (vec_id, embedding, label), and the final codebooks."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    spark = embeddings.sparkSession
    rows = valid(embeddings)
    out_schema = T.StructType([T.StructField("vec_id", T.LongType()), embeddings.schema["label"],
                               T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    size = F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v")))
    seen = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows"), F.max(size).alias("largest")).orderBy(
        F.desc("rows"), "n").first()
    if seen is None:
        return Compressed(spark.createDataFrame([], out_schema), [])
    plan = _plan(seen["n"], seen["largest"] or 0.0, parts, scale)
    rows = rows.where(F.size("v") == plan.length)
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "v").select("v").limit(entries).collect()
    start = integers(np.array([r["v"] for r in first], np.float64).reshape(len(first), plan.length), plan)
    books = [plan.part(start, p).copy() for p in range(parts)]
    for _ in range(rounds):
        sums = (rows.select("v").mapInArrow(_count(books, plan), "part long, entry long, pos long, limb long, value long")
                .groupBy("part", "entry", "pos", "limb").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")))
        total: dict[tuple[int, int], list[int]] = {}
        for r in sums.collect():  # at most one codebook of sums
            own = total.setdefault((r["part"], r["entry"]), [0] * (books[r["part"]].shape[1] + 1))
            own[r["pos"]] += int(r["value"]) << (SUM_BITS * r["limb"])
        for (p, e), (*own, n) in total.items():
            books[p][e] = [v // n for v in own]  # floor, also below zero
    coded = rows.mapInArrow(_code(books, plan), out_schema)
    return Compressed(coded, [[[int(v) for v in entry] for entry in book] for book in books])


def op12_query(embeddings: DataFrame) -> DataFrame:
    done = compress(embeddings.select("vec_id", "embedding", "label"))
    coded = materialize(done.rows, "vector-codes")  # read twice
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG_MAX).cast("decimal(38,0)")).cast("long")
    by_label = coded.groupBy(F.col("label").alias("_label")).agg(total.alias("label_error"))
    if by_label.count() <= MOST_LABELS:
        by_label = F.broadcast(by_label)
    return coded.join(by_label, coded["label"].eqNullSafe(by_label["_label"])).select(
        "vec_id", "code", "error", "label_error", F.lit(done.sha256).alias("codebooks_sha256"))


def _op12_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    far = "cast(list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as bigint)"
    near = lambda i: f"a{i} as materialized (select r, p, arg_min(e, (d, e)) e, min(d) d from (select r, x.p, e, {far} d " \
                     f"from x join c{i} c on x.p = c.p) group by r, p)"  # noqa: E731
    move = lambda i: f"""m{i} as (select p, e, list(cast((s - ((s % n) + n) % n) // n as bigint) order by i) v from (
        select p, e, i, sum(w) s, count(*) n from (select a.p, a.e, generate_subscripts(x.v, 1) i, unnest(x.v) w
          from a{i} a join x on a.r = x.r and a.p = x.p) group by p, e, i) group by p, e),
      c{i + 1} as materialized (select c.p, c.e, coalesce(m.v, c.v) v from c{i} c left join m{i} m on c.p = m.p and c.e = m.e)"""  # noqa: E731
    steps = ", ".join(f"{near(i)}, {move(i)}" for i in range(rounds))
    return f"""
with kept as (select row_number() over (order by vec_id) r, vec_id, label, embedding, len(embedding) // {parts} w from embeddings
   where embedding is not null and len(list_filter(embedding, lambda y: y is null or not isfinite(y))) = 0),
x as materialized (select r, p, list_transform(embedding[p * w + 1:(p + 1) * w], lambda y: cast(floor({scale} * cast(y as double)) as bigint)) v
   from kept, range({parts}) t(p)),
c0 as materialized (select p, r - 1 e, v from x where r <= {entries}),
{steps}, {near(rounds)},
coded as (select r, string_agg(lpad(to_hex(e), 2, '0'), '' order by p) code, cast(sum(d) as bigint) error from a{rounds} group by r),
rows as (select vec_id, label, lower(code) code, error from coded join kept using (r)),
books as (select sha256(string_agg(array_to_string(v, ','), ',' order by p, e)) h from c{rounds})
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) label_error, h codebooks_sha256 from rows, books"""


OP12_SQL = _op12_sql()
