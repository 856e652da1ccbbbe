"""Secret scans: an incremental blob ledger.

Every version of every path is content-addressed (sha256 of its text). A scan
looks only at (blob, rule, rule version) triples that the ledger does not hold,
reads one copy of each such blob, and appends what it found together with the
triples it has done. Findings belong to blobs; a join on the blob gives them
back to every path and version with that content. Raising a rule's version
makes just that rule run again, on each distinct blob once.

Nulls and edge cases: a null text is the empty text; empty texts and texts
without a finding have no finding rows (and an empty span list after the join);
rows that repeat a path, version and text give one finding each, not two; a null
path or version is a holder like any other (OP1_SQL, which joins on the plain id,
shows no findings in rows without one); other
columns of the input, whatever their names, are not looked at; an empty input
gives empty tables. Positions are code points, end exclusive.

Only DataFrame functions run on the data. Positions come from the lengths of
the pieces between matches (``split``) and of the matches
(``regexp_extract_all``), summed up by a window over the matches of one blob
and rule, so the work is linear in the text however many matches it has.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linecdc.llm.common import text_or_empty
from linecdc.session import materialize, scratch_path


@dataclass(frozen=True)
class Rule:
    """A secret pattern. ``group`` must have ``min_len`` characters, else the
    match is dropped (it still uses up its text). ``hint`` is a cheaper pattern
    that any text with a match also has."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    min_len: int = 1
    hint: str | None = None


# The three base rules. A run that is too short cannot hold a
# longer one, so for access and hex the least length is part of the pattern.
BASE_RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         group=2, min_len=12, hint=r"""(?i)(?:passw|secret|token|api_?key)[a-z"']*\x20*[:=]"""),
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}", hint=r"AKIA[A-Z0-9]{14}"),
    Rule("hex", 1, r"[0-9a-f]{16,}", hint=r"[0-9a-f]{16}"),
)
EXTRA_RULES = (
    Rule("private_key", 1, r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", hint=r"-----BEGIN "),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", hint=r"eyJ[A-Za-z0-9_-]{8}"),
)
RULES = BASE_RULES + EXTRA_RULES

TRIPLE = ["blob", "kind", "rule_version"]


def _rule_table(rules) -> Column:
    return F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("rule_version")) for r in rules])


def blobs_of(versions: DataFrame) -> DataFrame:
    """(path, version, blob, text): each version under its content address."""
    t = text_or_empty()
    return versions.select("path", "version", F.sha2(t, 256).alias("blob"), t.alias("text"))


def unseen(keyed: DataFrame, scanned: DataFrame | None, rules=RULES) -> DataFrame:
    """(blob, path, version, rules to run): one holder of every blob with work left."""
    holders = keyed.groupBy("blob").agg(F.min(F.struct("path", "version")).alias("h"))
    todo = holders.select("blob", "h", F.explode(_rule_table(rules)).alias("r")).select("blob", "h", "r.*")
    if scanned is not None:
        todo = todo.join(scanned.select(*TRIPLE).distinct(), TRIPLE, "left_anti")
    return (todo.groupBy("blob", "h").agg(F.collect_set("kind").alias("kinds"))
            .select("blob", "h.path", "h.version", "kinds"))


def _lengths(text: Column, r: Rule) -> Column:
    """One struct of lengths (gap before, match, group) per match of ``r``."""
    n = lambda a: F.transform(a, lambda x: F.char_length(x))
    found = F.arrays_zip(
        n(F.split(text, r.pattern, -1)).alias("gap"),
        n(F.regexp_extract_all(text, F.lit(r.pattern), F.lit(0))).alias("len"),
        n(F.regexp_extract_all(text, F.lit(r.pattern), F.lit(r.group))).alias("group_len"))
    none = F.lit(None).cast("array<struct<gap:int,len:int,group_len:int>>")
    return F.when(F.array_contains("kinds", r.kind) & text.rlike(r.hint or r.pattern), found).otherwise(none)


def find(texts: DataFrame, rules=RULES) -> DataFrame:
    """(blob, kind, rule_version, start, end) of all matches in (blob, kinds, text)."""
    per_rule = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("rule_version"),
                                  F.lit(r.min_len).alias("min_len"), _lengths(F.col("text"), r).alias("m"))
                         for r in rules])
    # The row id keeps repeated rows of one holder apart until the final distinct.
    one = (texts.select("blob", F.monotonically_increasing_id().alias("row"), F.explode(per_rule).alias("r"))
           .where(F.col("r.m").isNotNull())
           .select("blob", "row", "r.kind", "r.rule_version", "r.min_len", F.posexplode("r.m").alias("i", "x"))
           .where(F.col("x.len").isNotNull()))  # the last gap has no match
    upto = Window.partitionBy("blob", "row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    at = one.withColumn("end", F.sum(F.col("x.gap") + F.col("x.len")).over(upto))
    return (at.where(F.col("x.group_len") >= F.col("min_len"))
            .select(*TRIPLE, (F.col("end") - F.col("x.len")).cast("long").alias("start"),
                    F.col("end").cast("long").alias("end"))
            .distinct())


class Ledger:
    """Two Parquet tables under ``root``: ``findings`` and ``scanned``. Findings
    are written first; the triples in ``scanned`` are what counts as done, so a
    scan that broke off is repeated and its findings are not counted twice."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.runs = spark, root, 0

    def _read(self, name: str, schema: str) -> DataFrame | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}") if fs.exists(path) else None

    def scanned(self) -> DataFrame | None:
        return self._read("scanned", "blob string, kind string, rule_version int")

    def findings(self) -> DataFrame:
        """Findings of the newest rule versions, once each."""
        schema = "blob string, kind string, rule_version int, start long, end long"
        t = self._read("findings", schema)
        return self.spark.createDataFrame([], schema) if t is None else t.distinct()

    def scan(self, versions: DataFrame, rules=RULES) -> DataFrame:
        """Scan what is new in ``versions`` (path, version, text); returns (path,
        version, blob) joined with nothing yet: give it to ``by_path``."""
        keyed = blobs_of(versions)
        # Written once: what is scanned and what is then marked as scanned are the same rows.
        todo = materialize(unseen(keyed, self.scanned(), rules), "secret-todo")
        if todo.isEmpty():  # nothing new: no text is read
            return keyed.select("path", "version", "blob")
        k, t = keyed.alias("k"), todo.alias("t")
        holder = F.col("k.path").eqNullSafe(F.col("t.path")) & F.col("k.version").eqNullSafe(F.col("t.version"))
        texts = k.join(t, (F.col("k.blob") == F.col("t.blob")) & holder).select("k.blob", "t.kinds", "k.text")
        find(texts, rules).write.mode("append").parquet(f"{self.root}/findings")
        done = todo.select("blob", F.explode("kinds").alias("kind")).join(
            F.broadcast(self.spark.createDataFrame([(r.kind, r.version) for r in rules], "kind string, rule_version int")),
            "kind").select(*TRIPLE)  # a handful of rules
        done.write.mode("append").parquet(f"{self.root}/scanned")
        return keyed.select("path", "version", "blob")


def by_blob(findings: DataFrame, rules=RULES) -> DataFrame:
    """Per blob: sorted ``spans`` array of (start, rank, end, kind) under the given rules."""
    rank = F.lit(None).cast("int")
    for i, r in enumerate(rules):
        rank = F.when((F.col("kind") == r.kind) & (F.col("rule_version") == r.version), i).otherwise(rank)
    return (findings.withColumn("rank", rank).where(F.col("rank").isNotNull())
            .groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", "rank", "end", "kind"))).alias("found")))


def by_path(paths: DataFrame, findings: DataFrame, rules=RULES) -> DataFrame:
    """Findings of each (path, version): column ``found``, empty where there are none."""
    empty = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string>>")
    return (paths.join(by_blob(findings, rules), "blob", "left")
            .withColumn("found", F.coalesce("found", empty)))


def span_text(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, found: Column, mask: str = "[secret]") -> Column:
    """``text`` with each span of ``found`` replaced; overlapping spans share one mask."""
    step = lambda acc, s: F.struct(
        F.concat(acc["out"], F.when(s["start"] >= acc["at"], F.concat(
            F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mask)))
                 .otherwise(F.lit(""))).alias("out"),
        F.greatest(acc["at"], s["end"]).alias("at"))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))
    rest = lambda acc: F.concat(acc["out"], F.substring(
        text, (acc["at"] + 1).cast("int"), F.lit(2**31 - 1)))
    return F.when(F.size(found) > 0, F.aggregate(found, start, step, rest)).otherwise(text)


def scan_documents(docs: DataFrame, rules=RULES, root: str | None = None) -> DataFrame:
    """(path, version, blob, found) for a table of (path, version, text)."""
    spark = docs.sparkSession
    ledger = Ledger(spark, root or scratch_path(spark, "secret-ledger"))
    paths = ledger.scan(docs, rules)
    return by_path(paths, ledger.findings(), rules)


def op1_query(documents: DataFrame) -> DataFrame:
    out = scan_documents(documents.select(F.col("doc_id").alias("path"), F.lit(0).alias("version"), "text"))
    base = [r.kind for r in BASE_RULES]
    of = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select(
        F.col("path").alias("doc_id"), *[of(k) for k in base],
        F.sha2(span_text(F.filter("found", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        span_text(F.col("found")).alias("spans"))


def _sql_kind(r: Rule, i: int) -> str:
    pat = r.pattern.replace("'", "''")
    return f"""
select doc_id, {i} as rk, '{r.kind}' as kind, list_sum(list_transform(parts[:j], lambda x: length(x)))
         + coalesce(list_sum(list_transform(ms[:j - 1], lambda x: length(x))), 0) as st, length(ms[j]) as ln, length(vs[j]) as vl, {r.min_len} as ml
  from (select doc_id, parts, ms, vs, unnest(range(1, len(ms) + 1)) as j from (
    select doc_id, string_split_regex(t, '{pat}') as parts, regexp_extract_all(t, '{pat}') as ms,
           regexp_extract_all(t, '{pat}', {r.group}) as vs from d))"""


OP1_SQL = f"""
with d as (select doc_id, coalesce(text, '') t from documents),
m as ({' union all '.join(_sql_kind(r, i) for i, r in enumerate(RULES))}),
s as (select doc_id, rk, kind, cast(st as bigint) st, kind || ':' || cast(st as bigint) || ':' || cast(st + ln as bigint) sp
        from m where vl >= ml),
g as (select doc_id, count(*) filter (rk = 0) n_assign, count(*) filter (rk = 1) n_access, count(*) filter (rk = 2) n_hex,
             string_agg(sp, ',' order by st, rk) filter (rk < 3) b, string_agg(sp, ',' order by st, rk) a from s group by doc_id)
select d.doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex,
       sha256(coalesce(b, '')) base_sha256, coalesce(a, '') spans
  from d left join g using (doc_id)"""
