"""Document fingerprints: a Merkle tree over sections and paragraphs.

A text is cut at blank lines into sections, a section at line ends into paragraphs, a
paragraph into runs of up to six words (cut earlier after punctuation). The runs are the
leaves: a paragraph's hash is the sha256 of its runs' hashes, a section's of its
paragraphs' hashes, the root's of its sections' hashes (the upper levels with a prefix of
their own). The cuts lose nothing, so roots are equal exactly when texts are. Where roots
differ, ``differing`` walks down: branches are aligned by hash, so one that was put in
shifts no other; sections with unequal hashes, then the unequal paragraphs in them,
locate the edit.

Likeness is read off the leaves: the share of the distinct leaves of two trees that both
have. A run with a stretch of 25 code points or more without a space (a text in a script
without spaces, a long path) counts with all its windows of six code points instead, so
an edit inside it leaves the rest alike.

Nulls and edge cases: a null text is the empty text, whose tree is one section
with one empty paragraph; two trees without words are alike 1.0 if their roots
are equal, else 0.0. Extra columns are not looked at. Only DataFrame functions
run on the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linecdc.llm.common import shuffle_parts, text_or_empty

# Up to five words that don't end in punctuation, then one more; or left-over spaces.
RUN = r" *(?:[^ ]*[^ .!?,;:] +){0,5}[^ ]+| +"
# A stretch without spaces that counts by windows of code points, not as a word.
STRETCH, WINDOW = 25, 6


def runs(text: Column) -> Column:
    """array (sections) of array (paragraphs) of array (runs), which together are the text."""
    paragraph = lambda p: F.regexp_extract_all(p, F.lit(RUN), F.lit(0))
    return F.transform(F.split(text, "\n\n", -1), lambda s: F.transform(F.split(s, "\n", -1), paragraph))


def paragraph_hashes(parts: Column) -> Column:
    """array (sections) of array (paragraphs) of sha256, of ``runs``."""
    leaf = lambda r: F.sha2(r, 256)
    return F.transform(parts, lambda s: F.transform(s, lambda p: F.sha2(F.array_join(F.transform(p, leaf), ""), 256)))


def section_hashes(paragraphs: Column) -> Column:
    return F.transform(paragraphs, lambda s: F.sha2(F.concat(F.lit("section:"), F.array_join(s, "")), 256))


def root_hash(sections: Column) -> Column:
    return F.sha2(F.concat(F.lit("root:"), F.array_join(sections, "")), 256)


def fingerprint(parts: Column) -> Column:
    return root_hash(section_hashes(paragraph_hashes(parts)))


def leaves(parts: Column) -> Column:
    """Distinct 64-bit hashes of the leaves, without the spaces around them."""
    windows = lambda r: F.regexp_extract_all(r, F.lit(rf"(?s)(?=(.{{{WINDOW}}}))"), F.lit(1))
    own = lambda r: F.when(F.rlike(r, F.lit(rf"[^ ]{{{STRETCH}}}")), windows(F.trim(r))).otherwise(F.array(F.trim(r)))
    each = F.flatten(F.transform(F.flatten(F.flatten(parts)), own))
    return F.array_distinct(F.transform(F.filter(each, lambda x: x != ""), lambda x: F.xxhash64(x)))


def likeness(a_runs: Column, b_runs: Column, a_root: Column, b_root: Column) -> Column:
    both = F.size(F.array_intersect(a_runs, b_runs)).cast("double")
    either = F.size(a_runs) + F.size(b_runs) - both
    return F.when(a_root == b_root, 1.0).when(either == 0, 0.0).otherwise(both / either)


def tree(docs: DataFrame) -> DataFrame:
    """(doc_id, root, sections, paragraphs, leaves) of every document."""
    t = docs.select("doc_id", runs(text_or_empty()).alias("runs"))
    t = t.select("doc_id", paragraph_hashes(F.col("runs")).alias("paragraphs"), leaves(F.col("runs")).alias("leaves"))
    t = t.withColumn("sections", section_hashes(F.col("paragraphs")))
    return t.select("doc_id", root_hash(F.col("sections")).alias("root"), "sections", "paragraphs", "leaves")


def alike(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id, likeness) of the trees of equal doc_ids, by their leaves."""
    a, b = old.alias("a"), new.alias("b")
    return a.join(b, F.col("a.doc_id") == F.col("b.doc_id")).select("a.doc_id", likeness(
        F.col("a.leaves"), F.col("b.leaves"), F.col("a.root"), F.col("b.root")).alias("likeness"))


def _align(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, side, at, h, gap, ...), side 0 old and 1 new, at a struct of section and
    paragraph, with: ``kept`` if both sides have the branch (the n-th of a hash is the
    n-th of that hash on the other side), the kept one ``after`` which it comes, and
    whether a section starts in between."""
    n = nodes.withColumn("nth", F.row_number().over(Window.partitionBy(*keys, "side", "h").orderBy("at")))
    n = n.withColumn("kept", F.count("*").over(Window.partitionBy(*keys, "h", "nth")) == 2)
    before = Window.partitionBy(*keys, "side").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("kept"), F.struct("h", "nth", "at.section")), True).over(before)
    return (n.withColumn("last", last).withColumn("after", F.struct("last.h", F.col("last.nth").alias("nth")))
            .withColumn("starts", F.col("last.section") != F.col("at.section")))


def _changes(aligned: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, section, paragraph, change) of aligned branches; what is not kept is paired
    in order behind the same kept branch."""
    c = F.col
    place = [*keys, "gap", "kept", "after"]
    n = aligned.withColumn("left", F.row_number().over(Window.partitionBy(*place, "side").orderBy("at")))
    slot = F.when(c("kept"), F.struct("h", "nth")).otherwise(F.struct("after.h", "after.nth")).alias("slot")
    side = lambda s, name: F.max(F.when(c("side") == s, F.struct("at", "after", "starts"))).alias(name)
    open_only = lambda x: F.when(~c("kept"), x)
    both = n.groupBy(*keys, "kept", slot, open_only(c("gap")).alias("gap"), open_only(c("left")).alias("left")).agg(
        side(0, "a"), side(1, "b"))
    same = c("a.after").eqNullSafe(c("b.after")) & c("a.starts").eqNullSafe(c("b.starts"))
    change = (F.when(c("kept"), F.when(~same, "moved")).when(c("a").isNull(), "added").when(c("b").isNull(), "removed")
              .otherwise("changed"))
    at = F.coalesce("a.at", "b.at")
    return (both.withColumn("change", change).where(c("change").isNotNull())
            .select(*keys, at["section"].alias("section"), at["paragraph"].alias("paragraph"), "change"))


def differing(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id, section, paragraph, change) where the trees of equal doc_ids differ, once
    for each pair of roots; only sections with unequal hashes are opened, and their
    paragraphs are aligned by hash across them. Places count from 0, in the new text
    for what was added and in the old one otherwise. ``moved``: an equal branch comes
    after another equal branch than before, or a section bound between the two came
    or went (paragraph null: a whole section)."""
    o = old.select("doc_id", F.col("root").alias("r0"), F.col("sections").alias("s0"), F.col("paragraphs").alias("p0"))
    n = new.select("doc_id", F.col("root").alias("r1"), F.col("sections").alias("s1"), F.col("paragraphs").alias("p1"))
    both = o.join(n, "doc_id").where(F.col("r0") != F.col("r1")).dropDuplicates(["doc_id", "r0", "r1"])
    doc, none = ["doc_id", "r0", "r1"], F.lit(None)

    def side(i: int) -> DataFrame:
        z = F.posexplode(F.arrays_zip(F.col(f"s{i}").alias("h"), F.col(f"p{i}").alias("p"))).alias("section", "z")
        gap = none.cast("struct<h:string,nth:int>").alias("gap")
        # Sections are branches of one level: no bound lies between them.
        at = F.struct("section", none.cast("int").alias("paragraph")).alias("at")
        return both.select(*doc, F.lit(i).alias("side"), z).select(*doc, "side", at, "z.h", "z.p", gap)

    sections = _align(side(0).unionByName(side(1)), doc).withColumn("starts", F.lit(False))
    paragraphs = (sections.where(~F.col("kept"))
                  .select(*doc, "side", "at.section", F.col("after").alias("gap"), F.posexplode("p").alias("paragraph", "h"))
                  .select(*doc, "side", F.struct("section", "paragraph").alias("at"), "h", "gap"))
    return (_changes(_align(paragraphs, doc), doc).unionByName(_changes(sections.where("kept"), doc))
            .select("doc_id", "section", "paragraph", "change"))


def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """(doc_id, text, next_text): the text of the next row by ascending doc_id
    (nulls first, rows of one doc_id by text); after the last row the first.

    The rows are dealt into ranges of doc_id and each range is sorted on its
    own; a range also gets the first rows of the one after it. Range bounds are
    ids of the table, as many as ranges (by default four for each shuffle
    partition), found in a scan of the id column alone.
    """
    ranges = ranges or 4 * shuffle_parts(docs.sparkSession)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-2**63))
    d = docs.select("doc_id", text_or_empty().alias("text"), key.alias("key"))
    least, cuts = d.agg(F.min("key"), F.percentile_approx(
        "key", [i / ranges for i in range(1, ranges)] or [0.5], 20 * ranges)).first()
    if least is None:
        return d.select("doc_id", "text", F.lit(None).cast("string").alias("next_text"))
    bounds = sorted(set(cuts) - {least})
    # Two steps of about the square root of their number find a row's range.
    step = max(1, int(len(bounds) ** 0.5))
    coarse, fine = bounds[::step], [bounds[i:i + step] for i in range(0, len(bounds), step)]
    if bounds:
        i = F.size(F.filter(F.lit(coarse), lambda b: b <= F.col("key")))
        j = F.size(F.filter(F.element_at(F.array(*[F.lit(f) for f in fine]), F.greatest(i, F.lit(1))),
                            lambda b: b <= F.col("key")))
        at = F.when(i == 0, 0).otherwise((i - 1) * step + j)
    else:
        at = F.lit(0)
    d = d.withColumn("at", at)
    # A bound opens the range that it lies in.
    is_bound = F.element_at(F.lit(bounds), F.greatest(F.col("at"), F.lit(1))) == F.col("key") if bounds else F.lit(False)
    is_bound = is_bound & (F.col("at") > 0)
    place = lambda r, tail: F.struct(r.cast("int").alias("range"), F.lit(tail).alias("tail"))
    copies = F.array_compact(F.array(
        place(F.col("at"), 0), F.when(is_bound, place(F.col("at") - 1, 1)),
        F.when(F.col("key") == least, place(F.lit(len(bounds)), 1))))
    dealt = d.select("doc_id", "text", "key", F.explode(copies).alias("c")).select("doc_id", "text", "key", "c.*")
    w = Window.partitionBy("range").orderBy("tail", "key", "text")
    return (dealt.withColumn("next_text", F.lead("text").over(w)).where(F.col("tail") == 0)
            .select("doc_id", "text", "next_text"))


def op2_query(documents: DataFrame) -> DataFrame:
    n = F.char_length("text")
    d = (with_next(documents.select("doc_id", "text"))
         .withColumn("edited", F.concat(F.expr("substring(text, 1, char_length(text) - char_length(text) div 4)"),
                                        F.expr("substring(next_text, 1, int(char_length(text) div 4))")))
         .select("doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
                 *[runs(F.col(x)).alias(y) for x, y in (("text", "a"), ("edited", "b"), ("next_text", "c"))]))
    d = d.select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("a")).alias("fingerprint"),
                 fingerprint(F.col("b")).alias("edited_fingerprint"), fingerprint(F.col("c")).alias("next_fingerprint"),
                 *[leaves(F.col(x)).alias(x) for x in "abc"])
    c = F.col
    return d.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                    likeness(c("a"), c("b"), c("fingerprint"), c("edited_fingerprint")).alias("near_edited"),
                    likeness(c("a"), c("c"), c("fingerprint"), c("next_fingerprint")).alias("near_next"),
                    F.size("a").cast("long").alias("n_leaves"))


def _sql_runs(t: str) -> str:
    return (f"list_transform(string_split({t}, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)), "
            f"lambda p: regexp_extract_all(p, '{RUN}')))")


def _sql_root(x: str) -> str:
    paragraph = "sha256(array_to_string(list_transform(p, lambda r: sha256(r)), ''))"
    return (f"sha256('root:' || array_to_string(list_transform({x}, lambda s: sha256('section:' || "
            f"array_to_string(list_transform(s, lambda p: {paragraph}), ''))), ''))")


def _sql_leaves(x: str) -> str:
    windows = f"list_transform(range(length(trim(r, ' ')) - {WINDOW - 1}), lambda i: substr(trim(r, ' '), i + 1, {WINDOW}))"
    own = f"case when regexp_matches(r, '[^ ]{{{STRETCH}}}') then {windows} else [trim(r, ' ')] end"
    return f"list_distinct(list_filter(flatten(list_transform(flatten(flatten({x})), lambda r: {own})), lambda y: y <> ''))"


def _sql_like(x: str, y: str, rx: str, ry: str) -> str:
    both = f"cast(len(list_intersect({x}, {y})) as double)"
    return (f"case when {rx} = {ry} then 1.0 when len({x}) + len({y}) = 0 then 0.0 "
            f"else {both} / (len({x}) + len({y}) - {both}) end")


OP2_SQL = f"""
with t as (select doc_id, coalesce(text, '') text from documents),
w as (select doc_id, text, length(text) n, coalesce(lead(text) over (order by doc_id, text),
             first_value(text) over (order by doc_id, text)) nx from t),
e as (select doc_id, n, text, nx, substring(text, 1, n - n // 4) || substring(nx, 1, n // 4) ed from w),
p as (select doc_id, n, sha256(ed) es, {_sql_runs('text')} a, {_sql_runs('ed')} b, {_sql_runs('nx')} c from e),
f as (select doc_id, n, es, {_sql_root('a')} r, {_sql_root('b')} er, {_sql_root('c')} nr,
             {_sql_leaves('a')} a, {_sql_leaves('b')} b, {_sql_leaves('c')} c from p)
select doc_id, cast(n as bigint) n_chars, es edited_sha256, r fingerprint, er edited_fingerprint,
       {_sql_like('a', 'b', 'r', 'er')} near_edited, {_sql_like('a', 'c', 'r', 'nr')} near_next, cast(len(a) as bigint) n_leaves from f"""
