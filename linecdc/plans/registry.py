"""Registered queries: one Spark plan per operator of the inventory, each with
the DuckDB SQL that states its expected answer (``oracle.py``).

Every query reads the benchmark tables at ``sf_dir`` (or data Spark derives
from them) in full. Queries that write (sinks, streams) write under a fresh
folder of the session's shared checkpoint location.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linecdc.functions.text import ISO_FORMAT, base_name, extension, join_lines, splitlines
from linecdc.operators import codec, query, sink
from linecdc.operators.detect import detect_changes
from linecdc.operators.diff import apply_changes, compare_versions, diff_lines, diff_per_file, diff_versions, pair_versions
from linecdc.operators.matching import (KEYS, factorised_pairs, match_lines, pair_counts, pairs_in_range, prepare,
                                        unique_pairs)
from linecdc.plans import oracle as O
from linecdc.session import scratch_path
from linecdc.sources import fixtures as fx
from linecdc.schema import EVENT_COLUMNS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

EV_OUT = (*EVENT_COLUMNS, "version", "change_seq")


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _versions_time(lines: DataFrame) -> DataFrame:
    return lines.select("file_name", "version").distinct().withColumn("detected_at", fx.version_time(F.col("version")))


def _fmt_ts(c: str):
    return F.date_format(F.col(c), ISO_FORMAT).alias(c)


# ---------------------------------------------------------------- sources / lines

@register("split_lines", """
select doc_id, cast(unnest(generate_series(1, len(s))) as integer) line_number, unnest(s) line
  from (select doc_id, string_split(text, chr(10)) s from documents)""")
def q_split_lines(spark, sf):
    d = fx.table(spark, sf, "documents")
    return d.select("doc_id", F.posexplode(splitlines(F.col("text"))).alias("p", "line")).select(
        "doc_id", (F.col("p") + 1).cast("int").alias("line_number"), "line")


@register("join_lines", "select doc_id, md5(text) text_md5 from documents")
def q_join_lines(spark, sf):
    """The lines of a text, joined again (the fixture's texts end without a newline)."""
    d = fx.table(spark, sf, "documents")
    return d.select("doc_id", F.md5(join_lines(splitlines(F.col("text"))).cast("binary")).alias("text_md5"))


def _o12(spark, sf):
    lines = fx.order_lines(spark, sf, (1, 2))
    old = lines.where(F.col("version") == 1).withColumn("version", F.lit(2).cast("long"))
    new = lines.where(F.col("version") == 2)
    return lines, old, new


@register("changed_files", O.with_(O.O_CTES, """
a as (select file_name, count(*) n, string_agg(line, chr(1) order by line_number) t
        from o_lines where version = 1 group by file_name),
b as (select file_name, count(*) n, string_agg(line, chr(1) order by line_number) t
        from o_lines where version = 2 group by file_name)""") + """
select coalesce(a.file_name, b.file_name) file_name,
       case when a.file_name is null then 'new' when b.file_name is null then 'missing'
            when a.n = b.n and a.t = b.t then 'unchanged' else 'changed' end status,
       coalesce(a.n, 0) old_lines, coalesce(b.n, 0) new_lines
  from a full outer join b on a.file_name = b.file_name""")
def q_changed_files(spark, sf):
    _, old, new = _o12(spark, sf)
    c = compare_versions(old, new)
    status = (F.when(F.col("old_lines") == 0, "new").when(F.col("new_lines") == 0, "missing")
              .when(F.col("changed"), "changed").otherwise("unchanged"))
    return c.select("file_name", status.alias("status"), "old_lines", "new_lines")


@register("file_baseline", O.with_(O.O_CTES) + """
select file_name, version, count(*) n_lines from o_lines
 where version = 2 and file_name not in (select file_name from o_lines where version = 1)
 group by file_name, version""")
def q_file_baseline(spark, sf):
    lines = fx.order_lines(spark, sf, (1, 2))
    det = detect_changes(lines.where(F.col("version") == 2), lines.where(F.col("version") == 1))
    return det.baseline


@register("file_missing_as_deletes", O.o_events() + """
select event_id, file_name, old_value, new_value, event_type, line_number, event_timestamp from events
union all
select {eid}, file_name, line, cast(null as varchar), 'DELETE', line_number, {ts}
  from o_lines where version = 1 and file_name not in (select file_name from o_lines where version = 2)
""".format(eid=O.event_id_sql("file_name", "2", "'DELETE'", "line_number"), ts=O.version_ts("2")))
def q_file_missing_as_deletes(spark, sf):
    """All files: those in both versions are diffed, missing ones deleted."""
    lines = fx.order_lines(spark, sf, (1, 2))
    cur, snap = lines.where(F.col("version") == 2), lines.where(F.col("version") == 1)
    names = lines.select("file_name").distinct().withColumn("version", F.lit(2).cast("long"))
    det = detect_changes(cur, snap, names.withColumn("detected_at", fx.version_time(F.col("version"))), missing_as_empty=True)
    return det.events.select(*EVENT_COLUMNS)


FILTER_EXTS = (".html", ".txt", ".csv", ".json")


@register("file_filter", """
select page_id, base file_name, ext from (
  select page_id, regexp_extract(p, '([^/]*)$', 1) base,
         lower(regexp_extract(regexp_extract(p, '([^/]*)$', 1), '(\\.[^.]+)$', 1)) ext
    from (select page_id, regexp_replace(url, '[?#].*$', '') p from pages))
 where ext in ('.html', '.txt', '.csv', '.json')""")
def q_file_filter(spark, sf):
    p = fx.table(spark, sf, "pages").select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("p"))
    out = p.select("page_id", base_name(F.col("p")).alias("file_name"), extension(F.col("p")).alias("ext"))
    return out.where(F.col("ext").isin(*FILTER_EXTS))


# ---------------------------------------------------------------- alignment on D

def _d_sides(spark, sf):
    from linecdc.operators.diff import to_sides
    old, new = fx.document_sides(spark, sf)
    return old, new, to_sides(old, new)


@register("match_pairs", O.with_(O.D_CTES, O.CHAIN_BLOCKS) + " select file_name, version, i, j from pr")
def q_match_pairs(spark, sf):
    _, _, L = _d_sides(spark, sf)
    tagged, _, _ = prepare(L)
    return unique_pairs(tagged)


@register("match_pair_counts", O.with_(O.D_CTES, """
c as (select file_name, version, line, sum(1 - side) na, sum(side) nb from L group by all)""") + """
select file_name, version, cast(sum(na * nb) as bigint) n_pairs, count(*) n_contents from c where na > 0 and nb > 0
 group by file_name, version""")
def q_match_pair_counts(spark, sf):
    """How many pairs of equal lines each comparison has, from the position lists."""
    tagged, _, _ = prepare(_d_sides(spark, sf)[2])
    return pair_counts(factorised_pairs(tagged)).withColumn("n_pairs", F.col("n_pairs").cast("long"))


@register("match_pairs_range", O.with_(O.D_CTES) + """
select a.file_name, a.version, a.pos i, b.pos j from L a join L b
    on a.file_name = b.file_name and a.version = b.version and a.line = b.line
 where a.side = 0 and b.side = 1 and a.pos < 64 and b.pos >= 8 and b.pos < 40""")
def q_match_pairs_range(spark, sf):
    """All pairs of old lines 0 to 63 and new lines 8 to 39, repeated lines included."""
    tagged, _, _ = prepare(_d_sides(spark, sf)[2])
    return pairs_in_range(factorised_pairs(tagged), 0, 64, 8, 40)


D_BLOCKS_SQL = O.with_(O.D_CTES, O.RECURSIVE_BLOCKS) + " select file_name, version, i, j, n from blk"


def _blocks(strategy, **kw):
    def q(spark, sf):
        _, _, L = _d_sides(spark, sf)
        return match_lines(L, strategy=strategy, **kw).blocks
    return q


register("matching_blocks", D_BLOCKS_SQL)(_blocks("auto"))
register("matching_blocks_r", D_BLOCKS_SQL)(_blocks("rounds"))
# Steps of eight old starts: the state of a greedy chain is handed on many times.
register("matching_blocks_p", D_BLOCKS_SQL)(_blocks("rounds", walk=8))


@register("diff_opcodes", O.with_(O.D_CTES, O.RECURSIVE_BLOCKS, O.EXT, O.OPCODES)
          + " select file_name, version, tag, i1, i2, j1, j2 from ops")
def q_diff_opcodes(spark, sf):
    _, _, L = _d_sides(spark, sf)
    return match_lines(L).opcodes


def _d_events(spark, sf):
    old, new = fx.document_sides(spark, sf)
    return diff_lines(old, new, fx.version_time(F.col("version")))


D_EVENTS_SQL = O.d_events()

register("diff_events_docs", D_EVENTS_SQL + " select * from events")(
    lambda spark, sf: _d_events(spark, sf).select(*EV_OUT))
# L2: the same events by a function of one file's two lists.
register("diff_events_per_file", D_EVENTS_SQL + " select * from events")(
    lambda spark, sf: diff_per_file(*fx.document_sides(spark, sf), fx.version_time(F.col("version"))).select(*EV_OUT))
for _name, _t in (("diff_updates", "UPDATE"), ("diff_inserts", "INSERT"), ("diff_deletes", "DELETE")):
    register(_name, D_EVENTS_SQL + f" select * from events where event_type = '{_t}'")(
        (lambda t: lambda spark, sf: _d_events(spark, sf).where(F.col("event_type") == t).select(*EV_OUT))(_t))


# ---------------------------------------------------------------- O diffs

def _o_events(spark, sf, versions=(1, 2)):
    lines = fx.order_lines(spark, sf, versions)
    return diff_versions(lines, _versions_time(lines))


@register("diff_events_orders", O.o_events("and version = 2") + " select * from events")
def q_diff_events_orders(spark, sf):
    return _o_events(spark, sf).select(*EV_OUT)


@register("change_summary", O.o_events("and version = 2")
          + " select file_name, event_type, count(*) n_changes from events group by all")
def q_change_summary(spark, sf):
    return query.change_summary(_o_events(spark, sf))


@register("detect_multi_version", O.o_events("") + " select * from events")
def q_detect_multi_version(spark, sf):
    return _o_events(spark, sf, (1, 2, 3)).select(*EV_OUT)


@register("apply_changes_orders", O.with_(O.O_CTES, O.O_PAIRS.format(vfilter="and version = 2"))
          + """ select l.file_name, l.version, l.line_number, l.line from o_lines l
                 join o_cmp c on c.file_name = l.file_name and c.version = l.version""")
def q_apply_changes_orders(spark, sf):
    lines = fx.order_lines(spark, sf, (1, 2))
    old, new = pair_versions(lines)
    return apply_changes(old, diff_lines(old, new))


@register("apply_changes_docs", O.with_(O.D_CTES)
          + " select file_name, version, cast(pos + 1 as integer) line_number, line from L where side = 1")
def q_apply_changes_docs(spark, sf):
    old, new = fx.document_sides(spark, sf)
    return apply_changes(old, diff_lines(old, new))


@register("snapshot_latest", O.with_(O.O_CTES) + """
select file_name, version, count(*) n_lines from o_lines
 where (file_name, version) in (select file_name, max(version) from o_lines group by file_name)
 group by file_name, version""")
def q_snapshot_latest(spark, sf):
    lines = fx.order_lines(spark, sf, (1, 2, 3))
    return sink.snapshot_latest(lines).groupBy("file_name", "version").agg(F.count("*").alias("n_lines"))


# ---------------------------------------------------------------- codec on E

@register("encode_events", O.e_with() + """
select event_id key, file_name, case when et <> 'INSERT' then cents end old_value,
       case when et <> 'DELETE' then cents end new_value, et event_type, line_number, event_timestamp,
       true nulls_written from ef""")
def q_encode_events(spark, sf):
    f = fx.event_fields(spark, sf)
    rec = sink.publish(f.select(*EVENT_COLUMNS))
    text = F.col("value").cast("string")
    d = F.from_json(text, codec.EVENT_SCHEMA)
    nulls_ok = F.lit(True)
    for c in ("old_value", "new_value"):
        nulls_ok = nulls_ok & (d[c].isNotNull() | F.contains(text, F.lit(f'"{c}":null')))
    return rec.select(F.col("key").cast("string").alias("key"),
                      *[d[c].alias(c) for c in EVENT_COLUMNS if c != "event_id"],
                      nulls_ok.alias("nulls_written"))


@register("decode_lenient", O.e_with() + """
select "partition", "offset", event_id, file_name, old_value, new_value, event_type, line_number,
       event_timestamp, kind = 'malformed' corrupt from dec""")
def q_decode_lenient(spark, sf):
    d = codec.decode(fx.log_records(spark, sf))
    return d.select("partition", "offset", *EVENT_COLUMNS, F.col(codec.CORRUPT).isNotNull().alias("corrupt"))


@register("decode_strict", O.e_with("""
g as (select *, md5(concat_ws(chr(1), 'file-changes', "partition", "offset")) h from recs)""") + """
select "partition", "offset",
       case when kind = 'ok' then 'ok' else 'rejected' end status,
       case kind when 'null' then 'null_value' when 'malformed' then 'malformed_json'
                 when 'extra' then 'unknown_key' end reason,
       case when kind in ('ok', 'extra') then event_id
            else concat_ws('-', h[1:8], h[9:12], h[13:16], h[17:20], h[21:32]) end event_id,
       case when kind in ('ok', 'extra') then file_name end file_name,
       case when kind in ('ok', 'extra') then new_value end new_value, event_timestamp from g""")
def q_decode_strict(spark, sf):
    return codec.decode_strict(fx.log_records(spark, sf)).select(
        "partition", "offset", "status", "reason", "event_id", "file_name", "new_value", "event_timestamp")


@register("validate_route", O.e_with() + """
select "partition", "offset", case when reason is null then 'valid' else 'dlq' end route, reason from routed""")
def q_validate_route(spark, sf):
    v = codec.validate(codec.decode(fx.log_records(spark, sf)))
    return v.select("partition", "offset",
                    F.when(F.col("reason").isNull(), "valid").otherwise("dlq").alias("route"), "reason")


@register("first_wins", O.e_with() + """ select event_id, new_value, "partition", "offset" from firsts""")
def q_first_wins(spark, sf):
    valid, _ = codec.route(codec.decode(fx.log_records(spark, sf)))
    return sink.first_wins(valid).select("event_id", "new_value", "partition", "offset")


# ---------------------------------------------------------------- sinks and table queries

TABLE_SQL_COLS = ("event_id, file_name, old_value, new_value, event_type, line_number, "
                  "strftime(ts, {iso}) event_timestamp").format(iso=O.ISO)


def _table_cols(df: DataFrame) -> DataFrame:
    return df.select("event_id", "file_name", "old_value", "new_value", "event_type", "line_number",
                     _fmt_ts("event_timestamp"))


@register("insert_if_absent", O.e_with() + f"""
select {TABLE_SQL_COLS}, cast(case when "offset" >= 1000000 then 1 else 0 end as bigint) batch_id from firsts""")
def q_insert_if_absent(spark, sf):
    rec = fx.log_records(spark, sf)
    path, dlq = scratch_path(spark, "table"), scratch_path(spark, "dlq")
    loaded = F.to_timestamp(F.lit("2024-03-01 00:00:00"))
    for b, cond in ((0, F.col("offset") < fx.REDELIVERY_OFFSET), (1, F.col("offset") >= fx.REDELIVERY_OFFSET)):
        sink.write_batch(rec.where(cond), path, dlq, "run0", b, loaded)
    # Replaying batch 1 changes nothing.
    sink.write_batch(rec.where(F.col("offset") >= fx.REDELIVERY_OFFSET), path, dlq, "run0", 1, loaded)
    t = sink.read_table(spark, path)
    return t.select("event_id", "file_name", "old_value", "new_value", "event_type", "line_number",
                    _fmt_ts("event_timestamp"), "batch_id")


def _change_table(spark, sf) -> DataFrame:
    """The change table as the sink leaves it (two batches a day apart), written as
    Parquet and read back, so lookups push their filters into the scan."""
    rec = fx.log_records(spark, sf)
    path, dlq = scratch_path(spark, "table"), scratch_path(spark, "dlq")
    again = F.col("offset") >= fx.REDELIVERY_OFFSET
    for b, (rows, day) in enumerate(((rec.where(~again), "2024-03-01"), (rec.where(again), "2024-03-02"))):
        sink.write_batch(rows, path, dlq, "run0", b, F.to_timestamp(F.lit(day + " 00:00:00")))
    return sink.read_table(spark, path)


@register("change_table_sql", O.e_with() + f"""
select {TABLE_SQL_COLS}, case when "offset" >= 1000000 then '2024-03-02' else '2024-03-01' end loaded from firsts""")
def q_change_table_sql(spark, sf):
    """The sink's table by its declared name and columns."""
    rec = fx.log_records(spark, sf)
    path, dlq = scratch_path(spark, "table"), scratch_path(spark, "dlq")
    again = F.col("offset") >= fx.REDELIVERY_OFFSET
    for b, (rows, day) in enumerate(((rec.where(~again), "2024-03-01"), (rec.where(again), "2024-03-02"))):
        sink.write_batch(rows, path, dlq, "run0", b, F.to_timestamp(F.lit(day + " 00:00:00")))
    name = "change_table_" + path.rsplit("-", 1)[-1][:12]
    t = sink.define_table(spark, name, path)
    return t.select("event_id", "file_name", "old_value", "new_value", "event_type", "line_number",
                    _fmt_ts("event_timestamp"), F.date_format("loaded_at", "yyyy-MM-dd").alias("loaded"))


@register("recent_changes", O.e_with() + f"""
select {TABLE_SQL_COLS} from firsts order by "offset" >= 1000000 desc, ts desc, event_id limit 20""")
def q_recent_changes(spark, sf):
    return _table_cols(query.recent_changes(_change_table(spark, sf), 20))


@register("lookup_file", O.e_with() + f"select {TABLE_SQL_COLS} from firsts where file_name = 'user_7.log'")
def q_lookup_file(spark, sf):
    return _table_cols(query.changes_for_file(_change_table(spark, sf), "user_7.log"))


@register("lookup_time_range", O.e_with() + f"""
select {TABLE_SQL_COLS} from firsts where ts >= timestamp '2024-01-10' and ts < timestamp '2024-01-12'""")
def q_lookup_time_range(spark, sf):
    return _table_cols(query.changes_in_range(_change_table(spark, sf), "2024-01-10 00:00:00", "2024-01-12 00:00:00"))


@register("lookup_operation", O.e_with() + f"select {TABLE_SQL_COLS} from firsts where event_type = 'DELETE'")
def q_lookup_operation(spark, sf):
    return _table_cols(query.changes_by_operation(_change_table(spark, sf), "DELETE"))


@register("rename_vocabulary", O.e_with() + f"""
select event_id, file_name file_path, old_value, new_value, event_type operation, line_number,
       strftime(ts, {O.ISO}) detected_at,
       case when "offset" >= 1000000 then '2024-03-02' else '2024-03-01' end ingested_at from firsts""")
def q_rename_vocabulary(spark, sf):
    t = _change_table(spark, sf).drop("run_id", "batch_id")
    return query.rename_vocabulary(t.withColumn("event_timestamp", F.date_format("event_timestamp", ISO_FORMAT))
                                   .withColumn("loaded_at", F.date_format("loaded_at", "yyyy-MM-dd")))


@register("dlq_redrive", O.e_with() + """
select event_id key, kind <> 'ok' unreadable, case when kind in ('null', 'malformed') then 'redriven' else 'pending' end status
  from routed r join ef using (src_id) where r.reason is not null""".replace("event_id key", "ef.event_id key")
          .replace("kind <> 'ok'", "kind in ('null', 'malformed')"))
def q_dlq_redrive(spark, sf):
    """what a redrive of the sink's own dead letters sends, entry by entry."""
    from linecdc.plans.streams import _repair
    from linecdc.streaming.pipelines import redrive_dlq

    table, dlq, topic = (scratch_path(spark, n) for n in ("table", "dlq", "topic"))
    sink.write_batch(fx.log_records(spark, sf), table, dlq, "run0", 0)
    state = redrive_dlq(spark, dlq, topic, _repair(spark, sf), "redrive", 0)
    return state.select(F.col("key").cast("string").alias("key"), F.col("reason").isin("null_value", "malformed_json").alias("unreadable"),
                        "status")


@register("debounce", O.with_(O.N_CTES) + f"""
select file_name, strftime(min(ts), {O.ISO}) session_start, strftime(max(ts), {O.ISO}) session_end,
       count(*) n_saves, arg_max(version, (ts, version)) version from ns group by file_name, sess""")
def q_debounce(spark, sf):
    d = query.debounce(fx.notifications(spark, sf), 600)
    return d.select("file_name", _fmt_ts("session_start"), _fmt_ts("session_end"), "n_saves", "version")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from linecdc.plans import streams  # noqa: F401  (registers the streaming queries)
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from linecdc.plans import streams  # noqa: F401
    return dict(ORACLE)
