"""DuckDB SQL that states the expected answer of every registered query,
computed independently from the base tables (the correctness gate).

Block matching for repeated lines uses a recursive CTE that follows the
alignment rule literally (longest block, ties to smallest old then new index,
recurse left and right); unique-line inputs use the equivalent run form.
"""

from __future__ import annotations

ISO = "'%Y-%m-%dT%H:%M:%S.%f+00:00'"

UUID = ("concat_ws('-', substr({h},1,8), substr({h},9,4), substr({h},13,4), "
        "substr({h},17,4), substr({h},21,12))")


def uuid_sql(expr: str) -> str:
    return UUID.format(h=expr)


def event_id_sql(fn="file_name", ver="version", et="event_type", ln="line_number") -> str:
    return uuid_sql(f"md5(concat_ws(chr(1), {fn}, cast({ver} as varchar), {et}, cast({ln} as varchar)))")


def version_ts(v: str) -> str:
    return f"strftime(timestamp '2024-02-01 00:00:00' + ({v} - 1) * interval 1 day, {ISO})"


# ---------------------------------------------------------------- O

O_CTES = """
o_base as (select o_orderkey k, o_custkey % 16 f, o_orderstatus st,
       cast(round(o_totalprice * 100) as bigint) c,
       (o_orderkey * 7919) % 101 h, (o_orderkey * 104729) % 101 h3 from orders),
o_s2 as (select *, case when h >= 5 and h < 15 and f <> 0 then 'X' else st end st2
         from o_base where f <> 1 and (h >= 5 or f = 0)),
o_l as (
  select f, 1 v, k, 0 sub, concat('#', k, ' ', st, ' ', c) line
    from o_base where f <> 2
  union all select f, 2, k, 0, concat('#', k, ' ', st2, ' ', c) from o_s2
  union all select f, 2, k, 1, concat('#', k, ' NEW') from o_base
    where f not in (0, 1) and h >= 15 and h < 20
  union all select f, 3, k, 0, concat('#', k, ' ', case when h3 >= 5 and h3 < 15 and f <> 0 then 'X' else st2 end, ' ', c)
    from o_s2 where h3 >= 5 or f = 0
  union all select f, 3, k, 1, concat('#', k, ' NEW') from o_s2
    where f not in (0, 1) and h3 >= 15 and h3 < 20),
o_lines as (select concat('orders_', f, '.txt') file_name, cast(v as bigint) version,
       cast(row_number() over (partition by f, v order by k, sub) as integer) line_number, line from o_l)
"""

# Version pairs (new version, previous version of the same file) of O.
O_PAIRS = """
o_ver as (select distinct file_name, version from o_lines),
o_pairs as (select file_name, version, lag(version) over (partition by file_name order by version) prev
            from o_ver),
o_cmp as (select file_name, version, prev from o_pairs where prev is not null {vfilter})
"""

# L(file_name, version, side, pos, line) for the O comparisons.
O_SIDES = """
L as (select p.file_name, p.version, 0 side, l.line_number - 1 pos, l.line
        from o_cmp p join o_lines l on l.file_name = p.file_name and l.version = p.prev
      union all
      select p.file_name, p.version, 1, l.line_number - 1, l.line
        from o_cmp p join o_lines l on l.file_name = p.file_name and l.version = p.version)
"""

# Blocks for unique-line inputs: all matches kept; runs of consecutive matches.
CHAIN_BLOCKS = """
cnt as (select file_name, version, line, sum(case when side = 0 then 1 else 0 end) ca,
               sum(case when side = 1 then 1 else 0 end) cb from L group by all),
pr as (select a.file_name, a.version, a.pos i, b.pos j
         from L a join L b on a.file_name = b.file_name and a.version = b.version and a.line = b.line
         join cnt c on c.file_name = a.file_name and c.version = a.version and c.line = a.line
        where a.side = 0 and b.side = 1 and c.ca = 1 and c.cb = 1),
rk as (select *, row_number() over (partition by file_name, version order by i) - 1 r from pr),
blk as (select file_name, version, min(i) i, min(j) j, count(*) n from rk
        group by file_name, version, i - r, j - r)
"""

EXT = """
ext as (select file_name, version, sum(case when side = 0 then 1 else 0 end) la,
               sum(case when side = 1 then 1 else 0 end) lb from L group by all)
"""

# ---------------------------------------------------------------- D

D_CTES = """
dl as (select doc_id, unnest(generate_series(1, len(s))) n, unnest(s) line
         from (select doc_id, string_split(text, chr(10)) s from documents)),
dh as (select *, (doc_id * 31 + n * 7) % 23 h from dl),
dm as (select doc_id, case when h = 3 then n + 3.5 else n + 0.0 end o, 0 sub,
              case when h = 1 then concat(line, ' *') else line end line, n from dh where h <> 0
       union all select doc_id, n + 0.0, 1, line, n from dh where h = 2),
L as (select concat('doc_', doc_id) file_name, cast(2 as bigint) version, 0 side, n - 1 pos, line from dl
      union all
      select concat('doc_', doc_id), cast(2 as bigint), 1,
             row_number() over (partition by doc_id order by o, n, sub) - 1, line from dm)
"""

# The alignment rule as a recursive CTE: each step takes every open segment,
# finds its longest diagonal run of matches (ties: smallest i, then j) and
# opens the part left and right of it.
RECURSIVE_BLOCKS = """
pairs as materialized (select a.file_name f, a.pos i, b.pos j from L a join L b
    on a.file_name = b.file_name and a.line = b.line and a.side = 0 and b.side = 1),
rext as (select file_name f, max(case when side = 0 then pos + 1 else 0 end) la,
                max(case when side = 1 then pos + 1 else 0 end) lb from L group by file_name),
seg(f, alo, ahi, blo, bhi, bi, bj, bk) as (
  select f, 0, la, 0, lb, 0, 0, -1 from rext
  union all
  select f, alo, ahi, blo, bhi, best.i, best.j, best.n from (
   select f, alo, ahi, blo, bhi, arg_min({'i': i0, 'j': j0, 'n': n}, (-n, i0, j0)) best from (
    select f, alo, ahi, blo, bhi, d, g, min(i) i0, min(j) j0, count(*) n from (
     select p.f, alo, ahi, blo, bhi, j - i d, i, j,
            i - row_number() over (partition by p.f, alo, ahi, blo, bhi, j - i order by i) g
     from (select f, unnest(case when bk = -1
             then [{'alo': alo, 'ahi': ahi, 'blo': blo, 'bhi': bhi}]
             else [{'alo': alo, 'ahi': bi, 'blo': blo, 'bhi': bj},
                   {'alo': bi + bk, 'ahi': ahi, 'blo': bj + bk, 'bhi': bhi}] end, recursive := true)
           from seg) s
     join pairs p on p.f = s.f and p.i >= s.alo and p.i < s.ahi and p.j >= s.blo and p.j < s.bhi)
    group by all)
   group by all)),
blk as (select f file_name, cast(2 as bigint) version, bi i, bj j, bk n from seg where bk > 0)
"""

# ---------------------------------------------------------------- blocks -> events

OPCODES = """
bs as (select file_name, version, i, j, n from blk
       union all select file_name, version, la, lb, 0 from ext),
gaps as (select file_name, version,
                coalesce(lag(i + n) over w, 0) i1, i i2, coalesce(lag(j + n) over w, 0) j1, j j2
           from bs window w as (partition by file_name, version order by i, j)),
ops as (select *, i2 - i1 na, j2 - j1 nb,
               case when i2 > i1 and j2 > j1 then 'replace' when j2 = j1 then 'delete' else 'insert' end tag
          from gaps where i2 > i1 or j2 > j1)
"""

EVENTS = """
ops2 as (select *, coalesce(sum(greatest(na, nb)) over (partition by file_name, version order by i1
                 rows between unbounded preceding and 1 preceding), 0) seq0 from ops),
ex as (select *, unnest(generate_series(1, greatest(na, nb))) k from ops2),
ev as (select *, case when k <= least(na, nb) then 'UPDATE' when k > nb then 'DELETE' else 'INSERT' end event_type
         from ex),
ev2 as (select file_name, version, event_type,
               cast(case when event_type = 'DELETE' then i1 + k else j1 + k end as integer) line_number,
               case when event_type <> 'INSERT' then i1 + k - 1 end old_pos,
               case when event_type <> 'DELETE' then j1 + k - 1 end new_pos,
               seq0 + k change_seq from ev),
events as (select {eid} event_id, e.file_name, a.line old_value, b.line new_value, e.event_type,
                  e.line_number, {ts} event_timestamp, e.version, e.change_seq
             from ev2 e
             left join L a on a.file_name = e.file_name and a.version = e.version and a.side = 0 and a.pos = e.old_pos
             left join L b on b.file_name = e.file_name and b.version = e.version and b.side = 1 and b.pos = e.new_pos)
""".format(eid=event_id_sql("e.file_name", "e.version", "e.event_type", "e.line_number"),
           ts=version_ts("e.version"))


def with_(*parts: str) -> str:
    return "with recursive " + ",\n".join(p.strip() for p in parts)


def o_events(vfilter: str = "and version = 2") -> str:
    """CTE list ending in ``events`` for O comparisons."""
    return with_(O_CTES, O_PAIRS.format(vfilter=vfilter), O_SIDES, CHAIN_BLOCKS, EXT, OPCODES, EVENTS)


def d_events() -> str:
    return with_(D_CTES, RECURSIVE_BLOCKS, EXT, OPCODES, EVENTS)


# ---------------------------------------------------------------- E

E_CTES = """
ef as (select event_id src_id, concat('e', event_id) event_id,
              concat('user_', user_id % 20, '.log') file_name,
              case event_type when 'signup' then 'INSERT' when 'purchase' then 'UPDATE'
                   when 'view' then 'UPDATE' when 'click' then 'DELETE' else 'BAD' end et,
              cast(cast(round(value * 100) as bigint) as varchar) cents,
              cast(json_extract_string(props, '$.k') as integer) line_number,
              strftime(ts, {iso}) event_timestamp, ts from events),
recs as (
  select src_id, cast(src_id % 4 as integer) "partition", cast(src_id // 4 as bigint) "offset",
         case when src_id % 211 = 0 then 'null' when src_id % 37 = 0 then 'malformed'
              when src_id % 53 = 0 then 'extra' else 'ok' end kind,
         event_id, file_name, case when et <> 'INSERT' then cents end old_value,
         case when et <> 'DELETE' then cents end new_value, et event_type, line_number, event_timestamp, ts
    from ef
  union all
  select src_id, cast(src_id % 4 as integer), cast(src_id // 4 + 1000000 as bigint), 'ok',
         event_id, file_name, case when et <> 'INSERT' then cents end, 'sent again',
         et, line_number, event_timestamp, ts
    from ef where src_id % 10 = 0),
dec as (select "partition", "offset", kind, src_id, ts,
               case when kind in ('ok', 'extra') then event_id end event_id,
               case when kind in ('ok', 'extra') then file_name end file_name,
               case when kind in ('ok', 'extra') then old_value end old_value,
               case when kind in ('ok', 'extra') then new_value end new_value,
               case when kind in ('ok', 'extra') then event_type end event_type,
               case when kind in ('ok', 'extra') then line_number end line_number,
               case when kind in ('ok', 'extra') then event_timestamp end event_timestamp
          from recs),
routed as (select *, case when kind = 'null' then 'null_value' when kind = 'malformed' then 'malformed_json'
                          when event_type not in ('INSERT', 'UPDATE', 'DELETE') then 'bad_event_type' end reason
             from dec),
valid as (select * from routed where reason is null),
firsts as (select * from (select *, row_number() over (partition by event_id order by "partition", "offset") rn
                            from valid) where rn = 1)
""".format(iso=ISO)


def e_with(*more: str) -> str:
    return with_(E_CTES, *more)


N_CTES = """
nt as (select concat('user_', user_id % 20) file_name, ts, cast(event_id as bigint) version from events),
nb as (select *, case when lag(ts) over (partition by file_name order by ts, version) is null
                        or ts - lag(ts) over (partition by file_name order by ts, version) > interval 10 minute
                      then 1 else 0 end brk from nt),
ns as (select *, sum(brk) over (partition by file_name order by ts, version
                                rows between unbounded preceding and current row) sess from nb)
"""
