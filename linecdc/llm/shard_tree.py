"""Sharding: a weighted hash tree of regions, racks and shards.

A document descends level by level. At each node every child draws
``-ln(u) / weight`` with ``u`` a hash of the key and the child's name; the least
draw wins, so a child gets a share of the node's keys in proportion to its
weight, and a child's draw does not depend on its siblings. If a child's weight
grows, keys move only into it, if it shrinks, only out of it: movement stays
within subtrees on the path to a changed weight. The draws are md5 values, so
any engine can repeat them.

``layout(n)`` is the tree for ``n`` shards: the base tree (2 regions of 3 racks
of 4 shards), then each further shard as a region of its own with one rack.
Adding a shard leaves all weights of the old regions as they are, so keys move
only into the new shard. (A shard added inside an existing rack would also pull
keys into its neighbours below the grown subtree; use ``assign`` with an
explicit tree for that.)

Nulls and edge cases: a null text has size 8 and crc 0; a null key draws as the
empty string; rows with equal keys share a shard; repeated rows get slots of
their own. Extra columns are not looked at. Only DataFrame functions run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linecdc.llm.common import text_or_empty

BASE = (2, 3, 4)
SLOT_BLOCKS = 256  # blocks of a shard that are numbered each on their own

Tree = dict[str, dict[str, dict[int, float]]]  # region -> rack -> shard -> weight


def layout(shards: int, base=BASE) -> Tree:
    """The tree for ``shards`` shards of weight 1."""
    regions, racks, leaves = base
    tree: Tree = {}
    for s in range(shards):
        if s < regions * racks * leaves:
            r, k = f"r{s // (racks * leaves)}", f"k{s // leaves % racks}"
        else:
            r, k = f"r{regions + s - regions * racks * leaves}", "k0"
        tree.setdefault(r, {}).setdefault(k, {})[s] = 1.0
    return tree


def draw(key: Column, name: str, weight: float) -> Column:
    """Exponential draw of rate ``weight`` from the first 52 bits of an md5."""
    h = F.conv(F.substring(F.md5(F.concat(key, F.lit("|" + name)).cast("binary")), 1, 13), 16, 10).cast("long")
    return -F.log((h + 0.5) / float(2**52)) / weight


def _winner(options: list[tuple[Column, Column]]) -> Column:
    """The value with the least draw; ties go to the first."""
    if len(options) == 1:
        return options[0][1]
    return F.array_min(F.array(*[F.struct(d.alias("d"), F.lit(i).alias("i"), v.alias("v"))
                                 for i, (d, v) in enumerate(options)]))["v"]


def assign(df: DataFrame, key: str, tree: Tree, name: str) -> DataFrame:
    """Adds ``name``: the shard of column ``key``. One step per level; a row draws
    only among the children of the node that it has reached."""
    weight = lambda c: sum(map(weight, c.values())) if isinstance(c, dict) else float(c)
    at, nodes = None, {"": tree}  # node name -> children, all of one level
    for _level in ("region", "rack", "shard"):
        step = F.lit(None).cast("string")
        for node, children in nodes.items():
            pick = _winner([(draw(F.col(key), f"{node}/{c}", weight(w)), F.lit(f"{node}/{c}")) for c, w in children.items()])
            step = pick if at is None else F.when(F.col(at) == node, pick).otherwise(step)
        at = f"_{name}_{_level}"
        df = df.withColumn(at, step)
        nodes = {f"{node}/{c}": w for node, children in nodes.items() for c, w in children.items()}
    shard = F.element_at(F.split(at, "/"), -1).cast("int")
    return df.withColumn(name, shard).drop(*[f"_{name}_{x}" for x in ("region", "rack", "shard")])


def gapless(df: DataFrame, group: str, order: list[str], block: Column, name: str = "slot") -> DataFrame:
    """Numbers 0.. without gaps in every ``group``, in order of block, then
    ``order``. Rows are numbered per (group, block); the blocks' offsets come from
    a table of their counts, which is as large as groups x blocks."""
    d = df.withColumn("_block", block)
    here = Window.partitionBy(group, "_block").orderBy(*order)
    counts = d.groupBy(group, "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(group, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (d.withColumn("_rn", F.row_number().over(here)).join(offsets, [group, "_block"])
            .withColumn(name, (F.col("_off") + F.col("_rn") - 1).cast("long")).drop("_block", "_rn", "_off"))


def place(docs: DataFrame, shards: int = 24, blocks: int = SLOT_BLOCKS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, grown_shard, slot)."""
    t, key = text_or_empty(), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(t) + F.lit(8)).cast("long").alias("size"),
                       F.crc32(t.cast("binary")).alias("text_crc32"), key.alias("_key"))
    rows = assign(assign(rows, "_key", layout(shards), "shard"), "_key", layout(shards + 1), "grown_shard")
    block = F.conv(F.substring(F.md5(F.concat(F.lit("block|"), F.col("_key")).cast("binary")), 1, 8), 16, 10).cast("long") % blocks
    return gapless(rows, "shard", ["doc_id", "text_crc32", "size"], block).drop("_key")


def op6_query(documents: DataFrame, shards: int = 24) -> DataFrame:
    return place(documents.select("doc_id", "text"), shards).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def _sql_tree(key: str, tree: Tree, name: str) -> list[str]:
    """Steps of ``assign`` as SQL columns ``name_region``, ``name_rack``, ``name_shard``."""
    weight = lambda c: sum(map(weight, c.values())) if isinstance(c, dict) else float(c)
    at, nodes, out = None, {"": tree}, []
    for level in ("region", "rack", "shard"):
        cases = []
        for node, children in nodes.items():
            draws = ", ".join(
                f"{{'d': -ln((cast('0x' || md5({key} || '|{node}/{c}')[1:13] as bigint) + 0.5) / 4503599627370496.0) / {weight(w)}, "
                f"'i': {i}, 'v': '{node}/{c}'}}" for i, (c, w) in enumerate(children.items()))
            cases.append((node, f"list_min([{draws}])['v']"))
        expr = cases[0][1] if at is None else "case " + at + "".join(f" when '{n}' then {e}" for n, e in cases) + " end"
        at = f"{name}_{level}"
        out.append(f"{expr} as {at}")
        nodes = {f"{n}/{c}": w for n, children in nodes.items() for c, w in children.items()}
    return out


def op6_sql(shards: int = 24, blocks: int = SLOT_BLOCKS) -> str:
    key = "coalesce(cast(doc_id as varchar), '')"
    steps = list(zip(_sql_tree("k", layout(shards), "s"), _sql_tree("k", layout(shards + 1), "g")))
    chain = "".join(f", l{i} as (select *, {a}, {b} from l{i - 1})" for i, (a, b) in enumerate(steps, 1))
    return f"""
with tbl as (select list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
               lambda a, b: case when a & 1 = 1 then xor(3988292384, a >> 1) else a >> 1 end)) t),
b as (select doc_id, {key} k, hex(encode(coalesce(text, ''))) h from documents),
l0 as (select doc_id, k, length(h) // 2 + 8 as size, xor(list_reduce(
         list_prepend(4294967295, list_transform(range(length(h) // 2), lambda i: cast('0x' || substr(h, 2 * i + 1, 2) as bigint))),
         lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) as text_crc32,
         cast('0x' || md5('block|' || k)[1:8] as bigint) % {blocks} as blk from b, tbl){chain}
select doc_id, cast(size as bigint) size, text_crc32, 'key' as law, cast(split_part(s_shard, '/', 4) as integer) shard,
       cast(row_number() over (partition by s_shard order by blk, doc_id, text_crc32, size) - 1 as bigint) slot,
       cast(split_part(g_shard, '/', 4) as integer) grown_shard from l3"""


OP6_SQL = op6_sql()
