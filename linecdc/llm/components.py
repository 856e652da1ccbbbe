"""Connected components of an edge table, by alternating large and small stars.

Each round is two group-bys and joins on the nodes; its edges are written to the
shared checkpoint folder, so lineage stays short and a lost executor repeats one
round at most. The rounds grow with the logarithm of the longest path. Nothing
but a count and a checksum reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linecdc.session import materialize


def _mark(edges: DataFrame):
    return edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()


def components(edges: DataFrame, u: str, v: str) -> DataFrame:
    """(node, root): every node of an edge between two different nodes with the
    least node of its component (the root's own row included)."""
    e = edges.where(F.col(u) != F.col(v)).select(
        F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct()
    e = materialize(e, "components")
    mark = _mark(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(least, "u").where(F.col("v") > F.col("u"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        e = materialize(small.select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v"))
                        .union(least.select("u", F.col("m").alias("v"))).distinct(), "components")
        was, mark = mark, _mark(e)
        if was == mark:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
