"""Order-dependent operators that stay distributed when one key is huge.

A plain ``row_number() over (partition by file order by pos)`` puts every
row of a file into one task. Here ordering work is split by *position
block*: a window runs inside ``(keys, block)`` (bounded by the block width),
block totals are summed over a small table (one row per block), and the
block offsets are joined back. Used for line numbering, change order and
any running count over a file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows per block: bounds the rows a single window partition holds.
DEFAULT_BLOCK_BITS = 16


def _cols(names: Sequence[str]) -> list[Column]:
    return [F.col(c) for c in names]


def prefix_sum(df: DataFrame, keys: Sequence[str], position: str, value: Column | str,
               out: str, order: Sequence[str] = (), block_bits: int = DEFAULT_BLOCK_BITS,
               inclusive: bool = False) -> DataFrame:
    """Running sum of ``value`` within ``keys`` ordered by ``(position, *order)``.

    ``position`` must be a non-negative integer column whose rows per
    ``2**block_bits`` range are bounded (positions, ids, offsets). Exclusive by
    default (sum of the rows strictly before).
    """
    keys = list(keys)
    val = F.col(value) if isinstance(value, str) else value
    tmp_v, tmp_b, tmp_l, tmp_o = "_ps_v", "_ps_b", "_ps_local", "_ps_off"
    d = df.withColumn(tmp_v, val.cast("long")).withColumn(
        tmp_b, F.shiftright(F.col(position).cast("long"), block_bits))
    w = Window.partitionBy(*_cols(keys), F.col(tmp_b)).orderBy(F.col(position), *_cols(order))
    frame = w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    d = d.withColumn(tmp_l, F.coalesce(F.sum(tmp_v).over(frame), F.lit(0)))
    totals = d.groupBy(*keys, tmp_b).agg(F.sum(tmp_v).alias("_ps_t"))
    wb = Window.partitionBy(*_cols(keys)).orderBy(tmp_b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, tmp_b, F.coalesce(F.sum("_ps_t").over(wb), F.lit(0)).alias(tmp_o))
    # The rows lie by key and block already; the offsets, a row a key at least, join them
    # there and never go whole through the driver.
    return (d.join(offsets.hint("merge"), [*keys, tmp_b], "inner")
            .withColumn(out, F.col(tmp_l) + F.col(tmp_o))
            .drop(tmp_v, tmp_b, tmp_l, tmp_o))


def rank_within(df: DataFrame, keys: Sequence[str], position: str, out: str,
                order: Sequence[str] = (), block_bits: int = DEFAULT_BLOCK_BITS,
                one_based: bool = False) -> DataFrame:
    """Dense position of each row within ``keys`` ordered by ``(position, *order)``
    (rows must be unique in that order). 0-based unless ``one_based``."""
    r = prefix_sum(df, keys, position, F.lit(1), out, order=order, block_bits=block_bits)
    return r.withColumn(out, F.col(out) + 1) if one_based else r
