"""Prefix sums within groups of any size.

A window over a whole group is one task, however large the group. Here the
rows are summed within blocks of the group, and the blocks' totals, tables
that shrink by the block size, carry the sums from block to block."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def prefix_sums(df: DataFrame, group: list[str], block: list[str], order: list, sums: dict[str, str]) -> DataFrame:
    """Add exclusive prefix sums within ``group`` in the order (block, order).

    ``sums`` maps each new column to the summed one (``"1"`` counts rows).
    Group columns may be null (nulls are one group), block columns not. Blocks
    of several columns are summed column by column, so that no window holds
    more rows than one column has values. ``df`` is read twice: pass a table,
    or something cheap."""
    before = lambda keys, *by: Window.partitionBy(*keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    one = lambda c: F.lit(1).cast("long") if c == "1" else F.col(c)
    zero = lambda c: F.coalesce(c, F.lit(0))
    # a struct of the group's columns: equal where nulls are equal, so that joins keep null groups
    x = df.withColumn("_g", F.struct(*group) if group else F.struct(F.lit(0)))
    keys = ["_g", *block]
    totals = x.groupBy(*keys).agg(*[F.sum(one(c)).alias(f"_t_{n}") for n, c in sums.items()])
    base = None
    for i in range(len(block)):
        upper = keys[: i + 1]
        level = totals if i == len(block) - 1 else totals.groupBy(*upper, block[i]).agg(*[F.sum(f"_t_{n}").alias(f"_t_{n}") for n in sums])
        level = level.select(*upper, block[i], *[zero(F.sum(f"_t_{n}").over(before(upper, block[i]))).alias(f"_b{i}_{n}") for n in sums])
        base = level if base is None else level.join(base, upper)
    rows = x.select("*", *[zero(F.sum(one(c)).over(before(keys, *order))).alias(f"_w_{n}") for n, c in sums.items()])
    total = lambda n: sum((F.col(f"_b{i}_{n}") for i in range(len(block))), F.col(f"_w_{n}"))
    return rows.join(base, keys).select(*[F.col(f"`{c}`") for c in df.columns], *[total(n).alias(n) for n in sums])
