"""Ordered slices, fixed-size batches and flush parts (FLT-7, AGG-9..11).

A 0-based position in an ordered list is computed without a global
single-partition window: a range-partitioned sort spreads even a hot group
over many tasks, each row gets its in-partition rank from
monotonically_increasing_id, and a small table of per-(partition, group)
counts turns ranks into positions. The sorted ids are checkpointed to the
shared checkpoint folder first so that a lost executor cannot renumber rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanalign.operators.prefix import prefix_sums
from spanalign.session import ensure_checkpoint_dir


def with_index(df: DataFrame, order_by="doc_id", group: str | None = None, name: str = "idx") -> DataFrame:
    """Add the 0-based position of each row in ``order_by`` order (names or
    columns), within ``group`` when given (null is a group like any other).
    ``df`` is checkpointed as it is: pass narrow rows."""
    order = list(order_by) if isinstance(order_by, (list, tuple)) else [order_by]
    grp = [group] if group else []
    ensure_checkpoint_dir(df.sparkSession)
    s = (df.orderBy(*grp, *order)
           .withColumn("_pid", F.spark_partition_id())
           .withColumn("_mid", F.monotonically_increasing_id())
           .checkpoint(eager=True))
    return _positions(s, grp, name)


def _positions(s: DataFrame, grp: list, name: str) -> DataFrame:
    """Partition ids and ranks in them to positions: one row per partition and
    group is joined back; AQE broadcasts it when it is small."""
    cnt = s.groupBy("_pid", *grp).agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_m0"))
    w = Window.partitionBy(*grp).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    off = cnt.select(F.col("_pid").alias("_p"), *[F.col(g).alias(f"_g_{g}") for g in grp], "_m0",
                     F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    on = F.col("_pid") == F.col("_p")
    for g in grp:
        on = on & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    out = s.join(off, on).withColumn(name, F.col("_off") + F.col("_mid") - F.col("_m0"))
    return out.drop("_pid", "_mid", "_m0", "_off", "_p", *[f"_g_{g}" for g in grp])


def with_read_index(df: DataFrame, name: str = "idx") -> DataFrame:
    """Add the 0-based position of each row in the order in which Spark reads
    ``df`` (files by path, rows as they stand): no sort and nothing kept, the
    rows of each partition are counted and numbered on from those before. The
    broadcast table has one row per input partition."""
    s = df.withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id())
    cnt = df.select(F.spark_partition_id().alias("_p")).groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    off = cnt.select("_p", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    rank = F.col("_mid").bitwiseAND((1 << 33) - 1)   # the row's number in its partition
    return s.join(F.broadcast(off), F.col("_pid") == F.col("_p")).withColumn(name, F.col("_off") + rank).drop("_pid", "_mid", "_p", "_off")


def slice_docs(df: DataFrame, start_index: int = 0, max_files: int | None = None, order_by="doc_id",
               group: str | None = None) -> DataFrame:
    """FLT-7: the resumable slice [start_index, start_index + max_files) of
    the ordered list (per group when given); ``idx`` is kept. ``order_by``
    names the rows: only it and the group are sorted and kept, the other
    columns (texts) are joined back to the slice."""
    order = list(order_by) if isinstance(order_by, (list, tuple)) else [order_by]
    keys = list(dict.fromkeys([*order, *([group] if group else [])]))
    x = with_index(df.select(*keys), order, group)
    cond = F.col("idx") >= start_index
    if max_files is not None and max_files > 0:
        cond = cond & (F.col("idx") < start_index + max_files)
    x = x.filter(cond)
    if set(keys) == set(df.columns):
        return x
    x = x.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "idx")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return df.join(x, on).drop(*[f"_k_{k}" for k in keys])


def _part_stats(x: DataFrame, by, include_perfect: bool) -> DataFrame:
    sc = F.col("score") if include_perfect else F.when(~F.col("is_perfect"), F.col("score"))
    g = x.groupBy(*by).agg(
        F.count(F.lit(1)).alias("file_count"),
        F.count_if(~F.col("is_perfect")).alias("n_imperfect"),
        F.coalesce(F.avg(sc), F.lit(0.0)).alias("avg_score"),
        F.sum("n_distinct_rules").alias("total_rules"),
        F.sum("n_distinct_aligned").alias("total_aligned"),
        F.sum("n_chars").alias("total_code_size"))
    return g.withColumn("overall_alignment", F.coalesce(F.try_divide(
        F.col("total_aligned") * 100.0, F.col("total_rules").cast("double")), F.lit(0.0)))


def batch_stats(scores: DataFrame, size: int, start_index: int = 0, max_files: int | None = None,
                group: str = "grp", order_by="doc_id", include_perfect: bool = False) -> DataFrame:
    """AGG-9: fixed-size batches over the ordered, sliced list of each group;
    per batch totals over all files, average over imperfect files by
    default (the report convention; 0.0 when none)."""
    x = with_index(scores, order_by, group).filter(F.col("idx") >= start_index)
    if max_files is not None and max_files > 0:
        x = x.filter(F.col("idx") < start_index + max_files)
    x = x.withColumn("batch", F.floor((F.col("idx") - start_index) / size).cast("int") + 1)
    return _part_stats(x, [group, "batch"], include_perfect)


def flush_parts(scores: DataFrame, every: int, group: str = "grp", order_by="doc_id",
                include_perfect: bool = True, report_convention: bool = False) -> DataFrame:
    """AGG-10: part k holds accepted documents (k-1)*every .. k*every-1 of
    its group; the last part holds the remainder.

    ``report_convention`` reproduces the reference's part files exactly:
    numbering still counts every accepted document, but a part's totals,
    file count and average cover only its imperfect documents (parts made
    only of perfect documents then have no row)."""
    x = with_index(scores, order_by, group)
    x = x.withColumn("part", F.floor(F.col("idx") / every).cast("int") + 1)
    if report_convention:
        x = x.filter(~F.col("is_perfect"))
    return _part_stats(x, [group, "part"], include_perfect)


def stop_after(batches: DataFrame, max_files: int, group: str = "grp", order: str = "batch") -> DataFrame:
    """AGG-11: keep batches until the cumulative file count reaches
    ``max_files``, including the batch that reaches it."""
    x = batches.withColumn("_block", F.floor(F.col(order) / 1024))
    x = prefix_sums(x, [group], ["_block"], [order], {"_before": "file_count"})
    return x.filter(F.col("_before") < max_files).drop("_before", "_block")


def totals_of_totals(batches: DataFrame, group: str = "grp") -> DataFrame:
    """Run totals over the kept batches of each group."""
    g = batches.groupBy(group).agg(F.count(F.lit(1)).alias("n_batches"), F.sum("file_count").alias("file_count"),
                                   F.sum("total_rules").alias("total_rules"), F.sum("total_aligned").alias("total_aligned"),
                                   F.sum("total_code_size").alias("total_code_size"))
    return g.withColumn("overall_alignment", F.coalesce(F.try_divide(
        F.col("total_aligned") * 100.0, F.col("total_rules").cast("double")), F.lit(0.0)))
