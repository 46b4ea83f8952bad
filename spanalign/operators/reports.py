"""Report and chart tables (AGG-12..17): all inputs are already aggregated
per group (one row per group, or per group and scheme), so the small
literal dimension tables joined here are bounded by the literal itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanalign.functions.patterns import COST_SCALES, LANGUAGE_CATEGORIES, TIME_UNITS


def mapping_table(spark: SparkSession, mapping: dict, key: str = "grp", value: str = "category") -> DataFrame:
    """{value: [keys]} as a two-column DataFrame (a literal; its size is the
    literal's size)."""
    rows = [(k, v) for v, ks in mapping.items() for k in ks]
    return spark.createDataFrame(rows, f"{key} string, {value} string")


def category_stats(stats: DataFrame, mapping: dict | None = None, by: str = "grp",
                   metric: str = "avg_score") -> DataFrame:
    """AGG-12: per category of groups the mean, population std, count, the
    sorted score list and the box-plot five numbers (linear percentiles)."""
    m = mapping_table(stats.sparkSession, mapping or LANGUAGE_CATEGORIES, by, "category")
    x = stats.join(F.broadcast(m), by)
    q = F.percentile(F.col(metric), F.array(*[F.lit(p) for p in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    g = x.groupBy("category").agg(F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("std"),
                                  F.count(F.lit(1)).alias("count"), F.sort_array(F.collect_list(metric)).alias("scores"),
                                  q.alias("_q"))
    return g.select("category", "mean", "std", "count", "scores",
                    *[F.col("_q")[i].alias(n) for i, n in enumerate(["min", "q1", "median", "q3", "max"])])


def score_histogram(values: DataFrame, col: str = "avg_score", bins: int = 8) -> DataFrame:
    """AGG-13: equal-width histogram from min to max, the last bin closed
    (values equal to max fall in it); all-equal values use [v-0.5, v+0.5]
    as the range. Every bin is kept and the mean is attached as the marker
    line. The values are read once: the counts of distinct values are joined
    with their one-row extremes."""
    counts = values.groupBy(F.col(col).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    every = counts.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.try_divide(F.sum(F.col("v") * F.col("n")), F.sum(F.when(F.col("v").isNotNull(), F.col("n")))).alias("mean"))
    half = F.when(F.col("lo") == F.col("hi"), F.lit(0.5)).otherwise(F.lit(0.0))
    ends = every.filter(F.col("lo").isNotNull()).select((F.col("lo") - half).alias("lo"), (F.col("hi") + half).alias("hi"), "mean")
    ends = ends.withColumn("w", (F.col("hi") - F.col("lo")) / bins)
    place = F.least(F.floor((F.col("v") - F.col("lo")) / F.col("w")).cast("int"), F.lit(bins - 1))
    n = counts.filter(F.col("v").isNotNull()).join(F.broadcast(ends)).groupBy(place.alias("bin")).agg(F.sum("n").alias("n"))
    all_bins = ends.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return (all_bins.join(n, "bin", "left")
            .select("bin", (F.col("lo") + F.col("bin") * F.col("w")).alias("lo"), (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("hi"),
                    F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), "mean"))


def cross_group_report(stats: DataFrame, by: str = "grp"):
    """AGG-14: (rankings, summary). Rankings: language, avg_score,
    total_rules, aligned_rules, alignment_rate by average score; summary:
    analysed groups, total files / rules / aligned rules, mean of the
    averages, overall alignment rate."""
    from spanalign.operators.scores import rank_groups
    r = rank_groups(stats, by).select(
        "rank", F.col(by).alias("language"), "avg_score", "total_rules", F.col("total_aligned").alias("aligned_rules"),
        F.col("overall_alignment").alias("alignment_rate"), "file_count")
    s = stats.agg(F.count(F.lit(1)).alias("analyzed_languages"), F.sum("file_count").alias("total_files"),
                  F.sum("total_rules").alias("total_rules"), F.sum("total_aligned").alias("total_aligned_rules"),
                  F.avg("avg_score").alias("average_score"))
    s = s.withColumn("overall_alignment_rate", F.coalesce(F.try_divide(
        F.col("total_aligned_rules") * 100.0, F.col("total_rules").cast("double")), F.lit(0.0)))
    return r, s


def rules_vs_alignment(stats: DataFrame, by: str = "grp") -> DataFrame:
    """AGG-15 scatter data: total rules against alignment rate, point size
    by file count."""
    return stats.select(F.col(by).alias("language"), "total_rules", F.col("overall_alignment").alias("alignment_rate"),
                        "file_count")


def ranking_bars(stats: DataFrame, by: str = "grp") -> DataFrame:
    """AGG-15 bar data: groups by average score with the mean line."""
    w = Window.partitionBy()  # one row per group: a tiny table
    from spanalign.operators.scores import rank_groups
    return rank_groups(stats, by).select("rank", F.col(by).alias("language"), "avg_score",
                                         F.avg("avg_score").over(w).alias("mean_line"))


def compare_schemes(stats_by_scheme: DataFrame, schemes, by: str = "grp") -> DataFrame:
    """AGG-16: group x scheme table of avg score, overall alignment and file
    count. One pivot over the literal scheme list gives every group a slot
    for every scheme (holes stay null), then the slots are turned back into
    rows by a generator - no join, and the input lineage runs once."""
    metrics = ["avg_score", "overall_alignment", "file_count"]
    wide = stats_by_scheme.groupBy(by).pivot("scheme", list(schemes)).agg(*[F.first(m).alias(m) for m in metrics])
    rows = F.array(*[F.struct(F.lit(s).alias("scheme"), *[F.col(f"`{s}_{m}`").alias(m) for m in metrics]) for s in schemes])
    return wide.select(by, F.inline(rows))


def comparison_matrix(cmp_long: DataFrame, schemes, by: str = "grp", metric: str = "avg_score") -> DataFrame:
    """AGG-16 wide form: one column per scheme (pivot over the literal list)."""
    return cmp_long.groupBy(by).pivot("scheme", list(schemes)).agg(F.first(metric))


def _human(sec):
    """Seconds as text in the largest fitting unit (fixed unit ladder)."""
    c = None
    for upper, div, unit in TIME_UNITS:
        txt = F.format_string(f"%.2f {unit}", sec / F.lit(float(div)))
        if upper is None:
            c = c.otherwise(txt)
        elif c is None:
            c = F.when(sec < upper, txt)
        else:
            c = c.when(sec < upper, txt)
    return c


def project_cost(stats: DataFrame, speed_col: str = "speed", avg_size_col: str = "avg_size",
                 avg_size: float = 0.0, by: str = "grp") -> DataFrame:
    """AGG-17: projected time for 100 .. 10^8 files from a measured speed
    (bytes/s); ``avg_size`` <= 0 uses the observed mean size. The scale
    ladder is a literal array exploded per group (seven rows each)."""
    scales = F.array(*[F.struct(F.lit(n).cast("bigint").alias("files"), F.lit(lbl).alias("label"))
                       for n, lbl in COST_SCALES])
    size = F.col(avg_size_col) if avg_size <= 0 else F.lit(float(avg_size))
    x = stats.select(by, F.col(speed_col).alias("speed"), size.alias("used_size"), F.explode(scales).alias("_s"))
    sec = F.when(F.col("speed") > 0, F.col("used_size") * F.col("_s.files") / F.col("speed")).otherwise(F.lit(0.0))
    return x.select(by, F.col("_s.files").alias("files"), F.col("_s.label").alias("label"), "used_size",
                    sec.alias("seconds"), _human(sec).alias("human"),
                    (sec / F.col("_s.files") * 1000.0).alias("ms_per_file"))


def comparison_document(cmp_long: DataFrame, by: str = "grp") -> DataFrame:
    """SNK-4 document shape: one row {languages, models, data: map<group,
    map<scheme, struct<avg_score, overall_alignment, file_count>>>}. Its
    size is groups x schemes (a handful x a handful), so one row is safe."""
    metrics = F.struct("avg_score", "overall_alignment", "file_count")
    per_group = cmp_long.groupBy(by).agg(
        F.map_from_entries(F.collect_list(F.struct("scheme", metrics))).alias("_m"),
        F.collect_set("scheme").alias("_s"))
    return per_group.agg(
        F.sort_array(F.collect_list(by)).alias("languages"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("_s")))).alias("models"),
        F.map_from_entries(F.collect_list(F.struct(by, "_m"))).alias("data"))
