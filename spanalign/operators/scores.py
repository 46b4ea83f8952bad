"""Rule -> document -> group -> corpus roll-ups (AGG-1..8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanalign.functions.text import n_bytes, n_chars, rule_key


def _pct(num, den):
    return F.coalesce(F.try_divide(num.cast("double") * 100.0, den.cast("double")), F.lit(0.0))


def doc_scores(rule_flags: DataFrame, docs: DataFrame, keep=("grp",), flag: str = "fully_aligned") -> DataFrame:
    """AGG-1: score = aligned / rules * 100 (0 without rules); distinct
    ``type_start_end`` counts as the reference's report totals; n_chars and
    n_bytes; is_perfect = no failing rule.

    Rule-less documents are kept by a union with one marker row per
    document (no join); both inputs are doc_id-partitioned, so the grouping
    adds no exchange."""
    r = rule_flags.select("doc_id", F.lit(None).cast("string").alias("grp_"),
                          rule_key("type", "s", "e").alias("rule_key"), F.col(flag).alias("_ok"),
                          F.lit(None).cast("bigint").alias("_nc"), F.lit(None).cast("bigint").alias("_nb"))
    d = docs.select("doc_id", F.col(keep[0]).cast("string").alias("grp_") if keep else F.lit(None).cast("string").alias("grp_"),
                    F.lit(None).cast("string").alias("rule_key"), F.lit(None).cast("boolean").alias("_ok"),
                    n_chars("text").alias("_nc"), n_bytes("text").alias("_nb"))
    # distinct keys by a two-level aggregate (per key, then per document):
    # both levels group on supersets of doc_id, so the corpus partitioning
    # is reused; count_distinct would be rewritten with an Expand that drops
    # the partitioning and costs another shuffle
    per_key = r.unionByName(d).groupBy("doc_id", "rule_key").agg(
        F.max("grp_").alias("grp_"), F.count("rule_key").alias("_n"), F.count_if(F.col("_ok")).alias("_a"),
        F.max(F.col("_ok").cast("int")).alias("_ka"), F.max("_nc").alias("_nc"), F.max("_nb").alias("_nb"))
    g = per_key.groupBy("doc_id").agg(
        F.max("grp_").alias(keep[0] if keep else "grp"),
        F.sum("_n").alias("n_rules"),
        F.sum("_a").alias("n_aligned"),
        F.count("rule_key").alias("n_distinct_rules"),
        F.count_if(F.col("rule_key").isNotNull() & (F.col("_ka") == 1)).alias("n_distinct_aligned"),
        F.max("_nc").alias("n_chars"), F.max("_nb").alias("n_bytes"))
    return (g.withColumn("score", _pct(F.col("n_aligned"), F.col("n_rules")))
             .withColumn("is_perfect", F.col("n_aligned") == F.col("n_rules")))


def doc_scores_covering(docs: DataFrame, pieces_col, keep=("grp",)) -> DataFrame:
    """AGG-1 for covering spans (chunks): one row per document straight from
    the fast-path struct; no explode, no shuffle."""
    from spanalign.operators.align import covering_word_split
    # the pieces are a column of their own, so that their regex runs once a row
    x = docs.select("doc_id", *keep, pieces_col.alias("_pieces"), n_chars("text").alias("n_chars"), n_bytes("text").alias("n_bytes"))
    x = x.select("doc_id", *keep, covering_word_split("_pieces").alias("_w"), "n_chars", "n_bytes")
    return x.select("doc_id", *keep,
                    F.col("_w.n_rules").cast("bigint").alias("n_rules"),
                    F.col("_w.n_aligned").cast("bigint").alias("n_aligned"),
                    F.col("_w.n_rules").cast("bigint").alias("n_distinct_rules"),
                    F.col("_w.n_aligned").cast("bigint").alias("n_distinct_aligned"),
                    "n_chars", "n_bytes") \
            .withColumn("score", _pct(F.col("n_aligned"), F.col("n_rules"))) \
            .withColumn("is_perfect", F.col("n_aligned") == F.col("n_rules"))


def group_stats(scores: DataFrame, by="grp", include_perfect: bool = True) -> DataFrame:
    """AGG-3: file count, average score (all files, or imperfect files only
    as in the reference's reports; null when none), rule totals (distinct
    keys, as reported), overall alignment, total size. A group whose files
    are all perfect is kept. Partial aggregation runs map-side, so one hot
    group costs one small row per task in the shuffle."""
    by = [by] if isinstance(by, str) else list(by)
    sc = F.col("score") if include_perfect else F.when(~F.col("is_perfect"), F.col("score"))
    g = scores.groupBy(*by).agg(
        F.count(F.lit(1)).alias("file_count"),
        F.avg(sc).alias("avg_score"),
        F.sum("n_distinct_rules").alias("total_rules"),
        F.sum("n_distinct_aligned").alias("total_aligned"),
        F.sum("n_chars").alias("total_code_size"),
        F.sum("n_bytes").alias("total_bytes"))
    return g.withColumn("overall_alignment", _pct(F.col("total_aligned"), F.col("total_rules")))


def with_timing(stats: DataFrame, run_log: DataFrame, by="grp") -> DataFrame:
    """Attach measured seconds per group from a run log (the reference's
    total_analysis_time / avg_processing_speed); the run log is one small
    row per group and run."""
    t = run_log.groupBy(F.col(by).alias("_by")).agg(F.sum("seconds").alias("total_analysis_time"))
    return (stats.join(t, F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by")
            .withColumn("avg_processing_speed",
                        F.coalesce(F.try_divide(F.col("total_code_size").cast("double"),
                                                F.col("total_analysis_time")), F.lit(0.0))))


def corpus_summary(stats: DataFrame) -> DataFrame:
    """AGG-4: grand totals over all groups; with measured seconds (stats from
    ``with_timing``) also the average processing speed, characters a second."""
    timed = [F.coalesce(F.try_divide(F.sum("total_code_size").cast("double"), F.sum("total_analysis_time")), F.lit(0.0))
             .alias("avg_processing_speed")] if "total_analysis_time" in stats.columns else []
    return stats.agg(F.count(F.lit(1)).alias("total_languages"),
                     F.sum("file_count").alias("total_files"),
                     F.sum("total_rules").alias("total_rules"),
                     F.sum("total_aligned").alias("total_aligned"),
                     F.sum("total_code_size").alias("total_code_size"), *timed)


def rank_groups(stats: DataFrame, by: str = "grp", metric: str = "avg_score") -> DataFrame:
    """AGG-5: 1-based rank by metric desc, ties by name. ``stats`` is the
    already aggregated per-group table (one row per group), so an
    unpartitioned window is fine here."""
    w = Window.orderBy(F.col(metric).desc_nulls_last(), F.col(by).asc())
    return stats.withColumn("rank", F.row_number().over(w).cast("bigint"))


def rank_speed(runs: DataFrame, by: str = "grp", size: str = "total_code_size",
               seconds: str = "total_analysis_time") -> DataFrame:
    """AGG-6: processing speed = size / seconds (0 when seconds is 0),
    ranked desc, ties by name. There may be a row per user: the ranks come
    from a range sort, not from one window over all rows."""
    from spanalign.operators.batching import with_index
    sp = F.coalesce(F.try_divide(F.col(size).cast("double"), F.col(seconds).cast("double")), F.lit(0.0))
    x = with_index(runs.withColumn("speed", sp), [F.col("speed").desc(), F.col(by).asc()], name="rank")
    return x.withColumn("rank", (F.col("rank") + 1).cast("bigint"))


def top_and_bottom(stats: DataFrame, n: int = 5, by: str = "grp", metric: str = "avg_score") -> DataFrame:
    """AGG-7: the top n groups, each row also naming the best and the worst
    group (max_by / min_by over the whole, already aggregated, table)."""
    whole = Window.partitionBy()
    r = (rank_groups(stats, by, metric)
         .withColumn("best", F.max_by(by, F.struct(F.col(metric), -F.col("rank"))).over(whole))
         .withColumn("worst", F.min_by(by, F.struct(F.col(metric), -F.col("rank"))).over(whole)))
    return r.filter(F.col("rank") <= n).select(by, metric, "rank", "best", "worst")


def efficiency(stats: DataFrame) -> DataFrame:
    """AGG-8: aligned / total rules per group (fraction)."""
    return stats.withColumn("efficiency", F.coalesce(F.try_divide(
        F.col("total_aligned").cast("double"), F.col("total_rules").cast("double")), F.lit(0.0)))


def unaligned_list(detail: DataFrame, compact: bool = False, keep=()) -> DataFrame:
    """AGG-2: ordered list of failing rules per document (16-field form, or
    the 8-field form of the dataset report with ``compact``)."""
    f = detail.filter(~F.col("fully_aligned"))
    if compact:
        fields = ["rule_key", "type", "start_byte", "end_byte", "start_aligned", "end_aligned", "crossing_start", "crossing_end"]
    else:
        fields = ["rule_key", "type", "start_byte", "end_byte", "start_aligned", "end_aligned",
                  "crossing_start", "crossing_end", "crossing_start_reason", "crossing_end_reason",
                  "token_start_context", "token_end_context", "explain_tree_sitter", "explain_tokenizer",
                  "fully_aligned", "text_preview"]
    fields = [c for c in fields if c in f.columns]
    item = F.struct(F.col("start_byte").alias("_o1"), F.col("end_byte").alias("_o2"),
                    F.col("span_id").alias("_o3"), F.struct(*[F.col(c) for c in fields]).alias("_r"))
    g = f.groupBy("doc_id", *keep).agg(F.sort_array(F.collect_list(item)).alias("_l"))
    return g.select("doc_id", *keep, F.col("_l._r").alias("unaligned_rules"))


def file_results(scores: DataFrame, unaligned: DataFrame, extra=("grp",)) -> DataFrame:
    """The reference's per-file record: score, distinct rule totals, failing
    rules, size and the perfect flag. Both inputs are keyed and partitioned
    by doc_id, so the join needs no exchange of its own."""
    x = scores.join(unaligned.select("doc_id", "unaligned_rules"), "doc_id", "left")
    return x.select("doc_id", *[c for c in extra if c in x.columns], "score",
                    F.col("n_distinct_rules").alias("total_rules"), F.col("n_distinct_aligned").alias("aligned_rules"),
                    F.coalesce("unaligned_rules", F.array()).alias("unaligned_rules"),
                    F.col("n_chars").alias("code_size"), "is_perfect")
