"""Report, chart, comparison, cost and metric-series plans
(AGG-6, AGG-7, AGG-8, AGG-12..22)."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanalign.functions.patterns import COST_SCALES, TIME_UNITS
from spanalign.operators.inrow import tolerance_counts
from spanalign.operators.reports import (category_stats, compare_schemes, cross_group_report, project_cost,
                                         ranking_bars, rules_vs_alignment, score_histogram)
from spanalign.operators.scores import (corpus_summary, efficiency, group_stats, rank_speed, top_and_bottom,
                                        with_timing)
from spanalign.operators.series import (baseline_delta, micros, peak_point, phase_compare, run_summary,
                                        series_summary)
from spanalign.plans.catalog import (SQL_CHUNKS, SQL_DOC_SCORES, SQL_DOCS, r6, register, sql_group_stats)
from spanalign.plans.common import CHUNK, docs
from spanalign.plans.queries_align import SQL_CHUNK_RULES, sql_tokens
from spanalign.plans.queries_core import chunk_doc_scores
from spanalign.sources.tables import read_table, spread

# sources src0..src19 split into two categories by their number
SOURCE_CATEGORIES = {"low": [f"src{i}" for i in range(10)], "high": [f"src{i}" for i in range(10, 20)]}

SQL_SOURCE_DOCS = SQL_DOCS.replace("SELECT doc_id, lang AS grp, text, source", "SELECT doc_id, source AS grp, text, lang")
SQL_GS = f"WITH {SQL_DOCS}, {SQL_CHUNKS}, {SQL_DOC_SCORES}, {sql_group_stats(True)}"


def lang_stats(spark, sf):
    return group_stats(chunk_doc_scores(spark, sf), "grp")


def source_stats(spark, sf):
    """Group statistics by source: the corpus carries source along, so no
    join back to the documents table is needed."""
    from spanalign.operators.scores import doc_scores_covering
    from spanalign.operators.spans import chunk_pieces
    from spanalign.plans.common import docs
    from spanalign.sources.tables import spread
    d = spread(docs(spark, sf)).select("doc_id", F.col("source").alias("grp"), "text")
    return group_stats(doc_scores_covering(d, chunk_pieces("text", CHUNK)), "grp")


@register("top_and_bottom", SQL_GS + """,
r AS (SELECT grp, avg_score, row_number() OVER (ORDER BY avg_score DESC, grp) AS rank FROM gs)
SELECT grp, round(avg_score, 6) AS avg_score, rank, (SELECT grp FROM r ORDER BY avg_score DESC, rank LIMIT 1) AS best,
  (SELECT grp FROM r ORDER BY avg_score ASC, rank DESC LIMIT 1) AS worst FROM r WHERE rank <= 2""")
def top_and_bottom_q(spark, sf):
    """AGG-7: top 2 languages plus best and worst."""
    return r6(top_and_bottom(lang_stats(spark, sf), n=2))


@register("efficiency", SQL_GS + """
SELECT grp, round(CASE WHEN total_rules = 0 THEN 0.0 ELSE total_aligned * 1.0 / total_rules END, 6) AS efficiency FROM gs""")
def efficiency_q(spark, sf):
    """AGG-8: aligned / total rules per language."""
    return r6(efficiency(lang_stats(spark, sf)).select("grp", "efficiency"))


@register("category_stats", f"""WITH {SQL_SOURCE_DOCS}, {SQL_CHUNKS}, {SQL_DOC_SCORES}, {sql_group_stats(True)},
c AS (SELECT CASE WHEN CAST(substr(grp, 4) AS INTEGER) < 10 THEN 'low' ELSE 'high' END AS category, avg_score FROM gs)
SELECT category, round(avg(avg_score), 6) AS mean, round(stddev_pop(avg_score), 6) AS std, count(*) AS count,
  list_transform(list_sort(list(avg_score)), lambda x: round(x, 6)) AS scores,
  round(quantile_cont(avg_score, 0.0), 6) AS min, round(quantile_cont(avg_score, 0.25), 6) AS q1,
  round(quantile_cont(avg_score, 0.5), 6) AS median, round(quantile_cont(avg_score, 0.75), 6) AS q3,
  round(quantile_cont(avg_score, 1.0), 6) AS max FROM c GROUP BY category""")
def category_stats_q(spark, sf):
    """AGG-12: sources grouped into two categories; mean, population std,
    count, score list and five-number summary."""
    c = category_stats(source_stats(spark, sf), SOURCE_CATEGORIES)
    return r6(c).withColumn("scores", F.transform("scores", lambda x: F.round(x, 6)))


@register("score_histogram", f"""WITH {SQL_DOCS}, {SQL_CHUNKS}, {SQL_DOC_SCORES},
e AS (SELECT min(score) AS lo0, max(score) AS hi0, avg(score) AS mean FROM dss),
e2 AS (SELECT CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS lo, CASE WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END AS hi, mean FROM e),
b AS (SELECT least(CAST(floor((score - lo) / ((hi - lo) / 8)) AS INTEGER), 7) AS bin FROM dss, e2),
c AS (SELECT bin, count(*) AS n FROM b GROUP BY bin)
SELECT CAST(k AS INTEGER) AS bin, round(lo + k * (hi - lo) / 8, 6) AS lo, round(lo + (k + 1) * (hi - lo) / 8, 6) AS hi,
  CAST(coalesce(n, 0) AS BIGINT) AS n, round(mean, 6) AS mean
FROM e2, range(0, 8) t(k) LEFT JOIN c ON c.bin = t.k""")
def score_histogram_q(spark, sf):
    """AGG-13: 8-bin histogram of per-document chunk scores with the mean."""
    return r6(score_histogram(chunk_doc_scores(spark, sf), "score", 8))


@register("cross_group_report", SQL_GS + """
SELECT row_number() OVER (ORDER BY avg_score DESC, grp) AS rank, grp AS language, round(avg_score, 6) AS avg_score,
  total_rules, total_aligned AS aligned_rules, round(overall_alignment, 6) AS alignment_rate, file_count FROM gs""")
def cross_group_report_q(spark, sf):
    """AGG-14 rankings part."""
    r, _ = cross_group_report(lang_stats(spark, sf))
    return r6(r)


@register("cross_group_summary", SQL_GS + """
SELECT count(*) AS analyzed_languages, CAST(sum(file_count) AS BIGINT) AS total_files, CAST(sum(total_rules) AS BIGINT) AS total_rules,
  CAST(sum(total_aligned) AS BIGINT) AS total_aligned_rules, round(avg(avg_score), 6) AS average_score,
  round(100.0 * sum(total_aligned) / sum(total_rules), 6) AS overall_alignment_rate FROM gs""")
def cross_group_summary_q(spark, sf):
    """AGG-14 summary part."""
    _, s = cross_group_report(lang_stats(spark, sf))
    return r6(s)


@register("rules_vs_alignment", SQL_GS + """
SELECT grp AS language, total_rules, round(overall_alignment, 6) AS alignment_rate, file_count FROM gs""")
def rules_vs_alignment_q(spark, sf):
    """AGG-15: scatter data of total rules against alignment rate."""
    return r6(rules_vs_alignment(lang_stats(spark, sf)))


@register("ranking_bars", SQL_GS + """
SELECT row_number() OVER (ORDER BY avg_score DESC, grp) AS rank, grp AS language, round(avg_score, 6) AS avg_score,
  round(avg(avg_score) OVER (), 6) AS mean_line FROM gs""")
def ranking_bars_q(spark, sf):
    """AGG-15: ranking bar data with the mean line."""
    return r6(ranking_bars(lang_stats(spark, sf)))


# a run log derived from the corpus: a run per source and language that took a second for each million characters
SQL_TIMED = SQL_GS + """,
lg AS (SELECT grp, sum(s) AS total_analysis_time FROM (SELECT grp, source, sum(length(text)) / 1e6 AS s FROM d GROUP BY 1, 2) GROUP BY grp)"""


def timed_stats(spark, sf):
    from spanalign.plans.common import docs
    runs = docs(spark, sf).groupBy("grp", "source").agg((F.sum(F.char_length("text")) / 1e6).alias("seconds"))
    return with_timing(lang_stats(spark, sf), runs)


@register("group_stats_timed", SQL_TIMED + """
SELECT gs.grp, total_code_size, round(total_analysis_time, 6) AS total_analysis_time,
  round(total_code_size / total_analysis_time, 6) AS avg_processing_speed FROM gs JOIN lg ON lg.grp = gs.grp""")
def group_stats_timed_q(spark, sf):
    """AGG-3 with the seconds of a run log: time and speed per language."""
    return r6(timed_stats(spark, sf).select("grp", "total_code_size", "total_analysis_time", "avg_processing_speed"))


@register("corpus_summary_timed", SQL_TIMED + """
SELECT count(*) AS total_languages, CAST(sum(file_count) AS BIGINT) AS total_files, CAST(sum(total_rules) AS BIGINT) AS total_rules,
  CAST(sum(total_aligned) AS BIGINT) AS total_aligned, CAST(sum(total_code_size) AS BIGINT) AS total_code_size,
  round(sum(total_code_size) / sum(total_analysis_time), 6) AS avg_processing_speed FROM gs JOIN lg ON lg.grp = gs.grp""")
def corpus_summary_timed_q(spark, sf):
    """AGG-4 with the average processing speed."""
    return r6(corpus_summary(timed_stats(spark, sf)))


CMP_SCHEMES = ["word", "pretok", "piece4"]


def _cmp_sql():
    toks = ", ".join(sql_tokens(f"tk_{s}", s) for s in CMP_SCHEMES)
    flags = " UNION ALL ".join(
        f"""SELECT cr.doc_id, cr.grp, '{s}' AS scheme,
  EXISTS (SELECT 1 FROM tk_{s} t WHERE t.doc_id = cr.doc_id AND t.s BETWEEN cr.s - 1 AND cr.s + 1)
  AND EXISTS (SELECT 1 FROM tk_{s} t WHERE t.doc_id = cr.doc_id AND t.e BETWEEN cr.e - 1 AND cr.e + 1) AS ok FROM cr"""
        for s in CMP_SCHEMES)
    return f"""WITH {SQL_DOCS}, {SQL_CHUNK_RULES}, {toks},
f AS ({flags}),
ds AS (SELECT doc_id, grp, scheme, count(*) AS n, count(*) FILTER (WHERE ok) AS a FROM f GROUP BY ALL)
SELECT grp, scheme, round(avg(100.0 * a / n), 6) AS avg_score, round(100.0 * sum(a) / sum(n), 6) AS overall_alignment,
  count(*) AS file_count FROM ds GROUP BY grp, scheme"""


@register("compare_schemes", _cmp_sql())
def compare_schemes_q(spark, sf):
    """AGG-16: M2 (tol=1) of chunk rules under three token schemes computed
    in one job, as a language x scheme table."""
    ds = tolerance_counts(spread(docs(spark, sf)), CHUNK, CMP_SCHEMES).filter("n_rules > 0")
    st = ds.groupBy("grp", "scheme").agg(F.avg(F.col("n_fully_aligned") * 100.0 / F.col("n_rules")).alias("avg_score"),
                                         (F.sum("n_fully_aligned") * 100.0 / F.sum("n_rules")).alias("overall_alignment"),
                                         F.count(F.lit(1)).alias("file_count"))
    return r6(compare_schemes(st, CMP_SCHEMES))


SPEED = 1_000_000.0  # bytes per second, given


def _cost_sql():
    case = "CASE " + " ".join(f"WHEN sec < {u} THEN printf('%.2f {n}', sec / {d})" for u, d, n in TIME_UNITS if u) + \
        " ".join(f" ELSE printf('%.2f {n}', sec / {d}) END" for u, d, n in TIME_UNITS if not u)
    scales = ", ".join(f"({n}, '{lbl}')" for n, lbl in COST_SCALES)
    return f"""WITH {SQL_DOCS}, g AS (SELECT grp, avg(strlen(text)) AS used_size FROM d GROUP BY grp),
x AS (SELECT grp, CAST(files AS BIGINT) AS files, label, used_size, used_size * files / {SPEED} AS sec
      FROM g, (VALUES {scales}) s(files, label))
SELECT grp, files, label, round(used_size, 6) AS used_size, round(sec, 6) AS seconds, {case} AS human,
  round(sec / files * 1000.0, 6) AS ms_per_file FROM x"""


@register("project_cost", _cost_sql())
def project_cost_q(spark, sf):
    """AGG-17: projected processing time per language at a given speed of
    1 MB/s from the observed mean document size."""
    st = docs(spark, sf).groupBy("grp").agg(F.avg(F.octet_length("text")).alias("avg_size")) \
        .withColumn("speed", F.lit(SPEED))
    return r6(project_cost(st))


# ---------------------------------------------------------------- metric series on events
def _events(spark, sf):
    return read_table(spark, sf, "events").withColumnRenamed("user_id", "series_id")


@register("run_summary", """SELECT user_id AS run, count(*) FILTER (WHERE event_type <> 'error') AS n_success,
  count(*) FILTER (WHERE event_type = 'error') AS n_failure, count(*) AS n_total FROM events GROUP BY user_id""")
def run_summary_q(spark, sf):
    """AGG-18: events as a run log (error = failed run) per user."""
    e = read_table(spark, sf, "events").select(F.col("user_id").alias("run"),
                                               F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"))
    return run_summary(e, "run")


@register("rank_speed", """WITH r AS (SELECT user_id AS grp, sum(value) AS total_code_size,
  (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS total_analysis_time FROM events GROUP BY user_id),
s AS (SELECT *, CASE WHEN total_analysis_time = 0 THEN 0.0 ELSE total_code_size / total_analysis_time END AS speed FROM r)
SELECT grp, round(speed, 6) AS speed, row_number() OVER (ORDER BY speed DESC, grp) AS rank FROM s""")
def rank_speed_q(spark, sf):
    """AGG-6: users ranked by value per second of activity."""
    e = read_table(spark, sf, "events")
    r = e.groupBy(F.col("user_id").alias("grp")).agg(
        F.sum("value").alias("total_code_size"),
        ((F.max(micros("ts")) - F.min(micros("ts"))) / 1e6).alias("total_analysis_time"))
    return r6(rank_speed(r).select("grp", "speed", "rank"))


@register("series_summary", """SELECT user_id AS series_id, arg_min(value, (epoch_us(ts), event_id)) AS initial, max(value) AS peak,
  arg_max(value, (epoch_us(ts), event_id)) AS final,
  round(arg_max(value, (epoch_us(ts), event_id)) - arg_min(value, (epoch_us(ts), event_id)), 6) AS increase,
  count(*) AS n_samples, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6) AS duration FROM events GROUP BY user_id""")
def series_summary_q(spark, sf):
    """AGG-19: per user series of event values."""
    return r6(series_summary(_events(spark, sf)))


@register("baseline_delta", """WITH b AS (SELECT user_id, arg_min(value, (epoch_us(ts), event_id)) AS v0, min(epoch_us(ts)) AS t0
  FROM events GROUP BY user_id)
SELECT e.user_id AS series_id, event_id, round(value - v0, 6) AS delta, round((epoch_us(ts) - t0) / 1e6, 6) AS elapsed
FROM events e JOIN b ON b.user_id = e.user_id""")
def baseline_delta_q(spark, sf):
    """AGG-20: each event value minus its user's first value."""
    return r6(baseline_delta(_events(spark, sf)))


@register("peak_point", """SELECT user_id AS series_id, max(value) AS peak,
  arg_min(epoch_us(ts), (-value, epoch_us(ts), event_id)) AS peak_us,
  arg_min(event_id, (-value, epoch_us(ts), event_id)) AS peak_id FROM events GROUP BY user_id""")
def peak_point_q(spark, sf):
    """AGG-21: first time each user's value peaks."""
    return peak_point(_events(spark, sf))


@register("phase_compare", """SELECT event_type AS model, CAST((day(ts) - 1) // 7 + 1 AS INTEGER) AS phase,
  arg_min(value, (epoch_us(ts), event_id)) AS start_value, arg_max(value, (epoch_us(ts), event_id)) AS end_value,
  round(arg_max(value, (epoch_us(ts), event_id)) - arg_min(value, (epoch_us(ts), event_id)), 6) AS increase
FROM events GROUP BY 1, 2""")
def phase_compare_q(spark, sf):
    """AGG-22: per event type and week of the month, start/end/increase."""
    e = read_table(spark, sf, "events")
    ph = (F.floor((F.dayofmonth("ts") - 1) / 7) + 1).cast("int")
    return r6(phase_compare(e, "event_type", ph).withColumnRenamed("event_type", "model"))


@register("report_round_trip", SQL_GS + """
SELECT count(*) AS total_languages, CAST(sum(file_count) AS BIGINT) AS total_files,
  CAST(sum(total_rules) AS BIGINT) AS total_rules, CAST(sum(total_aligned) AS BIGINT) AS total_aligned,
  CAST(sum(total_code_size) AS BIGINT) AS total_code_size, 'chunk64' AS scheme FROM gs""")
def report_round_trip_q(spark, sf):
    """SNK-1 + SRC-8: the run report (summary, languages, files) is written
    as a report folder under the shared checkpoint folder and read back."""
    import uuid
    from spanalign.session import scratch_path
    from spanalign.sources.reports import read_report, write_report
    scores = chunk_doc_scores(spark, sf)
    path = scratch_path(spark, f"report-{uuid.uuid4().hex}")
    write_report(None, scores, path, "chunk64")
    summary, _, _ = read_report(spark, path)
    return summary.select("summary.*", "scheme").drop("avg_processing_speed")
