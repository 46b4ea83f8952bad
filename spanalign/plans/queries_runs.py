"""Plans over repeated runs: re-analysis of a changed corpus, and runs that
log what they measured."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from spanalign.analysis import run_analysis
from spanalign.operators.incremental import refresh
from spanalign.operators.scores import doc_scores_covering, rank_speed
from spanalign.operators.series import run_summary
from spanalign.operators.spans import chunk_pieces
from spanalign.plans.catalog import GS_COLS, SQL_CHUNKS, SQL_DOC_SCORES, SQL_DOCS, r6, register, sql_group_stats
from spanalign.plans.common import CHUNK, docs
from spanalign.session import scratch_path
from spanalign.sources.runlog import read_log

# the corpus before: some documents not there yet, some shorter, some of another language, some since removed
SQL_BEFORE = """b AS (SELECT doc_id, CASE WHEN doc_id % 13 = 2 THEN 'xx' ELSE grp END AS grp, CASE WHEN doc_id % 5 = 1 THEN left(text, 100) ELSE text END AS text FROM d WHERE doc_id % 7 <> 3
  UNION ALL SELECT doc_id + 1000000000, 'old', text FROM d WHERE doc_id % 11 = 4)"""


def _before(d):
    i = F.col("doc_id")
    kept = d.filter(i % 7 != 3).select("doc_id", F.when(i % 13 == 2, "xx").otherwise(F.col("grp")).alias("grp"),
                                       F.when(i % 5 == 1, F.left("text", F.lit(100))).otherwise(F.col("text")).alias("text"))
    return kept.unionByName(d.filter(i % 11 == 4).select((i + 1_000_000_000).alias("doc_id"), F.lit("old").alias("grp"), "text"))


def _score(d):
    return doc_scores_covering(d, chunk_pieces("text", CHUNK))


def _updates(spark, sf):
    now = docs(spark, sf).select("doc_id", "grp", "text")
    first = refresh(_before(now), _score)
    return refresh(now, _score, first)


@register("incremental_group_stats", f"""WITH {SQL_DOCS}, {SQL_CHUNKS}, {SQL_DOC_SCORES}, {sql_group_stats(True)}
SELECT {GS_COLS} FROM gs""")
def incremental_group_stats_q(spark, sf):
    """FLT-7, STR-4: totals kept by adding and subtracting equal a full run."""
    return r6(_updates(spark, sf).group_stats)


@register("incremental_changes", f"""WITH {SQL_DOCS}, {SQL_BEFORE},
c AS (SELECT CASE WHEN b.doc_id IS NULL THEN 'added' WHEN d.doc_id IS NULL THEN 'removed' WHEN d.text <> b.text OR d.grp <> b.grp THEN 'changed' END AS change
      FROM d FULL JOIN b ON b.doc_id = d.doc_id)
SELECT change, count(*) AS n_docs FROM c WHERE change IS NOT NULL GROUP BY change""")
def incremental_changes_q(spark, sf):
    """FLT-7: documents added, changed and removed; the others are not scored again."""
    return _updates(spark, sf).changes.groupBy("change").agg(F.count(F.lit(1)).alias("n_docs"))


@register("run_log_measured", f"""WITH {SQL_DOCS}, {SQL_CHUNKS}, {SQL_DOC_SCORES},
l AS (SELECT grp, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS n_chars, CAST(sum(n_bytes) AS BIGINT) AS n_bytes,
  CAST(sum(n_distinct_rules) AS BIGINT) AS total_rules, CAST(sum(n_distinct_aligned) AS BIGINT) AS total_aligned FROM dss WHERE grp IN ('en', 'de') GROUP BY grp)
SELECT grp AS run_id, 'ok' AS status, n, n_chars, n_bytes, total_rules, total_aligned, true AS timed, 2 AS n_success, 0 AS n_failure, true AS ranked FROM l""")
def run_log_measured_q(spark, sf):
    """AGG-3, AGG-6, AGG-18: two measured runs, what their log says, and the
    summaries that read it."""
    base = scratch_path(spark, f"runs-{uuid.uuid4().hex}")
    d = docs(spark, sf).select("doc_id", "grp", "text")
    for grp in ("en", "de"):
        run_analysis(d.filter(F.col("grp") == grp), f"{base}/{grp}", f"{base}/log", grp, rules=CHUNK)
    log = read_log(spark, f"{base}/log")
    runs = run_summary(log.withColumn("run", F.lit("all")), by="run").select(F.col("n_success").cast("int").alias("n_success"), F.col("n_failure").cast("int").alias("n_failure"))
    ranks = rank_speed(log.select(F.col("run_id").alias("grp"), F.col("n_chars").alias("total_code_size"), F.col("seconds").alias("total_analysis_time")))
    ranked = ranks.agg((F.max("rank") == 2).alias("ranked"))
    whole = runs.select(F.struct("n_success", "n_failure").alias("r"), F.lit(1).alias("_k")).join(ranked.withColumn("_k", F.lit(1)), "_k")
    rows = log.select("run_id", "status", "n", "n_chars", "n_bytes", "total_rules", "total_aligned", ((F.col("seconds") > 0) & (F.col("speed") > 0)).alias("timed"), F.lit(1).alias("_k"))
    return rows.join(whole, "_k").select("run_id", "status", "n", "n_chars", "n_bytes", "total_rules", "total_aligned", "timed", "r.n_success", "r.n_failure", "ranked")
