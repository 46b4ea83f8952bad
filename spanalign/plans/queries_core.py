"""Flagship slice: chunk borders vs words, scored and ranked per language."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanalign.operators.align import covering_word_split
from spanalign.operators.scores import (corpus_summary, doc_scores_covering, group_stats, rank_groups)
from spanalign.operators.spans import chunk_pieces
from spanalign.plans.catalog import (GS_COLS, SQL_CHUNKS, SQL_DOC_SCORES, SQL_DOCS, r6, register,
                                     sql_group_stats)
from spanalign.plans.common import CHUNK, docs
from spanalign.sources.tables import spread


def chunk_doc_scores(spark, sf):
    return doc_scores_covering(spread(docs(spark, sf)), chunk_pieces("text", CHUNK))


@register("chunk_word_split", f"""WITH {SQL_DOCS}, {SQL_CHUNKS}
SELECT grp, count(*) AS n_chunks, count(*) FILTER (WHERE NOT ms AND NOT me) AS n_no_split FROM ch GROUP BY grp""")
def chunk_word_split(spark, sf):
    """SPN-3 + ALN-2 fast path: chunks per language and chunks with no split word."""
    x = spread(docs(spark, sf)).select("grp", chunk_pieces("text", CHUNK).alias("pieces"))
    x = x.select("grp", covering_word_split("pieces").alias("w"))
    return x.groupBy("grp").agg(F.sum("w.n_rules").cast("bigint").alias("n_chunks"),
                                F.sum("w.n_aligned").cast("bigint").alias("n_no_split"))


@register("doc_scores", f"""WITH {SQL_DOCS}, {SQL_CHUNKS}, {SQL_DOC_SCORES}
SELECT doc_id, grp, n_rules, n_aligned, n_distinct_rules, n_distinct_aligned, n_chars, n_bytes,
  round(score, 6) AS score, is_perfect FROM dss""")
def doc_scores_q(spark, sf):
    """AGG-1 over chunk rules."""
    return r6(chunk_doc_scores(spark, sf))


@register("group_stats", f"""WITH {SQL_DOCS}, {SQL_CHUNKS}, {SQL_DOC_SCORES}, {sql_group_stats(True)}
SELECT {GS_COLS} FROM gs""")
def group_stats_q(spark, sf):
    """AGG-3, average over all files."""
    return r6(group_stats(chunk_doc_scores(spark, sf), "grp", include_perfect=True))


@register("group_stats_imperfect", f"""WITH {SQL_DOCS}, {SQL_CHUNKS}, {SQL_DOC_SCORES}, {sql_group_stats(False)}
SELECT {GS_COLS} FROM gs""")
def group_stats_imperfect_q(spark, sf):
    """AGG-3, average over imperfect files only (the reports' convention)."""
    return r6(group_stats(chunk_doc_scores(spark, sf), "grp", include_perfect=False))


@register("rank_groups", f"""WITH {SQL_DOCS}, {SQL_CHUNKS}, {SQL_DOC_SCORES}, {sql_group_stats(True)}
SELECT row_number() OVER (ORDER BY avg_score DESC NULLS LAST, grp) AS rank, grp, round(avg_score, 6) AS avg_score,
  file_count, total_rules FROM gs""")
def rank_groups_q(spark, sf):
    """Flagship: AGG-5 ranking of languages by average chunk score."""
    st = group_stats(chunk_doc_scores(spark, sf), "grp")
    return r6(rank_groups(st).select("rank", "grp", "avg_score", "file_count", "total_rules"))


@register("corpus_summary", f"""WITH {SQL_DOCS}, {SQL_CHUNKS}, {SQL_DOC_SCORES}, {sql_group_stats(True)}
SELECT count(*) AS total_languages, CAST(sum(file_count) AS BIGINT) AS total_files,
  CAST(sum(total_rules) AS BIGINT) AS total_rules, CAST(sum(total_aligned) AS BIGINT) AS total_aligned,
  CAST(sum(total_code_size) AS BIGINT) AS total_code_size FROM gs""")
def corpus_summary_q(spark, sf):
    """AGG-4."""
    return corpus_summary(group_stats(chunk_doc_scores(spark, sf), "grp"))
