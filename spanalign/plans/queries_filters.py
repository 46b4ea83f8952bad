"""Source, filter and batching plans (SRC-6, FLT-1..8, AGG-9..11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanalign.operators.batching import batch_stats, flush_parts, slice_docs, stop_after, totals_of_totals
from spanalign.operators.clean import (drop_blank, keep_languages, limit_accepted, max_bytes, normalize_language,
                                       only_imperfect, quarantine, within_bytes)
from spanalign.plans.catalog import (NOT_SPACE, SQL_CHUNKS, SQL_DOC_SCORES, SQL_DOCS, r6, register)
from spanalign.plans.queries_core import chunk_doc_scores
from spanalign.sources.tables import corpus_from_table, documents_corpus, read_table

LANG_NAMES = {"de": "german", "en": "english", "es": "spanish", "fr": "french"}
EVENT_ALIASES = {"click": "ui", "view": "ui", "purchase": "sale"}


@register("corpus_by_lang", r"""SELECT CASE lower(regexp_replace(lang, '^[\t\n\x0B\f\r\x1C-\x1F \x85\p{Z}]+|[\t\n\x0B\f\r\x1C-\x1F \x85\p{Z}]+$', '', 'g')) WHEN 'de' THEN 'german' WHEN 'en' THEN 'english'
  WHEN 'es' THEN 'spanish' WHEN 'fr' THEN 'french' END AS grp, count(*) AS n_docs,
  CAST(sum(strlen(text)) AS BIGINT) AS n_bytes, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM documents GROUP BY 1""")
def corpus_by_lang_q(spark, sf):
    """SRC-6: a table mapped onto the corpus schema with a per-row language
    column normalised through an alias map."""
    c = corpus_from_table(read_table(spark, sf, "documents"), "doc_id", "text", language_col="lang", aliases=LANG_NAMES)
    return c.groupBy("grp").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.octet_length("text")).cast("bigint").alias("n_bytes"),
                                F.sum(F.char_length("text")).cast("bigint").alias("n_chars"))


@register("corpus_fixed_language", """SELECT 'prose' AS grp, count(*) AS n_docs, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes
FROM benchmark""")
def corpus_fixed_language_q(spark, sf):
    """SRC-6 with one fixed label for every row (benchmark passages)."""
    c = corpus_from_table(read_table(spark, sf, "benchmark"), "item_id", "text", fixed_language="prose")
    return c.groupBy("grp").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.octet_length("text")).cast("bigint").alias("n_bytes"))


@register("drop_blank", f"""SELECT role AS grp, count(*) AS n_kept FROM conversations
WHERE text IS NOT NULL AND regexp_matches(text, '{NOT_SPACE}') GROUP BY role""")
def drop_blank_q(spark, sf):
    """FLT-1 on conversation turns."""
    c = read_table(spark, sf, "conversations").withColumnRenamed("role", "grp")
    return drop_blank(c).groupBy("grp").agg(F.count(F.lit(1)).alias("n_kept"))


@register("normalize_language", r"""SELECT CASE lower(regexp_replace(event_type, '^[\t\n\x0B\f\r\x1C-\x1F \x85\p{Z}]+|[\t\n\x0B\f\r\x1C-\x1F \x85\p{Z}]+$', '', 'g')) WHEN 'click' THEN 'ui' WHEN 'view' THEN 'ui'
  WHEN 'purchase' THEN 'sale' END AS grp, count(*) AS n FROM events GROUP BY 1""")
def normalize_language_q(spark, sf):
    """FLT-2: trim + lower + alias map, unknown labels become null."""
    e = read_table(spark, sf, "events")
    return normalize_language(e, "event_type", EVENT_ALIASES, out="grp").groupBy("grp").agg(F.count(F.lit(1)).alias("n"))


@register("keep_languages", """SELECT lang AS grp, count(*) AS n_docs FROM documents WHERE lang IN ('de', 'fr') GROUP BY lang""")
def keep_languages_q(spark, sf):
    """FLT-3: allow-list of languages."""
    return keep_languages(documents_corpus(spark, sf), ["de", "fr"]).groupBy("grp").agg(F.count(F.lit(1)).alias("n_docs"))


@register("size_guard", """SELECT lang AS grp, count(*) FILTER (WHERE strlen(text) <= 4096) AS n_accepted,
  count(*) FILTER (WHERE strlen(text) > 4096) AS n_rejected FROM documents GROUP BY lang""")
def size_guard_q(spark, sf):
    """FLT-4: UTF-8 size guard (strictly greater than the limit is dropped)."""
    ok = within_bytes("text", 4096)
    return documents_corpus(spark, sf).groupBy("grp").agg(F.count_if(ok).alias("n_accepted"), F.count_if(~ok).alias("n_rejected"))


@register("limit_accepted", f"""SELECT doc_id, lang AS grp, CAST(strlen(text) AS BIGINT) AS n_bytes FROM documents
WHERE text IS NOT NULL AND regexp_matches(text, '{NOT_SPACE}') AND strlen(text) <= 4096 ORDER BY doc_id LIMIT 50""")
def limit_accepted_q(spark, sf):
    """FLT-5: the limit counts only rows that passed every filter (top-k by id)."""
    d = max_bytes(drop_blank(documents_corpus(spark, sf)), 4096)
    return limit_accepted(d, 50).select("doc_id", "grp", F.octet_length("text").cast("bigint").alias("n_bytes"))


@register("only_imperfect", f"""WITH {SQL_DOCS}, {SQL_CHUNKS}, {SQL_DOC_SCORES}
SELECT grp, count(*) AS n_imperfect, round(avg(score), 6) AS avg_score FROM dss WHERE NOT is_perfect GROUP BY grp""")
def only_imperfect_q(spark, sf):
    """FLT-6: documents with at least one failing chunk rule."""
    return r6(only_imperfect(chunk_doc_scores(spark, sf)).groupBy("grp").agg(
        F.count(F.lit(1)).alias("n_imperfect"), F.avg("score").alias("avg_score")))


@register("slice_docs", f"""WITH {SQL_DOCS}, x AS (SELECT doc_id, grp, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM d)
SELECT doc_id, grp, CAST(idx AS BIGINT) AS idx FROM x WHERE idx >= 100 AND idx < 300""")
def slice_docs_q(spark, sf):
    """FLT-7: resumable slice [100, 300) of the id-ordered accepted list."""
    from spanalign.plans.common import docs
    return slice_docs(docs(spark, sf).select("doc_id", "grp"), 100, 200).select("doc_id", "grp", "idx")


@register("quarantine_reasons", f"""SELECT coalesce(CASE
    WHEN text IS NULL OR NOT regexp_matches(text, '{NOT_SPACE}') THEN 'blank'
    WHEN lang IS NULL THEN 'unknown_language'
    WHEN strlen(text) > 8192 THEN 'oversize'
    WHEN len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]')) > 1500 THEN 'too_many_pieces'
    WHEN lang NOT IN ('de', 'en', 'fr') THEN 'not_allowed' END, 'accepted') AS reason, count(*) AS n
FROM documents GROUP BY 1""")
def quarantine_reasons_q(spark, sf):
    """FLT-8: every rejected row keeps a reason instead of vanishing."""
    q = quarantine(documents_corpus(spark, sf), max_size=8192, max_pieces=1500, allowed=["de", "en", "fr"])
    return q.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


SQL_IDX = f"""WITH {SQL_DOCS}, {SQL_CHUNKS}, {SQL_DOC_SCORES},
ix AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id) - 1 AS idx FROM dss)"""

PART_COLS = """count(*) AS file_count, count(*) FILTER (WHERE NOT is_perfect) AS n_imperfect,
  round(coalesce({avg}, 0.0), 6) AS avg_score, CAST(sum(n_distinct_rules) AS BIGINT) AS total_rules,
  CAST(sum(n_distinct_aligned) AS BIGINT) AS total_aligned, CAST(sum(n_chars) AS BIGINT) AS total_code_size,
  round(CASE WHEN sum(n_distinct_rules) = 0 THEN 0.0 ELSE 100.0 * sum(n_distinct_aligned) / sum(n_distinct_rules) END, 6) AS overall_alignment"""


@register("batch_stats", SQL_IDX + f"""
SELECT grp, CAST(floor((idx - 10) / 50) + 1 AS INTEGER) AS batch, {PART_COLS.format(avg="avg(score) FILTER (WHERE NOT is_perfect)")}
FROM ix WHERE idx >= 10 GROUP BY 1, 2""")
def batch_stats_q(spark, sf):
    """AGG-9: batches of 50 per language after skipping 10 (start index)."""
    return r6(batch_stats(chunk_doc_scores(spark, sf), 50, start_index=10))


@register("flush_parts", SQL_IDX + f"""
SELECT grp, CAST(floor(idx / 40) + 1 AS INTEGER) AS part, {PART_COLS.format(avg="avg(score)")}
FROM ix GROUP BY 1, 2""")
def flush_parts_q(spark, sf):
    """AGG-10: a part after every 40 accepted documents of a language."""
    return r6(flush_parts(chunk_doc_scores(spark, sf), 40))


@register("stop_after", SQL_IDX + """,
b AS (SELECT grp, floor(idx / 50) + 1 AS batch, count(*) AS file_count, sum(n_distinct_rules) AS tr,
        sum(n_distinct_aligned) AS ta, sum(n_chars) AS tc FROM ix GROUP BY 1, 2),
k AS (SELECT *, coalesce(sum(file_count) OVER (PARTITION BY grp ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b)
SELECT grp, count(*) AS n_batches, CAST(sum(file_count) AS BIGINT) AS file_count, CAST(sum(tr) AS BIGINT) AS total_rules,
  CAST(sum(ta) AS BIGINT) AS total_aligned, CAST(sum(tc) AS BIGINT) AS total_code_size,
  round(CASE WHEN sum(tr) = 0 THEN 0.0 ELSE 100.0 * sum(ta) / sum(tr) END, 6) AS overall_alignment
FROM k WHERE before < 120 GROUP BY grp""")
def stop_after_q(spark, sf):
    """AGG-11: batches of 50 kept until 120 files are reached (inclusive),
    then totals of totals per language."""
    b = batch_stats(chunk_doc_scores(spark, sf), 50)
    return r6(totals_of_totals(stop_after(b, 120)))


@register("flush_parts_report", SQL_IDX + f"""
SELECT grp, CAST(floor(idx / 40) + 1 AS INTEGER) AS part, {PART_COLS.format(avg="avg(score)")}
FROM ix WHERE NOT is_perfect GROUP BY 1, 2""")
def flush_parts_report_q(spark, sf):
    """AGG-10 with the reports' convention: parts numbered over all
    documents, totals over the imperfect ones only."""
    return r6(flush_parts(chunk_doc_scores(spark, sf), 40, report_convention=True))
