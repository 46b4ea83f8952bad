"""Named query plans (one per operator of the inventory) and their DuckDB
oracles. Each plan takes (spark, sf_dir) and returns a DataFrame over the
whole given tables; each oracle is written from the operator's definition,
not by mirroring the Spark plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

REGISTRY: dict = {}
ORACLE: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        REGISTRY[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def r6(df: DataFrame) -> DataFrame:
    """Round every double column to 6 digits (the oracle does the same)."""
    return df.select(*[F.round(F.col(f.name), 6).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType))
                       else F.col(f.name) for f in df.schema.fields])


# ---------------------------------------------------------------- SQL pieces
WORD = r"[\p{L}\p{N}_]"
ONE_WORD = r"^[\p{L}\p{N}_]$"
NOT_SPACE = r"[^\t\n\x0B\f\r\x1C-\x1F \x85\p{Z}]"

SQL_DOCS = rf"""d AS (
  SELECT doc_id, lang AS grp, text, source FROM documents
  WHERE text IS NOT NULL AND regexp_matches(text, '{NOT_SPACE}'))"""

# chunk i of a document covers characters [64 i, 64 i + 64); a border at
# character c splits a word when characters c-1 and c are both word chars.
SQL_CHUNKS = rf"""ch AS (
  SELECT doc_id, grp, i,
    (i > 0 AND regexp_matches(substr(text, 64 * i, 1), '{ONE_WORD}')
           AND regexp_matches(substr(text, 64 * i + 1, 1), '{ONE_WORD}')) AS ms,
    (64 * (i + 1) < length(text) AND regexp_matches(substr(text, 64 * (i + 1), 1), '{ONE_WORD}')
           AND regexp_matches(substr(text, 64 * (i + 1) + 1, 1), '{ONE_WORD}')) AS me
  FROM (SELECT doc_id, grp, text, unnest(range(0, (length(text) + 63) // 64)) AS i FROM d))"""

SQL_DOC_SCORES = rf"""ds AS (
  SELECT d.doc_id, any_value(d.grp) AS grp, CAST(count(ch.i) AS BIGINT) AS n_rules,
    CAST(count(ch.i) FILTER (WHERE NOT ch.ms AND NOT ch.me) AS BIGINT) AS n_aligned,
    any_value(CAST(length(d.text) AS BIGINT)) AS n_chars, any_value(CAST(strlen(d.text) AS BIGINT)) AS n_bytes
  FROM d LEFT JOIN ch ON ch.doc_id = d.doc_id GROUP BY d.doc_id),
dss AS (
  SELECT *, n_rules AS n_distinct_rules, n_aligned AS n_distinct_aligned,
    CASE WHEN n_rules = 0 THEN 0.0 ELSE 100.0 * n_aligned / n_rules END AS score,
    n_aligned = n_rules AS is_perfect FROM ds)"""


def sql_group_stats(include_perfect: bool) -> str:
    sc = "score" if include_perfect else "CASE WHEN NOT is_perfect THEN score END"
    return rf"""gs AS (
  SELECT grp, count(*) AS file_count, avg({sc}) AS avg_score,
    CAST(sum(n_distinct_rules) AS BIGINT) AS total_rules, CAST(sum(n_distinct_aligned) AS BIGINT) AS total_aligned,
    CAST(sum(n_chars) AS BIGINT) AS total_code_size, CAST(sum(n_bytes) AS BIGINT) AS total_bytes,
    CASE WHEN sum(n_distinct_rules) = 0 THEN 0.0 ELSE 100.0 * sum(n_distinct_aligned) / sum(n_distinct_rules) END AS overall_alignment
  FROM dss GROUP BY grp)"""


GS_COLS = "grp, file_count, round(avg_score, 6) AS avg_score, total_rules, total_aligned, total_code_size, total_bytes, round(overall_alignment, 6) AS overall_alignment"

from spanalign.plans import queries_core  # noqa: E402,F401  (registers plans)
from spanalign.plans import queries_tokens  # noqa: E402,F401
from spanalign.plans import queries_spans  # noqa: E402,F401
from spanalign.plans import queries_align  # noqa: E402,F401
from spanalign.plans import queries_filters  # noqa: E402,F401
from spanalign.plans import queries_reports  # noqa: E402,F401
from spanalign.plans import queries_stream  # noqa: E402,F401
from spanalign.plans import queries_io  # noqa: E402,F401
from spanalign.plans import queries_bpe  # noqa: E402,F401
from spanalign.plans import queries_structure  # noqa: E402,F401
from spanalign.plans import queries_files  # noqa: E402,F401
from spanalign.plans import queries_runs  # noqa: E402,F401
from spanalign.plans import queries_store  # noqa: E402,F401
