"""Shared inputs of the named plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanalign.operators.clean import drop_blank
from spanalign.sources.tables import by_doc, documents_corpus, read_table

CHUNK = 64            # characters per chunk rule

# Span patterns over the documents corpus (our declarative rule set).
DOC_PATTERNS = {
    "line": r"[^\n]+",
    # a sentence can only start where a run of non-terminators starts; the
    # look-behind states that, so Java's matcher rejects every other start in
    # O(1) instead of rescanning the run (same matches as the plain form)
    "sentence": r"(?<![^.!?\n])[^.!?\n]++[.!?]",
    "number": r"\p{N}+",
    "capword": r"\p{Lu}\p{Ll}+",
}
# The same patterns in RE2 syntax (no look-behind / possessive) for DuckDB.
DOC_PATTERNS_RE2 = dict(DOC_PATTERNS, sentence=r"[^.!?\n]+[.!?]")
# Span patterns over raw HTML pages.
PAGE_PATTERNS = {
    "tag": r"<[^<>]+>",
    "entity": r"&[a-zA-Z]+;",
    # starts only where a run of name characters starts, as "sentence" does
    "attr": r"(?<![a-zA-Z-])[a-zA-Z-]++=\"[^\"]*\"",
    "text": r">[^<>]+<",
}
PAGE_PATTERNS_RE2 = dict(PAGE_PATTERNS, attr=r"[a-zA-Z-]+=\"[^\"]*\"")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted documents (FLT-1) as the corpus: texts of any length."""
    return drop_blank(documents_corpus(spark, sf_dir))


def docs_by_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted documents hash-partitioned by doc_id: the one exchange of
    every span/token plan (raw text is the smallest form to move)."""
    return by_doc(docs(spark, sf_dir))


def pages_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "pages")
    d = p.select(F.col("page_id").alias("doc_id"),
                 F.regexp_extract("url", r"/(de|en|es|fr)/", 1).alias("grp"),
                 F.col("html").alias("text"))
    return by_doc(drop_blank(d))


def conversations_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations turns as documents: doc_id = "conv_id/turn", role is the
    group."""
    c = read_table(spark, sf_dir, "conversations")
    d = c.select(F.concat_ws("/", "conv_id", "turn").alias("doc_id"), F.col("role").alias("grp"),
                 F.col("text"))
    return by_doc(drop_blank(d))


def sql_spans(src: str, patterns: dict, keep: str = "grp") -> str:
    """DuckDB CTEs ``sp`` (doc_id, keep, type, span_id, s, e, cs, ce, piece)
    for regex spans: matches wrapped in U+E000, split, offsets summed."""
    parts = []
    for t, pat in patterns.items():
        parts.append(
            f"SELECT doc_id, {keep}, '{t}' AS type, unnest(a) AS x, generate_subscripts(a, 1) AS k FROM "
            f"(SELECT doc_id, {keep}, string_split(regexp_replace(text, '({pat})', chr(57344) || '\\1' || chr(57344), 'g'), chr(57344)) AS a FROM {src})")
    return f"""sp0 AS ({' UNION ALL '.join(parts)}),
sp1 AS (SELECT *, sum(strlen(x)) OVER w AS e1, sum(length(x)) OVER w AS ce1 FROM sp0
        WINDOW w AS (PARTITION BY doc_id, type ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
sp AS (SELECT doc_id, {keep}, type, CAST(k / 2 - 1 AS INTEGER) AS span_id, CAST(e1 - strlen(x) AS BIGINT) AS s,
          CAST(e1 AS BIGINT) AS e, CAST(ce1 - length(x) AS BIGINT) AS cs, CAST(ce1 AS BIGINT) AS ce, x AS piece
       FROM sp1 WHERE k % 2 = 0)"""


SQL_PAGES = """pg AS (SELECT page_id AS doc_id, regexp_extract(url, '/(de|en|es|fr)/', 1) AS grp, html AS text FROM pages
  WHERE html IS NOT NULL AND regexp_matches(html, '[^\\t\\n\\x0B\\f\\r\\x1C-\\x1F \\x85\\p{Z}]'))"""
