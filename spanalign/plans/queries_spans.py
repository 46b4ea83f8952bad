"""Span plans (SPN-1, 2, 4, 6, 7, 8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanalign.operators.spans import (extract_spans, first_spans, rule_type_counts, span_keys,
                                       span_previews, spans_from_table, dedup_spans)
from spanalign.plans.catalog import SQL_DOCS, register
from spanalign.plans.common import (DOC_PATTERNS, DOC_PATTERNS_RE2, PAGE_PATTERNS, PAGE_PATTERNS_RE2, SQL_PAGES, docs_by_doc, pages_corpus,
                                    sql_spans)

SPAN_AGG_SQL = """SELECT grp, type, count(*) AS n_spans, CAST(sum(s) AS BIGINT) AS sum_s, CAST(sum(e) AS BIGINT) AS sum_e,
  CAST(sum(cs) AS BIGINT) AS sum_cs, CAST(sum(ce) AS BIGINT) AS sum_ce FROM sp GROUP BY grp, type"""


def _span_agg(sp):
    return sp.groupBy("grp", "type").agg(
        F.count(F.lit(1)).alias("n_spans"), F.sum("s").cast("bigint").alias("sum_s"),
        F.sum("e").cast("bigint").alias("sum_e"), F.sum("cs").cast("bigint").alias("sum_cs"),
        F.sum("ce").cast("bigint").alias("sum_ce"))


def doc_spans(spark, sf):
    return extract_spans(docs_by_doc(spark, sf), DOC_PATTERNS)


def page_spans(spark, sf):
    return extract_spans(pages_corpus(spark, sf), PAGE_PATTERNS)


@register("doc_rule_spans", f"WITH {SQL_DOCS}, {sql_spans('d', DOC_PATTERNS_RE2)}\n{SPAN_AGG_SQL}")
def doc_rule_spans_q(spark, sf):
    """SPN-1 on documents: lines, sentences, numbers, capitalised words."""
    return _span_agg(doc_spans(spark, sf))


@register("page_tag_spans", f"WITH {SQL_PAGES}, {sql_spans('pg', PAGE_PATTERNS_RE2)}\n{SPAN_AGG_SQL}")
def page_tag_spans_q(spark, sf):
    """SPN-1 on raw HTML: tags, entities, attributes, text nodes."""
    return _span_agg(page_spans(spark, sf))


@register("span_keys", f"""WITH {SQL_DOCS}, {sql_spans('d', DOC_PATTERNS_RE2)}
SELECT grp, count(*) AS n_spans, count(DISTINCT (doc_id, type || '_' || s || '_' || e)) AS n_keys,
  count(DISTINCT (doc_id, s, e)) AS n_offset_pairs FROM sp GROUP BY grp""")
def span_keys_q(spark, sf):
    """SPN-4: type_start_end keys; one row per (doc, key) after dedup, and
    the number of distinct offset pairs across types."""
    sp = span_keys(doc_spans(spark, sf))
    # distinct counts as nested groupings on supersets of doc_id (no Expand)
    by_key = sp.groupBy("doc_id", "grp", "s", "e", "rule_key").agg(F.count(F.lit(1)).alias("n"))
    by_pair = by_key.groupBy("doc_id", "grp", "s", "e").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
    return by_pair.groupBy("grp").agg(F.sum("n").cast("bigint").alias("n_spans"), F.sum("k").cast("bigint").alias("n_keys"),
                                      F.count(F.lit(1)).cast("bigint").alias("n_offset_pairs"))


@register("dedup_spans", f"""WITH {SQL_DOCS}, {sql_spans('d', {'a': DOC_PATTERNS['capword'], 'b': DOC_PATTERNS['number']})}
SELECT grp, count(DISTINCT (doc_id, s, e)) AS n_rules, CAST(sum(s) AS BIGINT) AS sum_s
FROM (SELECT DISTINCT doc_id, grp, s, e FROM sp)
GROUP BY grp""")
def dedup_spans_q(spark, sf):
    """SPN-4: the same patterns under two labels relabelled to one type give
    duplicate keys; dedup keeps one row per (doc, key)."""
    sp = extract_spans(docs_by_doc(spark, sf), {"a": DOC_PATTERNS["capword"], "b": DOC_PATTERNS["number"]})
    sp = sp.withColumn("type", F.lit("rule"))
    dd = dedup_spans(sp)
    return dd.groupBy("grp").agg(F.count(F.lit(1)).alias("n_rules"), F.sum("s").cast("bigint").alias("sum_s"))


TAG_NAME = "lower(regexp_extract(piece, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1))"


@register("rule_type_counts", f"""WITH {SQL_PAGES}, {sql_spans('pg', {'tag': PAGE_PATTERNS['tag']})},
t AS (SELECT doc_id, s, e, {TAG_NAME} AS type FROM sp),
c AS (SELECT type, count(*) AS n, min((doc_id, s, -e)) AS f FROM t GROUP BY type)
SELECT type, n FROM c ORDER BY n DESC, f LIMIT 10""")
def rule_type_counts_q(spark, sf):
    """SPN-6: the ten most frequent HTML tag names (ties by first use)."""
    sp = extract_spans(pages_corpus(spark, sf), {"tag": PAGE_PATTERNS["tag"]})
    sp = sp.withColumn("type", F.lower(F.regexp_extract("piece", r"^</?([a-zA-Z][a-zA-Z0-9]*)", 1)))
    return rule_type_counts(sp, 10)


@register("spans_from_table", f"""WITH {SQL_PAGES}, {sql_spans('pg', {'tag': PAGE_PATTERNS['tag']})},
t AS (SELECT sp.doc_id, s, e, CASE WHEN {TAG_NAME} = '' THEN 'ERROR' ELSE {TAG_NAME} END AS type, strlen(pg.text) AS nb
      FROM sp JOIN pg ON pg.doc_id = sp.doc_id)
SELECT type, count(*) AS n_spans, CAST(sum(e - s) AS BIGINT) AS bytes FROM t
WHERE type IS NOT NULL AND NOT starts_with(type, 'ERROR') AND s >= 0 AND e >= s AND e <= nb GROUP BY type""")
def spans_from_table_q(spark, sf):
    """SPN-2: a span table produced elsewhere (tag spans labelled by tag
    name, unparsable ones ERROR) accepted with bounds checks."""
    pg = pages_corpus(spark, sf)
    sp = extract_spans(pg, {"tag": PAGE_PATTERNS["tag"]}, keep=())
    name = F.lower(F.regexp_extract("piece", r"^</?([a-zA-Z][a-zA-Z0-9]*)", 1))
    table = sp.select("doc_id", F.when(name == "", F.lit("ERROR")).otherwise(name).alias("kind"),
                      F.col("s").alias("start"), F.col("e").alias("end"))
    table = table.join(pg.select("doc_id", F.octet_length("text").alias("nb")), "doc_id")
    acc = spans_from_table(table, "doc_id", "kind", "start", "end", text_bytes="nb")
    return acc.groupBy("type").agg(F.count(F.lit(1)).alias("n_spans"), F.sum(F.col("e") - F.col("s")).cast("bigint").alias("bytes"))


@register("span_preview", f"""WITH {SQL_DOCS}, {sql_spans('d', {'sentence': DOC_PATTERNS_RE2['sentence']})}
SELECT doc_id, type, span_id, left(piece, 50) AS text_preview FROM sp""")
def span_preview_q(spark, sf):
    """SPN-7: first 50 characters of every sentence span."""
    sp = extract_spans(docs_by_doc(spark, sf), {"sentence": DOC_PATTERNS["sentence"]}, keep=())
    return span_previews(sp, 50).select("doc_id", "type", "span_id", "text_preview")


@register("first_spans", f"""WITH {SQL_DOCS}, {sql_spans('d', DOC_PATTERNS_RE2)},
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s, e DESC, type, span_id) AS rank FROM sp)
SELECT doc_id, CAST(rank AS INTEGER) AS rank, type, s, e, replace(piece, chr(10), '\\n') AS text FROM r WHERE rank <= 5""")
def first_spans_q(spark, sf):
    """SPN-8: first five spans of each document in pre-order."""
    return first_spans(doc_spans(spark, sf), 5)


def sql_tree(types) -> str:
    """CTEs o, p, t: pre-order ids; per type the last span before each row
    (spans of one type are disjoint, so it has the greatest end); the parent
    is the latest of those that enclose the row, the depth their number."""
    w = "OVER (PARTITION BY doc_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    last = ", ".join(f"max(id) FILTER (WHERE type = '{t}') {w} AS i{k}, max(e) FILTER (WHERE type = '{t}') {w} AS e{k}" for k, t in enumerate(types))
    ids = ", ".join(f"CASE WHEN e{k} >= e THEN i{k} END" for k in range(len(types)))
    return f"""o AS (SELECT doc_id, type, span_id, s, e, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s, e DESC, type, span_id) - 1 AS INTEGER) AS id FROM sp),
p AS (SELECT *, {last} FROM o),
t AS (SELECT doc_id, type, span_id, s, e, id, list_filter([{ids}], lambda x: x IS NOT NULL) AS a FROM p)"""


@register("span_tree", f"""WITH {SQL_DOCS}, {sql_spans('d', DOC_PATTERNS_RE2)}, {sql_tree(DOC_PATTERNS_RE2)}
SELECT doc_id, type, span_id, s, e, id, list_max(a) AS parent_id, CAST(len(a) AS INTEGER) AS depth FROM t""")
def span_tree_q(spark, sf):
    """SPN-5 on the nested document spans (line > sentence > word/number)."""
    from spanalign.operators.spans import span_tree
    return span_tree(doc_spans(spark, sf), types=list(DOC_PATTERNS))


PAGE_NESTED = {k: PAGE_PATTERNS[k] for k in ("tag", "attr", "entity")}  # properly nested family


@register("page_tag_tree", f"""WITH {SQL_PAGES}, {sql_spans('pg', {k: PAGE_PATTERNS_RE2[k] for k in PAGE_NESTED})}, {sql_tree(PAGE_NESTED)}
SELECT type, count(*) AS n_spans, count(list_max(a)) AS n_with_parent, CAST(max(len(a)) AS INTEGER) AS max_depth,
  CAST(sum(list_max(a)) AS BIGINT) AS sum_parent_id FROM t GROUP BY type""")
def page_tag_tree_q(spark, sf):
    """SPN-5 on HTML pages: attributes and entities nest inside tags."""
    from spanalign.operators.spans import span_tree
    t = span_tree(extract_spans(pages_corpus(spark, sf), PAGE_NESTED), types=list(PAGE_NESTED))
    return t.groupBy("type").agg(F.count(F.lit(1)).alias("n_spans"), F.count("parent_id").alias("n_with_parent"),
                                 F.max("depth").alias("max_depth"), F.sum("parent_id").cast("bigint").alias("sum_parent_id"))
