"""Plans of sources, sinks and plug-ins that the given tables can drive
(SRC-3, SRC-5, SNK-2..4, STR-4, UDF-1..3, ALN-1 with overlaps, full ALN-5)."""

from __future__ import annotations

import re
import time
import uuid

from pyspark.sql import functions as F

from spanalign.functions.udf import apply_span_extractor, apply_tokenizer, register_extractor, run_extractor, word_class_runs
from spanalign.operators.align import boundary_points, stab
from spanalign.operators.batching import with_index
from spanalign.operators.reports import compare_schemes
from spanalign.operators.spans import chunk_spans, preorder
from spanalign.plans.catalog import (SQL_CHUNKS, SQL_DOC_SCORES, SQL_DOCS, r6, register, sql_group_stats)
from spanalign.plans.common import CHUNK, DOC_PATTERNS_RE2, docs, docs_by_doc, sql_spans
from spanalign.plans.queries_align import SQL_CHUNK_RULES, SQL_DETAIL, _detail, sql_points
from spanalign.plans.queries_core import chunk_doc_scores
from spanalign.plans.queries_spans import doc_spans
from spanalign.session import scratch_path
from spanalign.sources.files import language_from_path, read_text
from spanalign.sources.reports import write_comparison_document, write_parts, write_run_index
from spanalign.sources.tables import read_table

# ---------------------------------------------------------------- sources
# the suffixes stand in for the languages of the pages' paths
SQL_SUFFIX = "CASE doc_id % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.hpp' WHEN 2 THEN '.h' WHEN 3 THEN '.PY' ELSE '.rs' END"


@register("language_from_path", f"""WITH p AS (SELECT {SQL_SUFFIX.replace('doc_id', 'page_id')} AS x FROM pages)
SELECT CASE x WHEN '.py' THEN 'python' WHEN '.hpp' THEN 'cpp' WHEN '.h' THEN 'c' WHEN '.rs' THEN 'rust' END AS grp, count(*) AS n FROM p GROUP BY 1""")
def language_from_path_q(spark, sf):
    """SRC-3: the language of the suffix of each page's path (the case counts)."""
    k = F.col("page_id") % 5
    suffix = F.when(k == 0, ".py").when(k == 1, ".hpp").when(k == 2, ".h").when(k == 3, ".PY").otherwise(".rs")
    p = read_table(spark, sf, "pages").select(F.concat("url", suffix).alias("path"))
    return p.groupBy(language_from_path("path").alias("grp")).agg(F.count(F.lit(1)).alias("n"))


@register("read_text", """SELECT doc_id, CAST(length(replace(text, chr(10), '') ) AS BIGINT) AS n_other, CAST(length(text) + 2 AS BIGINT) AS n_chars,
  md5(replace(text, ' ', chr(10)) || chr(10) || chr(10)) AS text_md5 FROM documents WHERE text IS NOT NULL""")
def read_text_q(spark, sf):
    """SRC-5: texts as bytes with CRLF for blanks, a lone CR, a CRLF and a byte
    that is no UTF-8, read back with LF and without the bad byte."""
    d = read_table(spark, sf, "documents").filter("text is not null")
    raw = F.concat(F.encode(F.replace("text", F.lit(" "), F.lit("\r\n")), "UTF-8"), F.unhex(F.lit("FF0D0D0A")))
    t = d.select("doc_id", F.char_length(F.replace("text", F.lit("\n"), F.lit(""))).cast("bigint").alias("n_other"), read_text(raw).alias("t"))
    return t.select("doc_id", "n_other", F.char_length("t").cast("bigint").alias("n_chars"), F.md5(F.encode("t", "UTF-8")).alias("text_md5"))


# ---------------------------------------------------------------- sinks
@register("write_parts", f"""WITH {SQL_DOCS}, x AS (SELECT doc_id, grp, row_number() OVER (PARTITION BY grp ORDER BY doc_id) - 1 AS i FROM d)
SELECT grp, CAST(floor(i / 40) + 1 AS INTEGER) AS part, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM x GROUP BY 1, 2""")
def write_parts_q(spark, sf):
    """SNK-2: a folder per language and part of 40 documents, read back."""
    out = scratch_path(spark, f"parts-{uuid.uuid4().hex}")
    x = with_index(docs(spark, sf).select("doc_id", "grp"), "doc_id", "grp")
    write_parts(x.withColumn("part", (F.floor(F.col("idx") / 40) + 1).cast("int")), out)
    back = spark.read.schema("doc_id long, idx long, grp string, part int").json(out)
    return back.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


@register("write_run_index", """WITH r AS (SELECT source AS run_id, lang AS grp, count(*) AS n FROM documents GROUP BY 1, 2)
SELECT run_id, grp, 'ok' AS status, n FROM r UNION ALL SELECT run_id, grp, 'again' AS status, n FROM r""")
def write_run_index_q(spark, sf):
    """SNK-3: two runs appended to one index and read back."""
    out = scratch_path(spark, f"index-{uuid.uuid4().hex}")
    runs = read_table(spark, sf, "documents").groupBy(F.col("source").alias("run_id"), F.col("lang").alias("grp")).agg(F.count(F.lit(1)).alias("n"))
    for status in ("ok", "again"):
        write_run_index(runs.withColumn("status", F.lit(status)), out)
    return spark.read.schema("run_id string, grp string, status string, n long").json(out)


@register("write_comparison", f"""WITH {SQL_DOCS}, {SQL_CHUNKS}, {SQL_DOC_SCORES}, {sql_group_stats(True)}
SELECT grp, 'chunk64' AS scheme, round(avg_score, 6) AS avg_score, round(overall_alignment, 6) AS overall_alignment, file_count FROM gs""")
def write_comparison_q(spark, sf):
    """SNK-4: the nested comparison document, written and read back."""
    from spanalign.operators.scores import group_stats
    out = scratch_path(spark, f"comparison-{uuid.uuid4().hex}")
    st = group_stats(chunk_doc_scores(spark, sf), "grp").withColumn("scheme", F.lit("chunk64"))
    write_comparison_document(compare_schemes(st, ["chunk64"]).select("grp", "scheme", "avg_score", "overall_alignment", "file_count"), out)
    cell = "struct<avg_score:double,overall_alignment:double,file_count:long>"
    doc = spark.read.schema(f"languages array<string>, models array<string>, data map<string,map<string,{cell}>>").json(out)
    x = doc.select(F.explode("data").alias("grp", "m")).select("grp", F.explode("m").alias("scheme", "c"))
    return r6(x.select("grp", "scheme", "c.*"))


# ---------------------------------------------------------------- streams
@register("run_available", f"""WITH {SQL_DOCS} SELECT doc_id, grp, CAST(strlen(text) AS BIGINT) AS n_bytes FROM d""")
def run_available_q(spark, sf):
    """STR-4: all that is there now goes through the stream into parquet; a
    second run on the same progress adds nothing."""
    from spanalign.plans.queries_stream import _doc_stream
    from spanalign.streaming.stream import run_available
    out = scratch_path(spark, f"available-{uuid.uuid4().hex}")
    x = _doc_stream(spark, sf).select("doc_id", "grp", F.octet_length("text").cast("bigint").alias("n_bytes"))
    progress = run_available(x, out, name="available")
    run_available(x, out, checkpoint=progress, name="available")
    return spark.read.parquet(out)


# ---------------------------------------------------------------- plug-ins
def _line_extractor():
    def spans(text):
        out, at = [], 0
        for line in text.split("\n"):
            n = len(line.encode())
            out += [("line", at, at + n)] if n else [("ERROR", at, at)]
            at += n + 1
        return out
    return spans


@register("plugin_spans", f"""WITH {SQL_DOCS}, l AS (SELECT doc_id, grp, unnest(string_split(text, chr(10))) AS x FROM d)
SELECT grp, count(*) AS n_spans, CAST(sum(strlen(x)) AS BIGINT) AS bytes FROM l WHERE x <> '' GROUP BY grp""")
def plugin_spans_q(spark, sf):
    """UDF-1: lines from a user's Python extractor (ERROR spans dropped)."""
    sp = apply_span_extractor(docs(spark, sf), _line_extractor)
    return sp.groupBy("grp").agg(F.count(F.lit(1)).alias("n_spans"), F.sum(F.col("e") - F.col("s")).cast("bigint").alias("bytes"))


LONG = 30_000


def _fragile_extractor():
    """Lines, but it never ends on texts of more than LONG bytes and raises on
    five digits in a row."""
    lines = _line_extractor()

    def spans(text):
        while len(text.encode()) > LONG:
            try:
                time.sleep(0.01)
            except Exception:  # noqa: BLE001  (a plug-in that catches what it can)
                pass
        if re.search(r"[0-9]{5}", text):
            raise ValueError("five digits")
        return lines(text)
    return spans


@register("plugin_reasons", f"""WITH {SQL_DOCS},
r AS (SELECT grp, text, CASE WHEN strlen(text) > {LONG} THEN 'timeout' WHEN regexp_matches(text, '[0-9]{{5}}') THEN 'failed' END AS reason FROM d)
SELECT grp, reason, count(*) AS n_docs,
  CAST(sum(CASE WHEN reason IS NULL THEN len(list_filter(string_split(text, chr(10)), lambda x: x <> '')) ELSE 0 END) AS BIGINT) AS n_spans,
  CASE reason WHEN 'failed' THEN 'ValueError: five digits' WHEN 'timeout' THEN 'more than 1.0 s' END AS error FROM r GROUP BY grp, reason""")
def plugin_reasons_q(spark, sf):
    """FLT-8, UDF-1: a plug-in that hangs on some documents and raises on
    others loses exactly those, each with its reason."""
    out = run_extractor(docs(spark, sf), _fragile_extractor, seconds=1.0)
    kept = F.coalesce(F.size(F.filter("found", lambda x: x["type"] != "ERROR")), F.lit(0))
    return out.groupBy("grp", "reason").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.when(F.col("reason").isNull(), kept).otherwise(0)).alias("n_spans"),
                                            F.max("error").alias("error"))


@register("plugin_spans_sql", f"""WITH {SQL_DOCS}, l AS (SELECT doc_id, grp, unnest(string_split(text, chr(10))) AS x FROM d)
SELECT grp, count(*) AS n_spans, CAST(sum(strlen(x)) AS BIGINT) AS bytes, min(x) AS first_line FROM l WHERE x <> '' GROUP BY grp""")
def plugin_spans_sql_q(spark, sf):
    """UDF-1 from SQL: a plug-in as a table function in a lateral join."""
    register_extractor(spark, "line_spans", _line_extractor)
    docs(spark, sf).createOrReplaceTempView("plugin_docs")
    return spark.sql("""SELECT grp, count(*) AS n_spans, CAST(sum(e - s) AS BIGINT) AS bytes, min(piece) AS first_line
        FROM plugin_docs d, LATERAL line_spans(d.text, pieces => true) p WHERE reason IS NULL GROUP BY grp""")


def _pair_tokenizer():
    return lambda text: [(i, min(i + 2, len(text))) for i in range(0, len(text), 2)]


@register("plugin_tokens", f"""WITH {SQL_DOCS}
SELECT grp, CAST(sum((length(text) + 1) // 2) AS BIGINT) AS n_tokens, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM d GROUP BY grp""")
def plugin_tokens_q(spark, sf):
    """UDF-2: tokens of two characters from a user's Python tokenizer, in
    characters, mapped to bytes."""
    t = apply_tokenizer(docs(spark, sf), _pair_tokenizer, "pairs")
    return t.groupBy("grp").agg(F.count(F.lit(1)).alias("n_tokens"), F.sum(F.col("e") - F.col("s")).cast("bigint").alias("bytes"))


@register("word_class_runs", f"""WITH {SQL_DOCS}
SELECT grp, CAST(sum(len(regexp_extract_all(text, '[a-z]'))) AS BIGINT) AS n_chars FROM d GROUP BY grp""")
def word_class_runs_q(spark, sf):
    """UDF-3: runs of a user's word class cover exactly its characters."""
    runs = word_class_runs(docs_by_doc(spark, sf), "[a-z]", keep=("grp",))
    return runs.groupBy("grp").agg(F.sum(F.col("e") - F.col("s")).cast("bigint").alias("n_chars"))


# ---------------------------------------------------------------- joins
@register("containing_span", f"""WITH {SQL_DOCS}, {SQL_CHUNK_RULES}, {sql_points('cr')}, {sql_spans('d', DOC_PATTERNS_RE2)},
o AS (SELECT doc_id, s, e, row_number() OVER (PARTITION BY doc_id ORDER BY s, e DESC, type, span_id) - 1 AS tok_id FROM sp),
r AS (SELECT pts.doc_id, pts.grp, pts.span_id, pts.side, min(o.tok_id) AS tok_id FROM pts
      LEFT JOIN o ON o.doc_id = pts.doc_id AND o.s < pts.p AND pts.p < o.e GROUP BY ALL)
SELECT grp, count(*) AS n_points, count(tok_id) AS n_inside, CAST(sum(tok_id) AS BIGINT) AS sum_tok_id FROM r GROUP BY grp""")
def containing_span_q(spark, sf):
    """ALN-1 over overlapping intervals: for every chunk border the first, in
    pre-order, of the nested document spans that strictly contain it."""
    d = docs_by_doc(spark, sf)
    pts = boundary_points(chunk_spans(d, CHUNK))
    nested = doc_spans(spark, sf)
    nested = nested.select("doc_id", (F.row_number().over(preorder(nested)) - 1).alias("tok_id"), "s", "e")
    r = stab(pts, nested)
    return r.groupBy("grp").agg(F.count(F.lit(1)).alias("n_points"), F.count("tok").alias("n_inside"),
                                F.sum("tok.tok_id").cast("bigint").alias("sum_tok_id"))


@register("alignment_detail_all", SQL_DETAIL + """
SELECT doc_id, type || '_' || s || '_' || e AS rule_key, NOT ms AS start_aligned, NOT me AS end_aligned, NOT ms AND NOT me AS fully_aligned,
  CASE WHEN ms THEN si END AS start_token_index, CASE WHEN me THEN ei END AS end_token_index, left(piece, 50) AS text_preview FROM det""")
def alignment_detail_all_q(spark, sf):
    """ALN-5: the records of all chunk rules, aligned ones included."""
    return _detail(spark, sf).select("doc_id", "rule_key", "start_aligned", "end_aligned", "fully_aligned",
                                     F.col("token_start_context.token_index").alias("start_token_index"),
                                     F.col("token_end_context.token_index").alias("end_token_index"), "text_preview")
