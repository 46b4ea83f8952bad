"""Boundary-join plans (ALN-1..6) and the unaligned list (AGG-2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanalign.functions.patterns import TOKEN_SCHEMES
from spanalign.operators.align import (align_detail, boundary_context, boundary_points, nearest_token,
                                       rule_word_split, stab, token_cut, tolerance_align)
from spanalign.operators.scores import unaligned_list
from spanalign.operators.spans import chunk_spans, extract_spans, with_word_split
from spanalign.operators.tokens import boundaries, tokens, word_runs
from spanalign.plans.catalog import ONE_WORD, SQL_DOCS, r6, register
from spanalign.operators.blocks import chunks_in_segments, tokens_in_segments
from spanalign.operators.inrow import chunk_details, chunk_points, tolerance_counts
from spanalign.plans.common import CHUNK, DOC_PATTERNS, DOC_PATTERNS_RE2, docs, docs_by_doc, sql_spans
from spanalign.sources.tables import spread

# ------------------------------------------------------------------ oracle CTEs
SQL_CHARS = """chars AS (
  SELECT doc_id, c, CAST(sum(strlen(c)) OVER w - strlen(c) AS BIGINT) AS b0, CAST(sum(strlen(c)) OVER w AS BIGINT) AS b1
  FROM (SELECT doc_id, unnest(a) AS c, generate_subscripts(a, 1) AS k FROM (SELECT doc_id, regexp_extract_all(text, '(?s).') AS a FROM d))
  WINDOW w AS (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""

SQL_CHUNK_RULES = f"""cr AS (
  SELECT doc_id, grp, CAST(i AS INTEGER) AS span_id, 'chunk' AS type,
    CAST(strlen(substr(text, 1, {CHUNK} * i)) AS BIGINT) AS s, CAST(strlen(substr(text, 1, {CHUNK} * i + {CHUNK})) AS BIGINT) AS e,
    substr(text, {CHUNK} * i + 1, {CHUNK}) AS piece
  FROM (SELECT doc_id, grp, text, unnest(range(0, (length(text) + {CHUNK - 1}) // {CHUNK})) AS i FROM d))"""


def sql_points(rules: str) -> str:
    return f"""pts AS (SELECT doc_id, grp, type, span_id, 's' AS side, s AS p FROM {rules}
  UNION ALL SELECT doc_id, grp, type, span_id, 'e' AS side, e AS p FROM {rules})"""


# a border at byte p splits a word when the character ending at p and the
# character starting at p are both word characters
SQL_MW = f"""mw AS (
  SELECT pts.*, pv.c AS lc, nx.c AS rc,
    coalesce(regexp_matches(pv.c, '{ONE_WORD}') AND regexp_matches(nx.c, '{ONE_WORD}'), false) AS mid
  FROM pts LEFT JOIN chars pv ON pv.doc_id = pts.doc_id AND pv.b1 = pts.p
           LEFT JOIN chars nx ON nx.doc_id = pts.doc_id AND nx.b0 = pts.p)"""


def sql_tokens(name: str, scheme: str, src: str = "d") -> str:
    return f"""{name} AS (
  SELECT doc_id, CAST(k - 1 AS INTEGER) AS tok_id, CAST(e1 - strlen(x) AS BIGINT) AS s, CAST(e1 AS BIGINT) AS e, x AS piece
  FROM (SELECT doc_id, k, x, sum(strlen(x)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e1
        FROM (SELECT doc_id, unnest(a) AS x, generate_subscripts(a, 1) AS k
              FROM (SELECT doc_id, regexp_extract_all(text, '{TOKEN_SCHEMES[scheme]}') AS a FROM {src}))))"""


RULE_FLAGS_SQL = """pr AS (SELECT doc_id, grp, type, span_id,
    bool_or(mid) FILTER (WHERE side = 's') AS ms, bool_or(mid) FILTER (WHERE side = 'e') AS me FROM mw GROUP BY ALL)"""


def _flag_counts(df, by, s="start_aligned", e="end_aligned", f="fully_aligned"):
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rules"), F.count_if(F.col(s)).alias("n_start_aligned"),
                               F.count_if(F.col(e)).alias("n_end_aligned"), F.count_if(F.col(f)).alias("n_fully"))


# ------------------------------------------------------------------ plans
@register("mid_word", f"""WITH {SQL_DOCS}, {sql_spans('d', DOC_PATTERNS_RE2)}, {SQL_CHARS}, {sql_points('sp')}, {SQL_MW}, {RULE_FLAGS_SQL}
SELECT grp, type, count(*) AS n_rules, count(*) FILTER (WHERE NOT ms) AS n_start_aligned,
  count(*) FILTER (WHERE NOT me) AS n_end_aligned, count(*) FILTER (WHERE NOT ms AND NOT me) AS n_fully
FROM pr GROUP BY grp, type""")
def mid_word_q(spark, sf):
    """ALN-2 (M1) on regex spans of documents: borders inside word runs."""
    fl = with_word_split(extract_spans(docs_by_doc(spark, sf), DOC_PATTERNS, border_chars=True))
    return _flag_counts(fl, ["grp", "type"])


@register("mid_word_runs", f"""WITH {SQL_DOCS}, {sql_spans('d', DOC_PATTERNS_RE2)}, {SQL_CHARS}, {sql_points('sp')}, {SQL_MW}, {RULE_FLAGS_SQL}
SELECT grp, type, count(*) AS n_rules, count(*) FILTER (WHERE NOT ms) AS n_start_aligned,
  count(*) FILTER (WHERE NOT me) AS n_end_aligned, count(*) FILTER (WHERE NOT ms AND NOT me) AS n_fully
FROM pr GROUP BY grp, type""")
def mid_word_runs_q(spark, sf):
    """ALN-2 (M1) general form: borders stabbed into word runs (works for
    spans from any source, e.g. a user's span table)."""
    d = docs_by_doc(spark, sf)
    fl = rule_word_split(extract_spans(d, DOC_PATTERNS), word_runs(d, keep=("grp",)), carry=())
    return _flag_counts(fl, ["grp", "type"])


@register("mid_word_points", f"""WITH {SQL_DOCS}, {SQL_CHARS},
pts AS (SELECT doc_id, grp, NULL AS type, NULL AS span_id, 'p' AS side, unnest(range(0, strlen(text) + 1)) AS p FROM d),
{SQL_MW}
SELECT grp, count(*) AS n_points, count(*) FILTER (WHERE mid) AS n_mid,
  CAST(sum(p) FILTER (WHERE mid) AS BIGINT) AS sum_mid_p FROM mw GROUP BY grp""")
def mid_word_points_q(spark, sf):
    """ALN-2 on every byte: a position inside a multi-byte character
    never splits a word (no character index, as in the reference)."""
    d = docs_by_doc(spark, sf)
    pts = d.select("doc_id", "grp", F.explode(F.sequence(F.lit(0).cast("bigint"), F.octet_length("text").cast("bigint"))).alias("p"))
    c = boundary_context(pts, runs=word_runs(d, keep=("grp",)))
    return c.groupBy("grp").agg(F.count(F.lit(1)).alias("n_points"), F.count_if("mid_word").alias("n_mid"),
                                F.sum(F.when(F.col("mid_word"), F.col("p"))).cast("bigint").alias("sum_mid_p"))


@register("containing_token", f"""WITH {SQL_DOCS}, {SQL_CHUNK_RULES}, {sql_points('cr')}, {sql_tokens('tk', 'piece4')},
r AS (SELECT pts.grp, pts.p, tk.tok_id, tk.s FROM pts LEFT JOIN tk ON tk.doc_id = pts.doc_id AND tk.s < pts.p AND pts.p < tk.e)
SELECT grp, count(*) AS n_points, count(tok_id) AS n_inside, CAST(sum(tok_id) AS BIGINT) AS sum_tok_id,
  CAST(sum(s) AS BIGINT) AS sum_tok_s FROM r GROUP BY grp""")
def containing_token_q(spark, sf):
    """ALN-1: for every chunk border, the piece4 token strictly containing it
    (``containing_token_blocks`` has the general join)."""
    r = chunk_points(spread(docs(spark, sf)), CHUNK, "piece4")
    return r.groupBy("grp").agg(F.count(F.lit(1)).alias("n_points"), F.count("tok_id").alias("n_inside"),
                                F.sum("tok_id").cast("bigint").alias("sum_tok_id"),
                                F.sum("tok_s").cast("bigint").alias("sum_tok_s"))


def _tol_sql(tol: int) -> str:
    return f"""WITH {SQL_DOCS}, {SQL_CHUNK_RULES}, {sql_tokens('tk', 'pretok')},
f AS (SELECT grp,
  EXISTS (SELECT 1 FROM tk WHERE tk.doc_id = cr.doc_id AND tk.s BETWEEN cr.s - {tol} AND cr.s + {tol}) AS sa,
  EXISTS (SELECT 1 FROM tk WHERE tk.doc_id = cr.doc_id AND tk.e BETWEEN cr.e - {tol} AND cr.e + {tol}) AS ea FROM cr)
SELECT grp, count(*) AS n_rules, count(*) FILTER (WHERE sa) AS n_start_aligned, count(*) FILTER (WHERE ea) AS n_end_aligned,
  count(*) FILTER (WHERE sa AND ea) AS n_fully FROM f GROUP BY grp"""


def _tol(spark, sf, tol):
    d = docs_by_doc(spark, sf)
    return _flag_counts(tolerance_align(chunk_spans(d, CHUNK), boundaries(d, "pretok"), tol=tol, covering=True), ["grp"])


@register("tolerance_scores", _tol_sql(1))
def tolerance_scores_q(spark, sf):
    """ALN-3 (M2, tol=1): chunk borders against pretok token borders, inside
    each row (``tolerance_exact`` has the general join)."""
    c = tolerance_counts(spread(docs(spark, sf)), CHUNK, ["pretok"])
    return c.groupBy("grp").agg(F.sum("n_rules").alias("n_rules"), F.sum("n_start_aligned").alias("n_start_aligned"),
                                F.sum("n_end_aligned").alias("n_end_aligned"), F.sum("n_fully_aligned").alias("n_fully"))


@register("tolerance_exact", _tol_sql(0))
def tolerance_exact_q(spark, sf):
    """ALN-3 with tol=0 (exact border match)."""
    return _tol(spark, sf, 0)


@register("nearest_token", f"""WITH {SQL_DOCS}, {SQL_CHUNK_RULES}, {sql_tokens('tk', 'pretok')},
st AS (SELECT cr.doc_id, cr.span_id, arg_min(tk.tok_id, abs(cr.s - tk.s) * 1000000 + tk.tok_id) AS start_token,
         min(abs(cr.s - tk.s)) AS start_distance,
         arg_min(tk.tok_id, abs(cr.e - tk.e) * 1000000 + tk.tok_id) AS end_token, min(abs(cr.e - tk.e)) AS end_distance
       FROM cr JOIN tk ON tk.doc_id = cr.doc_id GROUP BY cr.doc_id, cr.span_id)
SELECT doc_id, span_id, start_token, CAST(start_distance AS BIGINT) AS start_distance, end_token,
  CAST(end_distance AS BIGINT) AS end_distance FROM st""")
def nearest_token_q(spark, sf):
    """ALN-4: nearest pretok token to each chunk border (ties -> lowest id)."""
    d = docs_by_doc(spark, sf)
    n = nearest_token(chunk_spans(d, CHUNK), boundaries(d, "pretok"), keep=(), covering=True)
    return n.select("doc_id", "span_id", "start_token", "start_distance", "end_token", "end_distance")


@register("token_cut_score", f"""WITH {SQL_DOCS}, {SQL_CHUNK_RULES}, {sql_tokens('tk', 'pretok')},
f AS (SELECT grp,
  EXISTS (SELECT 1 FROM tk WHERE tk.doc_id = cr.doc_id AND tk.s < cr.s AND cr.s < tk.e) AS sc,
  EXISTS (SELECT 1 FROM tk WHERE tk.doc_id = cr.doc_id AND tk.s < cr.e AND cr.e < tk.e) AS ec FROM cr)
SELECT grp, count(*) AS n_rules, count(*) FILTER (WHERE sc) AS n_start_cut, count(*) FILTER (WHERE ec) AS n_end_cut,
  count(*) FILTER (WHERE NOT sc AND NOT ec) AS n_uncut,
  round(100.0 * count(*) FILTER (WHERE NOT sc AND NOT ec) / count(*), 6) AS uncut_pct FROM f GROUP BY grp""")
def token_cut_score_q(spark, sf):
    """ALN-6 (M3 as a score): chunk borders strictly inside pretok tokens."""
    d = docs_by_doc(spark, sf)
    t = token_cut(chunk_spans(d, CHUNK), boundaries(d, "pretok"))
    g = t.groupBy("grp").agg(F.count(F.lit(1)).alias("n_rules"), F.count_if("start_cut").alias("n_start_cut"),
                             F.count_if("end_cut").alias("n_end_cut"), F.count_if("uncut").alias("n_uncut"))
    return r6(g.withColumn("uncut_pct", F.col("n_uncut") * 100.0 / F.col("n_rules")))


def _detail(spark, sf):
    """The general form: rules and tokens as rows."""
    d = docs_by_doc(spark, sf)
    return align_detail(chunk_spans(d, CHUNK, border_chars=True), None, tokens(d, "pretok", keep=("grp",)))


SQL_DETAIL = f"""WITH {SQL_DOCS}, {SQL_CHUNK_RULES}, {SQL_CHARS}, {sql_points('cr')}, {SQL_MW}, {sql_tokens('tk', 'pretok')},
-- tokens don't overlap: the last one that starts before a border is the only one that can hold it
near AS (SELECT mw.*, mw.mid AND tk.e > mw.p AS inside, tk.tok_id AS i, tk.s AS j, tk.e AS k, left(tk.piece, 50) AS l
         FROM mw ASOF LEFT JOIN tk ON tk.doc_id = mw.doc_id AND mw.p > tk.s),
ctx AS (SELECT * EXCLUDE (i, j, k, l), CASE WHEN inside THEN i END AS tok_id, CASE WHEN inside THEN j END AS ts, CASE WHEN inside THEN k END AS te,
          CASE WHEN inside THEN l END AS tp FROM near),
sd AS (SELECT * FROM ctx WHERE side = 's'), ed AS (SELECT * FROM ctx WHERE side = 'e'),
det AS (
  SELECT cr.doc_id, cr.type, cr.span_id, cr.s, cr.e, cr.piece, sd.mid AS ms, ed.mid AS me,
    sd.lc AS sl, sd.rc AS sr, ed.lc AS el, ed.rc AS er, sd.tok_id AS si, sd.ts, sd.te, sd.tp, ed.tok_id AS ei, ed.ts AS es, ed.te AS ee, ed.tp AS ep
  FROM cr JOIN sd ON sd.doc_id = cr.doc_id AND sd.span_id = cr.span_id
          JOIN ed ON ed.doc_id = cr.doc_id AND ed.span_id = cr.span_id)"""


@register("alignment_detail", SQL_DETAIL + """
SELECT doc_id, type || '_' || s || '_' || e AS rule_key, s AS start_byte, e AS end_byte, NOT ms AS start_aligned,
  NOT me AS end_aligned, ms AS crossing_start, me AS crossing_end,
  CASE WHEN ms THEN printf('rule.start_byte=%d splits word between ''%s'' and ''%s''', s, sl, sr) END AS crossing_start_reason,
  CASE WHEN me THEN printf('rule.end_byte=%d splits word between ''%s'' and ''%s''', e, el, er) END AS crossing_end_reason,
  si AS start_token_index, ts AS start_token_start, te AS start_token_end, tp AS start_token_preview,
  ei AS end_token_index, es AS end_token_start, ee AS end_token_end, ep AS end_token_preview,
  printf('Tree-sitter node ''%s'' spans bytes [%d, %d) from node.start_byte/end_byte.', type, s, e) AS explain_tree_sitter,
  'Token boundaries derived via offset_mapping; offsets mapped to UTF-8 byte positions.' AS explain_tokenizer,
  NOT ms AND NOT me AS fully_aligned, left(piece, 50) AS text_preview
FROM det WHERE ms OR me""")
def alignment_detail_q(spark, sf):
    """ALN-5: detail records of the failing chunk rules, token context of
    the crossing sides from pretok tokens (flattened for comparison)."""
    x = chunk_details(spread(docs(spark, sf)), CHUNK, "pretok", failing_only=True)
    ctx = []
    for side, c in (("start", "token_start_context"), ("end", "token_end_context")):
        ctx += [F.col(f"{c}.token_index").alias(f"{side}_token_index"), F.col(f"{c}.token_start").alias(f"{side}_token_start"),
                F.col(f"{c}.token_end").alias(f"{side}_token_end"), F.col(f"{c}.token_text_preview").alias(f"{side}_token_preview")]
    return x.select("doc_id", "rule_key", "start_byte", "end_byte", "start_aligned", "end_aligned", "crossing_start",
                    "crossing_end", "crossing_start_reason", "crossing_end_reason", *ctx, "explain_tree_sitter",
                    "explain_tokenizer", "fully_aligned", "text_preview")


@register("unaligned_list", SQL_DETAIL + """
SELECT doc_id, count(*) AS n_unaligned, arg_min(type || '_' || s || '_' || e, s) AS first_rule_key,
  CAST(max(e) AS BIGINT) AS last_end FROM det WHERE ms OR me GROUP BY doc_id""")
def unaligned_list_q(spark, sf):
    """AGG-2: per document the ordered list of failing rules (size, first
    key, last end checked)."""
    ul = unaligned_list(_detail(spark, sf))
    return ul.select("doc_id", F.size("unaligned_rules").cast("bigint").alias("n_unaligned"),
                     F.col("unaligned_rules")[0]["rule_key"].alias("first_rule_key"),
                     F.element_at("unaligned_rules", -1)["end_byte"].alias("last_end"))


# small segments and blocks, so that most documents are cut
SEGMENT, BLOCK = 1000, 2000


@register("containing_token_blocks", f"""WITH {SQL_DOCS}, {SQL_CHUNK_RULES}, {sql_points('cr')}, {sql_tokens('tk', 'piece4')},
r AS (SELECT pts.grp, pts.p, tk.tok_id, tk.s FROM pts LEFT JOIN tk ON tk.doc_id = pts.doc_id AND tk.s < pts.p AND pts.p < tk.e)
SELECT grp, count(*) AS n_points, count(tok_id) AS n_inside, CAST(sum(tok_id) AS BIGINT) AS sum_tok_id,
  CAST(sum(s) AS BIGINT) AS sum_tok_s FROM r GROUP BY grp""")
def containing_token_blocks_q(spark, sf):
    """ALN-1 with every document cut into segments and position blocks."""
    d = spread(docs(spark, sf))
    pts = boundary_points(chunks_in_segments(d, CHUNK, segment=SEGMENT))
    r = stab(pts, tokens_in_segments(d, ["piece4"], segment=SEGMENT), disjoint=True, block=BLOCK)
    return r.groupBy("grp").agg(F.count(F.lit(1)).alias("n_points"), F.count("tok").alias("n_inside"),
                                F.sum("tok.tok_id").cast("bigint").alias("sum_tok_id"),
                                F.sum("tok.s").cast("bigint").alias("sum_tok_s"))


@register("nearest_token_blocks", f"""WITH {SQL_DOCS}, {SQL_CHUNK_RULES}, {sql_tokens('t0', 'pretok')},
tk AS (SELECT * FROM t0 WHERE tok_id % 40 = 7),
st AS (SELECT cr.doc_id, cr.span_id, arg_min(tk.tok_id, abs(cr.s - tk.s) * 1000000 + tk.tok_id) AS start_token,
         min(abs(cr.s - tk.s)) AS start_distance,
         arg_min(tk.tok_id, abs(cr.e - tk.e) * 1000000 + tk.tok_id) AS end_token, min(abs(cr.e - tk.e)) AS end_distance
       FROM cr LEFT JOIN tk ON tk.doc_id = cr.doc_id GROUP BY cr.doc_id, cr.span_id)
SELECT doc_id, span_id, start_token, CAST(start_distance AS BIGINT) AS start_distance, end_token,
  CAST(end_distance AS BIGINT) AS end_distance FROM st""")
def nearest_token_blocks_q(spark, sf):
    """ALN-4 in position blocks with gapped tokens (every 40th of the pretok
    scheme), whose nearest lie blocks away."""
    d = spread(docs(spark, sf))
    t = tokens_in_segments(d, ["pretok"], segment=SEGMENT).filter("tok_id % 40 = 7").drop("is_last")
    n = nearest_token(chunks_in_segments(d, CHUNK, segment=SEGMENT), t, keep=(), block=BLOCK // 8)
    return n.select("doc_id", "span_id", "start_token", "start_distance", "end_token", "end_distance")


@register("analyze_tolerance", f"""WITH {SQL_DOCS}, {sql_spans('d', {'sentence': DOC_PATTERNS_RE2['sentence']})},
{sql_tokens('tk', 'pretok')},
f AS (SELECT doc_id, grp,
  EXISTS (SELECT 1 FROM tk WHERE tk.doc_id = sp.doc_id AND tk.s BETWEEN sp.s - 1 AND sp.s + 1)
  AND EXISTS (SELECT 1 FROM tk WHERE tk.doc_id = sp.doc_id AND tk.e BETWEEN sp.e - 1 AND sp.e + 1) AS ok,
  type || '_' || s || '_' || e AS k FROM sp),
ds AS (SELECT d.doc_id, d.grp, count(f.k) AS n, count(f.k) FILTER (WHERE f.ok) AS a, count(DISTINCT f.k) AS nd,
         count(DISTINCT f.k) FILTER (WHERE f.ok) AS ad, length(any_value(d.text)) AS nc, strlen(any_value(d.text)) AS nb
       FROM d LEFT JOIN f ON f.doc_id = d.doc_id GROUP BY d.doc_id, d.grp)
SELECT grp, count(*) AS file_count, round(avg(CASE WHEN n = 0 THEN 0.0 ELSE 100.0 * a / n END), 6) AS avg_score,
  CAST(sum(nd) AS BIGINT) AS total_rules, CAST(sum(ad) AS BIGINT) AS total_aligned, CAST(sum(nc) AS BIGINT) AS total_code_size,
  CAST(sum(nb) AS BIGINT) AS total_bytes, round(100.0 * sum(ad) / sum(nd), 6) AS overall_alignment FROM ds GROUP BY grp""")
def analyze_tolerance_q(spark, sf):
    """End-to-end run (E1/E2 flow): sentence rules, M2 against pretok
    tokens, per-document scores (documents without sentences kept), group
    statistics per language."""
    from spanalign.analysis import analyze
    from spanalign.plans.common import docs
    a = analyze(docs(spark, sf), {"sentence": DOC_PATTERNS["sentence"]}, metric="tolerance", scheme="pretok")
    return r6(a.group_stats)
