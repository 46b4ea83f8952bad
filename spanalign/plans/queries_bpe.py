"""Plans under learned byte-pair vocabularies (TOK-1, ALN-1, AGG-16). The
oracles read the same vocabulary files and merge by the definition: in each
round every word's neighbouring pair of lowest rank, the leftmost of equals."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanalign.functions.patterns import BPE_PRETOKEN, BPE_SPACE
from spanalign.operators.align import boundary_points, covering_tolerance, stab
from spanalign.operators.bpe import PREFIX, bpe_token_counts, bpe_tokens
from spanalign.operators.reports import compare_schemes
from spanalign.operators.spans import chunk_spans
from spanalign.operators.tokens import boundaries, multi_scheme_tokens
from spanalign.plans.catalog import SQL_DOCS, r6, register
from spanalign.plans.common import CHUNK, conversations_corpus, docs, docs_by_doc
from spanalign.plans.queries_align import SQL_CHUNK_RULES, sql_points
from spanalign.plans.queries_tokens import SQL_CONV
from spanalign.sources.tables import spread

VOCABULARIES = ["/opt/tokenizers/byte_bpe_50k.tiktoken", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"]
SCHEMES = [PREFIX + v for v in VOCABULARIES]

# RE2 has no look-ahead: a mark before the last of several blanks that a
# character follows splits the text where the look-ahead would
_PIECES = f"[{BPE_SPACE}]+".join(BPE_PRETOKEN.split(f"[{BPE_SPACE}]+(?![^{BPE_SPACE}])|[{BPE_SPACE}]+")).replace("'", "''")
_MARK = rf"string_split(regexp_replace(text, '([{BPE_SPACE}])([{BPE_SPACE}][^{BPE_SPACE}])', '\1' || chr(57344) || '\2', 'g'), chr(57344))"


def sql_segments(src: str, schemes=SCHEMES) -> str:
    """CTEs ``occ`` (doc_id, grp, i, piece) and ``seg`` (scheme, piece, p: the
    tokens as hex strings)."""
    ranks = " UNION ALL ".join(
        f"SELECT '{s}' AS scheme, hex(from_base64(b)) AS h, r FROM read_csv('{s.removeprefix(PREFIX)}', delim=' ', header=false, "
        "quote='', escape='', columns={'b': 'VARCHAR', 'r': 'INTEGER'})" for s in schemes)
    return f"""pcs AS (SELECT doc_id, grp, flatten(list_transform({_MARK}, lambda x: regexp_extract_all(x, '{_PIECES}'))) AS a FROM {src}),
occ AS (SELECT doc_id, grp, unnest(a) AS piece, generate_subscripts(a, 1) - 1 AS i FROM pcs),
ranks AS ({ranks}),
w AS (SELECT scheme, piece, hex(encode(piece)) AS h FROM (SELECT DISTINCT piece FROM occ), (SELECT DISTINCT scheme FROM ranks)),
bpe AS (SELECT w.scheme, piece, CASE WHEN ranks.h IS NOT NULL THEN [w.h] ELSE regexp_extract_all(w.h, '..') END AS p
    FROM w LEFT JOIN ranks ON ranks.scheme = w.scheme AND ranks.h = w.h
  UNION ALL SELECT scheme, piece, list_concat(list_concat(p[1:pos-1], [p[pos] || p[pos+1]]), p[pos+2:]) FROM (
    SELECT x.scheme, piece, any_value(p) AS p, arg_min(i, CAST(r AS BIGINT) * 1000000 + i) AS pos
    FROM (SELECT scheme, piece, p, unnest(range(1, len(p))) AS i FROM bpe WHERE len(p) > 1) x
    JOIN ranks ON ranks.scheme = x.scheme AND ranks.h = x.p[x.i] || x.p[x.i + 1] GROUP BY x.scheme, piece)),
seg AS (SELECT scheme, piece, arg_min(p, len(p)) AS p FROM bpe GROUP BY scheme, piece)"""


SQL_TOKENS = """tk AS (
  SELECT doc_id, grp, scheme, CAST(row_number() OVER w - 1 AS INTEGER) AS tok_id, CAST(sum(len(x) // 2) OVER w AS BIGINT) AS e,
    CAST(sum(len(x) // 2) OVER w - len(x) // 2 AS BIGINT) AS s
  FROM (SELECT doc_id, grp, scheme, i, unnest(p) AS x, generate_subscripts(p, 1) AS j FROM occ JOIN seg USING (piece))
  WINDOW w AS (PARTITION BY doc_id, scheme ORDER BY i, j ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@register("bpe_token_counts", f"""WITH RECURSIVE {SQL_DOCS}, {sql_segments('d')},
cnt AS (SELECT grp, piece, count(*) AS n FROM occ GROUP BY grp, piece)
SELECT grp, scheme, CAST(sum(n) AS BIGINT) AS n_pretokens, CAST(sum(n * len(p)) AS BIGINT) AS n_tokens
FROM cnt JOIN seg USING (piece) GROUP BY grp, scheme""")
def bpe_token_counts_q(spark, sf):
    """TOK-1: tokens of two learned vocabularies per language."""
    return bpe_token_counts(spread(docs(spark, sf)), SCHEMES)


@register("bpe_tokens", f"""WITH RECURSIVE {SQL_CONV}, {sql_segments('cv')}, {SQL_TOKENS}
SELECT doc_id, grp, scheme, tok_id, s, e FROM tk""")
def bpe_tokens_q(spark, sf):
    """TOK-1: every token of the conversation turns with its byte offsets."""
    t = bpe_tokens(conversations_corpus(spark, sf), SCHEMES)
    return t.select("doc_id", "grp", "scheme", "tok_id", "s", "e")


@register("bpe_containing_token", f"""WITH RECURSIVE {SQL_DOCS}, {SQL_CHUNK_RULES}, {sql_points('cr')}, {sql_segments('d', SCHEMES[:1])}, {SQL_TOKENS},
r AS (SELECT pts.grp, pts.p, CASE WHEN tk.e > pts.p THEN tk.tok_id END AS tok_id, CASE WHEN tk.e > pts.p THEN tk.s END AS s
      FROM pts ASOF LEFT JOIN tk ON tk.doc_id = pts.doc_id AND pts.p > tk.s)
SELECT grp, count(*) AS n_points, count(tok_id) AS n_inside, CAST(sum(tok_id) AS BIGINT) AS sum_tok_id,
  CAST(sum(s) AS BIGINT) AS sum_tok_s FROM r GROUP BY grp""")
def bpe_containing_token_q(spark, sf):
    """ALN-1: for every chunk border, the learned token strictly around it."""
    d = docs_by_doc(spark, sf)
    r = stab(boundary_points(chunk_spans(d, CHUNK)), boundaries(d, SCHEMES[0]), disjoint=True)
    return r.groupBy("grp").agg(F.count(F.lit(1)).alias("n_points"), F.count("tok").alias("n_inside"),
                                F.sum("tok.tok_id").cast("bigint").alias("sum_tok_id"),
                                F.sum("tok.s").cast("bigint").alias("sum_tok_s"))


@register("bpe_compare_schemes", f"""WITH RECURSIVE {SQL_DOCS}, {SQL_CHUNK_RULES}, {sql_segments('d')}, {SQL_TOKENS},
near AS (SELECT DISTINCT doc_id, scheme, x + unnest([-1, 0, 1]) AS p, k FROM (
  SELECT doc_id, scheme, s AS x, 's' AS k FROM tk UNION ALL SELECT doc_id, scheme, e, 'e' FROM tk)),
f AS (SELECT cr.doc_id, cr.grp, z.scheme, a.p IS NOT NULL AND b.p IS NOT NULL AS ok FROM cr, (SELECT DISTINCT scheme FROM ranks) z
  LEFT JOIN near a ON a.doc_id = cr.doc_id AND a.scheme = z.scheme AND a.k = 's' AND a.p = cr.s
  LEFT JOIN near b ON b.doc_id = cr.doc_id AND b.scheme = z.scheme AND b.k = 'e' AND b.p = cr.e),
ds AS (SELECT doc_id, grp, scheme, count(*) AS n, count(*) FILTER (WHERE ok) AS a FROM f GROUP BY ALL)
SELECT grp, scheme, round(avg(100.0 * a / n), 6) AS avg_score, round(100.0 * sum(a) / sum(n), 6) AS overall_alignment,
  count(*) AS file_count FROM ds GROUP BY grp, scheme""")
def bpe_compare_schemes_q(spark, sf):
    """AGG-16: two learned vocabularies compared by M2 (tol=1) on chunk rules."""
    d = docs_by_doc(spark, sf)
    fl = covering_tolerance(chunk_spans(d, CHUNK), multi_scheme_tokens(d, SCHEMES, counted=docs(spark, sf)), SCHEMES)
    ds = fl.groupBy("doc_id", "grp", "scheme").agg(F.count(F.lit(1)).alias("n"), F.count_if("fully_aligned").alias("a"))
    st = ds.groupBy("grp", "scheme").agg(F.avg(F.col("a") * 100.0 / F.col("n")).alias("avg_score"),
                                         (F.sum("a") * 100.0 / F.sum("n")).alias("overall_alignment"),
                                         F.count(F.lit(1)).alias("file_count"))
    return r6(compare_schemes(st, SCHEMES))
