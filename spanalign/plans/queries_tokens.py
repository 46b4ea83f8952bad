"""Token and offset plans (TOK-1, 2, 4, 5; OFF-1..4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanalign.functions.patterns import TOKEN_SCHEMES
from spanalign.operators.offsets import byte_to_char
from spanalign.operators.tokens import (fill_missing_tokens, token_counts, token_table, tokens,
                                        tokens_from_table)
from spanalign.plans.catalog import SQL_DOCS, register
from spanalign.plans.common import conversations_corpus, docs, docs_by_doc
from spanalign.sources.tables import spread

SCHEMES = ["word", "piece4", "ws", "char", "pretok"]

SQL_CONV = """cv AS (SELECT conv_id || '/' || turn AS doc_id, role AS grp, text FROM conversations
  WHERE text IS NOT NULL AND regexp_matches(text, '[^\\t\\n\\x0B\\f\\r\\x1C-\\x1F \\x85\\p{Z}]'))"""


def _sql_count(scheme):
    if scheme == "char":
        return "length(text)"
    return f"len(regexp_extract_all(text, '{TOKEN_SCHEMES[scheme]}'))"


@register("token_counts", f"""WITH {SQL_DOCS}
""" + "\nUNION ALL\n".join(
    f"SELECT grp, '{s}' AS scheme, CAST(sum({_sql_count(s)}) AS BIGINT) AS n_tokens FROM d GROUP BY grp"
    for s in SCHEMES))
def token_counts_q(spark, sf):
    """TOK-1: pieces per language and scheme, all schemes in one scan."""
    t = token_counts(spread(docs(spark, sf)), SCHEMES)
    return t.groupBy("grp", "scheme").agg(F.sum("n_tokens").cast("bigint").alias("n_tokens"))


SQL_WORD_PIECES = f"""wp AS (
  SELECT doc_id, grp, text, i, piece,
    sum(strlen(piece)) OVER w - strlen(piece) AS b0, sum(strlen(piece)) OVER w AS b1,
    sum(length(piece)) OVER w - length(piece) AS c0
  FROM (SELECT doc_id, grp, text, unnest(p) AS piece, generate_subscripts(p, 1) AS i
        FROM (SELECT *, regexp_extract_all(text, '{TOKEN_SCHEMES["word"]}') AS p FROM d))
  WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@register("byte_offsets", f"""WITH {SQL_DOCS}, {SQL_WORD_PIECES},
lastp AS (SELECT doc_id, max(b1) AS b_end, any_value(strlen(text)) AS nb FROM wp GROUP BY doc_id)
SELECT wp.grp, count(*) AS n_pieces, CAST(sum(b0) AS BIGINT) AS sum_b0, CAST(sum(b1) AS BIGINT) AS sum_b1,
  CAST(sum(c0) AS BIGINT) AS sum_c0,
  CAST(count(DISTINCT wp.doc_id) FILTER (WHERE lastp.b_end = lastp.nb) AS BIGINT) AS docs_covered
FROM wp JOIN lastp ON lastp.doc_id = wp.doc_id GROUP BY wp.grp""")
def byte_offsets_q(spark, sf):
    """OFF-1: byte and character offsets of word pieces; the last piece of
    every document must end at its UTF-8 length."""
    d = docs_by_doc(spark, sf).withColumn("nb", F.octet_length("text").cast("bigint"))
    t = tokens(d, "word", keep=("grp", "nb"))
    x = t.groupBy("doc_id", "grp").agg(
        F.count(F.lit(1)).alias("n"), F.sum("s").alias("sb0"), F.sum("e").alias("sb1"),
        F.sum("cs").alias("sc0"), F.max("e").alias("b_end"), F.max("nb").alias("nb"))
    return x.groupBy("grp").agg(
        F.sum("n").cast("bigint").alias("n_pieces"), F.sum("sb0").cast("bigint").alias("sum_b0"),
        F.sum("sb1").cast("bigint").alias("sum_b1"), F.sum("sc0").cast("bigint").alias("sum_c0"),
        F.count_if(F.col("b_end") == F.col("nb")).cast("bigint").alias("docs_covered"))


U16 = "(length({x}) + length(regexp_replace({x}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"


@register("utf16_offsets", f"""WITH {SQL_DOCS}, {SQL_WORD_PIECES},
u AS (SELECT doc_id, grp, i, sum({U16.format(x='piece')}) OVER w AS u1, {U16.format(x='piece')} AS nu
      FROM wp WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT grp, CAST(sum(u1 - nu) AS BIGINT) AS sum_u0, CAST(max(u1) AS BIGINT) AS max_u1,
  CAST(sum(u1) FILTER (WHERE nu <> 1) AS BIGINT) AS sum_u1_multi FROM u GROUP BY grp""")
def utf16_offsets_q(spark, sf):
    """OFF-3: UTF-16 code-unit positions of word pieces."""
    t = tokens(docs_by_doc(spark, sf), "word", keep=("grp",), utf16=True)
    return t.groupBy("grp").agg(F.sum("u0").cast("bigint").alias("sum_u0"), F.max("u1").cast("bigint").alias("max_u1"),
                                F.sum(F.when(F.col("u1") - F.col("u0") != 1, F.col("u1"))).cast("bigint").alias("sum_u1_multi"))


@register("byte_to_char", f"""WITH {SQL_DOCS},
chars AS (SELECT doc_id, ci - 1 AS ci, sum(strlen(c)) OVER w - strlen(c) AS b0
  FROM (SELECT doc_id, unnest(a) AS c, generate_subscripts(a, 1) AS ci FROM (SELECT doc_id, regexp_extract_all(text, '(?s).') AS a FROM d))
  WINDOW w AS (PARTITION BY doc_id ORDER BY ci ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
pts AS (SELECT doc_id, grp, unnest(range(0, strlen(text) + 1)) AS p, strlen(text) AS nb, length(text) AS nc FROM d),
r AS (SELECT pts.doc_id, grp, p, CASE WHEN p = nb THEN nc ELSE chars.ci END AS ci
      FROM pts LEFT JOIN chars ON chars.doc_id = pts.doc_id AND chars.b0 = pts.p)
SELECT grp, count(*) AS n_points, count(*) FILTER (WHERE ci IS NULL) AS n_inside, CAST(sum(ci) AS BIGINT) AS sum_char_index
FROM r GROUP BY grp""")
def byte_to_char_q(spark, sf):
    """OFF-2: character index of every byte position (null inside a
    multi-byte character), resolved against word pieces."""
    d = docs_by_doc(spark, sf)
    pts = d.select("doc_id", "grp", F.explode(F.sequence(F.lit(0).cast("bigint"),
                                                         F.octet_length("text").cast("bigint"))).alias("p"))
    pcs = tokens(d, "word", keep=("grp",)).select("doc_id", F.col("s").alias("b0"), F.col("cs").alias("c0"), "piece")
    r = byte_to_char(pts, pcs)
    return r.groupBy("grp").agg(F.count(F.lit(1)).alias("n_points"),
                                F.count_if(F.col("char_index").isNull()).alias("n_inside"),
                                F.sum("char_index").cast("bigint").alias("sum_char_index"))


SQL_WS_PIECES = f"""wsp AS (
  SELECT doc_id, grp, text, i - 1 AS tok_id, piece,
    sum(strlen(piece)) OVER w - strlen(piece) AS b0, sum(strlen(piece)) OVER w AS b1,
    sum(length(piece)) OVER w - length(piece) AS c0, sum(length(piece)) OVER w AS c1
  FROM (SELECT doc_id, grp, text, unnest(p) AS piece, generate_subscripts(p, 1) AS i
        FROM (SELECT *, regexp_extract_all(text, '{TOKEN_SCHEMES["ws"]}') AS p FROM cv))
  WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def _conv_char_offsets(spark, sf):
    """Character offsets of the non-space pieces of every turn, as an
    upstream tokenizer would hand them over (array<struct<s,e>> per turn)."""
    cv = conversations_corpus(spark, sf)
    t = tokens(cv, "ws", keep=("grp",)).filter(~F.col("piece").rlike(r"^[\t\n\x0B\f\r ]"))
    # one row per turn (carrying the text once) unioned with the offset rows and
    # grouped by doc_id: no join, and the grouping reuses the doc_id partitioning
    off = F.struct(F.col("cs").alias("s"), F.col("ce").alias("e"))
    rows = cv.select("doc_id", "grp", "text", F.lit(None).cast("struct<s:bigint,e:bigint>").alias("_o")).unionByName(
        t.select("doc_id", "grp", F.lit(None).cast("string").alias("text"), off.alias("_o")))
    return rows.groupBy("doc_id", "grp").agg(F.max("text").alias("text"),
                                             F.sort_array(F.collect_list("_o")).alias("offsets"))


@register("conversation_tokens", f"""WITH {SQL_CONV}, {SQL_WS_PIECES}
SELECT grp, count(*) AS n_tokens, CAST(sum(b0) AS BIGINT) AS sum_s, CAST(sum(b1) AS BIGINT) AS sum_e,
  CAST(sum(c0) AS BIGINT) AS sum_cs
FROM wsp WHERE NOT regexp_matches(piece, '^[\\t\\n\\x0B\\f\\r ]') GROUP BY grp""")
def conversation_tokens_q(spark, sf):
    """TOK-2: pre-tokenised turns with character offsets -> byte tokens."""
    t = tokens_from_table(_conv_char_offsets(spark, sf), "offsets", "text", unit="char", keep=("grp",))
    return t.groupBy("grp").agg(F.count(F.lit(1)).alias("n_tokens"), F.sum("s").cast("bigint").alias("sum_s"),
                                F.sum("e").cast("bigint").alias("sum_e"), F.sum("cs").cast("bigint").alias("sum_cs"))


def _messy(o, i):
    """Deterministic damage to offsets: every 7th pair null, every 5th
    reversed, the rest widened by 2 left / 3 right (may leave the text)."""
    return (F.when(i % 7 == 3, F.struct(F.lit(None).cast("bigint").alias("s"), o["e"].alias("e")))
            .when(i % 5 == 1, F.struct(o["e"].alias("s"), o["s"].alias("e")))
            .otherwise(F.struct((o["s"] - 2).alias("s"), (o["e"] + 3).alias("e"))))


@register("clean_offsets", f"""WITH {SQL_CONV}, {SQL_WS_PIECES},
ns AS (SELECT doc_id, grp, text, c0, c1, row_number() OVER (PARTITION BY doc_id ORDER BY tok_id) - 1 AS k
       FROM wsp WHERE NOT regexp_matches(piece, '^[\\t\\n\\x0B\\f\\r ]')),
m AS (SELECT doc_id, grp, text,
        CASE WHEN k % 7 = 3 THEN NULL WHEN k % 5 = 1 THEN c1 ELSE c0 - 2 END AS s,
        CASE WHEN k % 7 = 3 THEN c1 WHEN k % 5 = 1 THEN c0 ELSE c1 + 3 END AS e FROM ns),
c AS (SELECT doc_id, grp, text, greatest(0, least(s, length(text))) AS s, greatest(0, least(e, length(text))) AS e
      FROM m WHERE s IS NOT NULL AND e IS NOT NULL AND e > s),
b AS (SELECT grp, strlen(substr(text, 1, CAST(s AS BIGINT))) AS bs, strlen(substr(text, 1, CAST(e AS BIGINT))) AS be FROM c)
SELECT grp, count(*) AS n_tokens, CAST(sum(bs) AS BIGINT) AS sum_s, CAST(sum(be) AS BIGINT) AS sum_e
FROM b WHERE be > bs GROUP BY grp""")
def clean_offsets_q(spark, sf):
    """OFF-4: null pairs and e <= s dropped, offsets clamped to the text,
    mapped to bytes, empty pairs dropped."""
    x = _conv_char_offsets(spark, sf)
    x = x.withColumn("offsets", F.transform("offsets", _messy))
    t = tokens_from_table(x, "offsets", "text", unit="char", keep=("grp",))
    return t.groupBy("grp").agg(F.count(F.lit(1)).alias("n_tokens"), F.sum("s").cast("bigint").alias("sum_s"),
                                F.sum("e").cast("bigint").alias("sum_e"))


@register("fill_missing_tokens", f"""WITH {SQL_DOCS},
n AS (SELECT doc_id, grp, text, regexp_extract_all(text, '\\p{{N}}+') AS nums FROM d)
SELECT CASE WHEN len(nums) > 0 THEN 'offset_mapping' ELSE 'single_byte_fallback' END AS token_source,
  count(*) AS n_docs,
  CAST(sum(CASE WHEN len(nums) > 0 THEN len(nums) ELSE strlen(text) END) AS BIGINT) AS n_tokens,
  CAST(sum(CASE WHEN len(nums) > 0 THEN strlen(array_to_string(nums, '')) ELSE strlen(text) END) AS BIGINT) AS bytes_covered
FROM n GROUP BY 1""")
def fill_missing_tokens_q(spark, sf):
    """TOK-4: number tokens; documents without any get one token per byte."""
    d = docs_by_doc(spark, sf)
    t = tokens(d, r"\p{N}+", keep=("grp",))
    f = fill_missing_tokens(d, t)
    per_doc = f.groupBy("doc_id", "token_source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("e") - F.col("s")).alias("b"))
    return per_doc.groupBy("token_source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").cast("bigint").alias("n_tokens"),
                                               F.sum("b").cast("bigint").alias("bytes_covered"))


@register("token_table", f"""WITH {SQL_CONV},
p AS (SELECT doc_id, grp, unnest(a) AS piece, generate_subscripts(a, 1) - 1 AS tok_id, len(a) AS n_tokens
      FROM (SELECT *, regexp_extract_all(text, '{TOKEN_SCHEMES["pretok"]}') AS a FROM cv)),
o AS (SELECT *, sum(strlen(piece)) OVER (PARTITION BY doc_id ORDER BY tok_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e FROM p)
SELECT doc_id, grp, CAST(tok_id AS INTEGER) AS tok_id, CAST(e - strlen(piece) AS BIGINT) AS s, CAST(e AS BIGINT) AS e, piece,
  '''' || piece || '''' AS quoted, CAST(n_tokens AS BIGINT) AS n_tokens FROM o""")
def token_table_q(spark, sf):
    """TOK-5: the per-token table of the pretok scheme on conversation turns."""
    return token_table(tokens(conversations_corpus(spark, sf), "pretok", keep=("grp",)))


@register("locate_pieces", f"""WITH {SQL_CONV},
t AS (SELECT doc_id, grp, CAST(k - 1 AS INTEGER) AS tok_id, CAST(e1 - strlen(x) AS BIGINT) AS s, CAST(e1 AS BIGINT) AS e FROM (
        SELECT *, sum(strlen(x)) OVER w AS e1 FROM (
          SELECT doc_id, grp, i AS k, x FROM (SELECT doc_id, grp, unnest(b) AS x, generate_subscripts(b, 1) AS i
             FROM (SELECT *, regexp_extract_all(text, '[^\\t\\n\\x0B\\f\\r ]+|[\\t\\n\\x0B\\f\\r ]+') AS b FROM cv)))
        WINDOW w AS (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
      WHERE NOT regexp_matches(x, '^[\\t\\n\\x0B\\f\\r ]')),
lastt AS (SELECT cv.doc_id, cv.grp, strlen(cv.text) AS nb, coalesce(max(t.e), 0) AS le, count(t.tok_id) AS nt
          FROM cv LEFT JOIN t ON t.doc_id = cv.doc_id GROUP BY cv.doc_id, cv.grp, cv.text),
allt AS (SELECT grp, tok_id, s, e FROM t
         UNION ALL SELECT grp, CAST(nt AS INTEGER), least(le, nb), least(le + 1, nb) FROM lastt)
SELECT grp, count(*) AS n_tokens, CAST(sum(s) AS BIGINT) AS sum_s, CAST(sum(e) AS BIGINT) AS sum_e,
  count(*) FILTER (WHERE e = s) AS n_empty FROM allt GROUP BY grp""")
def locate_pieces_q(spark, sf):
    """TOK-3: the non-space pieces of every turn plus one piece that does
    not occur, located by the forward search; the missing piece becomes a
    one-byte placeholder at the cursor (empty at the very end)."""
    from spanalign.operators.tokens import locate_pieces
    cv = conversations_corpus(spark, sf)
    x = cv.withColumn("pieces", F.concat(F.regexp_extract_all("text", F.lit(r"[^\t\n\x0B\f\r ]+"), F.lit(0)),
                                         F.array(F.lit("\u0001"))))
    t = locate_pieces(x, "text", "pieces", keep=("grp",))
    return t.groupBy("grp").agg(F.count(F.lit(1)).alias("n_tokens"), F.sum("s").cast("bigint").alias("sum_s"),
                                F.sum("e").cast("bigint").alias("sum_e"), F.count_if(F.col("e") == F.col("s")).alias("n_empty"))
