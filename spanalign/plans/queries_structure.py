"""Plans over nested structure: brackets and indentation of code (SPN-1) and
the element tree of pages (SPN-5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanalign.functions.patterns import IMPLIED_ENDS, RAW_ELEMENTS, VOID_ELEMENTS
from spanalign.operators.markup import element_tree, markup_pattern
from spanalign.operators.spans import span_tree
from spanalign.operators.structure import TAB, bracket_spans, indent_spans, piece_pattern
from spanalign.plans.catalog import register
from spanalign.plans.common import SQL_PAGES, pages_corpus
from spanalign.sources.tables import read_table, text_partitions


def code_corpus(spark, sf):
    """Stand-in source files: an order as a block of calls, with brackets in
    strings and comments and some that are never closed.

    The tables' own columns are dealt by order once, over as many partitions as
    the texts need, and a text is put together where its order is: neither the
    join nor what runs by document later moves a text."""
    pad = lambda r, n: F.repeat(F.lit(" "), n + 2 * (r["l_linenumber"] % 3))
    line = lambda r: F.concat(pad(r, F.lit(2)), F.lit("part("), r["l_partkey"].cast("string"), F.lit(") {\n"), pad(r, F.lit(4)), F.lit("qty["), r["q"].cast("string"),
                              F.lit('] = "}'), r["l_returnflag"], F.lit('"; /* ) */\n'), F.when(r["l_returnflag"] == "R", F.lit("\n")).otherwise(F.concat(pad(r, F.lit(2)), F.lit("}\n"))))
    whole = lambda body: F.concat(F.lit("order("), F.col("o_orderkey").cast("string"), F.lit(', "'), F.col("o_orderpriority"), F.lit('") {  // ('), F.col("o_orderstatus"), F.lit("\n"), body, F.lit("}\n"))
    li = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("bigint").alias("q"), "l_returnflag")
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    r = F.struct("l_linenumber", "l_partkey", "l_suppkey", "q", "l_returnflag")
    n = text_partitions(li.select(line(r).alias("text")).unionAll(o.select(whole(F.lit("")).alias("text"))))
    body = li.repartition(n, "l_orderkey").groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(r)), line), "").alias("body"))
    o = o.repartition(n, "o_orderkey").join(body.hint("merge"), F.col("o_orderkey") == F.col("l_orderkey"))
    return o.select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderstatus").alias("grp"), whole(F.col("body")).alias("text"))


SQL_CODE = """code AS (SELECT o_orderkey AS doc_id, o_orderstatus AS grp,
    'order(' || o_orderkey || ', "' || o_orderpriority || '") {  // (' || o_orderstatus || chr(10) || body || '}' || chr(10) AS text
  FROM orders JOIN (SELECT l_orderkey, string_agg(t, '' ORDER BY l_linenumber, l_partkey, l_suppkey, q, l_returnflag) AS body FROM (
    SELECT *, CAST(l_quantity AS BIGINT) AS q, repeat(' ', 2 + 2 * (l_linenumber % 3)) AS p,
      p || 'part(' || l_partkey || ') {' || chr(10) || p || '  qty[' || q || '] = "}' || l_returnflag || '"; /* ) */' || chr(10)
        || CASE WHEN l_returnflag = 'R' THEN '' ELSE p || '}' END || chr(10) AS t FROM lineitem) GROUP BY l_orderkey) ON l_orderkey = o_orderkey)"""


def sql_brackets(src: str, comments: str = "c", strings: str = "\"'") -> str:
    """CTE ``br`` (doc_id, grp, type, s, e): an opener's partner is the first
    later closer of its kind after which the kind's depth is what it was
    before the opener."""
    pattern = piece_pattern(comments, strings).replace("'", "''")
    return f"""pc AS (SELECT doc_id, grp, unnest(a) AS x, generate_subscripts(a, 1) AS k FROM (SELECT doc_id, grp, regexp_extract_all(text, '{pattern}') AS a FROM {src})),
po AS (SELECT doc_id, grp, x, CAST(sum(strlen(x)) OVER w AS BIGINT) AS e, CAST(sum(strlen(x)) OVER w - strlen(x) AS BIGINT) AS s FROM pc
  WINDOW w AS (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
ev AS (SELECT *, CASE WHEN x IN ('(', ')') THEN 'paren' WHEN x IN ('[', ']') THEN 'bracket' ELSE 'brace' END AS type, x IN ('(', '[', '{{') AS up
  FROM po WHERE x IN ('(', ')', '[', ']', '{{', '}}')),
dp AS (SELECT *, sum(CASE WHEN up THEN 1 ELSE -1 END) OVER (PARTITION BY doc_id, type ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS d FROM ev),
br AS (SELECT o.doc_id, o.grp, o.type, o.s, min(c.e) AS e, CAST(o.d AS INTEGER) AS depth FROM dp o JOIN dp c ON c.doc_id = o.doc_id AND c.type = o.type AND c.s > o.s AND NOT c.up AND c.d = o.d - 1
  WHERE o.up GROUP BY ALL
  UNION ALL SELECT doc_id, grp, CASE WHEN x[1] IN ('"', '''') THEN 'string' ELSE 'comment' END, s, e, NULL FROM po
    WHERE (len(x) > 1 AND x[1] IN ('"', '''')) OR x[1:2] IN ('//', '/*'))"""


SQL_INDENT = f"""ln AS (SELECT doc_id, grp, unnest(a) AS x, generate_subscripts(a, 1) AS k FROM (SELECT doc_id, grp, regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+') AS a FROM code)),
lo AS (SELECT doc_id, grp, k, x, CAST(sum(strlen(x)) OVER w - strlen(x) AS BIGINT) AS b0, regexp_extract(x, '^[ \\t]*') AS l,
    regexp_extract(x, '^(?s:.*)[^ \\t\\r\\n]') AS b FROM ln WINDOW w AS (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
li AS (SELECT doc_id, grp, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS k, length(l) + {TAB - 1} * (length(l) - length(replace(l, chr(9), ''))) AS h, b0 + strlen(l) AS s, b0 + strlen(b) AS e
  FROM lo WHERE b <> ''),
hd AS (SELECT a.doc_id, a.grp, a.k, a.h, a.s, n.s AS s2, (SELECT min(z.k) FROM li z WHERE z.doc_id = a.doc_id AND z.k > a.k AND z.h <= a.h) AS stop
  FROM li a JOIN li n ON n.doc_id = a.doc_id AND n.k = a.k + 1 AND n.h > a.h),
bl AS (SELECT hd.doc_id, hd.grp, hd.h, hd.s, hd.s2, max(z.e) AS e FROM hd JOIN li z ON z.doc_id = hd.doc_id AND z.k > hd.k AND (hd.stop IS NULL OR z.k < hd.stop) GROUP BY ALL)"""


@register("code_bracket_spans", f"""WITH {SQL_CODE}, {sql_brackets('code')}
SELECT doc_id, grp, type, s, e, depth FROM br""")
def code_bracket_spans_q(spark, sf):
    """SPN-1: brackets, strings and comments of code-like texts."""
    return bracket_spans(code_corpus(spark, sf)).select("doc_id", "grp", "type", "s", "e", "depth")


@register("code_indent_spans", f"""WITH {SQL_CODE}, {SQL_INDENT}
SELECT doc_id, grp, 'block' AS type, s, e, h AS depth FROM bl UNION ALL SELECT doc_id, grp, 'suite', s2, e, h FROM bl""")
def code_indent_spans_q(spark, sf):
    """SPN-1: blocks by indentation of code-like texts."""
    return indent_spans(code_corpus(spark, sf)).select("doc_id", "grp", "type", "s", "e", "depth")


@register("page_bracket_spans", f"""WITH {SQL_PAGES}, {sql_brackets('pg', 'none', '"')}
SELECT doc_id, grp, type, s, e, depth FROM br""")
def page_bracket_spans_q(spark, sf):
    """SPN-1: brackets and quoted strings of pages."""
    return bracket_spans(pages_corpus(spark, sf), comments="none", strings='"').select("doc_id", "grp", "type", "s", "e", "depth")


@register("code_span_tree", f"""WITH {SQL_CODE}, {sql_brackets('code')},
b AS (SELECT * FROM br WHERE type IN ('paren', 'bracket', 'brace'))
SELECT x.doc_id, x.type, x.s, x.e, CAST(count(y.s) AS INTEGER) AS depth FROM b x
LEFT JOIN b y ON y.doc_id = x.doc_id AND y.s < x.s AND y.e >= x.e GROUP BY ALL""")
def code_span_tree_q(spark, sf):
    """SPN-5 on nested brackets: how many enclose each."""
    sp = bracket_spans(code_corpus(spark, sf)).filter(F.col("type").isin("paren", "bracket", "brace"))
    return span_tree(sp).select("doc_id", "type", "s", "e", "depth")


def _list(names) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


_RULES = ", ".join(f"({_list(names)}, {_list(closes)}, {_list(scope)})" for names, closes, scope in IMPLIED_ENDS)
_last = lambda names: f"coalesce(list_max(list_filter(range(1, len(st) + 1), lambda i: list_contains({names}, st[i].name))), 0)"

# one step per tag: the stack of open elements, cut at what the tag ends
SQL_TREE = f"""pc AS (SELECT doc_id, nb, unnest(a) AS x, generate_subscripts(a, 1) AS i
  FROM (SELECT doc_id, CAST(strlen(text) AS BIGINT) AS nb, regexp_extract_all(text, '{markup_pattern().replace("'", "''")}') AS a FROM pg)),
po AS (SELECT doc_id, nb, i, x, CAST(sum(strlen(x)) OVER w AS BIGINT) AS e, lower(regexp_extract(x, '^</?([A-Za-z][^\\s/>]*)', 1)) AS name FROM pc
  WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
rules AS (SELECT unnest(names) AS name, closes, scope FROM (VALUES {_RULES}) r(names, closes, scope)),
tg AS (SELECT doc_id, nb, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, po.name, e - strlen(x) AS s, e,
    CASE WHEN x[1:2] = '</' THEN 'end' WHEN list_contains({_list(RAW_ELEMENTS)}, po.name) THEN 'raw' WHEN list_contains({_list(VOID_ELEMENTS)}, po.name) THEN 'void' ELSE 'start' END AS kind,
    coalesce(closes, []) AS closes, coalesce(scope, []) AS scope FROM po LEFT JOIN rules ON rules.name = po.name WHERE po.name <> ''),
steps AS (SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS k, 0 AS n, CAST([] AS STRUCT(id INTEGER, name VARCHAR)[]) AS st, CAST([] AS STRUCT(id INTEGER, name VARCHAR)[]) AS was, 0 AS cut FROM tg
  UNION ALL SELECT doc_id, k, n + CASE WHEN kind = 'end' THEN 0 ELSE 1 END,
    list_concat(CASE WHEN cut > 0 THEN st[1:cut-1] ELSE st END, CASE WHEN kind = 'start' THEN [{{'id': n, 'name': name}}] ELSE [] END), st, cut FROM (
    SELECT steps.doc_id, tg.k, n, st, tg.name, kind, CASE WHEN kind = 'end' THEN {_last('[tg.name]')}
        WHEN {_last('tg.closes')} > {_last('tg.scope')} THEN {_last('tg.closes')} ELSE 0 END AS cut
    FROM steps JOIN tg ON tg.doc_id = steps.doc_id AND tg.k = steps.k + 1)),
gone AS (SELECT x.doc_id, z.id, CASE WHEN tg.kind = 'end' AND pos = cut THEN tg.e ELSE tg.s END AS e, CASE WHEN tg.kind = 'end' AND pos = cut THEN 'closed' ELSE 'implied' END AS ended
  FROM (SELECT doc_id, k, cut, unnest(was[cut:]) AS z, unnest(range(cut, len(was) + 1)) AS pos FROM steps WHERE cut > 0) x JOIN tg ON tg.doc_id = x.doc_id AND tg.k = x.k),
el AS (SELECT x.doc_id, x.n - 1 AS id, CASE WHEN x.cut > 0 THEN x.was[1:x.cut-1] ELSE x.was END AS around, tg.name, tg.s, tg.e, tg.kind, tg.nb
  FROM steps x JOIN tg ON tg.doc_id = x.doc_id AND tg.k = x.k WHERE kind <> 'end')"""


@register("page_element_tree", f"""WITH RECURSIVE {SQL_PAGES}, {SQL_TREE}
SELECT el.doc_id, el.id, around[len(around)].id AS parent_id, CAST(len(around) AS INTEGER) AS depth, el.name, el.s,
  CASE WHEN kind <> 'start' THEN el.e ELSE coalesce(gone.e, nb) END AS e, CASE WHEN kind <> 'start' THEN kind ELSE coalesce(gone.ended, 'page') END AS ended
FROM el LEFT JOIN gone ON gone.doc_id = el.doc_id AND gone.id = el.id""")
def page_element_tree_q(spark, sf):
    """SPN-5: the element tree of every page with void elements, implied ends
    and stray end tags."""
    return element_tree(pages_corpus(spark, sf))
