"""Nested spans without a parser against a plain stack, and the element tree
of markup by hand."""

import random
import re

import pytest

from spanalign.operators.markup import element_tree
from spanalign.operators.spans import span_tree, spans_from_table
from spanalign.operators.structure import bracket_spans, code_spans, indent_spans
from spanalign.plans.queries_structure import code_corpus, code_span_tree_q
from spanalign.sources.tables import by_doc

PAIRS = {"(": ")", "[": "]", "{": "}"}
NAMES = {"(": "paren", "[": "bracket", "{": "brace"}
MASKS = {"c": r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)", "hash": r"#[^\n]*", "none": r"(?!)"}


def plain_marks(text, comments, strings):
    q = "|".join(rf"{c}(?:[^{c}\\\n]|\\[^\n])*{c}" for c in strings) or "(?!)"
    for m in re.finditer(rf"(?P<comment>{MASKS[comments]})|(?P<string>{q})|(?P<bracket>[()\[\]{{}}])|\\[^\n]", text):
        if m.lastgroup:
            yield m.lastgroup, m.start(), m.end(), m.group()


def plain_brackets(text, comments="c", strings="\"'"):
    """A stack per kind: the next closer of its kind takes the innermost opener."""
    out, open_ = [], {k: [] for k in PAIRS}
    b = lambda i: len(text[:i].encode())
    for kind, s, e, t in plain_marks(text, comments, strings):
        if kind != "bracket":
            out.append((kind, b(s), b(e), s, e))
        elif t in PAIRS:
            open_[t].append(s)
        else:
            o = next(k for k, v in PAIRS.items() if v == t)
            if open_[o]:
                s = open_[o].pop()
                out.append((NAMES[o], b(s), b(e), s, e))
    return sorted(out)


def plain_blocks(text, tab=4):
    lines, at = [], 0
    for line in re.findall(r"[^\n]*\n|[^\n]+", text):
        body = line.rstrip(" \t\r\n")
        lead = re.match(r"[ \t]*", line).group()
        if body:
            s, e = at + len(lead), at + len(body)
            lines.append((sum(tab if c == "\t" else 1 for c in lead), len(text[:s].encode()), len(text[:e].encode())))
        at += len(line)
    out = []
    for i, (h, s, _) in enumerate(lines[:-1]):
        if lines[i + 1][0] > h:
            j = i + 1
            while j + 1 < len(lines) and lines[j + 1][0] > h:
                j += 1
            out += [("block", s, lines[j][2], h), ("suite", lines[i + 1][1], lines[j][2], h)]
    return sorted(out)


@pytest.fixture(scope="module")
def code(spark):
    rng = random.Random(8)
    parts = ["(", ")", "[", "]", "{", "}", '"', "'", "\\", '\\"', "//", "/*", "*/", "#", "\n", " ", "é", "😀", "ab", "*", "/", "x = 1;\n", "    ", "\t", "`"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.choice([3, 30, 200]))) for _ in range(120)]
    texts += ["", "   ", "\n \n", "f(a[0], {b: ')'}) // (\n", "/* ( */ [ /* unclosed ]", '"a\\"(b" (c)', "def f(x):\n    if x:\n\n        y(\n  z)\n    return [1,\n 2]\n",
              "a\n\tb\n\t\tc\n    d\n e\nf", "(" * 3000 + ")" * 3000, '"' + '\\"' * 60_000 + '" (x)', "/*" * 50_000 + "(", " " * 5000 + "x\ny", "a\r\n  b\r\n"]
    return by_doc(spark.createDataFrame([(i, "g", t) for i, t in enumerate(texts)] + [(9999, "g", None)], "doc_id long, grp string, text string")), texts


@pytest.mark.parametrize("comments,strings", [("c", "\"'"), ("hash", '"'), ("none", ""), ("c", "\"'`")])
def test_brackets(code, comments, strings):
    df, texts = code
    got = {}
    for r in bracket_spans(df, comments, strings).collect():
        got.setdefault(r.doc_id, []).append((r.type, r.s, r.e, r.cs, r.ce))
        assert (r.depth is None) == (r.type in ("string", "comment"))
    for i, t in enumerate(texts):
        assert sorted(got.get(i, [])) == plain_brackets(t, comments, strings), (i, t[:80])


def test_joint_depth_marks_errors(spark):
    df = by_doc(spark.createDataFrame([(1, "g", "f(a[1)] {b}"), (2, "g", "([{}])")], "doc_id long, grp string, text string"))
    got = sorted((r.doc_id, r.type, r.s, r.e, r.depth) for r in bracket_spans(df, jointly=True).collect())
    assert got == [(1, "ERROR", 1, 7, 1), (1, "ERROR", 3, 6, 2), (1, "brace", 8, 11, 1), (2, "brace", 2, 4, 3), (2, "bracket", 1, 5, 2), (2, "paren", 0, 6, 1)]
    assert {r.type for r in spans_from_table(bracket_spans(df, jointly=True)).collect()} == {"brace", "bracket", "paren"}


def test_indentation(code):
    df, texts = code
    got = {}
    for r in indent_spans(df).collect():
        got.setdefault(r.doc_id, []).append((r.type, r.s, r.e, r.depth))
    for i, t in enumerate(texts):
        assert sorted(got.get(i, [])) == plain_blocks(t), (i, t[:80])


def test_spans_nest(spark):
    text = "def f(x):\n    y = g(x[0], {1: (2)})\n    # not (this\n    return y\n"
    df = by_doc(spark.createDataFrame([(1, "g", text)], "doc_id long, grp string, text string"))
    sp = code_spans(df, comments="hash")
    data = text.encode()
    assert {(r.type, data[r.s:r.e].decode()) for r in sp.collect()} == {
        ("paren", "(x)"), ("paren", "(x[0], {1: (2)})"), ("bracket", "[0]"), ("brace", "{1: (2)}"), ("paren", "(2)"), ("comment", "# not (this"),
        ("block", text.strip()), ("suite", "y = g(x[0], {1: (2)})\n    # not (this\n    return y")}
    tree = {data[r.s:r.e].decode(): (r.id, r.parent_id, r.depth) for r in span_tree(sp.filter("type in ('paren', 'brace', 'bracket')")).collect()}
    assert tree["(2)"][2] == 2 and tree["{1: (2)}"][2] == 1 and tree["(x)"][2] == 0


def test_span_tree_moves_rows_once(spark, tmp_path):
    """Each table is dealt by order once; no text and no span is dealt again."""
    lines = [(1, 1, 10, 5, 3.0, "N"), (1, 2, 11, 5, 4.0, "R"), (2, 1, 12, 6, 5.0, "A"), (3, 1, None, 6, 5.0, "A"), (4, 1, 13, 7, 1.0, "N"), (4, 1, 13, 7, 1.0, "N"), (None, 1, 1, 1, 1.0, "N"), (9, 1, 1, 1, 1.0, "N")]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    orders = [(1, "O", "1-URGENT"), (2, "F", "5-LOW"), (3, "O", "5-LOW"), (4, "P", "5-LOW"), (5, "O", "5-LOW"), (None, "O", "5-LOW")]
    spark.createDataFrame(orders, "o_orderkey long, o_orderstatus string, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    texts = {r.doc_id: r.text for r in code_corpus(spark, str(tmp_path)).collect()}
    line = lambda k, part, q, flag: "  " * k + f"  part({part}) {{\n" + "  " * k + f"    qty[{q}] = \"}}{flag}\"; /* ) */\n"
    one = line(1, 13, 1, "N") + "    }\n"
    assert texts == {1: 'order(1, "1-URGENT") {  // (O\n' + line(1, 10, 3, "N") + "    }\n" + line(2, 11, 4, "R") + "\n}\n",
                     2: 'order(2, "5-LOW") {  // (F\n' + line(1, 12, 5, "A") + "    }\n}\n", 3: 'order(3, "5-LOW") {  // (O\n}\n', 4: 'order(4, "5-LOW") {  // (P\n' + one + one + "}\n"}
    tree = code_span_tree_q(spark, str(tmp_path))
    want = []
    for doc, text in texts.items():
        found = [s for s in plain_brackets(text) if s[0] in NAMES.values()]
        want += [(doc, *s[:3], sum(o[1] < s[1] and o[2] >= s[2] for o in found)) for s in found]
    assert sorted(tuple(r) for r in tree.collect()) == sorted(want)
    plan = tree._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall(r"\bExchange ", plan)) == 2 and "Union" not in plan


PAGES = {
    "<ul><li>a<li>b</ul>c": [("ul", None, 0, "closed", "<ul><li>a<li>b</ul>"), ("li", 0, 1, "implied", "<li>a"), ("li", 0, 1, "implied", "<li>b")],
    "<p>one<p>two<div>x</p></div>": [("p", None, 0, "implied", "<p>one"), ("p", None, 0, "implied", "<p>two"), ("div", None, 0, "closed", "<div>x</p></div>")],
    "<b><i>x</b></i><br>": [("b", None, 0, "closed", "<b><i>x</b>"), ("i", 0, 1, "implied", "<i>x"), ("br", None, 0, "void", "<br>")],
    "<A HREF='a>b'>x<!-- <b> --></a ><script>if (a<b) '</p>'</script>": [("a", None, 0, "closed", "<A HREF='a>b'>x<!-- <b> --></a >"), ("script", None, 0, "raw", "<script>if (a<b) '</p>'</script>")],
    "<table><tr><td>1<td><p>2<tr><td>3</table>": [
        ("table", None, 0, "closed", "<table><tr><td>1<td><p>2<tr><td>3</table>"), ("tr", 0, 1, "implied", "<tr><td>1<td><p>2"), ("td", 1, 2, "implied", "<td>1"),
        ("td", 1, 2, "implied", "<td><p>2"), ("p", 3, 3, "implied", "<p>2"), ("tr", 0, 1, "implied", "<tr><td>3"), ("td", 5, 2, "implied", "<td>3")],
    "<div>é<span>open": [("div", None, 0, "page", "<div>é<span>open"), ("span", 0, 1, "page", "<span>open")],
    "</p> < a <1> <title>never closed <b>": [("title", None, 0, "raw", "<title>never closed <b>")],
    "": [], "plain": [],
}


def test_element_tree(spark):
    texts = list(PAGES)
    df = spark.createDataFrame([(i, "g", t) for i, t in enumerate(texts)] + [(99, "g", None)], "doc_id long, grp string, text string")
    got = {}
    for r in element_tree(df).orderBy("doc_id", "id").collect():
        data = texts[r.doc_id].encode()
        got.setdefault(r.doc_id, []).append((r.name, r.parent_id, r.depth, r.ended, data[r.s:r.e].decode()))
    for i, t in enumerate(texts):
        assert got.get(i, []) == PAGES[t], t


def test_xml_and_deep_pages(spark):
    deep = "<a>" * 20_000 + "</b>" * 5 + "</a>" * 20_000
    attributes = "<x " + 'k="v" ' * 20_000 + "/>"
    df = spark.createDataFrame([(1, "<R><br/><p>a<p>b</p></p></R>"), (2, deep), (3, attributes), (4, "<" * 50_000 + "<i>")], "doc_id long, text string")
    rows = element_tree(df, xml=True).collect()
    assert sorted((r.id, r.parent_id, r.name, r.ended) for r in rows if r.doc_id == 1) == [(0, None, "R", "closed"), (1, 0, "br", "void"), (2, 0, "p", "closed"), (3, 2, "p", "closed")]
    assert max(r.depth for r in rows if r.doc_id == 2) == 19_999 and all(r.ended == "closed" for r in rows if r.doc_id == 2)
    assert [(r.name, r.e - r.s) for r in rows if r.doc_id == 3] == [("x", len(attributes))]
    assert [r.name for r in rows if r.doc_id == 4] == ["i"]
