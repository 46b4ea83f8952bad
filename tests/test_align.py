import random

from pyspark.sql import functions as F

from spanalign.operators.align import (boundary_context, covering_word_split, nearest_token, rule_word_split, stab,
                                       tolerance_align)
from spanalign.operators.spans import chunk_pieces, chunk_spans, extract_spans, span_tree, spans_from_table
from spanalign.operators.tokens import tokens, word_runs


def is_word(ch):
    return ch.isalnum() or ch == "_"


def m1_reference(text, p):
    """Definition: bytes -> char index; mid-word when both neighbours are
    word characters; no char index (inside a character) -> aligned."""
    b2c, b = {}, 0
    for i, ch in enumerate(text):
        b2c[b] = i
        b += len(ch.encode())
    b2c[b] = len(text)
    ci = b2c.get(p)
    if ci is None or ci == 0 or ci >= len(text):
        return False
    return is_word(text[ci - 1]) and is_word(text[ci])


def test_mid_word_fixture_spans(spark):
    text = "foo_bar1 = baz(2) é字ab"
    d = spark.createDataFrame([(1, "x", text)], "doc_id long, grp string, text string")
    spans = spark.createDataFrame([
        (1, "x", "mid_start", 0, 2, 8), (1, "x", "mid_end", 1, 0, 3), (1, "x", "both", 2, 1, 12),
        (1, "x", "whole", 3, 0, len(text.encode())), (1, "x", "zero", 4, 5, 5), (1, "x", "inside_char", 5, 19, 23),
    ], "doc_id long, grp string, type string, span_id int, s long, e long")
    got = {r.type: (r.crossing_start, r.crossing_end) for r in rule_word_split(spans, word_runs(d), carry=("s", "e")).collect()}
    for r in spans.collect():
        assert got[r.type] == (m1_reference(text, r.s), m1_reference(text, r.e)), r.type
    assert got["inside_char"][0] is False  # byte 19 is inside a 3-byte character


def test_fast_path_equals_general_path(spark):
    random.seed(7)
    alphabet = "ab_1 .é字😀\n"
    texts = [(i, "g", "".join(random.choice(alphabet) for _ in range(random.randint(0, 300)))) for i in range(40)]
    d = spark.createDataFrame(texts, "doc_id long, grp string, text string").repartition(4, "doc_id")
    fast = {r.doc_id: (r.w.n_rules, r.w.n_aligned) for r in
            d.select("doc_id", covering_word_split(chunk_pieces("text", 7)).alias("w")).collect()}
    fl = rule_word_split(chunk_spans(d, 7), word_runs(d), carry=())
    gen = {r.doc_id: (r.n, r.a) for r in fl.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.count_if("fully_aligned").alias("a")).collect()}
    for i, t, in [(x[0], x[2]) for x in texts]:
        assert fast[i] == gen.get(i, (0, 0)), t


def test_stab_window_equals_brute_force(spark):
    random.seed(3)
    pts, ivs = [], []
    for doc in range(5):
        pos = 0
        for k in range(50):
            s = pos + random.randint(0, 3)
            e = s + random.randint(1, 5)
            ivs.append((doc, k, s, e))
            pos = e
        pts += [(doc, j, random.randint(0, pos + 2)) for j in range(60)]
    P = spark.createDataFrame(pts, "doc_id long, pid int, p long")
    I = spark.createDataFrame(ivs, "doc_id long, tok_id int, s long, e long")
    got = {(r.doc_id, r.pid): (r.tok.tok_id if r.tok else None, r.in_token) for r in stab(P, I).collect()}
    for doc, pid, p in pts:
        inside = [k for d_, k, s, e in ivs if d_ == doc and s < p < e]
        assert got[(doc, pid)] == (inside[0] if inside else None, bool(inside))


def test_tolerance_and_nearest(spark):
    rules = spark.createDataFrame([(1, "r", 0, 5, 9), (1, "r", 1, 2, 3), (2, "r", 0, 0, 4)],
                                  "doc_id long, type string, span_id int, s long, e long")
    toks = spark.createDataFrame([(1, 0, 0, 4), (1, 1, 4, 6), (1, 2, 6, 10)], "doc_id long, tok_id int, s long, e long")
    n1 = {r.span_id if r.doc_id == 1 else -1: r for r in nearest_token(rules, toks, tol=1, keep=()).collect()}
    # rule (5,9): start 5 -> starts 4 and 6 both at distance 1 -> lowest id 1; end 9 -> end 10 (d=1)
    assert (n1[0].start_token, n1[0].start_distance, n1[0].end_token, n1[0].end_distance) == (1, 1, 2, 1)
    assert n1[0].fully_aligned
    # doc 2 has no tokens: nearest null, not aligned
    assert n1[-1].start_token is None and not n1[-1].fully_aligned
    t0 = {r.span_id: r.fully_aligned for r in tolerance_align(rules, toks, tol=0, keep=()).filter("doc_id = 1").collect()}
    t1 = {r.span_id: r.fully_aligned for r in tolerance_align(rules, toks, tol=1, keep=()).filter("doc_id = 1").collect()}
    assert all(t1[k] for k, v in t0.items() if v)  # tol=0 implies tol=1


def test_extract_spans_offsets_and_rejects_empty_pattern(spark):
    d = spark.createDataFrame([(1, "g", "ab 12 é3 4")], "doc_id long, grp string, text string")
    sp = extract_spans(d, {"num": r"\p{N}+"})
    assert [(r.s, r.e, r.piece) for r in sp.orderBy("s").collect()] == [(3, 5, "12"), (8, 9, "3"), (10, 11, "4")]
    import pytest
    with pytest.raises(ValueError):
        extract_spans(d, {"bad": r"\d*"})


def test_spans_from_table_and_tree(spark):
    raw = spark.createDataFrame([
        (1, "module", 0, 20, 0), (1, "ERROR", 2, 9, 1), (1, "def", 2, 9, 2), (1, "name", 4, 7, 3), (1, None, 1, 2, 4),
        (1, "zero", 9, 9, 5), (1, "bad", 5, 3, 6), (1, "expr", 10, 20, 7), (1, "expr", 10, 20, 8)],
        "doc_id long, type string, s long, e long, span_id int")
    acc = spans_from_table(raw, span_id="span_id")
    assert acc.count() == 6
    out = span_tree(acc).collect()
    tr = {(r.type, r.s, r.e): (r.id, r.parent_id, r.depth) for r in out}
    assert tr[("module", 0, 20)] == (0, None, 0)
    assert tr[("name", 4, 7)][1] == tr[("def", 2, 9)][0]
    ids = sorted((r.id, r.parent_id, r.depth) for r in out if r.type == "expr")
    assert ids[1][1] == ids[0][0]  # duplicate span: child of the earlier one


def test_covering_as_of_equals_general(spark):
    random.seed(11)
    alphabet = "ab 1é.\n"
    texts = [(i, "g", "".join(random.choice(alphabet) for _ in range(random.randint(1, 200)))) for i in range(30)]
    d = spark.createDataFrame(texts, "doc_id long, grp string, text string").repartition(4, "doc_id")
    rules = chunk_spans(d, 5)
    toks = tokens(d, "pretok", keep=())
    cols = ["doc_id", "span_id", "start_token", "start_distance", "end_token", "end_distance", "fully_aligned"]
    fast = sorted(tuple(r) for r in nearest_token(rules, toks, covering=True).select(*cols).collect())
    slow = sorted(tuple(r) for r in nearest_token(rules, toks, covering=False).select(*cols).collect())
    assert fast == slow


def test_border_chars_equal_word_runs(spark):
    from spanalign.operators.spans import with_word_split
    random.seed(5)
    alphabet = "aB 1é字.\n_"
    texts = [(i, "g", "".join(random.choice(alphabet) for _ in range(random.randint(0, 120)))) for i in range(30)]
    d = spark.createDataFrame(texts, "doc_id long, grp string, text string").repartition(4, "doc_id")
    pats = {"num": r"\p{N}+", "cap": r"\p{Lu}[^\n]{0,3}", "dot": r"[^.\n]+\."}
    sp = extract_spans(d, pats, border_chars=True)
    a = sorted((r.doc_id, r.type, r.span_id, r.crossing_start, r.crossing_end) for r in with_word_split(sp).collect())
    b = sorted((r.doc_id, r.type, r.span_id, r.crossing_start, r.crossing_end)
               for r in rule_word_split(extract_spans(d, pats), word_runs(d), carry=()).collect())
    assert a == b
    ch = chunk_spans(d, 4, border_chars=True)
    c1 = sorted((r.doc_id, r.span_id, r.fully_aligned) for r in with_word_split(ch).collect())
    c2 = sorted((r.doc_id, r.span_id, r.fully_aligned) for r in rule_word_split(chunk_spans(d, 4), word_runs(d), carry=()).collect())
    assert c1 == c2


def test_detail_token_source_per_document(spark):
    from spanalign.operators.align import align_detail
    from spanalign.operators.tokens import fill_missing_tokens
    d = spark.createDataFrame([(1, "g", "abc1 def"), (2, "g", "xyzw")], "doc_id long, grp string, text string")
    toks = fill_missing_tokens(d, tokens(d, r"\p{N}+"))
    det = align_detail(chunk_spans(d, 2, border_chars=True), None, toks.withColumn("piece", F.lit("")))
    got = {r.doc_id: r.explain_tokenizer for r in det.collect()}
    assert "via offset_mapping" in got[1] and "via single_byte_fallback" in got[2]
    crossing = [r for r in det.collect() if r.doc_id == 2 and r.crossing_start]
    assert crossing and crossing[0].token_start_context is None  # byte tokens never strictly contain a char border


def test_chunk_scores_match_python_definition(spark):
    """Brute force: M1 as the original defines it (str.isalnum() or '_')
    on random texts over several scripts, digits of other kinds, combining
    marks and an astral character."""
    from spanalign.operators.scores import doc_scores_covering
    random.seed(21)
    alphabet = list("aZ_9 .,-\n") + ["é", "ß", "字", "ж", "ع", "²", "½", "٣", "́", "😀", "Ⅻ", " "]
    texts = [(i, "g", "".join(random.choice(alphabet) for _ in range(random.randint(0, 90)))) for i in range(60)]
    d = spark.createDataFrame(texts, "doc_id long, grp string, text string")
    got = {r.doc_id: (r.n_rules, r.n_aligned) for r in doc_scores_covering(d, chunk_pieces("text", 6)).collect()}

    def word(ch):
        return ch.isalnum() or ch == "_"

    for i, _, t in texts:
        n = (len(t) + 5) // 6
        mid = [0 < k < len(t) and word(t[k - 1]) and word(t[k]) for k in range(0, 6 * n + 1, 6)]
        aligned = sum(1 for c in range(n) if not mid[c] and not mid[c + 1])
        assert got[i] == (n, aligned), t


def test_tolerance_and_nearest_match_definition(spark):
    random.seed(33)
    alphabet = list("ab1 .\n") + ["é", "字"]
    texts = [(i, "g", "".join(random.choice(alphabet) for _ in range(random.randint(1, 80)))) for i in range(40)]
    d = spark.createDataFrame(texts, "doc_id long, grp string, text string").repartition(4, "doc_id")
    rules = chunk_spans(d, 5)
    toks = tokens(d, "pretok", keep=())
    got = {(r.doc_id, r.span_id): r for r in nearest_token(rules, toks, tol=1, covering=True).collect()}
    rs = {(r.doc_id, r.span_id): (r.s, r.e) for r in rules.collect()}
    tk = {}
    for r in toks.orderBy("doc_id", "tok_id").collect():
        tk.setdefault(r.doc_id, []).append((r.s, r.e))
    for (doc, sid), (s, e) in rs.items():
        tb = tk.get(doc, [])
        best_s = min(range(len(tb)), key=lambda k: (abs(s - tb[k][0]), k))
        best_e = min(range(len(tb)), key=lambda k: (abs(e - tb[k][1]), k))
        g = got[(doc, sid)]
        assert (g.start_token, g.start_distance) == (best_s, abs(s - tb[best_s][0]))
        assert (g.end_token, g.end_distance) == (best_e, abs(e - tb[best_e][1]))
        assert g.fully_aligned == (any(abs(s - a) <= 1 for a, _ in tb) and any(abs(e - b) <= 1 for _, b in tb))


def test_stab_overlapping_intervals_lowest_index_wins(spark):
    """Nested, overlapping and repeated intervals against the definition."""
    random.seed(11)
    ivs = [(0, 0, 0, 10), (0, 1, 4, 5)]
    pts = [(0, 0, 6), (0, 1, 10), (0, 2, 0)]
    for doc in ("x", "y"):
        for k in range(80):
            s = random.randint(0, 60)
            ivs.append((doc, k, s, s + random.randint(0, 25)))
        pts += [(doc, j, random.randint(-1, 90)) for j in range(80)]
    P = spark.createDataFrame([(str(d), i, p) for d, i, p in pts], "doc_id string, pid int, p long")
    I = spark.createDataFrame([(str(d), k, s, e) for d, k, s, e in ivs], "doc_id string, tok_id int, s long, e long")
    got = {(r.doc_id, r.pid): (r.tok.tok_id if r.tok else None, r.in_token) for r in stab(P, I).collect()}
    for doc, pid, p in pts:
        inside = [k for d_, k, s, e in ivs if d_ == doc and s < p < e]
        assert got[(str(doc), pid)] == (min(inside) if inside else None, bool(inside))


def test_word_split_in_long_runs(spark):
    """Runs longer than the pieces they are cut into: borders inside them, at
    the cuts, between multi-byte characters and at their ends."""
    text = "a" * 64 + "é" * 100 + " " + "b" * 128 + "!" + "字" * 70
    d = spark.createDataFrame([(1, "g", text)], "doc_id long, grp string, text string")
    data = text.encode()
    pts = spark.createDataFrame([(1, p) for p in range(len(data) + 1)], "doc_id long, p long")
    got = {r.p: (r.mid_word, r.left_ch, r.right_ch) for r in boundary_context(pts, runs=word_runs(d)).collect()}
    at = {len(text[:i].encode()): i for i in range(len(text) + 1)}
    word = lambda c: c.isalnum() or c == "_"
    for p in range(len(data) + 1):
        i = at.get(p)
        mid = i is not None and 0 < i < len(text) and word(text[i - 1]) and word(text[i])
        assert got[p] == ((True, text[i - 1], text[i]) if mid else (False, None, None)), p


def test_spans_with_former_marks_back_references_and_empty_matches(spark):
    text = " 12 x aa bc dd"
    d = spark.createDataFrame([(1, "g", text)], "doc_id long, grp string, text string")
    n = lambda p: [r.piece for r in extract_spans(d, {"t": p}).orderBy("s").collect()]
    assert n(r"\p{N}+") == ["12"]
    assert n(r"(\w)\1") == ["aa", "dd"]
    import pytest
    with pytest.raises(Exception, match="matches the empty string"):
        n(r"(?=bc)")


def test_tree_of_string_ids_and_window_form(spark):
    rows = [("p/a", "line", 0, 0, 20), ("p/a", "word", 0, 2, 5), ("p/a", "word", 1, 5, 9), ("p/a", "sent", 0, 2, 9), ("p/b", "line", 0, 0, 3)]
    x = spark.createDataFrame(rows, "doc_id string, type string, span_id int, s long, e long")
    key = lambda df: sorted((r.doc_id, r.id, r.parent_id, r.depth) for r in df.collect())
    want = [("p/a", 0, None, 0), ("p/a", 1, 0, 1), ("p/a", 2, 1, 2), ("p/a", 3, 1, 2), ("p/b", 0, None, 0)]
    assert key(span_tree(x)) == want and key(span_tree(x, types=["line", "sent", "word"])) == want


def test_text_over_one_mebibyte_is_scored(spark):
    from spanalign.operators.scores import doc_scores_covering
    from spanalign.operators.clean import drop_blank
    text = "word " * 300_000
    d = drop_blank(spark.createDataFrame([(1, "g", text)], "doc_id long, grp string, text string"))
    r = doc_scores_covering(d, chunk_pieces("text", 64)).first()
    assert r.n_bytes == len(text) > (1 << 20) and r.n_rules == -(-len(text) // 64)


def test_covering_tolerance_equals_nearest_token(spark):
    """One point per border against two points per rule, for several schemes."""
    from spanalign.operators.align import covering_tolerance
    from spanalign.operators.tokens import multi_scheme_tokens
    random.seed(8)
    texts = ["", "a", "été 12!"] + ["".join(random.choice("ab é字 \n.1") for _ in range(random.randint(1, 90))) for _ in range(30)]
    d = spark.createDataFrame([(i, "g", t) for i, t in enumerate(texts)], "doc_id long, grp string, text string")
    schemes = ["word", "ws", "pretok"]
    toks = multi_scheme_tokens(d, schemes)
    for tol in (0, 1, 3):
        key = lambda df: sorted((r.doc_id, r.scheme, r.e, r.start_aligned, r.end_aligned, r.fully_aligned) for r in df.collect())
        want = nearest_token(chunk_spans(d, 5), toks, tol=tol, schemes=schemes, covering=True)
        assert key(covering_tolerance(chunk_spans(d, 5), toks, schemes, tol=tol)) == key(want)
