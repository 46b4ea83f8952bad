"""Documents cut into segments and blocks give what whole documents give."""

import random

import pytest
from pyspark.sql import functions as F

from spanalign.operators import blocks
from spanalign.operators.align import boundary_points, nearest_token, rule_word_split, stab, token_cut
from spanalign.operators.spans import chunk_spans
from spanalign.operators.tokens import boundaries, multi_scheme_tokens, word_runs
from spanalign.sources.tables import by_doc

SCHEMES = ["word", "piece4", "ws", "char", "pretok"]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    words = ["the", "naïve", "été", "数据", "x=1;", "//", "😀", "foo_bar", "3.14", ",", "\n\n", "  ", "\t", "a" * 90]
    rows = [(i, "g", "".join(rng.choice(words) + rng.choice(["", " ", " ", "\n"]) for _ in range(rng.choice([1, 30, 400])))) for i in range(25)]
    rows += [(100, "h", ""), (101, "h", None), (102, None, " "), (103, "h", "z" * 3000), (104, "h", " " * 700 + "x"), (None, "h", "no id  at all " * 20)]
    return by_doc(spark.createDataFrame(rows, "doc_id long, grp string, text string"))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("segment", [16, 100, 1 << 18])
def test_segments(corpus, segment):
    want = multi_scheme_tokens(corpus, SCHEMES)
    got = blocks.tokens_in_segments(corpus, SCHEMES, segment=segment)
    assert rows(got.select(want.columns)) == rows(want)
    want = chunk_spans(corpus, 8)
    assert rows(blocks.chunks_in_segments(corpus, 8, segment=segment).select(want.columns)) == rows(want)
    with pytest.raises(ValueError):
        blocks.tokens_in_segments(corpus, [r"\d+"])


@pytest.mark.parametrize("block", [7, 64, 1 << 18])
def test_joins_in_blocks(spark, corpus, block):
    corpus = corpus.filter("doc_id is not null")
    rules = chunk_spans(corpus, 8)
    for scheme in ("pretok", "ws"):
        toks = boundaries(corpus, scheme)
        assert rows(token_cut(rules, toks, block=block)) == rows(token_cut(rules, toks))
        for covering in (True, False):
            a = nearest_token(rules, toks, covering=covering, block=block)
            assert rows(a) == rows(nearest_token(rules, toks, covering=covering))
    some = boundaries(corpus, "pretok").filter("tok_id % 17 = 5").drop("is_last")   # far apart: the nearest lies blocks away
    assert rows(nearest_token(rules, some, block=block)) == rows(nearest_token(rules, some))
    runs = word_runs(corpus, keep=("grp",))
    assert rows(rule_word_split(rules, runs, block=block)) == rows(rule_word_split(rules, runs))
    both = multi_scheme_tokens(corpus, ["pretok", "ws"])
    kw = {"schemes": ["pretok", "ws"]}
    for covering in (True, False):
        assert rows(nearest_token(rules, both, covering=covering, block=block, **kw)) == rows(nearest_token(rules, both, covering=covering, **kw))


@pytest.mark.parametrize("block", [5, 50, 1 << 18])
def test_overlapping_intervals_in_blocks(spark, block):
    rng = random.Random(6)
    iv = [(d, i, s, s + rng.choice([0, 1, 2, 9, 40, 300])) for d in range(6) for i, s in enumerate(rng.sample(range(400), 60))]
    pts = [(d, p) for d in range(8) for p in range(0, 420, 3)]
    a = spark.createDataFrame(iv, "doc_id long, tok_id int, s long, e long")
    b = spark.createDataFrame(pts, "doc_id long, p long")
    want = sorted((d, p, min((i for x, i, s, e in iv if x == d and s < p < e), default=None)) for d, p in pts)
    got = sorted((r.doc_id, r.p, r.tok.tok_id if r.tok else None) for r in stab(b, a, block=block).collect())
    assert got == want
    flat = [(0, i, 10 * i, 10 * i + rng.choice([3, 10])) for i in range(40)]
    c = spark.createDataFrame(flat, "doc_id long, tok_id int, s long, e long")
    x, y = (sorted((r.doc_id, r.p, r.tok.tok_id if r.tok else None) for r in stab(b, c, disjoint=True, block=k).collect()) for k in (block, None))
    assert x == y


def test_a_long_document_is_spread(spark):
    """One document with most of the bytes: its tokens and its joins are in
    many partitions, none with a large part."""
    text = "some words, of a long text; and more " * 20_000
    docs = spark.createDataFrame([(1, "g", text), *[(i, "g", "short text") for i in range(2, 40)]], "doc_id long, grp string, text string")
    toks = blocks.tokens_in_segments(docs, ["pretok"], segment=1 << 12)
    pts = boundary_points(blocks.chunks_in_segments(docs, 64, segment=1 << 12))
    for df in (toks, blocks.unplaced(by_doc(blocks.placed(pts, 1 << 12)))):
        sizes = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("k")).count().collect()]
        assert len(sizes) > 4 and max(sizes) < sum(sizes) / 2
    want = text.count(" of ") + 0
    found = stab(pts, toks, disjoint=True, block=1 << 12)
    assert found.count() == 2 * (-(-len(text) // 64) + 38) and want == 20_000


def test_intervals_go_by_block_in_packs(spark):
    rng = random.Random(9)
    iv = [(d, None if rng.random() < 0.1 else i % 50, s, s + rng.choice([0, 1, 1, 2, 9, 40])) for d in (1, 2, None) for i, s in enumerate(sorted(rng.choices(range(400), k=200)))]
    iv += [(1, 7, None, 5), (1, 8, 5, None), (2, 1 << 20, 1 << 40, (1 << 40) + 9)]
    pts = [(d, "x", p) for d in (1, 2, 3, None) for p in [*range(0, 420, 3), None, (1 << 40) + 3]]
    a = spark.createDataFrame(iv, "doc_id long, tok_id int, s long, e long").repartition(5)
    b = spark.createDataFrame(pts, "doc_id long, grp string, p long")
    for block in (16, 1 << 18):
        # pieces are not packed: the windows over rows; of equal starts and ids any end may come last there
        want = stab(b, a.withColumn("piece", F.lit("")), disjoint=True, block=block)
        got = stab(b, a, disjoint=True, block=block)
        flat = lambda df: rows(df.select("doc_id", "grp", "p", "in_token"))
        assert flat(got) == flat(want) and got.schema["tok"].dataType.fieldNames() == ["tok_id", "s", "e"]
    one = a.dropDuplicates(["doc_id", "s"])
    for block in (16, 1 << 18):
        want, got = (stab(b, x, disjoint=True, block=block).select("doc_id", "p", "tok.tok_id", "tok.s", "tok.e", "in_token") for x in (one.withColumn("piece", F.lit("")), one))
        assert rows(got) == rows(want)
    many = spark.createDataFrame([(1, i, 3 * i, 3 * i + 3) for i in range(50_000)], "doc_id string, tok_id long, s long, e long").coalesce(1)
    packs = blocks.packed(many, 1 << 14).collect()
    assert len(packs) < 20 and sum(len(r["_pack"]) for r in packs) < 5_000   # a row and some sixty bytes each before
