"""Learned byte-pair schemes against the installed tokenizer libraries (as
oracles only) and against a plain merge by the definition."""

import base64
import random

import pytest
from pyspark.sql import functions as F

from spanalign.operators import bpe
from spanalign.operators.align import nearest_token, stab
from spanalign.operators.tokens import boundaries, tokens, tokens_from_table
from spanalign.sources.tables import by_doc

FILES = ["/opt/tokenizers/byte_bpe_50k.tiktoken", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"]
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

TEXTS = [
    "The quick brown fox's tail isn't here, we'll see 12345 x_y\n\n  def f(a):\r\n\treturn a+b   \n",
    "é字😀ab  cd größe naïve Ünïcödé ½ ٣ 中文字符 한국어 ไทย", "", None, " ", "\n", "   \n\n   x", "a" * 3000, "=" * 500 + " " * 300,
    "'S't'd don''t   x　y \x1c\x1d z", "�​‍👩‍👩‍👧", "0" * 40 + "z9" * 30,
]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    words = ["the", "ing", " ", "  ", "\n", "naïve", "été", "数据", "x=1;", "//", "😀", "HTTPServer", "foo_bar", "3.14", "'ll"]
    rows = [(i, "g", t) for i, t in enumerate(TEXTS)]
    rows += [(100 + i, "h", "".join(rng.choice(words) for _ in range(rng.randint(1, 300)))) for i in range(60)]
    return by_doc(spark.createDataFrame(rows, "doc_id long, grp string, text string"))


def plain_merge(piece, ranks):
    parts = [piece] if piece in ranks else [piece[i:i + 1] for i in range(len(piece))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return parts
        i = min(found)[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


def test_merges_by_definition():
    rng = random.Random(5)
    ranks = {bytes([c]): c for c in b"abc"}
    for _ in range(60):   # a vocabulary whose merges overlap and tie
        a, b = rng.choice(list(ranks)), rng.choice(list(ranks))
        ranks.setdefault(a + b, 10 + rng.randrange(20))
    for _ in range(400):
        piece = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 40)))
        ends = bpe.merged(piece, ranks)
        assert [piece[a:b] for a, b in zip([0, *ends], ends)] == plain_merge(piece, ranks)


@pytest.mark.parametrize("path", FILES)
def test_tokens_equal_the_library(spark, corpus, path):
    tiktoken = pytest.importorskip("tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {}
    for r in tokens(corpus, bpe.PREFIX + path).orderBy("doc_id", "tok_id").collect():
        got.setdefault(r.doc_id, []).append(r)
    for doc, text in corpus.select("doc_id", "text").collect():
        want, at = [], 0
        for t in enc.encode_ordinary(text or ""):
            k = len(enc.decode_single_token_bytes(t))
            want.append((at, at + k))
            at += k
        rows = got.get(doc, [])
        assert [(r.s, r.e) for r in rows] == want
        assert [r.tok_id for r in rows] == list(range(len(want))) and [r.is_last for r in rows] == [i == len(want) - 1 for i in range(len(want))]
        data = (text or "").encode()
        assert all(r.piece == data[r.s:r.e].decode("utf-8", "replace") or "�" in r.piece for r in rows)
    counts = {(r.grp): (r.n_pretokens, r.n_tokens) for r in bpe.bpe_token_counts(corpus, [bpe.PREFIX + path]).collect()}
    for g in ("g", "h"):
        ids = [t for (t,) in corpus.filter(F.col("grp") == g).select("text").collect()]
        assert counts[g][1] == sum(len(enc.encode_ordinary(t or "")) for t in ids)


def test_reported_offsets_are_whole_characters(spark, corpus):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    got = {}
    for r in bpe.bpe_tokens(corpus, [bpe.PREFIX + FILES[0]], whole_characters=True).orderBy("doc_id", "tok_id").collect():
        got.setdefault(r.doc_id, []).append(r)
    texts = {d: x or "" for d, x in corpus.select("doc_id", "text").collect()}
    reported = []
    for doc, text in texts.items():
        want = t.encode(text, add_special_tokens=False).offsets
        rows = got.get(doc, [])
        assert [(r.cs, r.ce) for r in rows] == want
        assert all((r.s, r.e) == (len(text[:r.cs].encode()), len(text[:r.ce].encode())) for r in rows)
        reported.append((doc, text, [{"s": a, "e": b} for a, b in want]))
    # the same through the table of given offsets (TOK-2)
    given = spark.createDataFrame(reported, "doc_id long, text string, offsets array<struct<s:long,e:long>>")
    table = {(r.doc_id, r.tok_id): (r.s, r.e) for r in tokens_from_table(given).collect()}
    assert table == {(d, r.tok_id): (r.s, r.e) for d, rows in got.items() for r in rows}


def test_fast_joins_equal_general_ones(spark, corpus):
    scheme = bpe.PREFIX + FILES[1]
    pts = corpus.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long"), F.lit(3).cast("long"))).alias("p"))
    toks = boundaries(corpus, scheme)
    key = lambda r: (r.doc_id, r.p, None if r.tok is None else (r.tok.tok_id, r.tok.s, r.tok.e))
    a, b = (sorted(map(key, stab(pts, toks, disjoint=d).collect()), key=str) for d in (True, False))
    assert a == b and any(x[2] for x in a)
    rules = corpus.filter(F.length("text") > 0).select("doc_id", "grp", F.lit("all").alias("type"), F.lit(0).alias("span_id"), F.lit(1).cast("long").alias("s"), (F.octet_length("text") - 1).cast("long").alias("e"))
    x, y = (sorted(map(tuple, nearest_token(rules, toks, covering=c).collect()), key=str) for c in (True, False))
    assert x == y


def test_rare_and_frequent_pretokens(spark, corpus, monkeypatch):
    scheme = bpe.PREFIX + FILES[0]
    want = sorted(map(tuple, tokens(corpus, scheme).collect()), key=str)
    monkeypatch.setattr(bpe, "FREQUENT", 1)   # nothing is frequent: all through the shuffled join
    assert sorted(map(tuple, tokens(corpus, scheme).collect()), key=str) == want
    with pytest.raises(ValueError):
        monkeypatch.setattr(bpe, "MAX_RANKS", 10)
        bpe.load_ranks(spark, FILES[0])


def test_texts_are_dealt_once_and_lookups_bring_back_offsets_only(spark, monkeypatch):
    from spanalign.operators.align import covering_tolerance
    from spanalign.operators.spans import chunk_spans
    from spanalign.operators.tokens import multi_scheme_tokens
    monkeypatch.setattr(bpe, "SHORT", 4)   # longer pre-tokens take the shuffled join
    raw = spark.createDataFrame([(i, "gh"[i % 2], t) for i, t in enumerate(TEXTS)], "doc_id long, grp string, text string")
    schemes = [bpe.PREFIX + f for f in FILES]
    d = by_doc(raw)
    for whole in (False, True):
        one = bpe.bpe_tokens(d, schemes, whole_characters=whole)
        assert sorted(map(tuple, bpe.bpe_tokens(d, schemes, whole_characters=whole, counted=raw).collect())) == sorted(map(tuple, one.collect()))
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fl = covering_tolerance(chunk_spans(d, 8), multi_scheme_tokens(d, schemes, counted=raw), schemes)
        plan = fl._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
    dealt = [i for i, line in enumerate(plan) if "REPARTITION_BY_NUM" in line and "ReusedExchange" not in line]
    assert len(dealt) == 2   # the texts, and what was looked up
    back = next(plan[i + 1] for i in dealt if "text#" not in plan[i + 1])
    assert "_es0" in back and "piece#" not in back.split("[", 1)[1].split("]")[0] and "_wss" not in back
