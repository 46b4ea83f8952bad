from pyspark.sql import functions as F

from spanalign.operators.offsets import byte_to_char
from spanalign.operators.tokens import (clean_offsets, fill_missing_tokens, locate_pieces, token_counts, tokens,
                                        tokens_from_table)


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy(*cols).collect()]


def test_offsets_bytes_chars_utf16(spark, texts):
    t = tokens(texts.filter("doc_id = 2"), "char", utf16=True)
    got = rows(t, "tok_id", "s", "e", "cs", "ce", "u0", "u1")
    # é = 2 bytes, 字 = 3 bytes, 😀 = 4 bytes and 2 UTF-16 units
    assert got[:4] == [(0, 0, 2, 0, 1, 0, 1), (1, 2, 5, 1, 2, 1, 2), (2, 5, 9, 2, 3, 2, 4), (3, 9, 10, 3, 4, 4, 5)]
    assert got[-1][2] == len("é字😀ab cd".encode())


def test_pieces_cover_text(spark, texts):
    d = texts.filter("text is not null")
    t = tokens(d, "word").groupBy("doc_id").agg(F.max("e").alias("e"), F.sum(F.col("e") - F.col("s")).alias("n"))
    nb = {r.doc_id: len((r.text or "").encode()) for r in d.collect()}
    for r in t.collect():
        assert r.e == nb[r.doc_id] and r.n == nb[r.doc_id]


def test_token_counts_all_schemes(spark, texts):
    c = {(r.doc_id, r.scheme): r.n_tokens for r in token_counts(texts.filter("doc_id = 1"), ["word", "char", "ws"]).collect()}
    assert c[(1, "char")] == len("foo_bar1 = baz(2)\n")
    assert c[(1, "word")] == 9  # foo_bar1, ' ', '=', ' ', baz, '(', 2, ')', '\n'
    assert c[(1, "ws")] == 6  # foo_bar1, " ", =, " ", baz(2), "\n"


def test_byte_to_char_inside_multibyte_is_null(spark, texts):
    d = texts.filter("doc_id = 2")
    pts = spark.createDataFrame([(2, p) for p in range(0, 15)], "doc_id long, p long")
    pcs = tokens(d, "word", keep=()).select("doc_id", F.col("s").alias("b0"), F.col("cs").alias("c0"), "piece")
    got = dict(rows(byte_to_char(pts, pcs), "p", "char_index"))
    text = "é字😀ab cd"
    expect, b = {}, 0
    for i, ch in enumerate(text):
        expect[b] = i
        b += len(ch.encode())
    expect[b] = len(text)
    for p in range(0, 15):
        assert got[p] == expect.get(p), p


def test_clean_offsets_and_char_to_byte(spark):
    df = spark.createDataFrame([(1, "aé b", [(0, 2), (None, 3), (3, 3), (2, 1), (-5, 1), (3, 99)])],
                               "doc_id long, text string, offsets array<struct<s:long,e:long>>")
    t = tokens_from_table(df, "offsets", "text", unit="char")
    # kept: (0,2)->(0,3) bytes, (-5,1)->(0,1)->(0,1), (3,99)->(3,4)->(4,5)
    # the pairs that are kept are numbered without gaps
    assert rows(t, "tok_id", "s", "e") == [(0, 0, 3), (1, 0, 1), (2, 4, 5)]
    c = clean_offsets(spark.createDataFrame([(None, 1, 5), (2, 2, 5), (4, 9, 5)], "s long, e long, n_chars long"))
    assert rows(c, "s", "e") == [(4, 5)]


def test_fill_missing_tokens(spark, texts):
    d = texts.filter("doc_id in (1, 7)")
    t = tokens(d, r"\p{N}+")
    f = fill_missing_tokens(d, t)
    got = rows(f, "doc_id", "tok_id", "s", "e", "token_source")
    assert (7, 0, 0, 1, "single_byte_fallback") in got
    assert [g for g in got if g[0] == 1] == [(1, 0, 7, 8, "offset_mapping"), (1, 1, 15, 16, "offset_mapping")]


def test_locate_pieces_found_missing_blank_repeated(spark):
    df = spark.createDataFrame([(1, "ab ab x", ["ab", "ab", "zz", " ", "x"])], "doc_id long, text string, pieces array<string>")
    got = rows(locate_pieces(df), "tok_id", "s", "e")
    # found 0-2, repeated found 3-5, missing -> placeholder 5-6, blank -> placeholder 6-7 (cursor 7),
    # so "x" is not found after the cursor: empty placeholder capped at the text end
    assert got == [(0, 0, 2), (1, 3, 5), (2, 5, 6), (3, 6, 7), (4, 7, 7)]


def test_blank_and_quarantine(spark, texts):
    from spanalign.operators.clean import drop_blank, quarantine
    assert sorted(r.doc_id for r in drop_blank(texts).collect()) == [1, 2, 6, 7]
    q = {r.doc_id: r.reason for r in quarantine(texts, max_size=10, allowed=["py"]).collect()}
    assert q == {1: "oversize", 2: "oversize", 3: "blank", 4: "blank", 5: "blank", 6: "oversize", 7: "not_allowed"}


def test_duplicate_offset_pairs_lowest_id(spark):
    from spanalign.operators.align import stab
    P = spark.createDataFrame([(1, 0, 2)], "doc_id long, pid int, p long")
    I = spark.createDataFrame([(1, 5, 0, 4), (1, 3, 0, 4), (1, 9, 4, 6)], "doc_id long, tok_id int, s long, e long")
    r = stab(P, I).first()
    assert r.tok.tok_id == 3 and r.in_token


def test_rank_speed_zero_seconds(spark):
    from spanalign.operators.scores import rank_speed
    runs = spark.createDataFrame([("a", 10, 0.0), ("b", 10, 2.0)], "grp string, total_code_size long, total_analysis_time double")
    got = {r.grp: (r.speed, r["rank"]) for r in rank_speed(runs).collect()}
    assert got == {"b": (5.0, 1), "a": (0.0, 2)}


def test_token_table_source_label(spark, texts):
    from spanalign.operators.tokens import token_table
    t = token_table(tokens(texts.filter("doc_id = 7"), "char"), token_source="offset_mapping").first()
    assert (t.piece, t.quoted, t.n_tokens, t.token_source) == ("x", "'x'", 1, "offset_mapping")


def test_text_partitions_follow_the_texts(spark, monkeypatch):
    from spanalign.sources import tables
    df = spark.createDataFrame([(i, "a", "x" * 100) for i in range(50)], "doc_id long, grp string, text string")
    least = tables.doc_partitions(spark)
    assert tables.by_doc(df).rdd.getNumPartitions() == least
    monkeypatch.setattr(tables, "TEXT_BYTES", 50)
    assert tables.by_doc(df).rdd.getNumPartitions() == max(least, 100)
    assert tables.by_doc(df, 3).rdd.getNumPartitions() == 3
    assert tables.by_doc(df.drop("text")).rdd.getNumPartitions() == least
    assert tables.by_doc(df.filter("false")).rdd.getNumPartitions() == least
