import __spark_entry__ as E


def test_contract_keys():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 60


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["rank", "grp", "avg_score", "file_count", "total_rules"]
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1)) and len(rows) == 4


def test_udf_plugins(spark):
    from spanalign.functions.udf import apply_span_extractor, apply_tokenizer, word_class_runs

    def spans_factory():
        return lambda t: [("all", 0, len(t.encode())), ("ERROR", 0, 1), ("head", 0, 2)]

    def tok_factory():
        return lambda t: [(i, i + 1) for i in range(len(t))]

    d = spark.createDataFrame([(1, "g", "aé-b")], "doc_id long, grp string, text string")
    sp = sorted((r.type, r.s, r.e) for r in apply_span_extractor(d, spans_factory).collect())
    assert sp == [("all", 0, 5), ("head", 0, 2)]
    tk = [(r.s, r.e) for r in apply_tokenizer(d, tok_factory, "chars").orderBy("tok_id").collect()]
    assert tk == [(0, 1), (1, 3), (3, 4), (4, 5)]
    runs = [(r.s, r.e) for r in word_class_runs(d, r"[a-z]").orderBy("s").collect()]
    assert runs == [(0, 1), (4, 5)]


def test_analyze_metrics(spark):
    from spanalign.analysis import analyze
    d = spark.createDataFrame([(1, "a", "Hello world. Bye now."), (2, "b", "x")], "doc_id long, grp string, text string")
    for metric in ("word_split", "tolerance", "token_cut"):
        a = analyze(d, {"sent": r"[^.]+\."}, metric=metric)
        st = {r.grp: r for r in a.group_stats.collect()}
        assert st["a"].total_rules == 2 and st["b"].total_rules == 0 and st["b"].file_count == 1
    w = {r.grp: r.total_aligned for r in analyze(d, 4).group_stats.collect()}
    assert w["b"] == 1



def test_analyze_detail(spark):
    from spanalign.analysis import analyze_detail
    d = spark.createDataFrame([(1, "a", "abcdef gh"), (2, "b", "")], "doc_id long, grp string, text string")
    det = {r.span_id: r for r in analyze_detail(d, rules=4).collect()}
    # chunks abcd|ef g|h: border 4 splits "abcdef", border 8 splits "gh"
    assert det[0].crossing_end and det[1].crossing_start and det[1].crossing_end and det[2].crossing_start
    assert det[0].crossing_end_reason == "rule.end_byte=4 splits word between 'd' and 'e'"
    assert det[0].grp == "a" and det[0].text_preview == "abcd"
