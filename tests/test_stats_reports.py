from pyspark.sql import functions as F

from spanalign.operators.batching import batch_stats, flush_parts, slice_docs, stop_after, with_index
from spanalign.operators.reports import category_stats, compare_schemes, project_cost, score_histogram
from spanalign.operators.scores import doc_scores, group_stats, rank_groups, top_and_bottom
from spanalign.operators.series import baseline_delta, peak_point, phase_compare, series_summary


def scores_fixture(spark):
    """FIXTURES.md 'scores': an all-perfect language, a mixed one, a document
    without rules."""
    rows = [(1, "a", 100.0, 4, 4, True), (2, "a", 100.0, 2, 2, True),
            (3, "b", 50.0, 4, 2, False), (4, "b", 100.0, 2, 2, True), (5, "b", 0.0, 0, 0, True)]
    df = spark.createDataFrame(rows, "doc_id long, grp string, score double, n_distinct_rules long, "
                                     "n_distinct_aligned long, is_perfect boolean")
    return df.withColumn("n_chars", F.lit(10).cast("long")).withColumn("n_bytes", F.lit(12).cast("long"))


def test_doc_scores_keeps_ruleless_docs_and_duplicates(spark):
    docs = spark.createDataFrame([(1, "g", "abc def"), (2, "g", "")], "doc_id long, grp string, text string")
    flags = spark.createDataFrame([(1, "w", 0, 0, 3, True), (1, "w", 1, 0, 3, True), (1, "w", 2, 2, 5, False)],
                                  "doc_id long, type string, span_id int, s long, e long, fully_aligned boolean")
    r = {x.doc_id: x for x in doc_scores(flags, docs).collect()}
    assert (r[1].n_rules, r[1].n_aligned, r[1].n_distinct_rules, r[1].n_distinct_aligned) == (3, 2, 2, 1)
    assert abs(r[1].score - 200 / 3) < 1e-9 and not r[1].is_perfect
    assert (r[2].n_rules, r[2].score, r[2].is_perfect, r[2].n_bytes) == (0, 0.0, True, 0)


def test_group_stats_include_perfect(spark):
    s = scores_fixture(spark)
    allf = {r.grp: r for r in group_stats(s, include_perfect=True).collect()}
    imp = {r.grp: r for r in group_stats(s, include_perfect=False).collect()}
    assert allf["a"].avg_score == 100.0 and imp["a"].avg_score is None  # all-perfect group kept
    assert abs(allf["b"].avg_score - 50.0) < 1e-9 and imp["b"].avg_score == 50.0
    assert allf["b"].total_rules == 6 and abs(allf["b"].overall_alignment - 400 / 6) < 1e-9
    rk = {r.grp: r.rank for r in rank_groups(group_stats(s)).collect()}
    assert rk == {"a": 1, "b": 2}
    tb = top_and_bottom(group_stats(s), n=1).collect()
    assert len(tb) == 1 and tb[0].best == "a" and tb[0].worst == "b"


def test_index_parts_batches(spark):
    df = spark.range(0, 25).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("grp"),
                                   F.lit(50.0).alias("score"), F.lit(2).cast("long").alias("n_distinct_rules"),
                                   F.lit(1).cast("long").alias("n_distinct_aligned"), F.lit(False).alias("is_perfect"),
                                   F.lit(5).cast("long").alias("n_chars")).repartition(5)
    idx = {r.doc_id: r.idx for r in with_index(df, "doc_id").collect()}
    assert [idx[i] for i in range(25)] == list(range(25))
    sl = sorted(r.doc_id for r in slice_docs(df, 5, 7).collect())
    assert sl == list(range(5, 12))
    parts = {(r.grp, r.part): r.file_count for r in flush_parts(df, 3).collect()}
    assert parts[("x", 1)] == 3 and parts[("x", 3)] == 3 and ("x", 4) not in parts  # 9 x-docs end exactly on 3
    assert sum(v for (g, _), v in parts.items() if g == "y") == 16 and parts[("y", 6)] == 1
    b = batch_stats(df, 4, group="grp")
    kept = stop_after(b, 6).filter("grp = 'x'").orderBy("batch").collect()
    assert [r.batch for r in kept] == [1, 2]  # 4 < 6 -> keep batch 2 which reaches 8 >= 6


def test_histogram_and_categories(spark):
    v = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (8.0,)], "avg_score double")
    h = {r.bin: r.n for r in score_histogram(v, bins=8).collect()}
    assert h == {0: 1, 1: 1, 2: 1, 3: 0, 4: 0, 5: 0, 6: 0, 7: 1}  # max lands in the closed last bin
    same = {r.bin: r.n for r in score_histogram(spark.createDataFrame([(3.0,), (3.0,)], "avg_score double")).collect()}
    assert same[4] == 2 and sum(same.values()) == 2  # [v-0.5, v+0.5]
    st = spark.createDataFrame([("python", 10.0), ("ruby", 20.0), ("java", 30.0)], "grp string, avg_score double")
    c = {r.category: r for r in category_stats(st).collect()}
    assert c["Dynamic Typed"].mean == 15.0 and c["Dynamic Typed"].std == 5.0  # population std
    assert c["Static Typed"]["count"] == 1 and c["Dynamic Typed"].median == 15.0


def test_compare_schemes_keeps_holes_and_cost(spark):
    st = spark.createDataFrame([("a", "word", 1.0, 2.0, 3), ("b", "char", 4.0, 5.0, 6)],
                               "grp string, scheme string, avg_score double, overall_alignment double, file_count long")
    c = {(r.grp, r.scheme): r.avg_score for r in compare_schemes(st, ["word", "char"]).collect()}
    assert c == {("a", "word"): 1.0, ("a", "char"): None, ("b", "word"): None, ("b", "char"): 4.0}
    pc = project_cost(spark.createDataFrame([("g", 100.0, 50.0)], "grp string, speed double, avg_size double"))
    h = {r.files: r.human for r in pc.collect()}
    assert h[100] == "50.00 seconds" and h[1000] == "8.33 minutes" and h[100000000] == "1.59 years"


def test_series(spark):
    rows = [(1, 1, "2024-01-01 00:00:00", 5.0), (2, 1, "2024-01-01 00:00:10", 9.0), (3, 1, "2024-01-01 00:00:20", 9.0),
            (4, 1, "2024-01-01 00:00:30", 2.0), (5, 2, "2024-01-01 00:00:00", 7.0)]
    s = spark.createDataFrame(rows, "event_id long, series_id long, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    sm = {r.series_id: r for r in series_summary(s).collect()}
    assert (sm[1].initial, sm[1].peak, sm[1].final, sm[1].increase, sm[1].n_samples, sm[1].duration) == (5.0, 9.0, 2.0, -3.0, 4, 30.0)
    assert (sm[2].initial, sm[2].final, sm[2].duration) == (7.0, 7.0, 0.0)  # single sample
    pk = {r.series_id: r.peak_id for r in peak_point(s).collect()}
    assert pk[1] == 2  # tie for the peak: the first one
    bd = {r.event_id: (r.delta, r.elapsed) for r in baseline_delta(s).collect()}
    assert bd[4] == (-3.0, 30.0)
    ph = phase_compare(s, "series_id", F.lit("all")).filter("series_id = 1").first()
    assert (ph.start_value, ph.end_value, ph.increase) == (5.0, 2.0, -3.0)


def test_comparison_document(spark):
    from spanalign.operators.reports import comparison_document
    st = spark.createDataFrame([("a", "word", 1.0, 2.0, 3), ("b", "char", 4.0, 5.0, 6)],
                               "grp string, scheme string, avg_score double, overall_alignment double, file_count long")
    doc = comparison_document(compare_schemes(st, ["word", "char"])).first()
    assert doc.languages == ["a", "b"] and doc.models == ["char", "word"]
    assert doc.data["a"]["word"].avg_score == 1.0 and doc.data["a"]["char"].avg_score is None
