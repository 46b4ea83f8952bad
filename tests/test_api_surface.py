"""Smoke tests of public functions not exercised by the plans."""
import json
import tempfile

from pyspark.sql import functions as F


def test_matrices_and_nested_report(spark):
    from spanalign.operators.reports import comparison_matrix, compare_schemes
    from spanalign.operators.series import phase_matrix
    from spanalign.sources.reports import read_nested_report
    st = spark.createDataFrame([("a", "word", 1.0, 2.0, 3), ("b", "char", 4.0, 5.0, 6)],
                               "grp string, scheme string, avg_score double, overall_alignment double, file_count long")
    m = {r.grp: (r.word, r.char) for r in comparison_matrix(compare_schemes(st, ["word", "char"]), ["word", "char"]).collect()}
    assert m == {"a": (1.0, None), "b": (None, 4.0)}
    ph = spark.createDataFrame([("m1", "load", 3.0), ("m1", "run", 5.0)], "model string, phase string, increase double")
    assert phase_matrix(ph, "model", ["load", "run"]).first().asDict() == {"model": "m1", "load": 3.0, "run": 5.0}
    doc = {"model": "gpt2", "summary": {"total_files": 1}, "rankings": [],
           "languages": {"python": {"file_count": 1, "avg_score": 50.0, "total_rules": 2, "total_aligned": 1,
                                    "overall_alignment": 50.0, "total_code_size": 10, "total_analysis_time": 0.5,
                                    "avg_processing_speed": 20.0,
                                    "files": [{"file": "a.py", "path": "/x/a.py", "score": 50.0, "total_rules": 2,
                                               "aligned_rules": 1, "code_size": 10, "analysis_time": 0.5,
                                               "processing_speed": 20.0, "is_perfect": False}]}}}
    path = tempfile.mkdtemp(prefix="nested-") + "/report.json"
    with open(path, "w") as f:
        json.dump(doc, f, indent=2)
    langs, files = read_nested_report(spark, path)
    assert langs.first().language == "python" and langs.first().file_count == 1
    assert files.first().file == "a.py" and files.first().aligned_rules == 1


def test_file_results_accepted_rejected_and_bytes(spark):
    from spanalign.operators.clean import accepted, quarantine, rejected
    from spanalign.operators.scores import file_results
    from spanalign.operators.tokens import tokens_from_table
    sc = spark.createDataFrame([(1, "g", 50.0, 2, 1, 10, False), (2, "g", 100.0, 1, 1, 5, True)],
                               "doc_id long, grp string, score double, n_distinct_rules long, n_distinct_aligned long, n_chars long, is_perfect boolean")
    ul = spark.createDataFrame([(1, [("k", 0)])], "doc_id long, unaligned_rules array<struct<rule_key:string,start_byte:long>>")
    fr = {r.doc_id: r for r in file_results(sc, ul).collect()}
    assert len(fr[1].unaligned_rules) == 1 and fr[2].unaligned_rules == [] and fr[1].code_size == 10
    d = spark.createDataFrame([(1, "g", "ok"), (2, "g", " ")], "doc_id long, grp string, text string")
    q = quarantine(d)
    assert [r.doc_id for r in accepted(q).collect()] == [1] and [r.reason for r in rejected(q).collect()] == ["blank"]
    t = spark.createDataFrame([(1, "aé", [(0, 1), (1, 3), (2, 9)])], "doc_id long, text string, offsets array<struct<s:long,e:long>>")
    got = [(r.s, r.e) for r in tokens_from_table(t, unit="byte").orderBy("tok_id").collect()]
    assert got == [(0, 1), (1, 3), (2, 3)]


def test_analyze_with_span_table_and_explode(spark):
    from spanalign.analysis import analyze
    from spanalign.operators.offsets import explode_pieces, with_offsets
    d = spark.createDataFrame([(1, "g", "abc def")], "doc_id long, grp string, text string")
    spans = spark.createDataFrame([(1, "g", "w", 0, 0, 3), (1, "g", "cut", 1, 1, 5)],
                                  "doc_id long, grp string, type string, span_id int, s long, e long")
    st = analyze(d, spans, metric="word_split").group_stats.first()
    assert (st.total_rules, st.total_aligned) == (2, 1)
    p = with_offsets(explode_pieces(d, F.split("text", " ")))
    assert [(r.b0, r.b1) for r in p.orderBy("i").collect()] == [(0, 3), (3, 6)]
