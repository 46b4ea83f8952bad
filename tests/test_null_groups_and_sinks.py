"""Null groups, fresh plug-ins, several schemes in one report, stray files:
inputs that the given tables do not hold."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from spanalign.analysis import folder_runs
from spanalign.functions.text import normalize_language
from spanalign.functions.udf import apply_span_extractor, apply_tokenizer
from spanalign.operators.batching import batch_stats, flush_parts, slice_docs, stop_after, with_index, with_read_index
from spanalign.operators.prefix import prefix_sums
from spanalign.operators.scores import corpus_summary, rank_speed, with_timing
from spanalign.operators.tokens import boundaries, multi_scheme_tokens
from spanalign.sources.files import code_files, code_output_dirs
from spanalign.sources.reports import read_nested_report, read_nested_run, read_report, write_report

SCORES = "doc_id string, grp string, score double, n_rules long, n_aligned long, n_distinct_rules long, n_distinct_aligned long, n_chars long, n_bytes long, is_perfect boolean"


@pytest.fixture(scope="module")
def scores(spark):
    rows = [(f"p/{i:03d}", None if i % 3 == 0 else "ab"[i % 2], float(i), 2, 1, 2, 1, 10, 10, False) for i in range(60)]
    return spark.createDataFrame(rows, SCORES)


def test_index_parts_and_batches_keep_null_groups(spark, scores):
    x = with_index(scores.select("doc_id", "grp"), "doc_id", "grp").collect()
    assert len(x) == 60
    for g in (None, "a", "b"):
        mine = sorted((r.doc_id, r.idx) for r in x if r.grp == g)
        assert [i for _, i in mine] == list(range(len(mine)))
    assert flush_parts(scores, 7).agg(F.sum("file_count")).first()[0] == 60
    batches = batch_stats(scores, 5)
    assert batches.agg(F.sum("file_count")).first()[0] == 60
    kept = stop_after(batches, 12)
    assert {(r.grp, r.n) for r in kept.groupBy("grp").agg(F.sum("file_count").alias("n")).collect()} == {(None, 15), ("a", 15), ("b", 15)}
    wide = scores.withColumn("text", F.lit("t"))
    part = slice_docs(wide, 2, 3, group="grp")
    assert part.count() == 9 and set(part.columns) == {*wide.columns, "idx"}


def test_read_index_counts_rows_in_reading_order(spark):
    x = with_read_index(spark.range(0, 1000, 1, 7).withColumn("v", F.col("id") * 2)).collect()
    assert all(r.idx == r.id for r in x)


def test_prefix_sums(spark):
    rows = [(g, b, i, (i * 7) % 5) for g in ("x", None) for b in range(4) for i in range(20)]
    df = spark.createDataFrame(rows, "g string, b int, i int, v long").withColumn("c", (F.col("b") * 2).cast("int"))
    got = {(r.g, r.b, r.i): (r.n, r.s) for r in prefix_sums(df, ["g"], ["b", "c"], ["i"], {"n": "1", "s": "v"}).collect()}
    assert len(got) == len(rows)
    for g in ("x", None):
        n = s = 0
        for b in range(4):
            for i in range(20):
                assert got[g, b, i] == (n, s)
                n, s = n + 1, s + (i * 7) % 5


def test_timing_and_speed(spark):
    stats = spark.createDataFrame([(None, 100), ("b", 50)], "grp string, total_code_size long")
    log = spark.createDataFrame([(None, 4.0)], "grp string, seconds double")
    timed = with_timing(stats, log)
    assert {r.grp: r.total_analysis_time for r in timed.collect()} == {None: 4.0, "b": None}
    full = timed.withColumns({"file_count": F.lit(1), "total_rules": F.lit(1), "total_aligned": F.lit(1)})
    assert corpus_summary(full).first().avg_processing_speed == 150 / 4.0
    runs = spark.createDataFrame([(f"u{i}", i % 5, 2.0 if i else 0.0) for i in range(50)], "grp string, total_code_size long, total_analysis_time double")
    got = [(r.grp, r["rank"]) for r in rank_speed(runs).orderBy("rank").collect()]
    want = sorted((f"u{i}" for i in range(50)), key=lambda g: (-(int(g[1:]) % 5 / 2.0 if g != "u0" else 0.0), g))
    assert got == [(g, k + 1) for k, g in enumerate(want)]


def test_fresh_plugins_return_their_own_rows(spark):
    d = spark.createDataFrame([(i, "g", "abc") for i in range(4)], "doc_id long, grp string, text string")
    for k in range(20):
        def spans(k=k):
            return lambda t: [(f"type{k}", 0, len(t))]

        def toks(k=k):
            return lambda t: [(0, 1 + k % 3)]
        assert {r.type for r in apply_span_extractor(d, spans).collect()} == {f"type{k}"}
        assert {r.e for r in apply_tokenizer(d, toks, "own").collect()} == {1 + k % 3}


def test_schemes_that_do_not_cover_are_refused(spark):
    d = spark.createDataFrame([(1, "g", "abc 12 de 345")], "doc_id long, grp string, text string")
    with pytest.raises(ValueError):
        boundaries(d, r"\p{N}+")
    with pytest.raises(ValueError):
        multi_scheme_tokens(d, ["word", r"\p{N}+"])
    assert multi_scheme_tokens(d, [r"(?s).{1,2}"], covering=True).count() == 7


def test_a_second_scheme_leaves_the_first_report(spark):
    out = tempfile.mkdtemp(prefix="rep-")
    stats = spark.createDataFrame([("a", 2, 50.0, 10, 5, 50.0, 100)], "grp string, file_count long, avg_score double, total_rules long, total_aligned long, overall_alignment double, total_code_size long")
    files = spark.createDataFrame([(1, "a", 50.0), (2, "a", 50.0)], "doc_id long, grp string, score double")
    for scheme in ("word", "char", "word"):
        write_report(stats, files, out, scheme, elapsed=2.0)
    s, l, f = read_report(spark, out)
    assert sorted(r.scheme for r in s.collect()) == ["char", "word"] and l.count() == 2 and f.count() == 4
    assert {r.summary.avg_processing_speed for r in s.collect()} == {50.0}


def test_nested_report_keeps_rules_and_summary(spark):
    path = tempfile.mkdtemp(prefix="nested-") + "/r.json"
    doc = {"model": "m", "timestamp": "t", "overall_analysis_time": 3.5, "summary": {"total_languages": 1, "total_files": 1, "avg_processing_speed": 9.0},
           "languages": {"go": {"file_count": 1, "files": [{"file": "a.go", "score": 50.0, "unaligned_rules": [{"rule_key": "x_0_2", "start_byte": 0}]}]}}}
    with open(path, "w") as f:
        json.dump(doc, f)
    langs, files = read_nested_report(spark, path)
    run = read_nested_run(spark, path)
    assert langs.first().language == "go" and files.first().unaligned_rules[0].rule_key == "x_0_2"
    assert (run.first().overall_analysis_time, run.first().total_files, run.first().avg_processing_speed) == (3.5, 1, 9.0)


def put(path, data=b"x = 1\n"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def test_stray_files_uri_roots_and_folders_without_rules(spark):
    root = tempfile.mkdtemp(prefix="tree-")
    put(f"{root}/python/a.py")
    put(f"{root}/lib/python/b.py")
    for base in (root, f"file://{root}", f"file:{root}/"):
        assert [r.file for r in code_files(spark, base, ["python"]).collect()] == ["a.py"]
    put(f"{root}/python_code_output/a.py", b"value_one = 1\n")
    put(f"{root}/python_code_output/README.md")
    put(f"{root}/go_code_output/empty.go", b"\n")
    put(f"{root}/pascal_code_output/x.pas")
    files, skipped = code_output_dirs(spark, root)
    assert sorted(r.doc_id.rsplit("/", 1)[1] for r in files.collect()) == ["a.py", "empty.go"]
    stats, log = folder_runs(files, ["word", "char"], rules=8, skipped=skipped)
    assert {(r.folder, r.scheme, r.file_count, r.total_rules > 0) for r in stats.collect()} == {("python", s, 1, True) for s in ("word", "char")} | {("go", s, 1, True) for s in ("word", "char")}
    assert {(r.folder, r.status) for r in log.collect()} == {("python", "ok"), ("go", "ok"), ("pascal", "skipped")}
    # rules of five letters: the folder whose text has none is still there
    stats, log = folder_runs(files, ["word"], rules={"w": "[a-z]{5}"})
    assert {(r.folder, r.file_count, r.total_rules) for r in stats.collect()} == {("python", 1, 1), ("go", 1, 0)}
    assert {(r.folder, r.status) for r in log.collect()} == {("python", "ok"), ("go", "empty")}


def test_language_labels_lose_all_white_space(spark):
    x = spark.createDataFrame([("Python\n",), ("\tgo",), ("  C++ ",)], "g string")
    assert [r[0] for r in x.select(normalize_language("g")).collect()] == ["python", "go", "cpp"]


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from spanalign import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, *_):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()
    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Session())
