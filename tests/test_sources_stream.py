import os
import tempfile

from pyspark.sql import functions as F

from spanalign.sources.files import code_files, code_output_dirs
from spanalign.sources.reports import read_report, write_comparison, write_parts, write_report


def write(path, data: bytes):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def test_code_files_layout_and_decoding(spark):
    root = tempfile.mkdtemp(prefix="tree-")
    write(f"{root}/python/a.py", b"x = 1\r\ny = 2\r")
    write(f"{root}/python/sub/b.py", b"bad \xff byte\n")
    write(f"{root}/other/c.py", b"print(3)\n")       # ignored: python/ yields files
    write(f"{root}/src/m.h", b"int f();\n")          # c: no c/ folder -> whole tree
    write(f"{root}/src/k.hpp", b"int g();\n")        # cpp
    write(f"{root}/src/n.PY", b"nope\n")             # wrong case suffix
    write(f"{root}/src/t.txt", b"nope\n")
    df = code_files(spark, root, ["python", "c", "cpp"])
    got = {r.file: (r.grp, r.text) for r in df.collect()}
    assert set(got) == {"a.py", "b.py", "m.h", "k.hpp"}
    assert got["a.py"] == ("python", "x = 1\ny = 2\n")     # CRLF and CR normalised
    assert got["b.py"][1] == "bad  byte\n"                # invalid byte dropped
    assert got["m.h"][0] == "c" and got["k.hpp"][0] == "cpp"


def test_code_output_dirs(spark):
    base = tempfile.mkdtemp(prefix="out-")
    write(f"{base}/py_code_output/x/1.py", b"a\n")
    write(f"{base}/golang_code_output/2.go", b"b\n")
    write(f"{base}/ruby_code_output/3.rb", b"c\n")          # not accepted by the folder runner
    files, skipped = code_output_dirs(spark, base)
    assert sorted(r.grp for r in files.collect()) == ["go", "python"]
    assert [r.dir_prefix for r in skipped.collect()] == ["ruby"]


def test_report_round_trip_and_sinks(spark):
    out = tempfile.mkdtemp(prefix="rep-")
    stats = spark.createDataFrame([("a", 2, 50.0, 10, 5, 50.0, 100)], "grp string, file_count long, avg_score double, "
                                  "total_rules long, total_aligned long, overall_alignment double, total_code_size long")
    scores = spark.createDataFrame([(1, "a", 50.0), (2, "a", 50.0)], "doc_id long, grp string, score double")
    write_report(stats, scores, f"{out}/r", "word", elapsed=1.5)
    s, l, f = read_report(spark, f"{out}/r")
    assert s.first().summary.total_files == 2 and l.first().scheme == "word" and f.count() == 2
    write_parts(scores.withColumn("part", F.lit(1)), f"{out}/parts")
    assert os.path.isdir(f"{out}/parts/grp=a/part=1")
    write_comparison(stats.select("grp", F.lit("word").alias("scheme"), "avg_score"), f"{out}/cmp")
    assert spark.read.json(f"{out}/cmp").count() == 1


def test_stream_equals_batch_and_resumes(spark):
    from spanalign.operators.scores import doc_scores_covering, group_stats
    from spanalign.operators.spans import chunk_pieces
    from spanalign.streaming.stream import (corpus_stream, overwrite_sink, run_available, stream_doc_scores,
                                            stream_group_stats)
    src = tempfile.mkdtemp(prefix="src-")
    rows = [(i, "de" if i % 2 else "en", "Wort" * (i % 7 + 1) + " und ende.") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, grp string, text string")
    df.filter("doc_id < 20").write.parquet(f"{src}/p1")
    schema = df.schema
    out, ck = tempfile.mkdtemp(prefix="agg-") + "/o", tempfile.mkdtemp(prefix="ck-")
    st = lambda: stream_group_stats(stream_doc_scores(corpus_stream(spark, f"{src}/*", schema, max_files_per_trigger=1),
                                                      chunk_pieces("text", 5)))
    run_available(st(), overwrite_sink(out), checkpoint=ck, mode="complete")
    df.filter("doc_id >= 20").write.parquet(f"{src}/p2")
    run_available(st(), overwrite_sink(out), checkpoint=ck, mode="complete")   # resumes: only new files
    got = {r.grp: (r.file_count, r.total_rules) for r in spark.read.parquet(out).collect()}
    batch = {r.grp: (r.file_count, r.total_rules) for r in group_stats(doc_scores_covering(df, chunk_pieces("text", 5))).collect()}
    assert got == batch


def test_run_index_and_timing(spark):
    from spanalign.operators.scores import with_timing
    from spanalign.sources.reports import write_run_index
    out = tempfile.mkdtemp(prefix="runs-") + "/index"
    log = spark.createDataFrame([("r1", "a", "word", "ok", 2, 4.0)], "run_id string, grp string, scheme string, status string, n long, seconds double")
    write_run_index(log, out)
    write_run_index(log.withColumn("run_id", F.lit("r2")), out)
    assert sorted(r.run_id for r in spark.read.json(out).collect()) == ["r1", "r2"]
    stats = spark.createDataFrame([("a", 100), ("b", 50)], "grp string, total_code_size long")
    t = {r.grp: (r.total_analysis_time, r.avg_processing_speed) for r in with_timing(stats, log).collect()}
    assert t["a"] == (4.0, 25.0) and t["b"] == (None, 0.0)


def test_distributed_stream_parts_across_epochs(spark):
    from spanalign.operators.batching import with_index
    from spanalign.streaming.stream import corpus_stream, flush_parts_sink, run_available
    src = tempfile.mkdtemp(prefix="src-")
    rows = [(i, "de" if i % 4 else "en") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, grp string")
    # one file per half: arrival order (one file per micro-batch) is then doc order
    df.filter("doc_id < 23").coalesce(1).write.parquet(f"{src}/p1")
    df.filter("doc_id >= 23").coalesce(1).write.parquet(f"{src}/p2")
    base = tempfile.mkdtemp(prefix="parts-")
    run_available(corpus_stream(spark, f"{src}/*", df.schema, max_files_per_trigger=1),
                  flush_parts_sink(f"{base}/out", f"{base}/state", 5), mode="append")
    got = {r.doc_id: (r.part, r.seq) for r in spark.read.parquet(f"{base}/out").collect()}
    idx = {r.doc_id: r.idx for r in with_index(df, "doc_id", "grp").collect()}
    assert got == {d: (i // 5 + 1, i) for d, i in idx.items()}
    assert spark.read.parquet(f"{base}/state").select("epoch").distinct().count() >= 2


def test_folder_runs_one_job(spark):
    from spanalign.analysis import folder_runs
    from spanalign.operators.series import run_summary
    base = tempfile.mkdtemp(prefix="runs-")
    write(f"{base}/py_code_output/a.py", b"def foo_bar(x):\n    return x + 1\n")
    write(f"{base}/py_code_output/b.py", b"print('hello world')\n")
    write(f"{base}/go_code_output/c.go", b"func main() { fmt.Println(1) }\n")
    files, _ = code_output_dirs(spark, base)
    stats, log = folder_runs(files, ["word", "char"], rules=8)
    got = {(r.folder, r.grp, r.scheme): r.file_count for r in stats.collect()}
    assert got == {("py", "python", "word"): 2, ("py", "python", "char"): 2, ("go", "go", "word"): 1, ("go", "go", "char"): 1}
    ch = {(r.folder, r.scheme): r.total_aligned == r.total_rules for r in stats.collect()}
    assert ch[("py", "char")] and ch[("go", "char")]  # every border is a char-token border
    s = {r.run: r.n_success for r in run_summary(log.withColumnRenamed("folder", "run"), "run").collect()}
    assert s == {"py": 2, "go": 2}


def test_single_file_path(spark):
    root = tempfile.mkdtemp(prefix="one-")
    write(f"{root}/x/only.rs", b"fn main() {}\n")
    got = [(r.file, r.grp) for r in code_files(spark, f"{root}/x/only.rs", ["rust", "python"]).collect()]
    assert got == [("only.rs", "rust")]
    assert code_files(spark, f"{root}/x/only.rs", ["python"]).count() == 0


def test_corpus_from_table_without_ids_and_formats(spark):
    from spanalign.sources.tables import corpus_from_table, read_any
    from spanalign.functions.patterns import LANGUAGE_ALIASES
    d = tempfile.mkdtemp(prefix="fmt-")
    rows = [("x = 1", " Py "), ("let a", "JS"), ("?", "cobol")]
    df = spark.createDataFrame(rows, "code string, language string")
    df.write.option("header", "true").csv(f"{d}/csv")
    df.write.json(f"{d}/json")
    for fmt, opts in (("csv", {"header": "true"}), ("json", {})):
        src = read_any(spark, f"{d}/{fmt}", fmt, **opts)
        c = corpus_from_table(src, id_col=None, text_col="code", language_col="language", aliases=LANGUAGE_ALIASES)
        got = sorted((r.doc_id.startswith("sample_"), r.grp or "") for r in c.collect())
        assert got == [(True, ""), (True, "javascript"), (True, "python")]
        assert sorted(r.doc_id for r in c.collect()) == ["sample_0", "sample_1", "sample_2"]
    fixed = corpus_from_table(df, id_col=None, text_col="code", fixed_language="go")
    assert {r.grp for r in fixed.collect()} == {"go"}
    import pytest
    with pytest.raises(ValueError):
        corpus_from_table(df, text_col="code")


def test_queries_stream_a_table_of_one_file_or_of_part_files(spark):
    import os
    import shutil
    from spanalign.plans.catalog import REGISTRY
    rows = [(i, "de" if i % 3 else "en", f"Text number {i}.") for i in range(95)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").withColumn("source", F.lit("s"))
    one, many = tempfile.mkdtemp(prefix="one-"), tempfile.mkdtemp(prefix="many-")
    df.coalesce(1).write.parquet(f"{one}/parts")
    part = next(f for f in os.listdir(f"{one}/parts") if f.endswith(".parquet"))
    shutil.copyfile(f"{one}/parts/{part}", f"{one}/documents.parquet")
    df.repartition(4).write.parquet(f"{many}/documents.parquet")   # ids are in no order over the files
    order = {i: sum(r[1] == g for r in rows[:i]) for i, g, _ in rows}
    for sf in (one, many):
        got = {r.doc_id: (r.part, r.seq) for r in REGISTRY["stream_flush_parts"](spark, sf).collect()}
        assert got == {i: (k // 40 + 1, k) for i, k in order.items()}
        n = {(r.grp, r.part): r.file_count for r in REGISTRY["stream_flush_parts_distributed"](spark, sf).collect()}
        assert n == {("de", 1): 40, ("de", 2): 23, ("en", 1): 32}
        assert REGISTRY["stream_limit"](spark, sf).first().n_rows == 95
        assert sorted(r.doc_id for r in REGISTRY["run_available"](spark, sf).collect()) == list(range(95))
        assert {r.grp: r.file_count for r in REGISTRY["stream_group_stats"](spark, sf).collect()} == {"de": 63, "en": 32}
