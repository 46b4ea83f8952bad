"""Trees are decided on from their listing: what is left out is never opened."""

import os

import pytest

from spanalign.sources.files import code_files, code_listing, code_output_dirs

HUGE = 3 << 30   # sparse; Spark's reader fails on a file of more than 2 GB that it opens


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")

    def file(path, content=b"x\n", size=None):
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(content)
        if size:
            os.truncate(p, size)

    file("python/a.py", b"a\r\nb\n")
    file("python/deep/b.py")
    file("misc/outside.py", size=HUGE)
    file("misc/large.go", size=HUGE)
    file("misc/small.go", b"package x\n")
    file("misc/notes.md", size=HUGE)
    file("python/header.h", size=HUGE)
    file("py_code_output/one.py")
    file("py_code_output/other.go", size=HUGE)
    file("py_code_output/large.py", size=HUGE)
    file("java_code_output/A.java", size=HUGE)
    return str(root)


def test_only_chosen_files_are_opened(spark, tree):
    rows = {r.file: (r.grp, r.text) for r in code_files(spark, f"{tree}", ["python", "go"], max_size=1 << 20).collect()}
    assert rows == {"a.py": ("python", "a\nb\n"), "b.py": ("python", "x\n"), "small.go": ("go", "package x\n")}
    listed = {os.path.basename(r.path): (r.language, r.reason) for r in code_listing(spark, tree, ["python", "go", "c"], max_size=1 << 20).collect()}
    assert listed == {"a.py": ("python", None), "b.py": ("python", None), "outside.py": ("python", "outside_language_dir"), "large.go": ("go", "oversize"),
                      "small.go": ("go", None), "header.h": ("c", "oversize"), "one.py": ("python", "outside_language_dir"),
                      "other.go": ("go", "oversize"), "large.py": ("python", "outside_language_dir")}


def test_folders_of_the_batch_runner(spark, tree):
    files, skipped = code_output_dirs(spark, tree, max_size=1 << 20)
    assert [(os.path.basename(r.doc_id), r.grp, r.dir_prefix) for r in files.collect()] == [("one.py", "python", "py")]
    assert [r.dir_prefix for r in skipped.collect()] == ["java"]


def test_a_file_that_is_read_must_fit(spark, tree):
    with pytest.raises(Exception, match="(?i)length|size|exceed"):
        code_files(spark, f"{tree}/misc", ["go"]).collect()


def test_small_files_are_read_in_few_tasks(spark, tmp_path):
    from spanalign.sources.tables import doc_partitions
    n = 32 * (doc_partitions(spark) + 4)   # the reader's own tasks hold 32 of them at most
    for k, (folder, name) in enumerate([("python", "a.py"), ("py_code_output", "b.py")]):
        os.makedirs(tmp_path / str(k) / folder)
        for i in range(n):
            (tmp_path / str(k) / folder / f"{i}{name}").write_text(f"x = {i}\n")
    files = code_files(spark, str(tmp_path / "0"), ["python"], max_size=1 << 20)
    folders, _ = code_output_dirs(spark, str(tmp_path / "1"), max_size=1 << 20)
    for df in (files, folders, code_listing(spark, str(tmp_path / "0"), ["python"])):
        assert df.rdd.getNumPartitions() <= doc_partitions(spark)
        assert df.count() == n


def test_output_folders_are_read_whatever_their_files_sizes(spark, tmp_path):
    from spanalign.plans import queries_files
    sizes = [1, 2048, 2049, 70_000]
    spark.createDataFrame([(i, "x" * sizes[i // 6]) for i in range(24)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries_files.code_output_dirs_q(spark, str(tmp_path)).collect()
    assert sorted(r.file for r in rows if r.file) == sorted(f"{i}{ext}" for i in range(24) for k, ext in ((0, ".py"), (1, ".go"), (3, ".cc")) if i % 6 == k)
    assert [r.dir_prefix for r in rows if not r.file] == ["java"]


def test_listing_is_made_by_tasks(spark, tmp_path, monkeypatch):
    from spanalign.sources import files
    for i, path in enumerate(["a.py", "python/b.py", "python/x/y/c.go", "python/x/_no/d.py", ".no/e.py", "_k=1/f.py", "g.txt", "_h.py", "empty/z.md"]):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("x" * i)
    rows = lambda df: sorted(map(tuple, df.collect()))
    by_reader = files._tree(spark, str(tmp_path), files._suffix_glob(["python", "go"])).select("path", "length")
    want = rows(by_reader)
    assert len(want) == 3   # not the empty one
    one = str(tmp_path / "python" / "b.py")
    assert rows(files._listed(spark, one, ["python"])) == rows(files._tree(spark, one).select("path", "length"))
    assert rows(files._listed(spark, str(tmp_path / "pyth*"), ["go"])) == [r for r in want if r[0].endswith(".go")]   # a pattern: Spark's reader

    def never(*a, **b):
        raise AssertionError("the driver lists no files")
    monkeypatch.setattr(files, "_tree", never)
    assert rows(files._listed(spark, str(tmp_path), ["python", "go"])) == rows(files._listed(spark, f"file://{tmp_path}/", ["python", "go"])) == want
    assert {(os.path.basename(r.path), r.reason) for r in code_listing(spark, str(tmp_path), ["python", "go"]).collect()} == {
        ("b.py", None), ("f.py", "outside_language_dir"), ("c.go", None)}
