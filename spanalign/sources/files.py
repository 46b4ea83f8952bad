"""Code-file trees as a corpus (SRC-1..5).

A tree is listed first, without opening a file: suffixes, the layout rule and
sizes decide on paths and lengths alone. Only the chosen files are then read:
the decision is a filter on the files' metadata, which Spark applies to its
listing before it makes partitions. What passes through the driver is two rows
per language."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanalign.functions.patterns import BATCH_LANGUAGES, LANGUAGE_ALIASES, LANGUAGE_EXTENSIONS
from spanalign.functions.text import map_lookup, stripped
from spanalign.sources.tables import doc_partitions


def extension_map(languages=None) -> dict:
    langs = languages or list(LANGUAGE_EXTENSIONS)
    return {ext: lang for lang in langs for ext in LANGUAGE_EXTENSIONS[lang]}


def language_from_path(path, languages=None):
    """SRC-3: case-sensitive file suffix -> language (null when unknown)."""
    p = F.col(path) if isinstance(path, str) else path
    return map_lookup(extension_map(languages), F.regexp_extract(p, r"(\.[^./]+)$", 1))


@F.pandas_udf(T.StringType())
def _decode_ignore(content: pd.Series) -> pd.Series:
    return content.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"))


def read_text(content) -> "F.Column":
    """SRC-5: lossy UTF-8 decode (invalid bytes dropped) and newline
    normalisation (CRLF and lone CR become LF), as text-mode reading does."""
    c = F.col(content) if isinstance(content, str) else content
    return F.regexp_replace(_decode_ignore(c), r"\r\n?", "\n")


def _plain_path(path):
    return F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")


def _tree(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (r.option("pathGlobFilter", glob) if glob else r).load(root)


#: Entries of a folder that leave Python at once.
ENTRIES = 1 << 14


def _hidden(name: str) -> bool:
    """What Spark's readers leave out of a folder."""
    kept = name.startswith(("_metadata", "_common_metadata"))
    return not kept and (name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_"))


def _store_path(spark: SparkSession, root: str) -> tuple[str, str, str] | None:
    """A folder's or file's full name, its URI and its path in the store that
    tasks can open; None if only Spark's readers can, or if it is a pattern."""
    from pyarrow import ArrowException, fs
    try:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        name = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
        if any(c in name for c in "*?[]{}%# \\"):
            return None
        uri = "file://" + name[5:] if name.startswith("file:/") and not name.startswith("file://") else name
        store, base = fs.FileSystem.from_uri(uri)
        return None if store.get_file_info(base).type == fs.FileType.NotFound else (name, uri, base)
    except (ArrowException, OSError, NotImplementedError):
        return None


def _listed(spark: SparkSession, root: str, languages=None) -> DataFrame:
    """``path, length`` of the tree's files with a suffix of the languages,
    listed by tasks, folder by folder and level by level: the driver sees how many
    folders there are and no file. Where only Spark's readers reach the tree they list it."""
    from spanalign.session import written
    found = _store_path(spark, root)
    if found is None:
        return _tree(spark, root, _suffix_glob(languages)).select("path", "length")
    name, uri, base = found
    suffixes = tuple(extension_map(languages))

    def entries(batches):
        import pyarrow as pa
        from pyarrow import fs
        store, _ = fs.FileSystem.from_uri(uri)
        for b in batches:
            for folder in b.column("at").to_pylist():
                one = store.get_file_info(folder)
                inside = [one] if one.is_file else [f for f in store.get_file_info(fs.FileSelector(folder)) if not _hidden(f.base_name)]
                inside = [f for f in inside if f.type == fs.FileType.Directory or (f.is_file and f.size and f.base_name.endswith(suffixes))]   # nor do the readers show empty files
                for k in range(0, len(inside), ENTRIES):
                    part = inside[k:k + ENTRIES]
                    yield pa.RecordBatch.from_arrays([pa.array([f.path for f in part], pa.string()), pa.array([f.size if f.is_file else None for f in part], pa.int64())], ["at", "length"])

    folders, files = spark.createDataFrame([(base,)], "at string"), None
    while True:
        level = written(folders.mapInArrow(entries, "at string, length long"), "listing")
        own = level.filter("length IS NOT NULL")
        files = own if files is None else files.unionByName(own)
        n = level.filter("length IS NULL").count()
        if not n:
            return files.select(F.concat(F.lit(name), F.substring("at", F.lit(len(base) + 1), F.char_length("at"))).alias("path"), "length")
        folders = level.filter("length IS NULL").select("at").repartition(min(n, 4 * doc_partitions(spark)))


def _suffix_glob(languages=None) -> str:
    return "*.{" + ",".join(sorted(e.lstrip(".") for e in extension_map(languages))) + "}"


def _in_language_dir(root: str, path, language):
    """The reader reports paths as URIs; both are compared without scheme and
    authority, from the start."""
    base = _plain_path(F.lit(root.rstrip("/") + "/"))
    return _plain_path(path).startswith(F.concat(base, language, F.lit("/")))


def code_listing(spark: SparkSession, root: str, languages=None, prefer_language_dirs: bool = True,
                 max_size: int | None = None) -> DataFrame:
    """SRC-1 + SRC-2 on metadata alone: ``path, length, language, reason`` of
    the files with a suffix of the asked languages; ``reason`` is null for
    those that ``code_files`` reads, else ``outside_language_dir`` or
    ``oversize``. No file is opened, and tasks list the folders."""
    x = _packed(_listed(spark, root, languages).select("path", "length", language_from_path("path", languages).alias("language")))
    x = x.filter(F.col("language").isNotNull())
    outside = F.lit(False)
    if prefer_language_dirs:
        own = _listed_sizes(x, root, None)[0]
        outside = F.col("language").isin(own) & ~_in_language_dir(root, F.col("path"), F.col("language"))
    reason = F.when(outside, "outside_language_dir")
    if max_size is not None:
        reason = reason.when(F.col("length") > max_size, "oversize")
    return x.withColumn("reason", reason)


#: Bytes and files that a task reads, about.
TASK_BYTES, TASK_FILES = 32 << 20, 4096


def _packed(files: DataFrame, n: int = 0, size: int = 0) -> DataFrame:
    """Files in tasks of about ``TASK_FILES`` or ``TASK_BYTES``, without a
    shuffle. The reader counts a file as ``spark.sql.files.openCostInBytes`` (4
    MB) more than it has, so each of its tasks holds some thirty small files
    and most of the time goes into starting them."""
    return files.coalesce(max(doc_partitions(files.sparkSession), -(-n // TASK_FILES) + -(-size // TASK_BYTES)))


def _sizes(listing: DataFrame, chosen, *by) -> list:
    """``by``, number and bytes of the listed files that ``chosen`` accepts."""
    n, size = F.count_if(chosen), F.coalesce(F.sum(F.when(chosen, F.col("length"))), F.lit(0))
    return _packed(listing).groupBy(*by).agg(n.alias("n"), size.alias("size")).collect()


def _listed_sizes(listing: DataFrame, root: str, max_size: int | None, prefer_language_dirs: bool = True) -> tuple[list[str], int, int]:
    """Languages whose own folder has files, and the number and bytes of the
    files that are then read: at most two rows per language."""
    inside = _in_language_dir(root, F.col("path"), F.col("language")) if prefer_language_dirs else F.lit(False)
    rows = _sizes(listing.filter(F.col("language").isNotNull()), _small(max_size), "language", inside.alias("inside"))
    own = sorted({r["language"] for r in rows if r["inside"]})
    read = [r for r in rows if r["inside"] or r["language"] not in own]
    return own, sum(r["n"] for r in read), sum(r["size"] for r in read)


def _small(max_size: int | None):
    return F.lit(True) if max_size is None else F.col("length") <= max_size


def _read_chosen(files: DataFrame, chosen, max_size: int | None) -> DataFrame:
    """Contents of the files that ``chosen`` (of a path) accepts: the filter on
    the hidden metadata column prunes the listing, the one on length is pushed
    to the reader, so other files are never opened."""
    files = files.filter(chosen(F.col("_metadata.file_path")))
    if max_size is not None:
        files = files.filter((F.col("_metadata.file_size") <= max_size) & (F.col("length") <= max_size))
    return files


def code_files(spark: SparkSession, root: str, languages=None, prefer_language_dirs: bool = True,
               max_size: int | None = None) -> DataFrame:
    """SRC-1 + SRC-2: files of the asked languages under ``root``, of at most
    ``max_size`` bytes if it is given.

    For each language the files under ``<root>/<language>/`` are used when
    that folder yields any; otherwise the whole tree is searched. A single
    file path is accepted when its suffix matches. ``code_listing`` tells which
    files are left out and why."""
    raw = _tree(spark, root, _suffix_glob(languages))
    own, n, size = _listed_sizes(raw.select("path", "length", language_from_path("path", languages).alias("language")), root, max_size, prefer_language_dirs)

    def chosen(path):
        language = language_from_path(path, languages)
        return language.isNotNull() & (~language.isin(own) | _in_language_dir(root, path, language))

    x = _packed(_read_chosen(raw, chosen, max_size), n, size)
    return x.select(F.col("path").alias("doc_id"), language_from_path("path", languages).alias("grp"),
                    read_text("content").alias("text"), F.col("length").alias("n_file_bytes"),
                    F.element_at(F.split("path", "/"), -1).alias("file"))


def normalize_batch_language(c):
    """Alias map restricted to the languages the folder runner accepts."""
    al = {k: v for k, v in LANGUAGE_ALIASES.items() if v in BATCH_LANGUAGES}
    return map_lookup(al, F.lower(stripped(c)))


def code_output_dirs(spark: SparkSession, base: str, max_size: int | None = None):
    """SRC-4: files under ``<base>/<lang>_code_output/`` folders; the language
    comes from the folder prefix through the alias map (nine languages), and
    only files with a suffix of that language, of at most ``max_size`` bytes if
    it is given, are taken; others are not opened.
    Returns (files, skipped_dirs)."""
    folders = base.rstrip("/") + "/*_code_output"
    prefix = lambda path: F.regexp_extract(path, r"/([^/]+)_code_output/", 1)

    def chosen(path):
        return language_from_path(path) == normalize_batch_language(prefix(path))

    raw = _tree(spark, folders, _suffix_glob(BATCH_LANGUAGES))
    [sizes] = _sizes(raw.select("path", "length"), chosen(F.col("path")) & _small(max_size))
    x = _packed(_read_chosen(raw, chosen, max_size), sizes["n"], sizes["size"])
    files = x.select(F.col("path").alias("doc_id"), normalize_batch_language(prefix(F.col("path"))).alias("grp"),
                     read_text("content").alias("text"), prefix(F.col("path")).alias("dir_prefix"))
    listed = _packed(_tree(spark, folders)).select(prefix(F.col("path")).alias("dir_prefix"))
    skipped = listed.filter(normalize_batch_language(F.col("dir_prefix")).isNull()).distinct()
    return files, skipped
