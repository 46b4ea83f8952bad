"""Corpus tables: parquet/JSON/CSV/ORC rows -> corpus(doc_id, grp, text, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanalign.functions.text import normalize_language

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_any(spark: SparkSession, path: str, fmt: str = "parquet", schema=None, **options) -> DataFrame:
    r = spark.read.format(fmt).options(**options)
    if schema is not None:
        r = r.schema(schema)
    return r.load(path)


def corpus_from_table(df: DataFrame, id_col: str | None = "doc_id", text_col: str = "text",
                      language_col: str | None = None, fixed_language: str | None = None,
                      aliases: dict | None = None, extra: tuple = ()) -> DataFrame:
    """Map a user table onto the corpus schema.

    Either ``fixed_language`` labels every row or ``language_col`` holds a
    per-row label (normalised through ``aliases`` when given). Rows without
    an id get ``sample_<i>``, i counting the rows in the order in which the
    files are read.
    """
    if language_col is None and fixed_language is None:
        raise ValueError("give language_col or fixed_language")
    if fixed_language is not None:
        grp = F.lit(fixed_language)
    elif aliases is not None:
        grp = normalize_language(language_col, aliases)
    else:
        grp = F.col(language_col)
    if id_col is None or id_col not in df.columns:
        from spanalign.operators.batching import with_read_index
        df = with_read_index(df, name="_i")
        doc = F.concat(F.lit("sample_"), F.col("_i").cast("string"))
    else:
        doc = F.col(id_col)
    # alias only when a name changes: a self-alias makes two branches of one
    # plan canonicalise differently and defeats exchange reuse
    name = lambda c, src, dst: c if src == dst else c.alias(dst)
    cols = [name(doc, id_col, "doc_id"), grp.alias("grp"), name(F.col(text_col), text_col, "text")]
    cols += [F.col(c) for c in extra]
    return df.select(*cols)


def documents_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test corpus: documents.lang is the group, source a second key."""
    return corpus_from_table(read_table(spark, sf_dir, "documents"), "doc_id", "text",
                             language_col="lang", extra=("source",))


def doc_partitions(spark: SparkSession) -> int:
    """Partition count for the text exchange: spark.sql.shuffle.partitions
    (sized to the corpus on a cluster, e.g. text bytes / 64 MB), and never
    fewer than the cores available."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    try:
        n = max(n, spark.sparkContext.defaultParallelism)
    except Exception:  # noqa: BLE001  (no SparkContext under Connect)
        pass
    return n


#: Text bytes of a partition, about: a byte may become a row of over a hundred
#: bytes, and what a task sorts must fit in its memory.
TEXT_BYTES = 1 << 20


def text_partitions(docs: DataFrame) -> int:
    """Partition count for the exchange of these texts: one for each
    ``TEXT_BYTES`` of them, and never fewer than ``doc_partitions``. A partition
    then holds the same amount whatever the corpus, and the sorts behind the
    exchange don't spill as it grows. Reads the texts once."""
    n = doc_partitions(docs.sparkSession)
    if docs.isStreaming or "text" not in docs.columns:
        return n
    size = docs.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    return max(n, -(-size // TEXT_BYTES))


TEXT_EXCHANGE_CONF = "spanalign.textExchange"


def by_doc(df: DataFrame, n: int | None = None) -> DataFrame:
    """Hash-partition by doc_id once. Every later per-document window, union
    and doc-level aggregate reuses this partitioning (no further exchange).

    The count is explicit on purpose: raw text is small in bytes but each
    byte fans out into many piece rows downstream, and AQE would otherwise
    coalesce this exchange by its byte size into a handful of tasks. It follows
    the size of the texts (``text_partitions``)."""
    return df.repartition(n or text_partitions(df), "doc_id")


def spread(df: DataFrame) -> DataFrame:
    """For map-only plans. A corpus of many files or row groups is read in
    parallel as it is, so such plans stay shuffle-free; a session that reads a
    table of one row group can set ``spanalign.textExchange=on`` (as
    ``local_session`` does) to deal the texts over the cores by doc_id."""
    if df.sparkSession.conf.get(TEXT_EXCHANGE_CONF, "off").lower() != "on":
        return df
    return by_doc(df)

