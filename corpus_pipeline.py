"""The corpus pipeline: five stages, each applying one operator of
``spanalign.llm`` to all that the stage before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet into the shared folder and read again as the next stage's docs.
All but the last return the columns of ``documents``.

In every stage a null text counts as empty and stays null, an empty table
gives no rows, equal rows are rows of their own (near_duplicates keeps one of
each group), ties are broken by hashes of the row, texts of any length are
read whole, and more columns, whatever their names, are carried along (packing
returns its own columns only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanalign.llm.common import cut, table
from spanalign.llm.mixing import mix
from spanalign.llm.packing import pack
from spanalign.llm.pii import redact
from spanalign.llm.quality import fit_and_keep
from spanalign.llm.simhash import deduplicated


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling keeps; without labels, or with
    one kind of them only, all."""
    return fit_and_keep(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id
    (null last). Null and empty texts are near each other."""
    return deduplicated(docs, shingle=3, max_bits=2)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with each found span replaced by its kind; n_chars follows (0 for
    a null text)."""
    return redact(docs).withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix draws them; those without words, and null
    sources by their own weight, as in ``mixing.mix``."""
    return mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's bucket, batch and slot; a document without words has one
    token, its end."""
    return pack(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("source_mix", source_mix), ("packing", packed)]

#: The stages hash, sample and infer in ways that SQL can't express; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
