"""Shared pieces of the operators: tables cut into the shared folder, hashes,
bins and connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanalign.session import ensure_checkpoint_dir

#: White space of the token rule: blank and the controls \x09 to \x0D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared checkpoint folder and read it back: later
    plans start from the files, which outlive any executor."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(*cols, seed: int) -> Column:
    """A number in (0, 1) that depends on the columns and the seed only."""
    h = F.xxhash64(F.lit(seed), *cols)
    return (F.shiftrightunsigned(h, 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))


def bin_of(n: Column, steps: int = 16) -> Column:
    """Monotone bins of a non-negative long: exact below ``steps``, then
    ``steps`` bins to each doubling (at most 64 * steps bins in all)."""
    octave = F.floor(F.log2(F.greatest(n, F.lit(1)).cast("double"))).cast("int")
    frac = F.floor(n.cast("double") / F.pow(F.lit(2.0), octave) * steps).cast("int") - steps
    return F.when(n < steps, n.cast("int")).otherwise(octave * steps + F.greatest(F.lit(0), F.least(frac, F.lit(steps - 1))))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(u, v)`` (longs): ``(node, label)`` with
    the smallest node of each component as label, for every node on an edge.

    Alternating large-star and small-star rounds: each replaces a node's
    edges by edges to its smallest neighbour. Only minima are aggregated, no
    neighbour list is collected, and each round is cut to the shared folder."""
    spark = edges.sparkSession
    e = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    last = None
    for _ in range(max_rounds):
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").filter("u <> v").distinct()
        e = cut(small, "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not converge")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).union(roots)
