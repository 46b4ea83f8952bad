"""Sharding by sampled splitters, in SQL functions: a size-weighted sample of
the keys gives quantile boundaries of many small ranges, overfull ranges are
subdivided, and contiguous runs of ranges of near equal bytes are the shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from spanalign.llm.common import cut, uniform


def size_of(text: Column) -> Column:
    """UTF-8 bytes (null: none) plus 1."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def splitters(keyed: DataFrame, total: int, ranges: int, sample: int, seed: int) -> list[int]:
    """Boundaries of ``ranges`` ranges of ``_key`` from a size-weighted sample.

    A row is drawn with probability sample * size / all sizes (``total``), so
    about ``sample`` keys (8 bytes each) reach the driver, whatever the input's
    size."""
    drawn = keyed.filter(uniform("_key", "_tie", seed=seed) * F.lit(float(total)) < F.col("size") * F.lit(float(sample)))
    keys = sorted(drawn.select("_key").toPandas()["_key"].tolist())
    return sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []


def range_of(key: Column, splits: list[int]) -> Column:
    """How many splitters are <= key, by binary search in a constant array."""
    if not splits:
        return F.lit(0)
    steps = [1 << k for k in reversed(range(len(splits).bit_length()))]
    table = F.expr("cast(split('" + ",".join(map(str, splits)) + "', ',') as array<bigint>)")
    n = len(splits)
    at = lambda i: F.get(table, i)
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda acc, s: F.when((acc + s <= n) & (at(acc + s - 1) <= key), acc + s).otherwise(acc))


def place(docs: DataFrame, shards: int = 16, per_shard: int = 256, sample: int = 1 << 16, overfull: float = 8.0, seed: int = 0) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, _tie, size, text_crc32, shard, slot``.

    The key is a hash of the text, so equal texts are neighbours in key order.
    A key that alone has more than ``overfull`` times a range's mean bytes (a
    text with very many copies; by default a 32nd of a shard) is cut into
    slices of the mean by a hash of the row; all other equal texts share a
    shard. What is left of an overfull range is cut into slices by key. A
    shard's bytes are off by half a slice at either end at most. Slots are
    numbered within each slice and shifted by the rows of the slices before it,
    so no shard is sorted in one task."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = cut(docs.select("doc_id", F.xxhash64("text", "doc_id").alias("_tie"), size_of(F.col("text")).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("_key")), "shard")
    ranges = shards * per_shard
    total = narrow.agg(F.sum("size")).first()[0] or 0
    most = F.lit(overfull * total / ranges)
    pieces = lambda c: F.when(F.col(c) > most, F.ceil(F.col(c) * ranges / F.lit(max(1, total)))).otherwise(F.lit(1)).cast("int")
    ranged = narrow.withColumn("_range", range_of(F.col("_key"), splitters(narrow, total, ranges, sample, seed)))
    full = cut(ranged.groupBy("_range").agg(F.sum("size").alias("_bytes")), "ranges")  # a row a range
    over = full.filter(F.col("_bytes") > most).select("_range")
    # keys that alone overfill a range: at most ranges / overfull of them, whatever the input's size
    hot = ranged.join(F.broadcast(over), "_range", "left_semi").groupBy("_range", "_key").agg(F.sum("size").alias("_bytes")).filter(F.col("_bytes") > most)
    hot = cut(hot.withColumn("_parts", pieces("_bytes")), "hot")
    rest = full.join(hot.groupBy("_range").agg(F.sum("_bytes").alias("_hot")), "_range", "left").withColumn("_bytes", F.col("_bytes") - F.coalesce("_hot", F.lit(0)))
    rest = rest.select(F.col("_range").alias("_r"), pieces("_bytes").alias("_left"))
    before = W.partitionBy("_range").orderBy("_key").rowsBetween(W.unboundedPreceding, -1)
    hot = hot.select(F.col("_key").alias("_k"), "_parts", F.coalesce(F.sum("_parts").over(before), F.lit(0)).alias("_at"))
    # at most two slices a range and hot key on average: a bounded number of rows in all, whatever the input's size
    sliced = ranged.join(F.broadcast(rest), F.col("_range") == F.col("_r")).join(F.broadcast(hot), F.col("_key") == F.col("_k"), "left")
    by_key, by_row = F.pmod(F.xxhash64(F.lit(seed), "_key"), F.col("_left")), F.col("_left") + F.col("_at") + F.pmod(F.xxhash64(F.lit(seed), "_tie"), F.col("_parts"))
    sliced = sliced.withColumn("_slice", F.coalesce(by_row, by_key).cast("int"))
    held = sliced.groupBy("_range", "_slice").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows"))
    order = W.orderBy("_range", "_slice")
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    middle = F.sum("_bytes").over(upto) - F.col("_bytes") / 2
    held = held.select("_range", "_slice", "_rows", F.least(F.floor(middle * shards / F.sum("_bytes").over(W.partitionBy())), F.lit(shards - 1)).cast("int").alias("shard"))
    held = held.select(F.col("_range").alias("_r2"), F.col("_slice").alias("_s2"), "shard", (F.sum("_rows").over(W.partitionBy("shard").orderBy("_range", "_slice")) - F.col("_rows")).alias("_first"))
    within = F.row_number().over(W.partitionBy("_range", "_slice").orderBy("_key", "_tie", "doc_id")) - 1
    rows = sliced.withColumn("_n", within).join(F.broadcast(held), (F.col("_range") == F.col("_r2")) & (F.col("_slice") == F.col("_s2")))
    return rows.select("doc_id", "_tie", "size", "text_crc32", "shard", (F.col("_first") + F.col("_n")).cast("long").alias("slot"))


def shard(docs: DataFrame, shards: int = 16, **how) -> DataFrame:
    """``docs`` with columns ``shard`` and ``slot``: 0 to ``shards - 1`` of near
    equal UTF-8 bytes (a null text counts as none; each row counts 1 more),
    slots gapless from 0 in each shard.

    Rows with equal id and text take their slots in any order; a null id is an
    id like any other; an empty table gives no rows; columns of ``docs`` named
    shard or slot are replaced."""
    names = [c for c in docs.columns if c not in ("shard", "slot")]
    placed = place(docs, shards, **how)
    again = W.partitionBy("_tie", "_id").orderBy("shard", "slot")
    placed = placed.select(F.col("_tie"), F.col("doc_id").alias("_id"), "shard", "slot").withColumn("_copy", F.row_number().over(again))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.xxhash64("text", "doc_id").alias("_t"), F.col("doc_id").alias("_i"))
    rows = rows.withColumn("_k", F.row_number().over(W.partitionBy("_t", "_i").orderBy(F.lit(1))))
    out = rows.join(placed, (F.col("_t") == F.col("_tie")) & (F.col("_k") == F.col("_copy")) & F.col("_i").eqNullSafe(F.col("_id")))
    return out.select("_row.*", "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = 16, **how) -> None:
    """Write each shard to ``path/shard=k``, its rows in slot order within
    files; a shard is dealt to several writers by slot range."""
    (shard(docs, shards, **how).repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot")
     .write.mode("errorifexists").partitionBy("shard").parquet(path))
