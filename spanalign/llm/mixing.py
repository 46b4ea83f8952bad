"""Mixing sources to target weights by systematic sampling, in SQL functions.

Each document's expected copies (its source's target over its source's size)
are prefix-summed within the source, one random offset is added, and a copy
is emitted at each integer boundary that the sum crosses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from spanalign.llm.common import bin_of, cut, uniform, word_count
from spanalign.llm.prefix import prefix_sums

#: Weights of the sources by code point, null last, repeating.
WEIGHTS = (3, 1, 2)
#: The mix takes SHARE[0] / SHARE[1] of all words.
SHARE = (3, 2)
#: No source is taken more than MAX_REPEAT times.
MAX_REPEAT = 2


def targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """``sizes(_null, _source, source_size)``, a row a source -> plus ``target``.

    Sources share the total by weight; one that would pass ``max_repeat``
    times its size stops there and the rest share the excess by weight, until
    none is above. That is: in the order of size / weight, the shortest
    prefix of stopped sources after which the next one stays below its bound."""
    n = len(weights)
    rank = F.row_number().over(W.orderBy("_null", "_source")) - 1
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.col("_rank") % n + 1).cast("int")).cast("long")
    s = sizes.withColumn("_rank", rank).withColumn("_w", w)
    place = F.struct((F.col("source_size") / F.col("_w")).alias("ratio"), F.col("_rank").alias("rank"))
    s = s.withColumn("_place", place)
    every, before = W.partitionBy(), W.orderBy("_place").rowsBetween(W.unboundedPreceding, -1)
    total, stopped = F.sum("source_size").over(every), F.coalesce(F.sum("source_size").over(before), F.lit(0))
    left = F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0))
    # what a unit of weight gets if all before this source have stopped: _num / _den
    s = s.withColumn("_num", (F.lit(share[0]) * total - F.lit(share[1] * max_repeat) * stopped).cast("long")).withColumn("_den", F.lit(share[1]) * left)
    stops = F.col("_w") * F.col("_num") >= F.lit(max_repeat) * F.col("source_size") * F.col("_den")
    s = s.withColumn("_first", F.min(F.when(~stops, F.struct("_place", "_num", "_den"))).over(every))
    free = F.col("_first").isNotNull() & (F.col("_place") >= F.col("_first._place"))
    shared = (F.col("_w") * F.col("_first._num")).cast("double") / F.col("_first._den").cast("double")
    return s.select("_null", "_source", "source_size", F.when(free, shared).otherwise((F.lit(max_repeat) * F.col("source_size")).cast("double")).alias("target"))


def copies(docs: DataFrame, seed: int = 0, sub: int = 256) -> DataFrame:
    """``docs(doc_id, text, source, ...)`` -> ``doc_id, _tie, size,
    source_size, target, copies``, a row for each row of ``docs``.

    Within its source a document's place is by size bin, then by hash: a
    systematic sample over sizes in order keeps the words taken near the
    target. The places come from blocks (size bin, hash modulo ``sub``), so a
    source with a third of all rows is numbered in many tasks."""
    narrow = cut(docs.select("doc_id", F.xxhash64("text", "doc_id").alias("_tie"), F.col("source").isNull().alias("_null"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_source"), word_count(F.col("text")).alias("size")), "mix")
    goal = targets(narrow.groupBy("_null", "_source").agg(F.sum("size").alias("source_size")))
    keyed = narrow.withColumn("_bin", bin_of(F.col("size"))).withColumn("_sub", F.pmod("_tie", F.lit(sub)).cast("int"))
    placed = prefix_sums(keyed, ["_null", "_source"], ["_bin", "_sub"], ["size", "_tie", "doc_id"], {"_before": "1"})
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    u = uniform("_null", "_source", seed=seed)
    out = placed.join(goal, ["_null", "_source"]).withColumn("_each", each)
    crossed = F.floor(F.col("_each") * (F.col("_before") + 1) + u) - F.floor(F.col("_each") * F.col("_before") + u)
    return out.select("doc_id", "_tie", "size", "source_size", "target", F.least(crossed, F.ceil("_each")).cast("long").alias("copies"))


def mix(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The mixed documents: each row of ``docs`` as often as it was drawn,
    with the columns of ``docs``. Needs doc_id, text and source.

    Null text has size 0, null source is a source of its own (last in code
    point order); equal rows are drawn apart; an empty table gives no rows; a
    source without words takes none. Extra columns are kept as they are."""
    drawn = copies(docs, seed).select(F.col("doc_id").alias("_id"), F.col("_tie"), "copies")
    # rows that share id and text are told apart by nothing: their copies are pooled and dealt out in order
    drawn = drawn.groupBy("_id", "_tie").agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows"))
    names = docs.columns
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col("doc_id").alias("_i"), F.xxhash64("text", "doc_id").alias("_t"))
    rows = kept.join(drawn.filter("_copies > 0"), (F.col("_t") == F.col("_tie")) & F.col("_i").eqNullSafe(F.col("_id")))
    rows = rows.withColumn("_k", F.row_number().over(W.partitionBy("_t", "_i").orderBy(F.lit(1))))
    share = lambda k: F.floor(k * F.col("_copies") / F.col("_rows"))
    rows = rows.withColumn("_n", (share(F.col("_k")) - share(F.col("_k") - 1)).cast("long")).filter("_n > 0")
    return rows.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).select("_row.*")
