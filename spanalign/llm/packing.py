"""Packing by optimal length buckets: dynamic programming over the global
histogram of lengths picks the bucket bounds with the least padding among the
histogram's bins, and token-budget batches form inside each bucket. Bins are
exact lengths below 64 tokens and a 64th of a doubling from there, so the
padded total is at most a 64th above that of the best bounds of all."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanalign.llm.common import bin_of, cut, word_count
from spanalign.llm.prefix import prefix_sums

#: Buckets at most, tokens in a batch (rows times the bucket's bound).
BUCKETS, BUDGET = 16, 16_384


def best_bounds(longest: list[int], count: list[int], buckets: int) -> list[int]:
    """Indexes of the bins that end a bucket, for bins in order of length.

    Bins up to j from i+1 cost longest[j] * rows - tokens; the tokens are the
    same for every choice, so the padded total alone is minimised, exactly, in
    buckets * bins vectorised steps. Fewer bounds win a tie."""
    n = len(longest)
    rows = np.concatenate([[0], np.cumsum(np.asarray(count, dtype=np.float64))])
    tall = np.asarray(longest, dtype=np.float64)
    best = np.concatenate([[0.0], np.full(n, np.inf)])
    back, ends = [], (np.inf, 0)
    for k in range(min(buckets, n)):
        new, arg = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=np.int64)
        for j in range(1, n + 1):
            cost = best[:j] + tall[j - 1] * (rows[j] - rows[:j])
            arg[j] = int(np.argmin(cost))
            new[j] = cost[arg[j]]
        back.append(arg)
        best = new
        if best[n] < ends[0]:
            ends = (best[n], k + 1)
    out, j = [], n
    for k in reversed(range(ends[1])):
        out.append(j - 1)
        j = int(back[k][j])
    return out[::-1]


def bounds(lengths: DataFrame, buckets: int = BUCKETS, steps: int = 64) -> list[int]:
    """Bucket bounds (longest length in each) for ``lengths(n_tokens)``.

    The histogram has the exact lengths below ``steps`` and ``steps`` bins to
    each doubling, each with its count and its longest length: at most 64 *
    steps rows reach the driver, whatever the input's size."""
    hist = lengths.groupBy(bin_of(F.col("n_tokens"), steps).alias("b")).agg(F.max("n_tokens").alias("top"), F.count("*").alias("n")).orderBy("b").collect()
    return [hist[i]["top"] for i in best_bounds([r["top"] for r in hist], [r["n"] for r in hist], buckets)] if hist else []


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, seed: int = 0, sub: int = 1024) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, n_tokens, bucket, padded, batch,
    slot``, a row for each row of ``docs``.

    A document's tokens are its words and one end (null or empty text: 1). It
    goes to the smallest bucket whose bound ``padded`` holds it whole; a batch
    has budget // padded rows of its bucket (a document longer than the budget
    is a batch of its own), in hash order, and only a bucket's last batch is
    short. Ranks come from blocks by hash, so a bucket with a third of all
    rows is numbered in many tasks. Rows with equal id and text take their
    slots in any order; other columns are not used; no rows give no rows."""
    narrow = cut(docs.select("doc_id", F.xxhash64(F.lit(seed), "doc_id", "text").alias("_tie"), (word_count(F.col("text")) + 1).alias("n_tokens")), "pack")
    ends = bounds(narrow, buckets)
    if not ends:
        return narrow.select("doc_id", "n_tokens", F.lit(0).alias("bucket"), F.lit(0).cast("long").alias("padded"), F.lit(0).cast("long").alias("batch"), F.lit(0).cast("long").alias("slot"))
    ends_col = F.array(*[F.lit(int(x)).cast("long") for x in ends])
    bucket = F.size(F.filter(ends_col, lambda e: e < F.col("n_tokens")))
    rows = narrow.withColumn("bucket", bucket).withColumn("_sub", F.pmod("_tie", F.lit(sub)).cast("int"))
    rows = prefix_sums(rows, ["bucket"], ["_sub"], ["_tie", "doc_id"], {"_rank": "1"})
    padded = F.element_at(ends_col, F.col("bucket") + 1)
    rows = rows.withColumn("padded", padded).withColumn("_fit", F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.col("padded"))))
    return rows.select("doc_id", "n_tokens", "bucket", "padded", F.floor(F.col("_rank") / F.col("_fit")).alias("batch"), (F.col("_rank") % F.col("_fit")).alias("slot"))
