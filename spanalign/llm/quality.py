"""Quality classifier by importance resampling.

Hashed n-gram models of target text (documents labelled clean) and of raw
text (all documents) give each document a log importance weight; Gumbel noise
turns the weights into a sample without replacement: the k documents of the
largest weight plus noise."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from spanalign.llm.common import cut, uniform
from spanalign.llm.textops import SPACE, mixed, raw, slices, span_hashes

#: Orders of the n-grams and hash buckets of their models. On the test corpus with pairs too, 2.7 times the
#: grams share the buckets.
ORDERS, BUCKETS = (1,), 1 << 20
#: Labelled documents that the models read, about, at most (their ids are sent to the tasks).
TARGET_DOCS = 200_000
#: Added to every count; the standard errors by which the clean share of a bucket's labelled documents must differ from
#: that of all labelled documents for its log ratio to count; and the |log ratio| that counts whatever the labels say, as
#: where none of many documents is labelled. What neither supports weighs 0.
SMOOTH, CLEAR, FAR = 2.0, 3.0, 2.5
#: Scale of the Gumbel noise: weights are raised to 1 / TEMPERATURE.
TEMPERATURE = 0.1
#: Width of the bins of labelled weights from which the least kept weight is chosen, and their largest number on either side of 0.
STEP, BINS = 0.05, 1 << 16

LETTER = np.zeros(256, dtype=bool)
for _a, _b in ((48, 57), (65, 90), (97, 122), (128, 255)):
    LETTER[_a : _b + 1] = True


def grams(texts: pa.Array, orders: tuple[int, ...] = ORDERS, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of each distinct n-gram of each text.

    Tokens are runs of letters and digits (all bytes from 128 count as such)
    and runs of other non-blank bytes. Two more grams of a text with tokens
    tell how repetitive it is: the share of tokens equal to the one before, in
    octaves, and the share of distinct tokens, in eighths."""
    data, offsets = raw(texts)
    n = len(offsets) - 1
    kind = np.zeros(len(data) + 2, dtype=np.int8)
    kind[1:-1] = np.where(SPACE[data], 0, np.where(LETTER[data], 1, 2))
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets] = True
    here = kind[1:-1]
    starts = np.flatnonzero((here > 0) & ((here != kind[:-2]) | first[:-1]))
    ends = np.flatnonzero((here > 0) & ((here != kind[2:]) | first[1:])) + 1
    of = np.searchsorted(offsets, starts, side="right") - 1
    token = span_hashes(data, starts, ends)
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    keys, h = [], token
    for order in range(1, max(orders) + 1):
        if order > 1:
            h = mixed(h[:-1] * np.uint64(order * 2 + 1) + token[order - 1 :])
        if order in orders:
            k = of[: len(h)]
            whole = k == of[order - 1 :]
            keys.append(k[whole] * buckets + (h[whole] >> shift).astype(np.int64))
    count = np.bincount(of, minlength=n)
    if count.any():
        again = np.bincount(of[1:][(of[1:] == of[:-1]) & (token[1:] == token[:-1])], minlength=n)
        kinds = np.bincount(np.unique(of * buckets + (token >> shift).astype(np.int64)) // buckets, minlength=n)
        some = np.flatnonzero(count)
        for name, share in ((1, np.floor(np.log2(1 + 256 * again[some] / count[some]))), (2, np.floor(8 * kinds[some] / count[some]))):
            h = mixed(mixed(np.full(len(some), name, dtype=np.uint64)) + share.astype(np.uint64))
            keys.append(some * buckets + (h >> shift).astype(np.int64))
    key = np.unique(np.concatenate(keys)) if keys else np.zeros(0, dtype=np.int64)
    return key // buckets, key % buckets


def counts(docs: DataFrame, labelled: np.ndarray, clean: np.ndarray, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, t, l, r``: target documents, labelled documents and all
    documents that hold a gram of the bucket; bucket -1 has all of them.
    ``labelled`` has the sorted id hashes of the labelled documents, ``clean``
    whether each is a target document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, m, r = (np.zeros(buckets + 1, dtype=np.int64) for _ in range(3))
        for b in slices(batches):
            doc, bucket = grams(b.column("text"), buckets=buckets)
            doc, bucket = np.append(doc, np.arange(b.num_rows)), np.append(bucket, np.full(b.num_rows, buckets))
            ids = b.column("_id").to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(labelled, ids), max(len(labelled) - 1, 0))
            known = labelled[at] == ids if len(labelled) else np.zeros(len(ids), dtype=bool)
            chosen = known & clean[at] if len(labelled) else known
            r += np.bincount(bucket, minlength=buckets + 1)
            m += np.bincount(bucket[known[doc]], minlength=buckets + 1)
            t += np.bincount(bucket[chosen[doc]], minlength=buckets + 1)
        some = np.flatnonzero(r)
        for at in range(0, len(some), 1 << 16):
            k = some[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(np.where(k < buckets, k, -1).astype(np.int32)), pa.array(t[k]), pa.array(m[k]), pa.array(r[k])], ["bucket", "t", "l", "r"])

    part = docs.select(F.xxhash64("doc_id").alias("_id"), "text").mapInArrow(run, "bucket int, t long, l long, r long")
    return part.groupBy("bucket").agg(F.sum("t").alias("t"), F.sum("l").alias("l"), F.sum("r").alias("r"))


def fit(docs: DataFrame, labels: DataFrame, target_docs: int = TARGET_DOCS) -> np.ndarray:
    """Log ratio of the target to the raw model for each bucket.

    The raw counts are brought to the target's scale by the median ratio of
    the buckets that at least 200 documents share (else by the totals), so
    that what both hold alike weighs 0 however long the text. A ratio counts if
    t of l labelled documents is CLEAR standard errors to its side of the
    clean share of all labelled ones, on the arcsine scale, where an error is
    as wide at every l and share, or if it reaches FAR. At most BUCKETS ratios come to the driver."""
    clean = labels.groupBy("doc_id").agg(((F.min("quality") == 1) & (F.max("toxic") == 0)).alias("clean"))
    share = target_docs / max(1, labels.count())
    ids = clean.filter(uniform("doc_id", seed=1) < share).select(F.xxhash64("doc_id").alias("h"), F.coalesce("clean", F.lit(False)).alias("clean")).toPandas().sort_values("h")
    every = cut(counts(docs, ids["h"].to_numpy(dtype=np.int64), ids["clean"].to_numpy(dtype=bool)), "grams")
    table = every.filter("bucket >= 0")
    scale = table.agg(F.percentile(F.when(F.col("r") >= 200, F.col("t") / F.col("r")), F.lit(0.5)), F.sum("t") / F.sum("r")).first()
    by = next((x for x in scale if x is not None), 0.0)
    known = every.filter("bucket < 0 and l > 0").select(F.col("t") / F.col("l")).first()
    ratio = F.log((F.col("t") + F.lit(SMOOTH)) / (F.col("r") * F.lit(float(by)) + F.lit(SMOOTH)))
    arc = F.asin(F.sqrt((F.col("t") + F.lit(0.375)) / (F.col("l") + F.lit(0.75)))) - F.lit(float(np.arcsin(np.sqrt(known[0] if known else 0.5))))
    errors = 2 * F.sqrt(F.col("l") + F.lit(0.5)) * arc
    clear = table.select("bucket", ratio.alias("w"), errors.alias("z")).filter(((F.abs("z") >= CLEAR) & (F.col("w") * F.col("z") > 0)) | (F.abs("w") >= FAR)).toPandas()
    weights = np.zeros(BUCKETS)
    weights[clear["bucket"].to_numpy(dtype=np.int64)] = clear["w"].to_numpy(dtype=np.float64)
    return weights


def weigh(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``doc_id, _tie, n_grams, weight`` for each row of ``docs``."""
    some = np.flatnonzero(weights)
    value = weights[some]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros(BUCKETS)
        w[some] = value
        for b in slices(batches):
            doc, bucket = grams(b.column("text"))
            total = np.bincount(doc, weights=w[bucket], minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("_tie"), pa.array(np.bincount(doc, minlength=b.num_rows)), pa.array(total)], ["doc_id", "_tie", "n_grams", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text", "doc_id").alias("_tie"), "text").mapInArrow(run, f"doc_id {kind}, _tie long, n_grams long, weight double")


def least_weight(weighed: DataFrame, labels: DataFrame) -> float:
    """The weight from which on a document counts as clean: the bound with the
    fewest labelled documents on its wrong side, the lowest of equals; below
    all weights if either kind has no label. Reads all labels, in bins."""
    kinds = labels.groupBy("doc_id").agg(((F.min("quality") == 1) & (F.max("toxic") == 0)).alias("clean"))
    both = weighed.join(kinds, "doc_id").select(F.least(F.greatest(F.floor((F.col("weight") + 50.0) / STEP), F.lit(-BINS)), F.lit(BINS)).alias("b"), "clean")
    bins = both.groupBy("b").agg(F.count_if("clean").alias("good"), F.count_if(~F.col("clean")).alias("bad")).orderBy("b").collect()
    good, bad = np.array([r["good"] for r in bins], dtype=np.int64), np.array([r["bad"] for r in bins], dtype=np.int64)
    if not good.sum() or not bad.sum():
        return -np.inf
    wrong = np.concatenate([[0], np.cumsum(good)]) + bad.sum() - np.concatenate([[0], np.cumsum(bad)])
    at = int(np.argmin(wrong))
    return -50.0 + STEP * bins[at]["b"] if at < len(bins) else np.inf


def top(keyed: DataFrame, k: int, bins: int = 4096) -> DataFrame:
    """The ``k`` rows of the largest ``_key`` (ties by ``_tie``, ``doc_id``):
    the range that holds the k-th is narrowed by histograms, and only the rows
    of a last bin narrower than the numbers' spacing or of at most 100,000
    rows are ranked."""
    low, high = keyed.agg(F.min("_key"), F.max("_key")).first()
    if low is None or k <= 0:
        return keyed.limit(0)
    above, open_ = 0, None
    while True:
        width = (high - low) / bins
        inside = keyed.filter(F.col("_key").between(low, high))
        if not width or low + width == low:
            break
        place = F.least(F.floor((F.col("_key") - F.lit(low)) / F.lit(width)), F.lit(bins - 1))
        held = {r["b"]: r for r in inside.groupBy(place.alias("b")).agg(F.count("*").alias("n"), F.min("_key").alias("a"), F.max("_key").alias("z")).collect()}
        for b in sorted(held, reverse=True):
            if above + held[b]["n"] >= k:
                break
            above += held[b]["n"]
        else:
            return keyed
        low, high, open_ = held[b]["a"], held[b]["z"], held[b]["n"]
        if open_ <= 100_000 or low == high:
            break
    edge = keyed.filter(F.col("_key").between(low, high)).orderBy(F.desc("_key"), "_tie", "doc_id").limit(k - above)
    return keyed.filter(F.col("_key") > high).union(edge)


def sample(docs: DataFrame, labels: DataFrame, seed: int = 0, temperature: float = TEMPERATURE) -> tuple[DataFrame, DataFrame]:
    """(all, kept): ``doc_id, _tie, n_grams, weight, _key`` for every row, and
    for those that the Gumbel top-k draws.

    k is the number of documents whose weight reaches ``least_weight``. A null
    or empty text has no grams and weight 0; a text of any length is read
    whole; rows with equal id and text share weight and noise; labels of
    unknown documents are not used; without labels, or with one kind only, all
    rows are kept; no rows give no rows; other columns are not used, whatever
    their names."""
    weighed = cut(weigh(docs, fit(docs, labels)), "weights")
    bound = least_weight(weighed, labels)
    gumbel = -F.log(-F.log(uniform("_tie", seed=seed)))
    keyed = weighed.withColumn("_key", F.col("weight") + F.lit(float(temperature)) * gumbel)
    k = weighed.filter(F.col("weight") >= F.lit(float(bound))).count()
    return keyed, top(keyed, k)


def fit_and_keep(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that the sample keeps, with all their columns."""
    kept = sample(docs, labels, **how)[1].groupBy("_tie", F.col("doc_id").alias("_id")).agg(F.count("*").alias("_copies"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.xxhash64("text", "doc_id").alias("_t"), F.col("doc_id").alias("_i"))
    rows = rows.join(kept, (F.col("_t") == F.col("_tie")) & F.col("_i").eqNullSafe(F.col("_id"))).withColumn("_n", F.row_number().over(W.partitionBy("_t", "_i").orderBy(F.lit(1))))
    return rows.filter("_n <= _copies").select("_row.*")
