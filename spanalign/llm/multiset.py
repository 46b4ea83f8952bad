"""Document fingerprints by a homomorphic multiset hash.

A paragraph is hashed to a wide vector, and a document's fingerprint is the
sum of its paragraphs' vectors modulo powers of two: the order of paragraphs
doesn't matter, and a paragraph is inserted or deleted by one addition or
subtraction. EQUAL lanes of 64 random bits each decide equality; ALIKE lanes,
in which each word run of the paragraph is a random sign in a random lane,
keep the size of a difference and so give likeness."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from spanalign.llm.sharding import range_of
from spanalign.llm.textops import mixed, raw, slices, span_hashes, words

#: Lanes modulo 2 ** 64 for equality, lanes modulo 2 ** 32 for likeness, words in a run.
EQUAL, ALIKE, RUN = 4, 128, 3
MASK = (1 << 32) - 1
#: Blocks of neighbouring ids: so many, more from ROWS documents a block on, and MOST at most (their bounds are sent to
#: the tasks, 8 bytes each).
BLOCKS, ROWS, MOST = 1 << 12, 1 << 15, 1 << 16


def paragraph_vectors(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The two vectors of each paragraph (the bytes between line feeds)."""
    digests = b"".join(hashlib.blake2b(p, digest_size=8 * EQUAL).digest() for p in parts)
    equal = np.frombuffer(digests, dtype="<u8").reshape(len(parts), EQUAL)
    data, offsets = raw(pa.array(parts, pa.binary()))
    starts, ends, of = words(data, offsets)
    token = span_hashes(data, starts, ends)
    run, doc = token, of
    for k in range(1, RUN):  # runs of RUN words of the same paragraph; a shorter paragraph is a run of its own
        if len(token) <= k:
            break
        same = of[k:] == of[:-k]
        longer = mixed(run[: len(token) - k] * np.uint64(2 * k + 3) + token[k:])
        run = np.where(np.append(same, np.zeros(k, dtype=bool)), np.append(longer, run[len(token) - k :]), run)
    last = np.searchsorted(of, np.arange(len(parts)), side="right")
    first = np.searchsorted(of, np.arange(len(parts)), side="left")
    index = np.arange(len(token))
    keep = (index <= np.maximum(last - RUN, first)[of]) if len(token) else np.zeros(0, dtype=bool)
    run, doc = run[keep], doc[keep]
    lane = (run & np.uint64(ALIKE - 1)).astype(np.int64)
    sign = np.where(run >> np.uint64(63), 1.0, -1.0)
    alike = np.bincount(doc * ALIKE + lane, weights=sign, minlength=len(parts) * ALIKE).reshape(-1, ALIKE)
    return equal, alike.astype(np.int64)


def fingerprint_many(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Both vectors of each text; an empty text has zeros."""
    parts, of = [], []
    for i, t in enumerate(texts):
        own = [p for p in t.encode().split(b"\n") if p]
        parts += own
        of += [i] * len(own)
    equal, alike = np.zeros((len(texts), EQUAL), dtype=np.uint64), np.zeros((len(texts), ALIKE), dtype=np.int64)
    if parts:
        e, a = paragraph_vectors(parts)
        np.add.at(equal, of, e)
        np.add.at(alike, of, a)
    return equal, alike & MASK


def add(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint after inserting paragraphs."""
    return one[0] + two[0], (one[1] + two[1]) & MASK


def subtract(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint after deleting paragraphs."""
    return one[0] - two[0], (one[1] - two[1]) & MASK


def printed(f: tuple[np.ndarray, np.ndarray]) -> list[str]:
    """Hex of the lanes, those for equality first."""
    both = np.concatenate([f[0].astype("<u8").view(np.uint8).reshape(len(f[0]), -1), f[1].astype("<u4").view(np.uint8).reshape(len(f[1]), -1)], axis=1)
    return [r.tobytes().hex() for r in both]


def likeness(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """1 for equal fingerprints; else 1 - |a - b| ** 2 / (|a| ** 2 + |b| ** 2) of
    the ALIKE lanes, which estimates the share of word runs in common, from 0
    (or just below 1 if only order or blanks within paragraphs differ)."""
    signed = lambda x: ((x + (1 << 31)) & MASK) - (1 << 31)
    a, b = signed(one[1]).astype(np.float64), signed(two[1]).astype(np.float64)
    gap, size = (signed((one[1] - two[1]) & MASK).astype(np.float64) ** 2).sum(axis=1), (a * a).sum(axis=1) + (b * b).sum(axis=1)
    alike = np.clip(1 - gap / np.maximum(size, 1), 0, 1 - 2**-20)
    return np.where(np.all(one[0] == two[0], axis=1), 1.0, alike)


def in_order(docs: DataFrame, blocks: int | None = None) -> DataFrame:
    """``docs(doc_id, text)`` in descending order of doc_id (null last, then by
    text hash), dealt into blocks of neighbours that each end with the first
    document of the next block: ``_block, _after, doc_id, text``, sorted.

    Block bounds are quantiles of the ids, so at most ``blocks`` rows are
    broadcast. The one shuffle moves each text once, and the first text of
    each block twice; after the last block comes the first."""
    blocks = blocks or min(MOST, max(BLOCKS, docs.count() // ROWS))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("_tie"))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / blocks for i in range(1, blocks)], 10 * blocks)).first()[0]
    order = [F.col("doc_id").isNull().alias("_no"), F.bitwise_not("doc_id").alias("_down"), F.col("_tie")]
    rows = rows.withColumn("_block", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(range_of(F.col("doc_id"), sorted(set(cuts or [])))))
    heads = rows.select("_block", F.struct(*order).alias("_head")).groupBy("_block").agg(F.min("_head").alias("_head"))
    every = W.orderBy(F.desc("_block"))
    heads = heads.select(F.col("_block").alias("_b"), "_head", F.coalesce(F.lag("_block").over(every), F.min("_block").over(W.partitionBy())).alias("_before"))
    own, copy = F.struct(F.col("_block"), F.lit(0).alias("_after")), F.struct(F.col("_before").alias("_block"), F.lit(1).alias("_after"))
    rows = rows.select("doc_id", "text", "_block", *order).join(F.broadcast(heads), F.col("_block") == F.col("_b"))
    head = F.struct("_no", "_down", "_tie").eqNullSafe(F.col("_head"))
    rows = rows.select("doc_id", "text", "_no", "_down", "_tie", F.explode(F.when(head, F.array(own, copy)).otherwise(F.array(own))).alias("_at"))
    rows = rows.select("_at._block", "_at._after", "doc_id", "text", "_no", "_down", "_tie")
    return rows.repartition("_block").sortWithinPartitions("_block", "_after", "_no", "_down", "_tie").select("_block", "_after", "doc_id", "text")


def compare(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next`` for each row of ``docs(doc_id, text)``.

    The edited text is the text with its last half replaced by as much of the
    beginning of the next document's. Null text as empty; a single document is
    its own next; rows that share a doc_id follow each other by text hash;
    other columns are not used; doc_id is an integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row, its text and its fingerprint wait for the row after it
        for b in slices(batches):
            texts = b.column("text").to_pylist()
            prints = fingerprint_many(texts)
            blocks, after, ids = (b.column(c).to_pylist() for c in ("_block", "_after", "doc_id"))
            if held:
                texts, blocks, after, ids = ([h, *x] for h, x in zip(held[0], (texts, blocks, after, ids), strict=True))
                prints = tuple(np.concatenate([h, x]) for h, x in zip(held[1], prints, strict=True))
            some = [i for i in range(len(texts) - 1) if not after[i] and blocks[i] == blocks[i + 1]]
            edited = [texts[i][: len(texts[i]) - len(texts[i]) // 2] + texts[i + 1][: len(texts[i]) // 2] for i in some]
            own, after_ = (tuple(x[np.array(some, dtype=np.int64) + d] for x in prints) for d in (0, 1))
            new = fingerprint_many(edited)
            held = ((texts[-1], blocks[-1], after[-1], ids[-1]), tuple(x[-1:] for x in prints))
            columns = [pa.array([ids[i] for i in some], b.schema.field("doc_id").type), pa.array([len(texts[i]) for i in some], pa.int64()), pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                       pa.array(printed(own), pa.string()), pa.array(printed(new), pa.string()), pa.array(likeness(own, new)), pa.array(likeness(own, after_))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_order(docs).mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` for each row of ``docs(doc_id, text)``, without a shuffle.
    Empty lines are no paragraphs: texts that differ in them only have equal fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(printed(fingerprint_many([t or "" for t in b.column("text").to_pylist()])), pa.string())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fingerprint string")
