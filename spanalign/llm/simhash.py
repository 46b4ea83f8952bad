"""SimHash near-duplicates through deletion-variant signatures.

A 64-bit fingerprint is cut into max_bits // 2 + 1 segments, so that of two
fingerprints within max_bits one segment differs by at most one bit. Each
segment is indexed under every variant with one bit wiped: equal variants
meet in an equality shuffle and the pairs there are verified."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from spanalign.llm.common import components, cut
from spanalign.llm.textops import slices

#: A variant shared by more distinct fingerprints than this is indexed once more by its other bits.
CROWD = 1 << 16


def fingerprint(data: bytes, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of one UTF-8 text: A-Z lower-cased, words at ASCII white space,
    shingles of ``shingle`` words joined by a blank (fewer words: all of them),
    repeats counted; a bit is 1 if it is set in over half the hashes."""
    tokens = data.lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    k = min(shingle, len(tokens))
    starts = [0, *(ends[: len(tokens) - k] + 1).tolist()]
    stops = ends[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(starts), 1 << 14):
        h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[at : at + (1 << 14)], stops[at : at + (1 << 14)], strict=True)], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """``doc_id, _tie, _fp`` (a hash of the text; the fingerprint as signed 64
    bits) for each row, null text as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            fps = np.array([fingerprint((t or "").encode(), shingle, seed) for t in b.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("_tie"), pa.array(fps.view(np.int64))], ["doc_id", "_tie", "_fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("_tie"), "text").mapInArrow(run, f"doc_id {kind}, _tie long, _fp long")


def segments(bits: list[int], max_bits: int) -> list[list[int]]:
    n = max_bits // 2 + 1
    return [bits[len(bits) * k // n : len(bits) * (k + 1) // n] for k in range(n)]


def variants(fps: DataFrame, parts: list[tuple[int, list[int]]], keys: list[str]) -> DataFrame:
    """A row for each part (number, bits) and wiped bit of each fingerprint:
    ``part, wiped, kept`` after the columns ``keys`` and ``_fp``."""
    each = []
    for part, bits in parts:
        mask = sum(1 << b for b in bits)
        for b in bits:
            left = mask & ~(1 << b)
            each.append(F.struct(F.lit(part * 64 + b).alias("_part"), F.lit(left - (1 << 64) if left >= 1 << 63 else left).cast("long").alias("_mask")))
    rows = fps.select(*keys, "_fp", F.explode(F.array(*each)).alias("_v"))
    return rows.select(*keys, "_fp", F.col("_v._part").alias(f"_part{len(keys)}"), F.col("_fp").bitwiseAND(F.col("_v._mask")).alias(f"_kept{len(keys)}"))


def near(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of pairs within ``max_bits``, enough to connect all of them,
    among distinct fingerprints of one group."""
    n = len(fps)
    if n <= 2048:
        i, j = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= max_bits, 1))
        return i, j
    order = np.argsort(fps)
    ranked = fps[order]
    free = int(np.bitwise_or.reduce(fps ^ fps[0]))
    bits = [np.uint64(1 << b) for b in range(64) if free >> b & 1]
    masks = [np.uint64(0)]
    for _ in range(max_bits):  # every change of at most max_bits of the bits that vary here
        masks = list({int(m | b) for m in masks for b in bits} | {int(m) for m in masks})
        masks = [np.uint64(m) for m in masks]
    out_i, out_j = [], []
    for m in masks:
        if m:
            want = fps ^ m
            at = np.minimum(np.searchsorted(ranked, want), n - 1)
            hit = np.flatnonzero((ranked[at] == want) & (fps < want))
            out_i.append(hit)
            out_j.append(order[at[hit]])
    return np.concatenate(out_i), np.concatenate(out_j)


def lowest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that each of ``n`` indexes reaches over pairs."""
    label = np.arange(n)
    while len(i):
        m = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, m)
        np.minimum.at(new, j, m)
        np.minimum.at(new, label[i], m)
        np.minimum.at(new, label[j], m)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    return label


def starred(keys: np.ndarray, fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (u, v) that connect what is near within each run of equal rows of
    ``keys``: each linked fingerprint once, to one of its group."""
    change = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
    begin = np.concatenate([[0], change])
    size = np.diff(np.concatenate([begin, [len(fps)]]))
    of = np.repeat(np.arange(len(begin)), size)
    ii, jj = [], []
    few = (size <= 64)[of]  # small groups together, by distance in the run
    for k in range(1, int(size[size <= 64].max(initial=0))):
        i = np.flatnonzero(few[:-k] & (of[:-k] == of[k:]))
        i = i[np.bitwise_count(fps[i] ^ fps[i + k]) <= max_bits]
        ii.append(i)
        jj.append(i + k)
    for g in np.flatnonzero(size > 64):
        i, j = near(fps[begin[g] : begin[g] + size[g]], max_bits)
        ii.append(i + begin[g])
        jj.append(j + begin[g])
    label = lowest(len(fps), np.concatenate([*ii, []]).astype(np.int64), np.concatenate([*jj, []]).astype(np.int64))
    u = np.flatnonzero(label != np.arange(len(fps)))
    return fps[u], fps[label[u]]


def linked(groups: DataFrame, keys: list[str], max_bits: int) -> DataFrame:
    """Links within groups that stand together, sorted by ``keys``; the last
    group of a batch waits for the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out(rows: np.ndarray) -> pa.RecordBatch:
            u, v = starred(rows[:, :-1], np.ascontiguousarray(rows[:, -1]).view(np.uint64), max_bits)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        for b in batches:
            rows = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(len(keys) + 1)], axis=1)
            if not len(rows):
                continue
            differs = np.flatnonzero(np.any(rows[:, :-1] != rows[-1, :-1], axis=1))
            if held and (len(differs) or np.any(held[-1][-1, :-1] != rows[-1, :-1])):
                last = int(differs[-1]) + 1 if len(differs) else 0
                yield out(np.concatenate([*held, rows[:last]]))
                held, rows = [], rows[last:]
            elif len(differs):
                last = int(differs[-1]) + 1
                yield out(rows[:last])
                rows = rows[last:]
            held.append(rows)
        if held:
            yield out(np.concatenate(held))

    return groups.select(*keys, "_fp").mapInArrow(run, "u long, v long")


def links(fps: DataFrame, max_bits: int = 2, crowd: int = CROWD) -> DataFrame:
    """Links ``(u, v)`` among distinct ``_fp``, enough to connect all pairs
    within ``max_bits``.

    Groups of more than ``crowd`` are found by partial counts, before any group
    is together; groups of one, most of them, are dropped before anything is
    kept. A crowded group is never held in one task: its rows are indexed once
    more by variants of the other bits, after which only the bits of the last
    segment and two wiped ones are free, so a group is bounded by construction."""
    first = segments(list(range(64)), max_bits)
    rows = variants(fps, list(enumerate(first)), [])
    keys = ["_part0", "_kept0"]
    large = cut(rows.groupBy(*keys).count().filter(F.col("count") > crowd).select(*keys), "crowded")
    none = max_bits < 2 or large.isEmpty()
    calm = rows if none else rows.join(large, keys, "left_anti").select(*rows.columns)
    calm = cut(calm.withColumn("_n", F.count("*").over(W.partitionBy(*keys))).filter("_n > 1"), "met")
    out = linked(calm.repartition(*keys).sortWithinPartitions(*keys), keys, max_bits)
    if none:
        return out
    crowded = cut(rows.join(large, keys, "left_semi").select(*rows.columns), "crowd")
    for part, bits in enumerate(first):
        rest = [b for b in range(64) if b not in bits]
        deep = variants(crowded.filter(F.floor(F.col("_part0") / 64) == part), list(enumerate(segments(rest, max_bits))), keys)
        every = [*keys, "_part2", "_kept2"]
        deep = deep.withColumn("_m", F.count("*").over(W.partitionBy(*every))).filter("_m > 1")
        out = out.union(linked(deep, every, max_bits))
    return out


def classes(prints: DataFrame, max_bits: int = 2) -> DataFrame:
    """``(doc_id, _fp)`` -> ``_fp, _label, component_id`` for each distinct
    fingerprint: its component and the smallest doc_id in it."""
    reps = cut(prints.groupBy("_fp").agg(F.min("doc_id").alias("_rep")), "prints")
    labels = components(links(reps.select("_fp"), max_bits))
    joined = reps.join(labels, F.col("_fp") == F.col("node"), "left").select("_fp", "_rep", F.coalesce("label", "_fp").alias("_label"))
    low = joined.groupBy("_label").agg(F.min("_rep").alias("component_id"))
    return joined.join(low, "_label").select("_fp", "_label", "component_id")


def clusters(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits), ``component_id`` for each row of
    ``docs(doc_id, text, ...)``.

    Null and empty texts have fingerprint zero and link like any other; a
    component whose ids are all null has a null component_id; repeated rows
    stay rows; other columns are not used; no rows give no rows."""
    prints = cut(fingerprints(docs, shingle), "simhash")
    found = prints.join(classes(prints, max_bits), "_fp")
    return found.select("doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """One row of each component, with all columns of ``docs``: the one with
    the smallest doc_id (null last), by text hash among rows that share it.

    Null and empty texts are near each other and one of them stays; of equal
    rows any one; no rows give no rows; columns may have any names; a text of
    any length is read whole."""
    prints = cut(fingerprints(docs, shingle), "simhash")
    found = prints.join(classes(prints, max_bits), "_fp")
    first = found.groupBy("_label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "_tie")).alias("_k")).select(F.col("_k.doc_id").alias("_id"), F.col("_k._tie").alias("_tie"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_i"), F.xxhash64("text").alias("_h"))
    rows = rows.join(first, (F.col("_h") == F.col("_tie")) & F.col("_i").eqNullSafe(F.col("_id")))
    return rows.withColumn("_n", F.row_number().over(W.partitionBy("_h", "_i").orderBy(F.lit(1)))).filter("_n = 1").select("_row.*")
