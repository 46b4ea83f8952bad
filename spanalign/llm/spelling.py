"""Spelling variants through a bit-sliced position index.

Two words are near if one inserted, deleted or replaced letter makes them
equal. Whatever the place of that letter, what stands before and after a window
around it is equal, so words meet in shards by window and surroundings. Within
a shard the index has, for each (position, letter), the bit set of the words
with that letter there; a query's letters drive recurrences over whole sets at
once: the words that agree so far (no error), and those that agree but for one
replaced, inserted or deleted letter (one error, positions shifted by one)."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanalign.llm.common import cut
from spanalign.llm.textops import LOWER, raw, run_hashes, runs, slices

#: Letters of a window at most, before it is halved for crowded shards.
WIDE = 12
#: A shard of more words than this is split by halves of its window (a window of one letter bounds it by the alphabet).
CROWD = 1 << 13
#: Words worked on at once, and (query, 64 words) states at once.
WORDS, STATES = 1 << 14, 1 << 18

LETTER = np.zeros(256, dtype=bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
#: First of the two bytes of U+00C0 to U+00FF.
LEAD = 0xC3
CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    CRC = np.where(CRC & 1, CRC >> 1 ^ np.uint32(0xEDB88320), CRC >> 1)


def crc32s(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """CRC-32 of each span of bytes, going on from a checksum each."""
    size = ends - starts
    order = np.argsort(-size)
    at, size, state = starts[order], size[order], ~seeds[order].astype(np.uint32)
    for j in range(min(64, int(size.max(initial=0)))):
        n = int(np.searchsorted(-size, -j, side="left"))  # spans of more than j bytes
        some = state[:n]
        state[:n] = CRC[(some ^ data[at[:n] + j]) & np.uint32(255)] ^ some >> np.uint32(8)
    for i in range(int(np.searchsorted(-size, -64, side="left"))):
        state[i] = ~np.uint32(zlib.crc32(data[at[i] + 64 : at[i] + size[i]], int(~state[i])))
    out = np.empty_like(state)
    out[order] = ~state
    return out


def counts(docs: DataFrame, least: int = 5, typos: int | None = None) -> DataFrame:
    """``word, n`` for each distinct word of at least ``least`` letters: maximal
    runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased.

    With ``typos``, a run whose CRC-32 (of ``<doc_id>:<run>``; a null id is
    empty) that number divides loses the letter at checksum modulo length
    first. Equal words of a slice of the input are found by 64-bit hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=1 << 23):
            data, offsets = raw(b.column("text"))
            data = LOWER[data]
            lead = data == LEAD
            on = LETTER[data] | lead
            on[1:] |= lead[:-1]
            starts, ends, of = runs(on, offsets)
            two = np.append(0, np.cumsum(lead, dtype=np.int64))
            size = ends - starts - (two[ends] - two[starts])
            wrong: Counter = Counter()
            if typos:
                seeds = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in b.column("doc_id").to_pylist()], dtype=np.uint32)
                crc = crc32s(data, starts, ends, seeds[of])
                hit = crc % np.uint32(typos) == 0
                for i in np.flatnonzero(hit & (size > least)).tolist():
                    word, k = data[starts[i] : ends[i]].tobytes().decode(), int(crc[i]) % int(size[i])
                    wrong[word[:k] + word[k + 1 :]] += 1
                size = np.where(hit, 0, size)
            keep = np.flatnonzero(size >= least)
            starts, ends = starts[keep], ends[keep]
            _, first, n = np.unique(run_hashes(data, starts, ends), return_index=True, return_counts=True)
            text = data.tobytes()
            words = [text[i:j] for i, j in zip(starts[first].tolist(), ends[first].tolist(), strict=True)] + [w.encode() for w in wrong]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array([*n.tolist(), *wrong.values()], pa.int64())], ["word", "n"])

    part = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return part.groupBy("word").agg(F.sum("n").alias("n"))


def keyed(windows: DataFrame) -> DataFrame:
    """Windows ``[a, b)`` of words for a shorter length ``m``, with the shard
    that they belong to (two hashes of what stands around the window) and the
    letters in the window: b - a, or one more in the longer words."""
    after = F.col("m") - F.col("b")
    middle = F.substring("word", F.col("a") + 1, F.char_length("word") - after - F.col("a"))
    before, behind = F.expr("left(word, a)"), F.expr("right(word, m - b)")
    return windows.withColumns({"k1": F.xxhash64("m", "a", "b", before, behind), "k2": F.xxhash64(F.lit(1), behind, before, "b", "a", "m"), "middle": middle})


def windows(vocabulary: DataFrame, least: int, wide: int) -> DataFrame:
    """Each word's windows, as the shorter (or equal) and as the longer word of a pair."""
    m = F.explode(F.filter(F.array(F.char_length("word"), F.char_length("word") - 1), lambda x: x >= least)).alias("m")
    parts = F.greatest(F.lit(2), F.ceil(F.col("m") / wide).cast("int"))
    rows = vocabulary.select("id", "word", m).withColumn("k", parts).select("id", "word", "m", "k", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("i"))
    return keyed(rows.select("id", "word", "m", F.expr("cast(m * i div k as int)").alias("a"), F.expr("cast(m * (i + 1) div k as int)").alias("b")))


def searched(size: int, last: bool, shard: np.ndarray, long: np.ndarray, middles: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each row, how many words of its shard are near it, and the row of
    the first of them (-1: none). Rows stand shard by shard; ``long`` marks the
    words with ``size + 1`` letters in the window, the others have ``size``.

    A pair of unequal lengths may differ at several places; it counts where
    its common beginning ends, so that one window has it."""
    n = len(shard)
    points = np.frombuffer("".join(x.ljust(size + 1, "\0") for x in middles).encode("utf-32-le"), dtype=np.uint32).reshape(n, size + 1)
    kinds, code = np.unique(points, return_inverse=True)
    code = code.reshape(n, size + 1)
    begin = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
    sizes = np.diff(np.append(begin, n))
    start, members = np.repeat(begin, sizes), np.repeat(sizes, sizes)
    place = np.arange(n) - start
    width = (sizes + 63) // 64  # blocks of 64 words
    base = np.cumsum(width) - width
    block = np.repeat(base, sizes) + place // 64
    bit = np.uint64(1) << (place % 64).astype(np.uint64)
    blocks = int(width.sum())
    index = np.zeros((size + 1, len(kinds), blocks), dtype=np.uint64)
    for j in range(size + 1):
        np.bitwise_or.at(index[j], (code[:, j], block), bit)
    short_set, long_set = np.zeros(blocks, dtype=np.uint64), np.zeros(blocks, dtype=np.uint64)
    np.bitwise_or.at(short_set, block[~long], bit[~long])
    np.bitwise_or.at(long_set, block[long], bit[long])
    count, found = np.zeros(n, dtype=np.int64), np.full(n, n, dtype=np.int64)
    ends_here = np.uint64(0) if last else ~np.uint64(0)
    for kind in (False, True):
        query = np.flatnonzero(long == kind)
        per = (members[query] + 63) // 64
        upto = np.append(0, np.cumsum(per))
        at = 0
        while at < len(query):
            to = max(at + 1, int(np.searchsorted(upto, upto[at] + STATES, side="right")) - 1)
            q = np.repeat(query[at:to], per[at:to])
            k = np.repeat(base[shard[query[at:to]]], per[at:to]) + np.arange(len(q)) - np.repeat(upto[at:to] - upto[at], per[at:to])
            none = short_set[k] | long_set[k]
            if not kind:
                replaced, inserted = np.zeros_like(none), none
                for j in range(size):
                    here, shifted = index[j][code[q, j], k], index[j + 1][code[q, j], k]
                    replaced = replaced & here | none & ~here
                    none = none & here
                    inserted = inserted & shifted | none
                near = replaced & short_set[k] | inserted & long_set[k] & ~(none & ends_here)
            else:
                deleted = none
                for j in range(1, size + 1):
                    none = none & index[j - 1][code[q, j - 1], k]
                    deleted = deleted & index[j - 1][code[q, j], k] | none
                near = deleted & short_set[k] & ~(none & ends_here)
            hit = np.flatnonzero(near)
            if len(hit):
                x = near[hit]
                count += np.bincount(q[hit], weights=np.bitwise_count(x), minlength=n).astype(np.int64)
                lowest = np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)).astype(np.int64)
                np.minimum.at(found, q[hit], start[q[hit]] + (k[hit] - base[shard[q[hit]]]) * 64 + lowest)
            at = to
    return count, np.where(found < n, found, -1)


def near(vocabulary: DataFrame, least: int = 5, wide: int = WIDE, crowd: int = CROWD) -> DataFrame:
    """``id, n_near, best`` for the words of ``vocabulary(id, word)`` that have
    near words: how many, and the smallest id among them."""
    rows, ready = windows(vocabulary, least, wide), None
    while True:
        crowded = cut(rows.groupBy("k1", "k2", "a", "b").count().filter((F.col("count") > crowd) & (F.col("b") - F.col("a") > 1)).select("k1", "k2"), "crowded")
        done = crowded.isEmpty()
        calm = rows if done else rows.join(crowded, ["k1", "k2"], "left_anti").select(*rows.columns)
        ready = calm if ready is None else ready.union(calm)
        if done:
            break
        middle = F.expr("cast((a + b) div 2 as int)")
        halves = F.explode(F.array(F.struct("a", middle.alias("b")), F.struct(middle.alias("a"), "b"))).alias("w")
        rows = cut(keyed(rows.join(crowded, ["k1", "k2"], "left_semi").select("id", "word", "m", halves).select("id", "word", "m", "w.a", "w.b")).select(*rows.columns), "halves")
    ready = ready.select("k1", "k2", (F.col("b") - F.col("a")).alias("size"), (F.col("b") == F.col("m")).alias("last"), (F.char_length("word") > F.col("m")).alias("long"), "middle", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def out(t: pa.Table) -> Iterator[pa.RecordBatch]:
            k1, k2 = t["k1"].to_numpy(), t["k2"].to_numpy()
            kind = t["size"].to_numpy().astype(np.int64) * 2 + t["last"].to_numpy()
            long = t["long"].to_numpy()
            new = np.append(True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]) | (kind[1:] != kind[:-1]))
            shard = np.cumsum(new) - 1
            # a shard of one word, or of longer words alone, has no pair
            some = (np.bincount(shard) > 1) & (np.bincount(shard, weights=~long) > 0)
            for each in np.unique(kind):
                keep = np.flatnonzero(some[shard] & (kind == each))
                if not len(keep):
                    continue
                own = np.cumsum(np.append(True, shard[keep][1:] != shard[keep][:-1])) - 1
                count, best = searched(int(each) // 2, bool(each % 2), own, long[keep], t["middle"].take(pa.array(keep)).to_pylist())
                ids, got = t["id"].to_numpy()[keep], count > 0
                yield pa.RecordBatch.from_arrays([pa.array(ids[got]), pa.array(count[got]), pa.array(ids[best[got]])], ["id", "n_near", "best"])

        for b in batches:
            held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            if held.num_rows < WORDS:
                continue
            k1, k2 = held["k1"].to_numpy(), held["k2"].to_numpy()
            other = np.flatnonzero((k1 != k1[-1]) | (k2 != k2[-1]))
            if len(other):  # the last shard may go on in the next batch
                cut_at = int(other[-1]) + 1
                yield from out(held.slice(0, cut_at).combine_chunks())
                held = held.slice(cut_at)
        if held is not None and held.num_rows:
            yield from out(held.combine_chunks())

    met = ready.repartition("k1", "k2").sortWithinPartitions("size", "last", "k1", "k2", "id").mapInArrow(run, "id long, n_near long, best long")
    return met.groupBy("id").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def roots(ups: DataFrame) -> DataFrame:
    """``id, up`` with each ``up`` followed to the last: pointers are doubled,
    so that chains of 2 ** r links end after r rounds."""
    ups = cut(ups, "ups")
    while True:
        step = ups.join(ups.select(F.col("id").alias("up"), F.col("up").alias("_next")), "up", "left")
        step = cut(step.select("id", F.coalesce("_next", "up").alias("up"), F.col("_next").isNotNull().alias("moved")), "ups")
        if step.filter("moved").isEmpty():
            return step.select("id", "up")
        ups = step.select("id", "up")


def group(docs: DataFrame, least: int = 5, often: int = 3, typos: int | None = None, crowd: int = CROWD) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each distinct word of at least
    ``least`` letters that occurs at least ``often`` times in ``docs(doc_id, text)``.

    A word's form is its near word of largest n (ties: smallest by code point)
    if that occurs at least twice as often, else null; its root is the last
    word that following forms reaches. Null text has no words; repeated rows
    count each; other columns are not used; no words give no rows."""
    words = counts(docs, least, typos).filter(F.col("n") >= often)
    # numbered in the order of preference; written, so that the numbers stay
    vocabulary = cut(words.orderBy(F.desc("n"), "word").withColumn("id", F.monotonically_increasing_id()), "vocabulary")
    found = near(vocabulary.select("id", "word"), least, crowd=crowd)
    named = vocabulary.select(F.col("id").alias("best"), F.col("word").alias("_form"), F.col("n").alias("_n"))
    found = cut(found.join(vocabulary.select("id", "n"), "id").join(named, "best").withColumn("_up", F.col("_n") >= 2 * F.col("n")).drop("n"), "near")
    ends = roots(found.filter("_up").select("id", F.col("best").alias("up")))
    ends = ends.join(vocabulary.select(F.col("id").alias("up"), F.col("word").alias("_root")), "up").select("id", "_root")
    rows = vocabulary.join(found, "id", "left").join(ends, "id", "left")
    form = lambda c: F.when(F.col("_up"), F.col(c))
    return rows.select("word", form("_form").alias("form"), F.coalesce("_root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form("_n").alias("form_n"))
