"""Ranked lexical search through hashed max-sketches.

A document's sketch has WIDTH coordinates; a term's impact (how much its
repeats count in a text of that length) is folded into the coordinate that the
term hashes to, by maximum. A query looks up its terms' coordinates: their
weighted sum is never below the exact score, so documents are rescored exactly
in the order of their bounds, until no bound reaches the k-th exact score."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from spanalign.llm.common import cut
from spanalign.llm.textops import LOWER, raw, run_hashes, runs, slices

#: Coordinates of a sketch; kept are those that a document has, 3 bytes each.
WIDTH = 1 << 16
#: Repeats from here on are kept as this many, and count as infinitely many.
MANY = 255
#: Items looked up at once, and bytes of item texts whose terms are counted at once (a section).
GROUP, SECTION = 256, 1 << 22
#: The bit set of documents to rescore has at most 2 ** BITS bits (8 MB), however many they are.
BITS = 26

TERM = np.zeros(256, dtype=bool)
TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash (64 bits; terms are told apart by it) and text number of every term."""
    data, offsets = raw(texts)
    data = LOWER[data]
    starts, ends, of = runs(TERM[data], offsets)
    return run_hashes(data, starts, ends), of


def batches_of(batches: Iterator[pa.RecordBatch], rows: int = 4096) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def sketched(hashes: np.ndarray, of: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coordinates and their largest number of repeats, by document, and the
    m + 1 cuts between the documents. Terms that share 48 bits are counted
    together, which can only raise a bound."""
    key = np.sort(of.astype(np.uint64) << np.uint64(48) | hashes >> np.uint64(16))
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    repeats = np.diff(np.append(first, len(key)))
    place = key[first] >> np.uint64(32)
    head = np.flatnonzero(np.append(True, place[1:] != place[:-1])[: len(place)])
    most = np.maximum.reduceat(repeats, head) if len(head) else repeats
    place = place[head].astype(np.int64)
    cuts = np.searchsorted(place >> 16, np.arange(m + 1))
    return (place & 0xFFFF).astype("<u2"), np.minimum(most, MANY).astype(np.uint8), cuts


def binaries(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    width = values.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * width).astype(np.int32)), pa.py_buffer(values.tobytes())])


def index(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """One row per document with its length in terms and its sketch
    (``slots``, ``repeats``); and a row per task (length null) with ``df``, the
    number of documents with each wanted term. One pass over the texts."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, names = np.zeros(len(wanted), dtype=np.int64), ["doc_id", "_key", "n", "slots", "repeats", "df"]
        ids = None
        for b in batches_of(batches):
            m, ids = b.num_rows, b.column("doc_id").type
            hashes, of = tokens(b.column("text"))
            if len(wanted):
                at = np.minimum(np.searchsorted(wanted, hashes), len(wanted) - 1)
                hit = wanted[at] == hashes
                df += np.bincount(np.unique(of[hit] * len(wanted) + at[hit]) % len(wanted), minlength=len(wanted))
            slots, repeats, cuts = sketched(hashes, of, m)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("_key"), pa.array(np.bincount(of, minlength=m)), binaries(slots, cuts), binaries(repeats, cuts), pa.nulls(m, pa.list_(pa.int64()))], names)
        if ids is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, ids), pa.array([0]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.array([df.tolist()], pa.list_(pa.int64()))], names)

    return keyed(docs).mapInArrow(run, f"doc_id {kind}, _key long, n long, slots binary, repeats binary, df array<long>")


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("_key"), "text")


def saturation(n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """20 times each document's m, from its number of terms (whole numbers of any size)."""
    return np.array([20 * (50 + 50 * k * documents // length) for k in n.tolist()], dtype=np.int64)


def impact(repeats: np.ndarray, m20: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * repeats // np.maximum(1000 * repeats + m20, 1)


class Best:
    """The k best rows of each item among those added: largest score, then
    smallest id (null last)."""

    def __init__(self, k: int, items: int, kind: pa.DataType) -> None:
        self.k, self.floor, self.pending = k, np.ones(items, dtype=np.int64), 0
        self.rows = pa.table({"item": pa.array([], pa.int64()), "score": pa.array([], pa.int64()), "doc_id": pa.array([], kind), "_key": pa.array([], pa.int64())})

    def add(self, scores: np.ndarray, ids: pa.Array, keys: pa.Array) -> None:
        i, q = np.nonzero(scores >= self.floor)
        new = pa.table({"item": pa.array(q), "score": pa.array(scores[i, q]), "doc_id": ids.take(pa.array(i)), "_key": keys.take(pa.array(i))})
        self.rows, self.pending = pa.concat_tables([self.rows, new]), self.pending + len(i)
        if self.pending > 1 << 16:
            self.prune()

    def prune(self) -> pa.Table:
        rows = self.rows.take(pc.sort_indices(self.rows, [("item", "ascending"), ("score", "descending"), ("doc_id", "ascending")], null_placement="at_end"))
        item = rows["item"].to_numpy()
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        score = rows["score"].to_numpy()
        last = rank == self.k - 1
        self.floor[item[last]] = score[last]
        self.rows, self.pending = rows.filter(pa.array(rank < self.k)).combine_chunks(), 0
        return self.rows


class Queries:
    """A group of items as weights: by coordinate for bounds, by term for scores."""

    def __init__(self, items: list[np.ndarray], weight: dict[int, int], documents: int, length: int) -> None:
        self.documents, self.length, self.n = documents, length, len(items)
        self.terms = np.unique(np.concatenate([*items, np.zeros(0, dtype=np.uint64)]))
        self.coordinates = np.unique(self.terms >> np.uint64(48)).astype(np.int64)
        self.rows = [(q, h, weight.get(int(h), 0)) for q, own in enumerate(items) for h in own]
        # sums of whole numbers below 2 ** 53 are exact in doubles, in any order
        most = max([sum(w for _, _, w in self.rows)] if len(items) < 2 else np.bincount([q for q, _, _ in self.rows], weights=[w for _, _, w in self.rows], minlength=1).tolist())
        self.dtype = np.float64 if most * 1_000_000 < 1 << 53 else np.int64

    def matrix(self, by: np.ndarray, place: np.ndarray) -> np.ndarray:
        w = np.zeros((len(by), self.n), dtype=self.dtype)
        if self.rows:
            np.add.at(w, (np.searchsorted(by, place), [q for q, _, _ in self.rows]), [x for _, _, x in self.rows])
        return w

    def bounds(self) -> callable:
        """Upper bounds (documents x items) of a batch of index rows."""
        place = np.array([int(h) >> 48 for _, h, _ in self.rows], dtype=np.int64)
        w, column = self.matrix(self.coordinates, place), np.full(WIDTH, -1)
        column[self.coordinates] = np.arange(len(self.coordinates))

        def of(b: pa.RecordBatch) -> np.ndarray:
            data, cuts = raw(b.column("repeats").cast(pa.binary()))
            slots = np.frombuffer(raw(b.column("slots").cast(pa.binary()))[0].tobytes(), dtype="<u2")
            doc = np.repeat(np.arange(b.num_rows), np.diff(cuts))
            on = column[slots] >= 0
            doc, col, times = doc[on], column[slots[on]], data[on].astype(np.int64)
            m20 = saturation(b.column("n").to_numpy(), self.documents, self.length)
            value = np.where(times == MANY, 1_000_000, impact(times, m20[doc]))
            return (dense(doc, col, value, (b.num_rows, len(w)), self.dtype) @ w).astype(np.int64)

        return of

    def scores(self) -> callable:
        """Exact scores (documents x items) of a batch of texts."""
        w = self.matrix(self.terms, np.array([h for _, h, _ in self.rows], dtype=np.uint64))

        def of(texts: pa.Array) -> np.ndarray:
            hashes, doc = tokens(texts)
            m20 = saturation(np.bincount(doc, minlength=len(texts)), self.documents, self.length)
            at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
            hit = self.terms[at] == hashes
            pair, times = np.unique(doc[hit] * len(self.terms) + at[hit], return_counts=True)
            doc, col = pair // len(self.terms), pair % len(self.terms)
            return (dense(doc, col, impact(times, m20[doc]), (len(texts), len(w)), self.dtype) @ w).astype(np.int64)

        return of


def dense(i: np.ndarray, j: np.ndarray, x: np.ndarray, shape: tuple[int, int], dtype: type) -> np.ndarray:
    out = np.zeros(shape, dtype=dtype)
    out[i, j] = x
    return out


def first(rows: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "_key")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def bit_set(keys: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The words (number, 64 bits) of a bit set of keys that are not zero."""
    at = F.shiftrightunsigned("_key", 64 - BITS)
    bits = keys.groupBy(F.shiftright(at, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(_key, {64 - BITS}) & 63 as int))")).alias("b")).toPandas()
    return bits["w"].to_numpy(dtype=np.int64), bits["b"].to_numpy(dtype=np.int64)


def rescored(docs: DataFrame, keys: DataFrame, queries: Queries, k: int) -> DataFrame:
    """Exact scores of the documents in the bit set of ``keys`` (and of the few
    that share a bit with one): each task's k best of each item."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    words, bits = bit_set(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = np.zeros(1 << (BITS - 6), dtype=np.int64)
        chosen[words] = bits
        best, scores = None, queries.scores()
        for b in batches_of(batches, 256):
            at = b.column("_key").to_numpy().view(np.uint64) >> np.uint64(64 - BITS)
            b = b.filter(pa.array((chosen[(at >> np.uint64(6)).astype(np.int64)].view(np.uint64) >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)))
            best = best or Best(k, queries.n, b.column("doc_id").type)
            if b.num_rows:
                best.add(scores(b.column("text")), b.column("doc_id"), b.column("_key"))
        if best:
            yield from best.prune().to_batches()

    return keyed(docs).mapInArrow(run, f"item long, score long, doc_id {kind}, _key long")


def search_group(docs: DataFrame, sketches: DataFrame, queries: Queries, k: int) -> DataFrame:
    """``item`` (number), ``rank, doc_id, score`` for one group of items."""
    kind = docs.schema["doc_id"].dataType
    whole = kind.simpleString() in ("tinyint", "smallint", "int", "bigint")

    def highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, bounds = None, queries.bounds()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                best = best or Best(k, queries.n, b.column("doc_id").type)
                best.add(bounds(b), b.column("doc_id"), b.column("_key"))
        if best:
            yield from best.prune().to_batches()

    rows = sketches.select("doc_id", "_key", "n", "slots", "repeats")
    top = first(rows.mapInArrow(highest, f"item long, score long, doc_id {kind.simpleString()}, _key long"), k)
    begun = cut(first(rescored(docs, top.select("_key"), queries, k), k), "first-scores")
    # the threshold: the k-th exact score so far, and the id that has it
    least, latest = np.ones(queries.n, dtype=np.int64), np.full(queries.n, np.iinfo(np.int64).max)
    for r in begun.filter(F.col("rank") == k).select("item", "score", "doc_id").collect():
        least[r["item"]] = r["score"]
        if whole and r["doc_id"] is not None:
            latest[r["item"]] = r["doc_id"]

    def reaching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = queries.bounds()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                x = bounds(b)
                on = x >= least
                if whole:  # an equal score needs a smaller id
                    ids = pc.fill_null(b.column("doc_id").cast(pa.int64()), np.iinfo(np.int64).max).to_numpy()
                    on &= (x > least) | (ids[:, None] <= latest)
                yield pa.RecordBatch.from_arrays([b.column("_key").filter(pa.array(on.any(axis=1)))], ["_key"])

    rest = rows.mapInArrow(reaching, "_key long")
    return first(rescored(docs, rest, queries, k), k)


def sections(items: DataFrame) -> Iterator[list]:
    """The distinct rows of items, in parts of about SECTION bytes of text."""
    items = items.select("item_id", "text").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = size // SECTION + 1
    for part in range(parts):
        yield items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).orderBy("item_id", "text").collect()


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's k best documents with a
    score above 0 (all, if fewer), equal scores by ascending doc_id.

    Items are a stated set of queries: equal rows of items count once, two
    texts under one id are two searches. A null or empty text has no terms;
    documents without terms are no documents of the statistics; a null doc_id
    ranks after the others of its score; repeated rows of documents are
    ranked each; other columns are not used; no documents or no items give no
    rows. Terms are told apart by 64-bit hashes."""
    out = sketches = None
    docs = docs.select("doc_id", "text")
    for part in sections(items):
        hashes, of = tokens(pa.array([r["text"] for r in part], pa.string()))
        own = [np.unique(hashes[of == q]) for q in range(len(part))]
        wanted = np.unique(hashes)
        made = cut(index(docs, wanted), "sketches")
        sketches = sketches or made.filter("n is not null")  # the same for every section
        documents, length = sketches.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        counts = made.filter("n is null").select(F.posexplode("df").alias("t", "c")).groupBy("t").agg(F.sum("c").alias("c")).collect()
        weight = {int(wanted[r["t"]]): math.floor(1000 * math.log((2 * documents + 2) / (2 * r["c"] + 1))) for r in counts}
        for at in range(0, len(part) if documents else 0, GROUP):
            queries = Queries(own[at : at + GROUP], weight, documents, length)
            if not len(queries.terms):
                continue
            got = search_group(docs, sketches.filter("n > 0"), queries, k)
            names = docs.sparkSession.createDataFrame([(q, r["item_id"]) for q, r in enumerate(part[at : at + GROUP])], items.select(F.lit(0).cast("long").alias("item"), "item_id").schema)
            got = got.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
            out = got if out is None else out.union(got)
    if out is None:
        kinds = [f"{name} {df.schema[name].dataType.simpleString()}" for name, df in (("item_id", items), ("doc_id", docs))]
        out = docs.sparkSession.createDataFrame([], f"{kinds[0]}, rank int, {kinds[1]}, score long")
    return out
