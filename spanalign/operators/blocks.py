"""One document over many tasks (ALN-1..4).

Two cuts. A text is cut into segments at places where every covering scheme
has a border, so each segment makes its own tokens; numbers and offsets go on
from prefix sums over a document's few segments. And positions are cut into
blocks of equal size: the joins of points and targets run for each (doc_id,
block) as they would for a document. An interval is put into every block that
it reaches into; where the nearest target may lie far away, the last before
and the first after each block are carried into it, from one row per block."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanalign.functions.patterns import NON_WS_CHAR, TOKEN_SCHEMES, WS_CHAR
from spanalign.operators.bpe import is_bpe
from spanalign.operators.offsets import running
from spanalign.operators.spans import chunk_spans
from spanalign.operators.tokens import multi_scheme_tokens, scheme_pattern
from spanalign.sources.tables import by_doc, text_partitions

#: Characters of a segment and bytes of a block, about.
SEGMENT, BLOCK = 1 << 18, 1 << 18


def _segments(docs: DataFrame, pattern: str, keep, counted: dict[str, Column]) -> DataFrame:
    """Rows ``doc_id`` (struct of id and segment), keep, ``text`` and ``_b0, _c0``
    (bytes and characters before it), ``_t0..`` (``counted`` before it) and
    ``_end``; dealt over all tasks."""
    n = text_partitions(docs)   # measured before the texts are cut, so that they are cut once
    x = docs.select("doc_id", *keep, F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("_a"))
    x = x.select("doc_id", *keep, F.size("_a").alias("_k"), F.posexplode(F.col("_a")).alias("_seg", "text"))
    x = x.select(F.struct("doc_id", "_seg").alias("doc_id"), *keep, "_k", "text")
    x = by_doc(x, n)   # dealt over all tasks before anything is counted in a segment
    sizes = {"_b0": F.octet_length("text").cast("bigint"), "_c0": F.char_length("text").cast("bigint"), **counted}
    # the sums are over one narrow row per segment; the columns kept only order them, so that both uses share one exchange of the texts
    w = running([F.col("_d.doc_id")], [F.col("_d._seg"), "_k", *keep])
    sums = x.select(F.col("doc_id").alias("_d"), "_k", *keep, *[c.alias(n) for n, c in sizes.items()])
    sums = sums.select("_d", *[(F.sum(n).over(w) - F.col(n)).alias(n) for n in sizes])
    x = x.join(sums, F.col("doc_id") == F.col("_d"))   # structs: a null id equals a null id
    return x.select("doc_id", *keep, "text", *sizes, (F.col("doc_id._seg") == F.col("_k") - 1).alias("_end"))


def cut_pattern(segment: int) -> str:
    """Segments of ``segment`` characters and then up to the next white space
    that follows something else: words, blanks and any covering scheme's pieces
    end there. What has no such place is not cut."""
    return rf"(?s:.{{{segment}}}.*?)(?<={NON_WS_CHAR})(?={WS_CHAR})|(?s:.+)"


def tokens_in_segments(docs: DataFrame, schemes, keep=("grp",), segment: int = SEGMENT) -> DataFrame:
    """``multi_scheme_tokens`` of covering regex schemes with each document's
    text cut into segments: the same rows, from many tasks."""
    wrong = [s for s in schemes if is_bpe(s) or s not in TOKEN_SCHEMES]
    if wrong:
        raise ValueError(f"only the named regex schemes are known to end where segments are cut: {wrong}")
    counted = {f"_t{k}": F.regexp_count("text", F.lit(scheme_pattern(s))).cast("int") for k, s in enumerate(schemes)}
    seg = _segments(docs, cut_pattern(segment), keep, counted)
    own = [*keep, "_b0", "_c0", *counted, "_end"]
    t = multi_scheme_tokens(seg, schemes, keep=own)
    before = F.element_at(F.array(*counted), F.col("scheme_id") + 1)
    return t.select(F.col("doc_id.doc_id").alias("doc_id"), *keep, "scheme", "scheme_id", (F.col("tok_id") + before).cast("int").alias("tok_id"),
                    (F.col("s") + F.col("_b0")).alias("s"), (F.col("e") + F.col("_b0")).alias("e"), (F.col("is_last") & F.col("_end")).alias("is_last"))


def chunks_in_segments(docs: DataFrame, k: int, keep=("grp",), segment: int = SEGMENT) -> DataFrame:
    """``chunk_spans`` with each text cut at a multiple of ``k`` characters."""
    many = max(1, segment // k)
    seg = _segments(docs, r"(?s).{1,%d}" % (k * many), keep, {})
    c = chunk_spans(seg, k, keep=[*keep, "_b0", "_c0", "_end"])   # _end: what it is made of stays in the exchange, which the sums then share
    return c.select(F.col("doc_id.doc_id").alias("doc_id"), *keep, "type", (F.col("span_id") + many * F.col("doc_id._seg")).cast("int").alias("span_id"),
                    (F.col("s") + F.col("_b0")).alias("s"), (F.col("e") + F.col("_b0")).alias("e"), (F.col("cs") + F.col("_c0")).alias("cs"),
                    (F.col("ce") + F.col("_c0")).alias("ce"), "piece")


def _of(position: Column, block: int) -> Column:
    return F.floor(position / F.lit(block)).cast("bigint")


def _key(block: Column) -> Column:
    return F.struct(F.col("doc_id").alias("id"), block.alias("block")).alias("doc_id")


def placed(points: DataFrame, block: int, p: str = "p") -> DataFrame:
    """Points under (doc_id, block) in place of the doc_id."""
    return points.select(_key(_of(F.col(p), block)), *[c for c in points.columns if c != "doc_id"])


def unplaced(df: DataFrame) -> DataFrame:
    return df.select(F.col("doc_id.id").alias("doc_id"), *[F.col(c) for c in df.columns if c != "doc_id"])


def overlapping(intervals: DataFrame, block: int, touch: bool = False) -> DataFrame:
    """Each interval in every block that holds a point strictly inside it, or
    with ``touch`` one at its ends too."""
    rest = [c for c in intervals.columns if c != "doc_id"]
    low, high = (F.col("s"), F.col("e")) if touch else (F.col("s") + 1, F.col("e") - 1)
    reach = F.sequence(_of(low, block), F.greatest(_of(low, block), _of(high, block)))
    return intervals.select("doc_id", *rest, F.explode(reach).alias("_block")).select(_key(F.col("_block")), *rest)


#: Intervals that are packed at once, about.
PACK = 1 << 17


def _runs(key: pa.Array) -> np.ndarray:
    """Whether each row's key is another one than the row's before (a null is
    like a null); true for the first row."""
    if not len(key):
        return np.zeros(0, dtype=bool)
    if pa.types.is_nested(key.type):
        rows = key.to_pylist()
        return np.array([True, *(a != b for a, b in zip(rows, rows[1:], strict=False))])
    a, b = key.slice(0, len(key) - 1), key.slice(1)
    same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
    return np.append(True, ~same.to_numpy(zero_copy_only=False))


def _small(v: np.ndarray) -> bytes:
    """Numbers in the least width that holds them, led by that width."""
    most = max(int(v.max()), -int(v.min()) - 1) if len(v) else 0
    width = next(w for w in (1, 2, 4, 8) if most < 1 << (8 * w - 1))
    return bytes([width]) + v.astype(f"<i{width}").tobytes()


def _pack(tok: np.ndarray, known: np.ndarray, s: np.ndarray, e: np.ndarray) -> bytes:
    """Intervals as differences: of one token from the next ones there are an
    id's step, the gap to the end before, and a length."""
    steps = np.diff(tok, prepend=0), s - np.append(0, e[:-1]), e - s, known.astype(np.int64)
    return len(s).to_bytes(4, "little") + zlib.compress(b"".join(map(_small, steps)), 1)


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, rest, at, steps = int.from_bytes(data[:4], "little"), zlib.decompress(data[4:]), 0, []
    for _ in range(4):
        width = rest[at]
        steps.append(np.frombuffer(rest, dtype=f"<i{width}", count=n, offset=at + 1).astype(np.int64))
        at += 1 + width * n
    tok, gap, size, known = steps
    e = np.cumsum(gap + size)
    return np.cumsum(tok), known == 1, e - size, e


def packed(intervals: DataFrame, block: int) -> DataFrame:
    """``overlapping`` with one row for the intervals of a block that stand
    together: ``_pack`` holds their ``tok_id, s, e`` as compressed differences, a
    byte or less for each, in place of a row."""
    x = intervals.select("doc_id", *[F.col(c).cast("bigint") for c in ("tok_id", "s", "e")]).filter("s IS NOT NULL AND e IS NOT NULL")
    schema = T.StructType([T.StructField("doc_id", T.StructType([T.StructField("id", x.schema["doc_id"].dataType), T.StructField("block", T.LongType())])),
                           T.StructField("_pack", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _gathered(batches, PACK):
            doc, tok, s, e = b.column("doc_id"), b.column("tok_id"), b.column("s").to_numpy(), b.column("e").to_numpy()
            known, tok = tok.is_valid().to_numpy(zero_copy_only=False), tok.fill_null(0).to_numpy(zero_copy_only=False)
            low = (s + 1) // block
            n = np.maximum(low, (e - 1) // block) - low + 1
            at = np.repeat(np.arange(len(s)), n)   # once for each block
            where = low[at] + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            of = np.cumsum(_runs(doc))[at]
            order = np.lexsort((where, of))
            at, where, of = at[order], where[order], of[order]
            first = np.flatnonzero(np.append(True, (np.diff(of) != 0) | (np.diff(where) != 0)))
            rows = [_pack(tok[k], known[k], s[k], e[k]) for k in np.split(at, first[1:])]
            key = pa.StructArray.from_arrays([doc.take(pa.array(at[first])), pa.array(where[first])], ["id", "block"])
            yield pa.RecordBatch.from_arrays([key, pa.array(rows, pa.binary())], ["doc_id", "_pack"])

    return x.mapInArrow(run, schema)


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if n:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def stab_packed(points: DataFrame, intervals: DataFrame, p: str, block: int) -> DataFrame:
    """``boundary_context`` of tokens for ``placed`` points and ``packed``
    intervals: the last interval that starts before each point, of equal starts
    the lowest id, if it ends behind it."""
    columns = [c for c in points.columns if c != "doc_id"]
    a = placed(points, block, p).select("doc_id", F.col(p).cast("bigint").alias("_k"), F.struct(*columns).alias("_pt"))
    u = a.unionByName(packed(intervals, block), allowMissingColumns=True)
    u = u.repartition("doc_id").sortWithinPartitions("doc_id", F.col("_pt").isNotNull())
    fields = [intervals.schema[c] for c in ("tok_id", "s", "e")]

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, begun, toks = None, [], None
        for b in batches:
            doc, pack, k = b.column("doc_id"), b.column("_pack"), b.column("_k")
            if not b.num_rows:
                continue
            new = _runs(doc.field(0)) | _runs(doc.field(1))
            new[0] = last is None or _runs(pa.concat_arrays([last, doc.slice(0, 1)]).field(0))[1] or _runs(pa.concat_arrays([last, doc.slice(0, 1)]).field(1))[1]
            last = doc.slice(b.num_rows - 1)
            starts = sorted({0, *np.flatnonzero(new).tolist()})
            point = b.column("_pt").is_valid().to_numpy(zero_copy_only=False)
            p_known, places = k.is_valid().to_numpy(zero_copy_only=False), k.fill_null(0).to_numpy(zero_copy_only=False)
            found, inside = [], []
            for low, high in zip(starts, [*starts[1:], b.num_rows], strict=True):
                if new[low]:
                    begun, toks = [], None
                n = int(point[low:high].argmax()) if point[low:high].any() else high - low
                begun += [_unpack(x.as_py()) for x in pack.slice(low, n)]
                if low + n == high:
                    continue
                if toks is None:
                    toks = [np.concatenate(c) for c in zip(*begun, strict=True)] if begun else [np.zeros(0, dtype=np.int64)] * 4
                    order = np.lexsort((np.where(toks[1], -toks[0], 0), toks[2]))
                    toks = [c[order] for c in toks]
                    toks.append(np.maximum.accumulate(toks[3]))
                at = places[low + n:high]
                i = np.searchsorted(toks[2], at, side="left") - 1
                some = (i >= 0) & p_known[low + n:high]
                i = np.where(some, i, 0)
                if len(toks[2]):
                    found.append([c[i] for c in toks[:4]] + [some & (toks[3][i] > at)])
                    inside.append(some & (toks[4][i] > at))
                else:
                    found.append([np.zeros(len(at), dtype=np.int64)] * 4 + [some & False])
                    inside.append(some & False)
            if not found:
                continue
            tok, known, s, e, ok = (np.concatenate(c) for c in zip(*found, strict=True))
            kind = [pa.int32() if f.dataType == T.IntegerType() else pa.int64() for f in fields]
            tok = [pa.array(tok, mask=known == 0).cast(kind[0]), pa.array(s).cast(kind[1]), pa.array(e).cast(kind[2])]
            take = pa.array(np.flatnonzero(point))
            struct = pa.StructArray.from_arrays(tok, [f.name for f in fields], mask=pa.array(~ok))
            yield pa.RecordBatch.from_arrays([doc.take(take), b.column("_pt").take(take), struct, pa.array(np.concatenate(inside))], ["doc_id", "_pt", "tok", "in_token"])

    schema = T.StructType([u.schema["doc_id"], u.schema["_pt"], T.StructField("tok", T.StructType(fields)), T.StructField("in_token", T.BooleanType())])
    return unplaced(u.mapInArrow(sweep, schema).select("doc_id", "_pt.*", "tok", "in_token"))


def with_nearest(toks: DataFrame, points: DataFrame, block: int, extra=()) -> DataFrame:
    """Tokens under the blocks of both their ends; and for each block that has
    points the tokens that are nearest to it on either side, by start and by
    end, the lowest id of equals."""
    rest = [c for c in toks.columns if c != "doc_id"]
    both = F.array_distinct(F.array(_of(F.col("s"), block), _of(F.col("e"), block)))
    inside = toks.select("doc_id", *rest, F.explode(both).alias("_block"))
    row = F.struct(*rest)
    here = lambda c: _of(F.col(c), block) == F.col("_block")  # noqa: E731  (a token counts by each end in that end's block)
    best = {f"{f}{c}": (F.max if f == "last" else F.min)(F.when(here(c), F.struct(F.col(c).alias("at"), (-F.col("tok_id") if f == "last" else F.col("tok_id")).alias("tie"), row.alias("row"))))
            for f in ("last", "first") for c in ("s", "e")}
    ends = inside.groupBy("doc_id", *extra, "_block").agg(*[c.alias(n) for n, c in best.items()])
    has = points.select("doc_id", *extra, _of(F.col("p"), block).alias("_block")).distinct().withColumn("_p", F.lit(True))
    kinds = {f.name: f.dataType for f in ends.schema.fields if f.name in best}
    u = ends.withColumn("_p", F.lit(False)).unionByName(has.select("*", *[F.lit(None).cast(t).alias(n) for n, t in kinds.items()]))
    # a few rows per block: their own exchange, whatever the union's branches look like
    u = u.repartition("doc_id", "_block").groupBy("doc_id", *extra, "_block").agg(F.max("_p").alias("_p"), *[F.first(n, ignorenulls=True).alias(n) for n in best])
    at = Window.partitionBy("doc_id", *extra).orderBy("_block")
    back, on = at.rowsBetween(Window.unboundedPreceding, -1), at.rowsBetween(1, Window.unboundedFollowing)
    near = [(F.max(n).over(back) if n.startswith("last") else F.min(n).over(on)).alias(n) for n in best]
    carried = u.select("doc_id", "_block", "_p", *near).filter("_p")
    carried = carried.select("doc_id", "_block", F.explode(F.array(*[F.col(f"{n}.row") for n in best])).alias("_r")).filter("_r IS NOT NULL")
    every = inside.select("doc_id", *rest, "_block").union(carried.select("doc_id", *[F.col(f"_r.{c}") for c in rest], "_block"))
    return every.select(_key(F.col("_block")), *rest)
