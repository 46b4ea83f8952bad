"""Offsets (OFF-1..4): pieces -> byte / character / UTF-16 positions.

Pieces of one document are produced by a generator from one input row, so
they sit in that row's partition. When the corpus is hash-partitioned by
doc_id (``sources.tables.by_doc``) the running-sum windows below need no
exchange; Catalyst only sorts inside each partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanalign.functions.text import is_continuation_byte, n_utf16


def running(parts, order) -> Window:
    return (Window.partitionBy(*parts).orderBy(*order)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))


def explode_pieces(docs: DataFrame, pieces: Column, keep=("grp",), pos: str = "i",
                   val: str = "piece") -> DataFrame:
    """One row per array element, with its 0-based position."""
    return docs.select("doc_id", *keep, F.posexplode(pieces).alias(pos, val))


def with_offsets(pieces: DataFrame, piece: str = "piece", order=("i",), parts=("doc_id",),
                 chars: bool = True, utf16: bool = False, prefix: str = "", carried=()) -> DataFrame:
    """Start/end of each piece in bytes (b0, b1), characters (c0, c1) and
    optionally UTF-16 code units (u0, u1), from ordered covering pieces.

    ``carried`` are per-document columns (e.g. grp) placed after the order
    key: constant within a document they never decide a comparison (so the
    sort stays on longs), yet being referenced they stay alive down to the
    doc_id exchange, so every branch built from one corpus frame has the
    same exchange and AQE runs it once."""
    w = running(parts, [*order, *carried])
    nb = F.octet_length(piece).cast("bigint")
    out = pieces.withColumn(prefix + "b1", F.sum(nb).over(w)) \
                .withColumn(prefix + "b0", F.col(prefix + "b1") - nb) \
                .withColumn(prefix + "is_last", F.lead(F.lit(1)).over(Window.partitionBy(*parts).orderBy(*order, *carried)).isNull())
    if chars:
        nc = F.char_length(piece).cast("bigint")
        out = out.withColumn(prefix + "c1", F.sum(nc).over(w)) \
                 .withColumn(prefix + "c0", F.col(prefix + "c1") - nc)
    if utf16:
        nu = n_utf16(piece)
        out = out.withColumn(prefix + "u1", F.sum(nu).over(w)) \
                 .withColumn(prefix + "u0", F.col(prefix + "u1") - nu)
    return out


def byte_to_char(points: DataFrame, pieces: DataFrame, p: str = "p") -> DataFrame:
    """Character index of byte position ``p`` (OFF-2).

    ``pieces`` are covering pieces with b0, c0 and their text; longer ones are
    cut at 64 characters, so that no point carries a long text. The piece
    holding ``p`` is found with an as-of window (last piece with b0 <= p);
    inside it the offset is resolved on the piece's own bytes. Null when
    ``p`` falls inside a multi-byte character or outside the text.
    """
    pt_cols = [c for c in points.columns if c != "doc_id"]
    pt_type = points.select(F.struct(*pt_cols).alias("x")).schema["x"].dataType
    cut = F.regexp_extract_all("piece", F.lit("(?s).{1,64}"), F.lit(0))
    pieces = pieces.select("doc_id", F.col("b0").alias("_b"), F.posexplode(cut).alias("_j", "piece"))
    pieces = with_offsets(pieces, order=("_b", "_j"))
    pc = pieces.select("doc_id", F.struct("b0", "c0", "piece").alias("_pc"),
                       F.col("b0").alias("_k"), F.lit(0).alias("_kind"),
                       F.lit(None).cast(pt_type).alias("_pt"))
    pp = points.select("doc_id", F.lit(None).cast(pc.schema["_pc"].dataType).alias("_pc"),
                       F.col(p).alias("_k"), F.lit(1).alias("_kind"),
                       F.struct(*pt_cols).alias("_pt"))
    w = running(["doc_id"], ["_k", "_kind"])
    u = pp.unionByName(pc).withColumn("_at", F.last("_pc", ignorenulls=True).over(w)) \
          .filter(F.col("_kind") == 1)
    k = F.col("_k") - F.col("_at.b0")
    bin_ = F.encode(F.col("_at.piece"), "UTF-8")
    nbp = F.octet_length(F.col("_at.piece"))
    ci = (F.when(F.col("_at").isNull() | (k > nbp) | (F.col("_k") < 0), F.lit(None))
          .when(k == 0, F.col("_at.c0"))
          .when(k == nbp, F.col("_at.c0") + F.char_length(F.col("_at.piece")))
          .when(is_continuation_byte(bin_, k + 1), F.lit(None))
          .otherwise(F.col("_at.c0") + F.char_length(F.decode(F.substring(bin_, F.lit(1), k), "UTF-8"))))
    return u.select("doc_id", "_pt.*", ci.cast("bigint").alias("char_index"))
