"""Token boundaries (TOK-1..5) under named schemes or from user tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from spanalign.functions.patterns import NON_WORD_CHAR, RUN_PATTERN, TOKEN_SCHEMES, WORD_CHAR
from spanalign.operators.bpe import bpe_tokens, is_bpe
from spanalign.operators.offsets import running, with_offsets


#: Characters of a word run that one row carries.
RUN_CHARS = 64


def scheme_pattern(scheme: str) -> str:
    return TOKEN_SCHEMES.get(scheme, scheme)


def scheme_pieces(text, scheme: str) -> Column:
    """Pieces of a covering scheme, in order."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(text, F.lit(scheme_pattern(scheme)), F.lit(0))


def tokens(docs: DataFrame, scheme: str = "word", keep=("grp",), covering: bool | None = None,
           utf16: bool = False) -> DataFrame:
    """TOK-1: token table (doc_id, scheme, tok_id, s, e, cs, ce, piece).

    Known schemes cover the text, so a running sum of piece lengths gives
    offsets. ``bpe:<path>`` is a learned byte-pair vocabulary (``operators.bpe``).
    Any other regex is treated as non-covering and split around its matches
    (gaps carry only lengths)."""
    if is_bpe(scheme):
        if utf16:
            raise ValueError("UTF-16 offsets are of regex schemes")
        return bpe_tokens(docs, [scheme], keep=keep).drop("scheme_id")
    if covering is None:
        covering = scheme in TOKEN_SCHEMES or scheme == RUN_PATTERN
    if covering:
        x = docs.select("doc_id", *keep, F.posexplode(scheme_pieces("text", scheme)).alias("tok_id", "piece"))
        x = with_offsets(x, order=("tok_id",), carried=keep, utf16=utf16)
        return x.select("doc_id", *keep, F.lit(scheme).alias("scheme"), F.col("tok_id").cast("int"),
                        F.col("b0").alias("s"), F.col("b1").alias("e"),
                        F.col("c0").alias("cs"), F.col("c1").alias("ce"), "piece", "is_last",
                        *(["u0", "u1"] if utf16 else []))
    from spanalign.operators.spans import extract_spans
    sp = extract_spans(docs, {scheme: scheme_pattern(scheme)}, keep=keep)
    return sp.select("doc_id", *keep, F.lit(scheme).alias("scheme"), F.col("span_id").alias("tok_id"),
                     "s", "e", "cs", "ce", "piece")


def _covering(schemes, covering: bool) -> None:
    for sc in schemes:
        if not (covering or sc in TOKEN_SCHEMES or sc == RUN_PATTERN):
            raise ValueError(f"offsets from piece lengths need a scheme whose pieces cover the text: {sc!r} is not known to "
                             "(use tokens(), or covering=True if its pieces do)")


def multi_scheme_tokens(docs: DataFrame, schemes, keep=("grp",), with_piece: bool = False,
                        covering: bool = False, counted: DataFrame | None = None) -> DataFrame:
    """Tokens of several covering schemes from one generator per document (a
    user's regex only with ``covering=True``, which vouches for it).
    Without ``with_piece`` the rows carry only byte lengths (computed inside
    the generator), not the token strings; ``is_last`` comes from the piece
    array's size, so the offset window holds a single running sum. Learned
    vocabularies (``bpe:<path>``) stand by themselves: all or none of
    ``schemes``; ``counted`` is of ``bpe_tokens``."""
    if all(map(is_bpe, schemes)):
        return bpe_tokens(docs, schemes, keep=keep, counted=counted).drop("cs", "ce", *([] if with_piece else ["piece"]))
    _covering(schemes, covering)
    arrays = {f"_a{k}": scheme_pieces("text", sc) for k, sc in enumerate(schemes)}
    base = docs.select("doc_id", *keep, *[c.alias(n) for n, c in arrays.items()])

    if len(schemes) == 1:
        # outer: a filter that drops texts without pieces would run their regex before the exchange as well
        x = base.select("doc_id", *keep, F.size("_a0").alias("_n"), F.posexplode_outer("_a0").alias("tok_id", "piece")).filter("piece IS NOT NULL")
        x = x.select("doc_id", *keep, F.lit(0).alias("scheme_id"), "tok_id", F.octet_length("piece").cast("bigint").alias("nb"),
                     (F.col("tok_id") == F.col("_n") - 1).alias("is_last"), *(["piece"] if with_piece else []))
    else:
        def tagger(sc, arr):
            last = F.size(F.col(arr)) - 1

            def f(x, i):
                cols = [F.lit(schemes.index(sc)).alias("scheme_id"), i.alias("tok_id"),
                        F.octet_length(x).cast("bigint").alias("nb"), (i == last).alias("is_last")]
                return F.struct(*cols, *([x.alias("piece")] if with_piece else []))
            return f

        arrs = [F.transform(F.col(n), tagger(sc, n)) for n, sc in zip(arrays, schemes)]
        allp = arrs[0] if len(arrs) == 1 else F.concat(*arrs)
        x = base.select("doc_id", *keep, F.explode(allp).alias("_t")).select("doc_id", *keep, "_t.*")
    # integer scheme id in the partition key, carried columns after the order key
    w = running(["doc_id", "scheme_id"], ["tok_id", *keep])
    x = x.withColumn("e", F.sum("nb").over(w))
    name = F.element_at(F.array(*[F.lit(sc) for sc in schemes]), F.col("scheme_id") + 1)
    return x.select("doc_id", *keep, name.alias("scheme"), "scheme_id", F.col("tok_id").cast("int"),
                    (F.col("e") - F.col("nb")).alias("s"), "e", *(["piece"] if with_piece else []), "is_last")


def boundaries(docs: DataFrame, scheme: str, keep=("grp",)) -> DataFrame:
    """Token offsets of one covering scheme without the token strings
    (enough for tolerance, nearest-token and token-cut tests)."""
    if is_bpe(scheme):
        return bpe_tokens(docs, [scheme], keep=keep).drop("scheme", "scheme_id", "cs", "ce", "piece")
    return multi_scheme_tokens(docs, [scheme], keep=keep).drop("scheme", "scheme_id")


def _count(sc: str):
    if is_bpe(sc):
        raise ValueError("tokens of a learned vocabulary are counted by bpe.bpe_token_counts")
    # the char scheme has one piece per code point: its count is the length
    if sc == "char":
        return F.char_length("text")
    return F.regexp_count("text", F.lit(scheme_pattern(sc)))


def token_counts(docs: DataFrame, schemes, keep=("grp",)) -> DataFrame:
    """Pieces per document and scheme, counted without building piece arrays."""
    arr = F.array(*[F.struct(F.lit(sc).alias("scheme"), _count(sc).cast("bigint").alias("n_tokens"))
                    for sc in schemes])
    return docs.select("doc_id", *keep, F.inline(arr))


def word_runs(docs: DataFrame, keep=(), longest: int = RUN_CHARS) -> DataFrame:
    """Runs of word characters with byte offsets (the M1 stab targets): word
    and other runs cover the text, word runs are kept. A run of more than
    ``longest`` characters is several rows, so that no row carries a long
    text; ``next_ch`` is the character with which the run goes on, else null."""
    x = docs.select("doc_id", *keep, F.posexplode(F.regexp_extract_all(
        "text", F.lit(bounded_runs(WORD_CHAR, NON_WORD_CHAR, longest)), F.lit(0))).alias("i", "piece"))
    return _runs(x, WORD_CHAR, keep)


def bounded_runs(inside: str, outside: str, longest: int = RUN_CHARS) -> str:
    return f"{inside}{{1,{longest}}}|{outside}{{1,{longest}}}"


def _runs(pieces: DataFrame, inside: str, keep) -> DataFrame:
    x = with_offsets(pieces, carried=keep, chars=False)
    following = F.lead("piece").over(Window.partitionBy("doc_id").orderBy("i", *keep))
    x = x.withColumn("next_ch", F.when(following.rlike("^" + inside), F.left(following, F.lit(1))))
    return x.filter(F.col("piece").rlike("^" + inside)).select(
        "doc_id", *keep, F.col("b0").alias("s"), F.col("b1").alias("e"), "piece", "next_ch")


@F.pandas_udf(T.ArrayType(T.LongType()))
def char_to_byte(text: pd.Series, pos: pd.Series) -> pd.Series:
    """Byte offset of each character position (positions must lie in
    [0, len(text)]). Vectorised per document on the UTF-8 bytes: character
    starts are the bytes that are not continuation bytes."""
    out = []
    for t, p in zip(text, pos):
        if t is None or p is None:
            out.append(None)
            continue
        b = np.frombuffer(t.encode("utf-8"), dtype=np.uint8)
        c2b = np.append(np.flatnonzero((b & 0xC0) != 0x80), len(b))
        out.append(c2b[np.asarray(p, dtype=np.int64)])
    return pd.Series(out)


def clean_offsets(pairs: DataFrame, s: str = "s", e: str = "e", n: str = "n_chars") -> DataFrame:
    """OFF-4: drop null pairs and e <= s, clamp to [0, n]."""
    lo, hi = F.lit(0), F.col(n)
    return (pairs.filter(F.col(s).isNotNull() & F.col(e).isNotNull() & (F.col(e) > F.col(s)))
            .withColumn(s, F.greatest(lo, F.least(F.col(s), hi)))
            .withColumn(e, F.greatest(lo, F.least(F.col(e), hi))))


def tokens_from_table(df: DataFrame, offsets: str = "offsets", text: str = "text",
                      unit: str = "char", keep=()) -> DataFrame:
    """TOK-2: pre-tokenised input, ``offsets`` = array<struct<s,e>> in
    characters (or bytes). Pairs are cleaned (OFF-4), character offsets are
    mapped to bytes, pairs empty after mapping are dropped, and the pairs that
    are left are numbered from 0."""
    kinds = [f.dataType for f in df.schema[offsets].dataType.elementType.fields if f.name in ("s", "e")]
    if not all(isinstance(k, T.IntegerType | T.LongType) for k in kinds):   # compared as they are, then whole numbers
        ok = F.filter(offsets, lambda o: o["s"].isNotNull() & o["e"].isNotNull() & (o["e"] > o["s"]))
        given = F.transform(ok, lambda o: F.struct(o["s"].cast("bigint").alias("s"), o["e"].cast("bigint").alias("e")))
    else:
        given = F.col(offsets)
    x = df.select("doc_id", *keep, F.posexplode(cleaned_offsets(unit)(F.col(text), given)).alias("tok_id", "_z"))
    return x.select("doc_id", *keep, F.col("tok_id").cast("int"), "_z.s", "_z.e", "_z.cs", "_z.ce")


#: Pairs of offsets that leave Python at once, about.
PAIRS = 1 << 18


def cleaned_offsets(unit: str):
    """A column of (s, e, cs, ce) from a text and its pairs: cleaned as in OFF-4,
    in bytes and as given, without those that are empty in bytes."""
    kind = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("s", "e", "cs", "ce")]))

    @F.arrow_udf(kind)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        lists = to_arrow_type(kind)
        for text, pairs in batches:
            n = pc.fill_null(pc.list_value_length(pairs), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            group = np.cumsum(n) // PAIRS
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(n)]
            for low, high in zip(cuts, cuts[1:], strict=False):
                s, e = (c for c, f in zip(pairs.slice(low, high - low).flatten().flatten(), pairs.type.value_type, strict=True) if f.name in ("s", "e"))
                ok = pc.and_(s.is_valid(), e.is_valid()).to_numpy(zero_copy_only=False)
                s, e = (c.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in (s, e))
                ok &= e > s
                at = np.concatenate([[0], np.cumsum(n[low:high])])
                cs, ce, bs, be = (np.zeros(len(s), dtype=np.int64) for _ in range(4))
                for i, t in enumerate(text.slice(low, high - low)):
                    a, z = at[i], at[i + 1]
                    if a == z or not t.is_valid:
                        continue
                    data = np.frombuffer(t.as_buffer(), dtype=np.uint8)
                    first = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data)) if unit == "char" else None
                    most = len(data) if first is None else len(first) - 1
                    cs[a:z], ce[a:z] = np.clip(s[a:z], 0, most), np.clip(e[a:z], 0, most)
                    bs[a:z], be[a:z] = (cs[a:z], ce[a:z]) if first is None else (first[cs[a:z]], first[ce[a:z]])
                ok &= be > bs
                ends = np.concatenate([[0], np.cumsum(ok)])[at]
                rows = pa.StructArray.from_arrays([pa.array(c[ok]) for c in (bs, be, cs, ce)], fields=list(lists.value_type))
                yield pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), rows, type=lists)
    return run


def fill_missing_tokens(docs: DataFrame, toks: DataFrame, keep=("grp",)) -> DataFrame:
    """TOK-4: documents without any token get one token per byte
    (source ``single_byte_fallback``); others keep theirs (``offset_mapping``).

    One marker row per document is unioned with the tokens and grouped by
    doc_id - no join, and the grouping reuses the doc_id partitioning."""
    marks = docs.select("doc_id", *keep, F.octet_length("text").cast("bigint").alias("_nb"),
                        F.lit(None).cast("int").alias("_tok"))
    have = toks.select("doc_id", *keep, F.lit(None).cast("bigint").alias("_nb"), F.col("tok_id").alias("_tok"))
    per_doc = marks.unionByName(have).groupBy("doc_id", *keep).agg(
        F.count("_tok").alias("_n"), F.max("_nb").alias("_nb"))
    missing = per_doc.filter((F.col("_n") == 0) & (F.col("_nb") > 0))
    fb = missing.select("doc_id", *keep, F.posexplode(
        F.sequence(F.lit(0).cast("bigint"), F.col("_nb") - 1)).alias("tok_id", "s"))
    fb = fb.select("doc_id", *keep, F.col("tok_id").cast("int"), "s", (F.col("s") + 1).alias("e"),
                   F.lit("single_byte_fallback").alias("token_source"))
    base = toks.select("doc_id", *keep, "tok_id", "s", "e", F.lit("offset_mapping").alias("token_source"))
    return base.unionByName(fb)


def token_table(toks: DataFrame, keep=("grp",), token_source: str | None = None) -> DataFrame:
    """TOK-5: id, piece, start, end, quoted text, per-document count and
    (when given, or carried by ``fill_missing_tokens``) the source label
    offset_mapping / heuristic_decode / single_byte_fallback."""
    w = F.count(F.lit(1)).over(Window.partitionBy("doc_id"))
    src = ([F.lit(token_source).alias("token_source")] if token_source
           else [F.col("token_source")] if "token_source" in toks.columns else [])
    return toks.select("doc_id", *keep, "tok_id", "s", "e", "piece",
                       F.concat(F.lit("'"), F.col("piece"), F.lit("'")).alias("quoted"),
                       w.alias("n_tokens"), *src)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("s", T.LongType()), T.StructField("e", T.LongType())])))
def locate_pieces_udf(text: pd.Series, pieces: pd.Series) -> pd.Series:
    """TOK-3 per-row fold: search each piece forward from a cursor in the
    UTF-8 bytes; a blank or missing piece becomes a one-byte placeholder at
    the cursor and advances it by one (capped at the text end)."""
    out = []
    for t, ps in zip(text, pieces):
        if t is None or ps is None:
            out.append(None)
            continue
        data = t.encode("utf-8")
        cur, res = 0, []
        for pc in ps:
            pb = (pc or "").encode("utf-8")
            pos = data.find(pb, cur) if pb.strip() else -1
            if pos >= 0:
                res.append({"s": pos, "e": pos + len(pb)})
                cur = pos + len(pb)
            else:
                res.append({"s": cur, "e": min(cur + 1, len(data))})
                cur = min(cur + 1, len(data))
        out.append(res)
    return pd.Series(out)


def locate_pieces(df: DataFrame, text: str = "text", pieces: str = "pieces", keep=()) -> DataFrame:
    """TOK-3: reconcile piece strings with their text -> token rows."""
    x = df.select("doc_id", *keep, F.posexplode(locate_pieces_udf(F.col(text), F.col(pieces))).alias("tok_id", "_t"))
    return x.select("doc_id", *keep, F.col("tok_id").cast("int"), F.col("_t.s").alias("s"), F.col("_t.e").alias("e"))
