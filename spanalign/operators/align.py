"""Boundary joins (ALN-1..6).

All of them are per-document as-of lookups written as one union of
"points" and "targets" followed by ordered windows partitioned by doc_id:
O((points + targets) log) per document instead of a quadratic range join,
and no exchange when both inputs come from a doc_id-partitioned corpus.

Fast paths (each pinned to its general form by a property test):
covering token tables need one ascending window (``_as_of_covering``);
covering spans score word splits inside one row (``covering_word_split``);
regex / chunk spans carrying border characters need no word-run table
(``spans.with_word_split`` and ``align_detail(runs=None)``).
"""

from __future__ import annotations

import heapq
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanalign.functions.patterns import (END_REASON, EXPLAIN_SPAN, EXPLAIN_TOKENS, PREVIEW_CHARS,
                                          START_REASON)
from spanalign.functions.text import is_continuation_byte, preview, rule_key
from spanalign.operators.offsets import running

RULE_ID = ["doc_id", "type", "span_id"]


def boundary_points(rules: DataFrame, keep=("grp",), carry=()) -> DataFrame:
    """Two points per rule: side 's' at its start, side 'e' at its end."""
    sides = F.array(F.struct(F.lit("s").alias("side"), F.col("s").alias("p")),
                    F.struct(F.lit("e").alias("side"), F.col("e").alias("p")))
    return rules.select(*RULE_ID, *keep, *carry, F.inline(sides))


def boundary_context(points: DataFrame, runs: DataFrame | None = None,
                     toks: DataFrame | None = None, p: str = "p") -> DataFrame:
    """For every point: the word run and the token that start strictly before
    it (the only candidates to contain it when targets do not overlap), plus
    the running maximum token end (exact containment test for any tokens).

    Adds: mid_word, left_ch, right_ch (when mid_word), tok (struct of the
    containing token or null), in_token."""
    pcols = [c for c in points.columns if c != "doc_id"]
    P = points.select("doc_id", F.col(p).alias("_k"), F.lit(0).alias("_kind"), F.struct(*pcols).alias("_pt"))
    parts = []
    if runs is not None:
        # a run cut into bounded pieces goes on with ``next_ch``; a user's own runs end where they end
        following = F.col("next_ch") if "next_ch" in runs.columns else F.lit(None).cast("string")
        parts.append(runs.select("doc_id", F.col("s").alias("_k"), F.lit(1).alias("_kind"),
                                 F.struct("s", "e", "piece", following.alias("next_ch")).alias("_run")))
    if toks is not None:
        tcols = ["tok_id", "s", "e"] + (["piece"] if "piece" in toks.columns else [])
        parts.append(toks.select("doc_id", F.col("s").alias("_k"), F.lit(1).alias("_kind"),
                                 F.struct(*tcols).alias("_tok")))
    u = P
    for q in parts:
        u = u.unionByName(q, allowMissingColumns=True)
    order = ["_k", "_kind"]
    if toks is not None:
        # among targets starting at one offset the lowest token id wins
        order.append(F.coalesce(-F.col("_tok.tok_id"), F.lit(0)))
    w = running(["doc_id"], order)
    if runs is not None:
        u = u.withColumn("_lrun", F.last("_run", ignorenulls=True).over(w))
    if toks is not None:
        u = u.withColumn("_ltok", F.last("_tok", ignorenulls=True).over(w)) \
             .withColumn("_maxe", F.max("_tok.e").over(w))
    u = u.filter(F.col("_kind") == 0)
    k = F.col("_k")
    out = [F.col("doc_id"), F.col("_pt.*")]
    if runs is not None:
        r = F.col("_lrun")
        off = k - r["s"]
        rb = F.encode(r["piece"], "UTF-8")
        at_cut = (r["e"] == k) & r["next_ch"].isNotNull()
        within = r.isNotNull() & (r["e"] > k) & ~is_continuation_byte(rb, off + 1)
        out += [F.coalesce(within | at_cut, F.lit(False)).alias("mid_word"),
                F.when(at_cut, F.right(r["piece"], F.lit(1)))
                 .when(within, F.right(F.decode(F.substring(rb, F.lit(1), off), "UTF-8"), F.lit(1))).alias("left_ch"),
                F.when(at_cut, r["next_ch"])
                 .when(within, F.left(F.decode(F.substring(rb, off + 1, F.octet_length(r["piece"]) - off), "UTF-8"),
                                      F.lit(1))).alias("right_ch")]
    if toks is not None:
        t = F.col("_ltok")
        out += [F.when(t.isNotNull() & (t["e"] > k), t).alias("tok"),
                F.coalesce(F.col("_maxe") > k, F.lit(False)).alias("in_token")]
    return u.select(*out)


def stab(points: DataFrame, intervals: DataFrame, p: str = "p", disjoint: bool = False, block: int | None = None) -> DataFrame:
    """ALN-1: for each point the interval with s < p < e of the lowest tok_id
    (``tok``, null if none) and whether there is one (``in_token``).

    Intervals may overlap: the sorted starts and points of a document are
    swept with a heap of the open intervals, so memory is a batch and what is
    open at one place. ``disjoint=True`` vouches that they don't (tokens of a
    covering scheme) and stays in as-of windows. With ``block`` (bytes) a
    document is many tasks' work (``operators.blocks``)."""
    if block:
        from spanalign.operators import blocks
        whole = all(isinstance(intervals.schema[c].dataType, T.IntegerType | T.LongType) for c in ("tok_id", "s", "e"))
        if disjoint and whole and "piece" not in intervals.columns:
            return blocks.stab_packed(points, intervals, p, block)
        return blocks.unplaced(stab(blocks.placed(points, block, p), blocks.overlapping(intervals, block), p, disjoint))
    if disjoint:
        return boundary_context(points, toks=intervals, p=p)
    tcols = ["tok_id", "s", "e"] + (["piece"] if "piece" in intervals.columns else [])
    pcols = [c for c in points.columns if c != "doc_id"]
    a = points.select("doc_id", F.col(p).cast("bigint").alias("_k"), F.lit(0).alias("_kind"), F.struct(*pcols).alias("_pt"))
    b = intervals.select("doc_id", F.col("s").cast("bigint").alias("_k"), F.lit(1).alias("_kind"),
                         F.struct(*tcols).alias("_tok"))
    u = a.unionByName(b, allowMissingColumns=True).repartition("doc_id").sortWithinPartitions("doc_id", "_k", "_kind")
    tok = u.schema["_tok"].dataType

    def sweep(batches):
        doc, heap = object(), []
        for batch in batches:
            if not batch.num_rows:
                continue
            col = dict(zip(batch.schema.names, batch.columns))
            rows, found = [], []
            for i, (d, k, kind, t) in enumerate(zip(*(col[c].to_pylist() for c in ("doc_id", "_k", "_kind", "_tok")))):
                if d != doc:
                    doc, heap = d, []
                if kind:
                    if t["tok_id"] is not None and t["e"] is not None:
                        heapq.heappush(heap, (t["tok_id"], t["s"], t["e"], t.get("piece")))
                    continue
                while heap and k is not None and heap[0][2] <= k:   # ended: no later point is inside
                    heapq.heappop(heap)
                rows.append(i)
                found.append(dict(zip(tcols, heap[0])) if heap and k is not None else None)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([col["doc_id"].take(take), col["_pt"].take(take), pa.array(found, batch.schema.field("_tok").type)],
                                             ["doc_id", "_pt", "tok"])

    schema = T.StructType([u.schema["doc_id"], u.schema["_pt"], T.StructField("tok", tok)])
    out = u.mapInArrow(sweep, schema)
    return out.select("doc_id", "_pt.*", "tok", F.col("tok").isNotNull().alias("in_token"))


def rule_word_split(rules: DataFrame, runs: DataFrame, keep=("grp",), carry=("s", "e", "piece"), block: int | None = None) -> DataFrame:
    """ALN-2 (M1): a border is crossing when it falls strictly inside a run
    of word characters (and on a character boundary). One row per rule. With
    ``block`` (bytes) a document is many tasks' work (``operators.blocks``)."""
    carry = [c for c in carry if c in rules.columns]
    pts = boundary_points(rules, keep=keep, carry=carry)
    if block:
        from spanalign.operators import blocks
        ctx = blocks.unplaced(boundary_context(blocks.placed(pts, block), runs=blocks.overlapping(runs, block, touch=True)))
    else:
        ctx = boundary_context(pts, runs=runs)
    side = lambda sd, c: F.max(F.when(F.col("side") == sd, F.col(c)))
    g = ctx.groupBy(*RULE_ID, *keep).agg(
        *[F.first(c).alias(c) for c in carry],
        side("s", "mid_word").alias("crossing_start"), side("e", "mid_word").alias("crossing_end"),
        side("s", "left_ch").alias("_ls"), side("s", "right_ch").alias("_rs"),
        side("e", "left_ch").alias("_le"), side("e", "right_ch").alias("_re"))
    return (g.withColumn("start_aligned", ~F.col("crossing_start"))
             .withColumn("end_aligned", ~F.col("crossing_end"))
             .withColumn("fully_aligned", F.col("start_aligned") & F.col("end_aligned")))


def covering_word_split(pieces) -> F.Column:
    """ALN-2 fast path for covering spans (chunks, pieces) on one row:
    struct(n_rules, n_aligned) without exploding. Border k between pieces
    k-1 and k is crossing when the last character of one and the first of
    the next are both word characters."""
    from spanalign.functions.text import is_word_char
    c = F.col(pieces) if isinstance(pieces, str) else pieces
    n = F.size(c)
    inner = F.zip_with(F.slice(c, 1, F.greatest(n - 1, F.lit(0))), F.slice(c, 2, F.greatest(n - 1, F.lit(0))),
                       lambda a, b: is_word_char(F.right(a, F.lit(1))) & is_word_char(F.left(b, F.lit(1))))
    mw = F.concat(F.array(F.lit(False)), inner, F.array(F.lit(False)))
    ok = F.zip_with(F.slice(mw, 1, n), F.slice(mw, 2, n), lambda a, b: ~a & ~b)
    return F.when(n == 0, F.struct(F.lit(0).alias("n_rules"), F.lit(0).alias("n_aligned"))).otherwise(
        F.struct(n.alias("n_rules"), F.size(F.filter(ok, lambda x: x)).alias("n_aligned")))


def _as_of_targets(points: DataFrame, toks: DataFrame, extra_parts=()) -> DataFrame:
    """Nearest target at or below and at or above each point, per side:
    rule starts look at token starts, rule ends at token ends."""
    pcols = [c for c in points.columns if c not in ("doc_id", *extra_parts)]
    P = points.select("doc_id", *extra_parts, "side", F.col("p").alias("_k"), F.lit(1).alias("_kind"),
                      F.struct(*pcols).alias("_pt"))
    tg = toks.select("doc_id", *extra_parts, F.inline(F.array(
        F.struct(F.lit("s").alias("side"), F.col("s").alias("_k"), F.col("tok_id").alias("_id")),
        F.struct(F.lit("e").alias("side"), F.col("e").alias("_k"), F.col("tok_id").alias("_id")))))
    tg = tg.select("doc_id", *extra_parts, "side", "_k", F.lit(0).alias("_kind"),
                   F.struct(F.col("_k").alias("pos"), F.col("_id").alias("id")).alias("_tg"))
    u = P.unionByName(tg, allowMissingColumns=True)
    parts = ["doc_id", *extra_parts, "side"]
    tie = F.coalesce(-F.col("_tg.id"), F.lit(0))
    w_up = running(parts, [F.col("_k").asc(), F.col("_kind").asc(), tie])
    w_dn = running(parts, [F.col("_k").desc(), F.col("_kind").asc(), tie])
    u = (u.withColumn("_lo", F.last("_tg", ignorenulls=True).over(w_up))
          .withColumn("_hi", F.last("_tg", ignorenulls=True).over(w_dn))
          .filter(F.col("_kind") == 1))
    d_lo = F.col("_k") - F.col("_lo.pos")
    d_hi = F.col("_hi.pos") - F.col("_k")
    near = (F.when(F.col("_lo").isNull(), F.col("_hi.id"))
            .when(F.col("_hi").isNull(), F.col("_lo.id"))
            .when(d_lo < d_hi, F.col("_lo.id")).when(d_hi < d_lo, F.col("_hi.id"))
            .otherwise(F.least(F.col("_lo.id"), F.col("_hi.id"))))
    return u.select("doc_id", *extra_parts, "_pt.*", F.least(d_lo, d_hi).alias("dist"), near.alias("nearest"))


def _as_of_covering(points: DataFrame, toks: DataFrame, extra_parts=()) -> DataFrame:
    """Nearest border for covering tokens (contiguous, non-overlapping, in
    id order, as every regex scheme produces): the token holding p (or
    starting at p) is found by ONE ascending as-of window over one row per
    token; its start and end are the only candidates on both sides, with
    the previous token's end (= this start) and the next token's start
    (= this end)."""
    pcols = [c for c in points.columns if c not in ("doc_id", *extra_parts)]
    P = points.select("doc_id", *extra_parts, F.col("p").alias("_k"), F.lit(1).alias("_kind"),
                      F.struct(*pcols).alias("_pt"))
    T = toks.select("doc_id", *extra_parts, F.col("s").alias("_k"), F.lit(0).alias("_kind"),
                    F.struct("tok_id", "s", "e", "is_last").alias("_tk"))
    w = running(["doc_id", *extra_parts], ["_k", "_kind"])
    u = (P.unionByName(T, allowMissingColumns=True)
          .withColumn("_t", F.last("_tk", ignorenulls=True).over(w)).filter(F.col("_kind") == 1))
    p, t = F.col("_k"), F.col("_t")
    d_lo, d_hi = p - t["s"], t["e"] - p
    is_start = F.col("_pt.side") == "s"
    # start side: candidates tok (at s) and tok+1 (at e, absent when e is the text end)
    # end side: candidates tok-1 (at s, absent for the first token) and tok (at e)
    lo_id = F.when(is_start, t["tok_id"]).otherwise(F.when(t["tok_id"] > 0, t["tok_id"] - 1))
    hi_id = F.when(is_start, t["tok_id"] + 1).otherwise(t["tok_id"])
    lo_ok = lo_id.isNotNull()
    hi_ok = F.when(is_start, ~t["is_last"]).otherwise(F.lit(True))
    dist = F.when(lo_ok & hi_ok, F.least(d_lo, d_hi)).when(lo_ok, d_lo).otherwise(d_hi)
    near = (F.when(lo_ok & hi_ok, F.when(d_lo <= d_hi, lo_id).otherwise(hi_id))
            .when(lo_ok, lo_id).otherwise(hi_id))
    return u.select("doc_id", *extra_parts, "_pt.*", F.when(t.isNotNull(), dist).alias("dist"),
                    F.when(t.isNotNull(), near).alias("nearest"), F.col("_t.e").alias("_te"))


def nearest_token(rules: DataFrame, toks: DataFrame, tol: int = 1, keep=("grp",), schemes=None,
                  covering: bool = False, block: int | None = None) -> DataFrame:
    """ALN-3/ALN-4 (M2): per rule the nearest token start to its start and the
    nearest token end to its end (ties -> lowest token id; no tokens -> null)
    and the tolerance flags |distance| <= tol.

    With ``schemes`` (a short list of names) ``toks`` holds several schemes;
    rule points are repeated per scheme by a generator over that literal
    list, never by a join, and the windows run per (doc_id, scheme). With
    ``block`` (bytes) a document is many tasks' work (``operators.blocks``)."""
    carry = [c for c in ("s", "e") if c in rules.columns]
    pts = boundary_points(rules, keep=keep, carry=carry)
    extra = []
    if schemes:
        ids = F.array(*[F.struct(F.lit(k).alias("scheme_id"), F.lit(x).alias("scheme")) for k, x in enumerate(schemes)])
        pts = pts.select("*", F.inline(ids))
        extra = ["scheme_id"]
    fast = covering and "is_last" in toks.columns
    if block:
        from spanalign.operators import blocks
        spread = blocks.overlapping(toks, block, touch=True) if fast else blocks.with_nearest(toks, pts, block, extra)
        pts, toks = blocks.placed(pts, block), spread
    x = _as_of_covering(pts, toks, extra) if fast else _as_of_targets(pts, toks, extra_parts=extra)
    if block:
        x = blocks.unplaced(x)
    side = lambda sd, c: F.max(F.when(F.col("side") == sd, F.col(c)))
    g = x.groupBy(*RULE_ID, *extra, *(["scheme"] if schemes else []), *keep).agg(
        *[F.first(c).alias(c) for c in carry],
        side("s", "nearest").alias("start_token"), side("s", "dist").alias("start_distance"),
        side("e", "nearest").alias("end_token"), side("e", "dist").alias("end_distance"))
    return (g.withColumn("start_aligned", F.coalesce(F.col("start_distance") <= tol, F.lit(False)))
             .withColumn("end_aligned", F.coalesce(F.col("end_distance") <= tol, F.lit(False)))
             .withColumn("fully_aligned", F.col("start_aligned") & F.col("end_aligned")))


def tolerance_align(rules: DataFrame, toks: DataFrame, tol: int = 1, keep=("grp",), schemes=None,
                    covering: bool = False, block: int | None = None) -> DataFrame:
    """ALN-3 (M2) flags per rule (and scheme)."""
    return nearest_token(rules, toks, tol=tol, keep=keep, schemes=schemes, covering=covering, block=block)


def covering_tolerance(rules: DataFrame, toks: DataFrame, schemes, tol: int = 1, keep=("grp",)) -> DataFrame:
    """ALN-3 (M2) for covering rules (chunks) under several covering schemes
    (``multi_scheme_tokens``): one row per rule and scheme with its flags.

    The end of a rule is the start of the next one, so each border is one
    point; the token that holds it gives the nearest starts and ends on both
    sides, and a rule takes the start flag of the border before it. The first
    rule starts at 0, where the first token starts."""
    ids = F.array(*[F.struct(F.lit(k).alias("scheme_id"), F.lit(x).alias("scheme")) for k, x in enumerate(schemes)])
    pts = rules.select("doc_id", *keep, F.col("e").alias("_k"), F.inline(ids)).withColumn("_kind", F.lit(1))
    tks = toks.select("doc_id", "scheme_id", F.col("s").alias("_k"), F.lit(0).alias("_kind"), F.struct("tok_id", "s", "e", "is_last").alias("_tk"))
    at = running(["doc_id", "scheme_id"], ["_k", "_kind"])
    u = pts.unionByName(tks, allowMissingColumns=True).withColumn("_t", F.last("_tk", ignorenulls=True).over(at)).filter(F.col("_kind") == 1)
    low, high = F.col("_k") - F.col("_t.s") <= tol, F.col("_t.e") - F.col("_k") <= tol
    u = u.select("doc_id", *keep, "scheme_id", "scheme", "_k", (low | (high & ~F.col("_t.is_last"))).alias("_starts"),
                 ((low & (F.col("_t.tok_id") > 0)) | high).alias("end_aligned"))
    before = Window.partitionBy("doc_id", "scheme_id").orderBy("_k")
    return u.select("doc_id", *keep, "scheme", F.col("_k").alias("e"), F.lag("_starts", 1, True).over(before).alias("start_aligned"), "end_aligned") \
            .withColumn("fully_aligned", F.col("start_aligned") & F.col("end_aligned"))


def token_cut(rules: DataFrame, toks: DataFrame, keep=("grp",), block: int | None = None) -> DataFrame:
    """ALN-6 (M3 promoted): a border is cut when it lies strictly inside a
    token. One row per rule with both flags. With ``block`` (bytes) a document
    is many tasks' work (``operators.blocks``)."""
    carry = [c for c in ("s", "e") if c in rules.columns]
    pts = boundary_points(rules, keep=keep, carry=carry)
    if block:
        from spanalign.operators import blocks
        ctx = blocks.unplaced(boundary_context(blocks.placed(pts, block), toks=blocks.overlapping(toks, block)))
    else:
        ctx = boundary_context(pts, toks=toks)
    side = lambda sd: F.max(F.when(F.col("side") == sd, F.col("in_token")))
    g = ctx.groupBy(*RULE_ID, *keep).agg(*[F.first(c).alias(c) for c in carry],
                                         side("s").alias("start_cut"), side("e").alias("end_cut"))
    return g.withColumn("uncut", ~F.col("start_cut") & ~F.col("end_cut"))


def align_detail(rules: DataFrame, runs: DataFrame | None, toks: DataFrame, keep=("grp",),
                 token_source: str = "offset_mapping") -> DataFrame:
    """ALN-5: per-rule detail record. Word-run and token lookups share one
    window; token context is filled for crossing sides only. With
    ``runs=None`` the rules must carry their border characters
    (``extract_spans`` / ``chunk_spans`` with ``border_chars=True``)."""
    carry = [c for c in ("s", "e", "piece") if c in rules.columns]
    if "piece" in toks.columns:   # only a preview of a token is shown: sort and shuffle no more
        toks = toks.withColumn("piece", preview("piece", PREVIEW_CHARS))
    if "piece" in rules.columns:
        rules = rules.withColumn("piece", preview("piece", PREVIEW_CHARS))
    if runs is None:
        # border characters carried by regex / chunk spans decide M1 directly
        from spanalign.functions.text import is_word_char
        border = ["ls", "rs", "le", "re"]
        ctx = boundary_context(boundary_points(rules, keep=keep, carry=carry + border), toks=toks)
        st = F.col("side") == "s"
        lc = F.when(st, F.col("ls")).otherwise(F.col("le"))
        rc = F.when(st, F.col("rs")).otherwise(F.col("re"))
        mid = is_word_char(lc) & is_word_char(rc)
        ctx = (ctx.withColumn("mid_word", mid).withColumn("left_ch", F.when(mid, lc))
                  .withColumn("right_ch", F.when(mid, rc)).drop(*border))
    else:
        ctx = boundary_context(boundary_points(rules, keep=keep, carry=carry), runs=runs, toks=toks)
    side = lambda sd, c: F.max(F.when(F.col("side") == sd, F.col(c)))
    ctx_tok = F.when(F.col("mid_word") & F.col("tok").isNotNull(), F.struct(
        F.col("tok.tok_id").alias("token_index"), F.col("tok.s").alias("token_start"),
        F.col("tok.e").alias("token_end"), preview(F.col("tok.piece"), PREVIEW_CHARS).alias("token_text_preview")))
    ctx = ctx.withColumn("_ctx", ctx_tok)
    g = ctx.groupBy(*RULE_ID, *keep).agg(
        *[F.first(c).alias(c) for c in carry],
        side("s", "mid_word").alias("crossing_start"), side("e", "mid_word").alias("crossing_end"),
        side("s", "left_ch").alias("_ls"), side("s", "right_ch").alias("_rs"),
        side("e", "left_ch").alias("_le"), side("e", "right_ch").alias("_re"),
        F.first(F.when(F.col("side") == "s", F.col("_ctx")), ignorenulls=True).alias("token_start_context"),
        F.first(F.when(F.col("side") == "e", F.col("_ctx")), ignorenulls=True).alias("token_end_context"))
    source = F.lit(token_source)
    if "token_source" in toks.columns:
        # per-document label (e.g. single_byte_fallback from fill_missing_tokens);
        # both sides are keyed and partitioned by doc_id, so the join adds no exchange
        labels = toks.groupBy("doc_id").agg(F.max("token_source").alias("_src"))
        g = g.join(labels, "doc_id", "left")
        source = F.coalesce(F.col("_src"), source)
    return detail_records(g, keep, source, "piece" in carry)


def _filled(fmt: str, *cols: F.Column) -> F.Column:
    """``format_string`` of plain places (%d, %s) as a concatenation, which takes
    a fraction of its time; null is "null" there too."""
    texts = re.split("%[ds]", fmt)
    parts = [p for c, t in zip(cols, texts[1:], strict=True) for p in (F.coalesce(c.cast("string"), F.lit("null")), F.lit(t))]
    return F.concat(F.lit(texts[0]), *parts)


def detail_records(g: DataFrame, keep, source, with_preview: bool) -> DataFrame:
    """ALN-5's record of each row of ``g``: rule ids, ``s, e``, the crossing
    flags, the characters around the borders (``_ls, _rs, _le, _re``) and the
    token contexts."""
    reason = lambda fmt, pos, l, r: _filled(fmt, F.col(pos), F.coalesce(F.col(l), F.lit("")),
                                            F.coalesce(F.col(r), F.lit("")))
    return g.select(
        *RULE_ID, *keep, rule_key("type", "s", "e").alias("rule_key"),
        F.col("s").alias("start_byte"), F.col("e").alias("end_byte"),
        (~F.col("crossing_start")).alias("start_aligned"), (~F.col("crossing_end")).alias("end_aligned"),
        "crossing_start", "crossing_end",
        F.when(F.col("crossing_start"), reason(START_REASON, "s", "_ls", "_rs")).alias("crossing_start_reason"),
        F.when(F.col("crossing_end"), reason(END_REASON, "e", "_le", "_re")).alias("crossing_end_reason"),
        "token_start_context", "token_end_context",
        _filled(EXPLAIN_SPAN, F.col("type"), F.col("s"), F.col("e")).alias("explain_tree_sitter"),
        F.format_string(EXPLAIN_TOKENS, source).alias("explain_tokenizer"),
        (~F.col("crossing_start") & ~F.col("crossing_end")).alias("fully_aligned"),
        *([preview("piece", PREVIEW_CHARS).alias("text_preview")] if with_preview else []))
