"""Spans (SPN-1..8): typed, possibly nested byte spans per document.

Spans are the "rules" whose borders get tested. They come from declarative
regex patterns (SPN-1), fixed-size character chunks (SPN-3) or a user's own
span table (SPN-2, e.g. the output of a parser run elsewhere).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanalign.functions.text import preview, rule_key, show_newlines
from spanalign.operators.offsets import running, with_offsets

def check_pattern(spark: SparkSession, pattern: str) -> None:
    """Reject a pattern that matches the empty text, as Spark's own matcher
    sees it (a constant expression, no job)."""
    if spark.sql("SELECT size(regexp_extract_all('', :p, 0)) AS n", args={"p": pattern}).first()["n"]:
        raise ValueError(f"pattern matches the empty string: {pattern!r}")


#: Marks put around matches; a text that holds one of them is split without marks.
OPEN, CLOSE = "\uE000", "\uE001"


def regex_parts(text, pattern: str) -> Column:
    """[gap0, match1, gap1, match2, ...]: odd positions are the matches.

    One pass of the matcher puts marks around the matches, at which the text is
    then split. A text that holds a mark itself takes two passes instead: the
    gaps between the matches and the matches, from the same Java matcher,
    interleaved. A pattern that matches the empty string in a text is an error
    when that text is read."""
    text = F.col(text) if isinstance(text, str) else text
    wrong = F.raise_error(F.lit(f"pattern matches the empty string: {pattern}"))
    marked = F.regexp_replace(text, F.lit(pattern), F.lit(f"{OPEN}$0{CLOSE}"))
    # one element, so that the marked text is made once
    fast = F.get(F.transform(F.array(marked), lambda m: F.when(F.contains(m, F.lit(OPEN + CLOSE)), wrong).otherwise(F.split(m, F.lit(f"[{OPEN}{CLOSE}]"), -1))), 0)
    gaps, hits = F.split(text, F.lit(pattern), -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.flatten(F.zip_with(gaps, hits, lambda g, m: F.when(m.isNull(), F.array(g)).otherwise(F.array(g, m))))
    empty = F.exists(hits, lambda m: m == "") | (F.size(gaps) != F.size(hits) + 1)
    own = F.contains(text, F.lit(OPEN)) | F.contains(text, F.lit(CLOSE))
    return F.when(own, F.when(empty, wrong).otherwise(parts)).otherwise(fast)


def _border_chars(arr, i, piece, n):
    """Characters around the borders of element ``i`` of a covering array
    whose odd elements are non-empty matches (or whose every element is
    non-empty, as chunks): the neighbour of a possibly empty gap is the match
    beyond it."""
    def prev_last(k):
        return F.when(k >= 0, F.when(F.get(arr, k) != "", F.right(F.get(arr, k), F.lit(1)))
                      .when(k >= 1, F.right(F.get(arr, k - 1), F.lit(1))))

    def next_first(k):
        return F.when(k < n, F.when(F.get(arr, k) != "", F.left(F.get(arr, k), F.lit(1)))
                      .when(k + 1 < n, F.left(F.get(arr, k + 1), F.lit(1))))

    return [prev_last(i - 1).alias("ls"), F.left(piece, F.lit(1)).alias("rs"),
            F.right(piece, F.lit(1)).alias("le"), next_first(i + 1).alias("re")]


def with_word_split(spans: DataFrame) -> DataFrame:
    """ALN-2 (M1) from the border characters carried by regex / chunk spans:
    a border splits a word when both characters around it are word
    characters. No word-run table and no extra window are needed."""
    from spanalign.functions.text import is_word_char
    cs = is_word_char("ls") & is_word_char("rs")
    ce = is_word_char("le") & is_word_char("re")
    return (spans.withColumn("crossing_start", cs).withColumn("crossing_end", ce)
                 .withColumn("start_aligned", ~F.col("crossing_start")).withColumn("end_aligned", ~F.col("crossing_end"))
                 .withColumn("fully_aligned", F.col("start_aligned") & F.col("end_aligned")))


def extract_spans(docs: DataFrame, patterns: dict, keep=("grp",), border_chars: bool = False) -> DataFrame:
    """SPN-1: all matches of every ``{type: regex}`` with byte and char
    offsets; nested spans arise from overlapping patterns. One generator per
    document carries every type, gap pieces keep only their lengths. With
    ``border_chars`` the characters around both borders of every match come
    along (ls, rs, le, re) for the M1 test."""
    types = list(patterns)
    for p in patterns.values():
        check_pattern(docs.sparkSession, p)
    cols = {f"_parts{k}": regex_parts("text", patterns[t]) for k, t in enumerate(types)}
    base = docs.select("doc_id", *keep, *[c.alias(n) for n, c in cols.items()])

    def tagger(t, arr):
        n = F.size(F.col(arr))

        def f(x, i):
            extra = _border_chars(F.col(arr), i, x, n) if border_chars else []
            return F.struct(F.lit(types.index(t)).alias("type_id"), i.alias("i"),
                            F.octet_length(x).cast("bigint").alias("nb"),
                            F.char_length(x).cast("bigint").alias("nc"),
                            F.when(i % 2 == 1, x).alias("piece"),
                            *extra)
        return f

    arrs = [F.transform(F.col(f"_parts{k}"), tagger(t, f"_parts{k}")) for k, t in enumerate(types)]
    allp = arrs[0] if len(arrs) == 1 else F.concat(*arrs)
    x = base.select("doc_id", *keep, F.explode(allp).alias("_p")).select("doc_id", *keep, "_p.*")
    # integer type id in the partition key, carried columns after the order key
    w = running(["doc_id", "type_id"], ["i", *keep])
    extra = ["ls", "rs", "le", "re"] if border_chars else []
    tname = F.element_at(F.array(*[F.lit(t) for t in types]), F.col("type_id") + 1)
    x = (x.withColumn("e", F.sum("nb").over(w)).withColumn("ce", F.sum("nc").over(w))
          .filter(F.col("i") % 2 == 1)
          .select("doc_id", *keep, tname.alias("type"), ((F.col("i") - 1) / 2).cast("int").alias("span_id"),
                  (F.col("e") - F.col("nb")).alias("s"), "e",
                  (F.col("ce") - F.col("nc")).alias("cs"), "ce", "piece", *extra))
    return x


def chunk_pieces(text, k: int) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % k), F.lit(0))


def chunk_spans(docs: DataFrame, k: int = 64, keep=("grp",), border_chars: bool = False) -> DataFrame:
    """SPN-3: consecutive k-character chunks as spans (covering). With
    ``border_chars`` the characters around both borders come along."""
    base = docs.select("doc_id", *keep, chunk_pieces("text", k).alias("_c"))
    n = F.size("_c")
    if border_chars:
        arr = F.transform("_c", lambda x, i: F.struct(x.alias("piece"), *_border_chars(F.col("_c"), i, x, n)))
    else:
        arr = F.transform("_c", lambda x, i: F.struct(x.alias("piece")))
    x = base.select("doc_id", *keep, F.posexplode(arr).alias("span_id", "_p")).select("doc_id", *keep, "span_id", "_p.*")
    x = with_offsets(x, order=("span_id",), carried=keep)
    extra = ["ls", "rs", "le", "re"] if border_chars else []
    return x.select("doc_id", *keep, F.lit("chunk").alias("type"), F.col("span_id").cast("int"),
                    F.col("b0").alias("s"), F.col("b1").alias("e"),
                    F.col("c0").alias("cs"), F.col("c1").alias("ce"), "piece", *extra)


def spans_from_table(df: DataFrame, doc="doc_id", type_="type", s="s", e="e",
                     span_id: str | None = None, text_bytes: str | None = None) -> DataFrame:
    """SPN-2: accept spans produced elsewhere. Null types and types starting
    with ERROR are skipped, zero-length spans kept, spans outside
    ``[0, text_bytes]`` or with e < s dropped."""
    out = df.select(F.col(doc).alias("doc_id"), F.col(type_).cast("string").alias("type"),
                    F.col(s).cast("bigint").alias("s"), F.col(e).cast("bigint").alias("e"),
                    *([F.col(span_id).cast("int").alias("span_id")] if span_id else []),
                    *([F.col(text_bytes).cast("bigint").alias("_nb")] if text_bytes else []),
                    *[F.col(c) for c in df.columns if c not in {doc, type_, s, e, span_id, text_bytes}])
    cond = (F.col("type").isNotNull() & ~F.col("type").startswith("ERROR")
            & F.col("s").isNotNull() & F.col("e").isNotNull()
            & (F.col("s") >= 0) & (F.col("e") >= F.col("s")))
    if text_bytes:
        cond = cond & (F.col("e") <= F.col("_nb"))
    out = out.filter(cond)
    return out.drop("_nb") if text_bytes else out


def span_keys(spans: DataFrame) -> DataFrame:
    """SPN-4: ``type_start_end`` key."""
    return spans.withColumn("rule_key", rule_key("type", "s", "e"))


def dedup_spans(spans: DataFrame, keep_cols=("grp",)) -> DataFrame:
    """SPN-4: one row per (doc_id, rule_key); keeps the lowest span_id.
    Groups on a superset of doc_id, so a doc_id partitioning is reused."""
    k = span_keys(spans)
    return k.groupBy("doc_id", "rule_key", *keep_cols).agg(
        F.min("span_id").alias("span_id"), F.first("type").alias("type"),
        F.first("s").alias("s"), F.first("e").alias("e"))


def preorder(spans: DataFrame) -> Window:
    return Window.partitionBy("doc_id").orderBy(F.col("s").asc(), F.col("e").desc(),
                                                F.col("type").asc(), F.col("span_id").asc())


def rule_type_counts(spans: DataFrame, n: int = 10) -> DataFrame:
    """SPN-6: the n most frequent types; ties by first appearance in
    (doc_id, pre-order)."""
    first = F.min(F.struct("doc_id", "s", (-F.col("e")).alias("ne"), "type"))
    return (spans.groupBy("type").agg(F.count(F.lit(1)).alias("n"), first.alias("_first"))
            .orderBy(F.col("n").desc(), F.col("_first").asc()).limit(n)
            .select("type", "n"))


def span_previews(spans: DataFrame, n: int = 50) -> DataFrame:
    """SPN-7: first n characters of each span's text."""
    return spans.withColumn("text_preview", preview("piece", n))


def first_spans(spans: DataFrame, n: int = 5, keep=()) -> DataFrame:
    """SPN-8: first n spans of each document in pre-order, newlines shown
    as the two characters backslash-n."""
    r = spans.withColumn("rank", F.row_number().over(preorder(spans)))
    return r.filter(F.col("rank") <= n).select(
        "doc_id", *keep, "rank", "type", "s", "e", show_newlines("piece").alias("text"))


def span_tree(spans: DataFrame, types=None) -> DataFrame:
    """SPN-5: 0-based pre-order id (s asc, e desc), parent = innermost
    enclosing span earlier in pre-order, and depth. ERROR spans are removed
    beforehand (spans_from_table), so their children attach to the nearest
    kept ancestor.

    With ``types`` (a short list of types, each without overlaps among its own
    spans, as regex spans are) the last span of each type before a row is the
    only one of that type that can enclose it: running windows, no Python.
    Without, any nesting: a stack runs over the sorted spans of a partition
    and is emptied at each new document, so memory is a batch and the depth."""
    x = spans.select("doc_id", "type", F.col("span_id").cast("int"), "s", "e")
    if types is not None:
        x = x.withColumn("id", (F.row_number().over(preorder(x)) - 1).cast("int"))
        before = preorder(x).rowsBetween(Window.unboundedPreceding, -1)
        last = [F.last(F.when(F.col("type") == t, F.struct("id", "e")), ignorenulls=True).over(before).alias(f"_l{k}") for k, t in enumerate(types)]
        x = x.select("*", *last)
        around = F.filter(F.array(*[F.when(F.col(f"_l{k}.e") >= F.col("e"), F.col(f"_l{k}.id")) for k in range(len(types))]), lambda i: i.isNotNull())
        return x.select("doc_id", "type", "span_id", "s", "e", "id", F.array_max(around).alias("parent_id"), F.size(around).alias("depth"))

    def stack(batches):
        import pandas as pd
        doc, n, open_ = object(), 0, []   # open_: (s, e, id) of the enclosing spans
        for pdf in batches:
            pdf = pdf.drop(columns="_n")
            ids, parents, depths = [], [], []
            for d, s, e in zip(pdf["doc_id"].tolist(), pdf["s"].tolist(), pdf["e"].tolist()):
                if d != doc:
                    doc, n, open_ = d, 0, []
                while open_ and not (open_[-1][0] <= s and e <= open_[-1][1]):
                    open_.pop()
                ids.append(n)
                parents.append(open_[-1][2] if open_ else None)
                depths.append(len(open_))
                open_.append((s, e, n))
                n += 1
            yield pdf.assign(id=ids, parent_id=pd.array(parents, dtype="Int32"), depth=depths)

    kind = x.schema["doc_id"].dataType.simpleString()
    # the window asks for whole documents, which spans by document already are (no
    # exchange then), and leaves the rows in its order, so that nothing is sorted twice
    ordered = x.withColumn("_n", F.row_number().over(preorder(x))).sortWithinPartitions("doc_id", "s", F.col("e").desc(), "type", "span_id")
    return ordered.mapInPandas(stack, f"doc_id {kind}, type string, span_id int, s long, e long, id int, parent_id int, depth int")
