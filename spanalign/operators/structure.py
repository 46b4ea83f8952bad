"""Nested spans of code and prose without a parser (SPN-1): brackets, quoted
strings, comments and indentation.

Strings and comments are masked first, so that a bracket inside one is none.
Depth is a prefix sum over a document's brackets: an opener's partner is the
next closer at its depth, which is the very next event at that depth. Lines
are a height profile: a block ends where the profile first comes back to its
header's height, again the next event at that height. Both are windows over
events; no stack and no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanalign.functions.patterns import BRACKETS, COMMENT_STYLES, STRING_PATTERNS
from spanalign.functions.text import possessive
from spanalign.operators.offsets import running, with_offsets

#: Columns a tab counts for in indentation.
TAB = 4


def masked_patterns(comments: str, strings: str) -> dict[str, str]:
    if comments not in COMMENT_STYLES:
        raise ValueError(f"comments must be one of {sorted(COMMENT_STYLES)}")
    return {"comment": COMMENT_STYLES[comments], "string": "|".join(STRING_PATTERNS[q] for q in strings)}


def piece_pattern(comments: str, strings: str) -> str:
    """Covering pieces: a comment, a string, a bracket, an escaped character,
    or a run of anything else."""
    masks = [p for p in masked_patterns(comments, strings).values() if p]
    plain = r"[^()\[\]{}\\/#\"'`]+"
    return "|".join([*masks, r"[()\[\]{}]", r"\\[^\n]", plain, r"(?s:.)"])


def _kind(piece: Column, comments: str, strings: str) -> Column:
    long = F.char_length(piece) > 1
    quote = F.left(piece, F.lit(1)).isin(list(strings)) if strings else F.lit(False)
    starts = {"c": ["//", "/*"], "hash": ["#"], "none": []}[comments]
    comment = F.lit(False)
    for s in starts:
        comment = comment | piece.startswith(s)
    bracket = ~long & piece.isin([c for pair in BRACKETS.values() for c in pair])
    return F.when(comment, "comment").when(quote & long & (F.left(piece, F.lit(1)) == F.right(piece, F.lit(1))), "string").when(bracket, "bracket")


def marks(docs: DataFrame, comments: str = "c", strings: str = "\"'", keep=("grp",)) -> DataFrame:
    """Brackets, strings and comments with byte and character offsets:
    ``doc_id, kind, s, e, cs, ce, ch`` (ch: the bracket)."""
    pattern = possessive(piece_pattern(comments, strings))
    x = docs.select("doc_id", *keep, F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("i", "piece"))
    kind = _kind(F.col("piece"), comments, strings)
    x = x.select("doc_id", *keep, "i", kind.alias("kind"), F.octet_length("piece").cast("bigint").alias("nb"),
                 F.char_length("piece").cast("bigint").alias("nc"), F.when(kind == "bracket", F.col("piece")).alias("ch"))
    w = running(["doc_id"], ["i", *keep])
    x = x.withColumn("e", F.sum("nb").over(w)).withColumn("ce", F.sum("nc").over(w)).filter(F.col("kind").isNotNull())
    return x.select("doc_id", *keep, "kind", (F.col("e") - F.col("nb")).alias("s"), "e", (F.col("ce") - F.col("nc")).alias("cs"), "ce", "ch")


def _numbered(spans: DataFrame, keep) -> DataFrame:
    at = Window.partitionBy("doc_id", "type").orderBy("s", F.col("e").desc())
    return spans.select("doc_id", *keep, "type", (F.row_number().over(at) - 1).cast("int").alias("span_id"), "s", "e", "cs", "ce", "depth")


def paired(brackets: DataFrame, keep=("grp",), jointly: bool = False) -> DataFrame:
    """Each opener of ``marks`` with the next closer at its depth. ``depth``
    counts the open brackets of its kind from 1, below 1 where closers without
    an opener came before. Brackets without a partner give no span.

    By default each kind has a depth of its own, so that a stray bracket costs
    nothing else; ``jointly`` counts all kinds together, and a pair of two
    kinds has the type ERROR (which ``spans_from_table`` drops, as it does for
    a parser's error nodes)."""
    return _partnered(brackets.filter(F.col("kind") == "bracket"), keep, jointly)


def _partnered(marks: DataFrame, keep, jointly: bool) -> DataFrame:
    """``paired``, strings and comments going along with a depth of null: one
    pass over the marks, no union of two."""
    openers = [o for o, _ in BRACKETS.values()]
    name = F.element_at(F.create_map(*[F.lit(x) for name, pair in BRACKETS.items() for ch in pair for x in (ch, name)]), F.col("ch"))
    leaf = F.col("kind") != "bracket"
    x = marks.withColumn("type", F.when(leaf, F.col("kind")).otherwise(name)).withColumn("up", F.col("ch").isin(openers))
    part = ["doc_id"] if jointly else ["doc_id", "type"]
    depth = F.sum(F.when(leaf, 0).when(F.col("up"), 1).otherwise(-1)).over(running(part, ["s"]))
    x = x.withColumn("depth", F.when(leaf, F.lit(None)).when(F.col("up"), depth).otherwise(depth + 1).cast("int"))
    after = Window.partitionBy(*part, "depth").orderBy("s")
    nxt = F.lead(F.struct("e", "ce", F.col("type").alias("t"))).over(after)
    x = x.withColumn("_n", nxt).filter(leaf | (F.col("up") & F.col("_n").isNotNull()))
    kind = F.when(leaf | (F.col("type") == F.col("_n.t")), F.col("type")).otherwise(F.lit("ERROR")).alias("type") if jointly else F.col("type")
    end = lambda c: F.when(leaf, F.col(c)).otherwise(F.col(f"_n.{c}")).alias(c)
    return x.select("doc_id", *keep, kind, "s", end("e"), "cs", end("ce"), "depth")


def bracket_spans(docs: DataFrame, comments: str = "c", strings: str = "\"'", keep=("grp",), jointly: bool = False) -> DataFrame:
    """Spans of types paren, bracket, brace, string and comment; a span
    includes its delimiters and ``depth`` is null for strings and comments.

    ``comments``: ``c`` (``//`` and ``/* */``), ``hash`` (``#``) or ``none``;
    an unclosed block comment goes to the end. ``strings``: the quotes that
    make strings; a string ends on its line, else its quote is a character."""
    return _numbered(_partnered(marks(docs, comments, strings, keep), keep, jointly), keep)


def indented_lines(docs: DataFrame, keep=("grp",), tab: int = TAB) -> DataFrame:
    """Lines that aren't blank: number, height (columns of indentation), and the
    bytes and characters from their first character to their last but white
    space."""
    x = docs.select("doc_id", *keep, F.posexplode(F.regexp_extract_all("text", F.lit(r"[^\n]*+\n|[^\n]++"), F.lit(0))).alias("i", "piece"))
    x = with_offsets(x, carried=keep)
    lead, body = F.regexp_extract("piece", r"^[ \t]*", 0), F.regexp_extract("piece", r"^(?s:.*)[^ \t\r\n]", 0)
    x = x.withColumn("_l", lead).withColumn("_b", body).filter(F.char_length("_b") > 0)
    tabs = F.char_length("_l") - F.char_length(F.replace("_l", F.lit("\t"), F.lit("")))
    return x.select("doc_id", *keep, F.col("i").alias("line"), (F.char_length("_l") + (tab - 1) * tabs).cast("int").alias("h"),
                    (F.col("b0") + F.octet_length("_l")).alias("s"), (F.col("b0") + F.octet_length("_b")).alias("e"),
                    (F.col("c0") + F.char_length("_l")).alias("cs"), (F.col("c0") + F.char_length("_b")).alias("ce"))


def indent_spans(docs: DataFrame, keep=("grp",), tab: int = TAB) -> DataFrame:
    """Blocks by indentation: a line followed by a deeper one heads a block up
    to the line before the next one that is no deeper than the header (blank
    lines don't count). Type ``block`` is header and body, ``suite`` the body;
    ``depth`` is the header's height in columns."""
    at = Window.partitionBy("doc_id").orderBy("line", *keep)
    x = indented_lines(docs, keep, tab)
    x = x.withColumn("_p", F.lag(F.struct("h", "e", "ce")).over(at)).withColumn("_n", F.lead(F.struct("h", "s", "cs")).over(at))
    start = F.struct(F.col("h").alias("level"), F.col("line").alias("line"), F.lit(1).alias("open"), F.col("s"), F.col("cs"), F.col("_n.s").alias("s2"), F.col("_n.cs").alias("cs2"))

    def ends(frm: Column, to: Column, line: Column, e: Column, ce: Column) -> Column:
        """The heights from ``frm`` to below ``to`` that the profile comes back to."""
        levels = F.when(to > frm, F.sequence(frm, to - 1)).otherwise(F.array().cast("array<int>"))
        none = F.lit(None).cast("bigint")
        return F.transform(levels, lambda v: F.struct(v.alias("level"), line.alias("line"), F.lit(0).alias("open"), e.alias("s"), ce.alias("cs"), none.alias("s2"), none.alias("cs2")))

    opens = F.when(F.col("_n.h") > F.col("h"), F.array(start)).otherwise(F.array().cast("array<struct<level:int,line:int,open:int,s:bigint,cs:bigint,s2:bigint,cs2:bigint>>"))
    falls = ends(F.col("h"), F.coalesce(F.col("_p.h"), F.lit(0)), F.col("line"), F.col("_p.e"), F.col("_p.ce"))
    last = F.when(F.col("_n").isNull(), ends(F.lit(0), F.col("h"), F.col("line") + 1, F.col("e"), F.col("ce"))).otherwise(F.array().cast("array<struct<level:int,line:int,open:int,s:bigint,cs:bigint,s2:bigint,cs2:bigint>>"))
    events = x.select("doc_id", *keep, F.explode(F.concat(falls, opens, last)).alias("_e")).select("doc_id", *keep, "_e.*")
    after = Window.partitionBy("doc_id", "level").orderBy("line", "open")
    events = events.withColumn("_x", F.lead(F.struct("s", "cs")).over(after)).filter(F.col("open") == 1)
    both = F.array(F.struct(F.lit("block").alias("type"), F.col("s"), F.col("cs")), F.struct(F.lit("suite").alias("type"), F.col("s2").alias("s"), F.col("cs2").alias("cs")))
    spans = events.select("doc_id", *keep, F.col("level").alias("depth"), F.col("_x.s").alias("e"), F.col("_x.cs").alias("ce"), F.explode(both).alias("_b"))
    return _numbered(spans.select("doc_id", *keep, "_b.type", "_b.s", "e", "_b.cs", "ce", "depth"), keep)


def code_spans(docs: DataFrame, comments: str = "c", strings: str = "\"'", keep=("grp",), tab: int = TAB) -> DataFrame:
    """All of them: brackets, strings, comments and indented blocks."""
    return bracket_spans(docs, comments, strings, keep).unionByName(indent_spans(docs, keep, tab))
