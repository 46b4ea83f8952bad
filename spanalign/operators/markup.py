"""Element tree of markup with error recovery (SPN-5).

Tags are found and measured in the JVM; elements come from a stack of open
elements per page that runs over its sorted tags, with one stack of places per
name, so each tag costs its own pops and nothing else. An end tag closes the
innermost open element of its name and all that is open inside it; one
without an open element of its name is no node, and a start tag that can't
stand inside an open element ends it. What stays open ends with the page."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanalign.functions.patterns import IMPLIED_ENDS, RAW_ELEMENTS, TAG, VOID_ELEMENTS
from spanalign.functions.text import possessive
from spanalign.operators.offsets import running

#: Columns of the tree that a user reads.
TREE = ["id", "parent_id", "depth", "name", "s", "e", "ended"]


def markup_pattern(xml: bool = False) -> str:
    """Covering pieces: comment, declaration, raw element with its text, tag,
    or anything else."""
    raw = [] if xml else [rf"(?i:<{n}(?:[\s/][^<>]*)?>)(?s:.*?)(?:(?i:</{n}\s*>)|\z)" for n in RAW_ELEMENTS]
    return "|".join([r"<!--(?s:.*?)(?:-->|\z)", r"<!\[CDATA\[(?s:.*?)(?:\]\]>|\z)", r"<[!?][^>]*>", *raw, TAG, r"[^<]+", "<"])


def page_tags(pages: DataFrame, keep=("grp",), xml: bool = False) -> DataFrame:
    """Tags of ``pages(doc_id, text)``: ``k`` (number on the page), ``kind``
    (start, end, void, raw), lower-case ``name``, byte offsets, and the page's
    length in bytes."""
    x = pages.select("doc_id", *keep, F.octet_length("text").cast("bigint").alias("nb"),
                     F.posexplode(F.regexp_extract_all("text", F.lit(possessive(markup_pattern(xml))), F.lit(0))).alias("i", "piece"))
    name = F.regexp_extract("piece", r"^</?([A-Za-z][^\s/>]*)", 1)
    name = name if xml else F.lower(name)
    size = F.octet_length("piece").cast("bigint")
    x = x.select("doc_id", *keep, "nb", "i", size.alias("_n"), name.alias("name"), F.left("piece", F.lit(2)).alias("_h"), F.right("piece", F.lit(2)).alias("_t"))
    x = x.withColumn("e", F.sum("_n").over(running(["doc_id"], ["i", *keep]))).filter(F.col("name") != "")
    kind = F.when(F.col("_h") == "</", "end")
    if xml:
        kind = kind.when(F.col("_t") == "/>", "void")
    else:
        kind = kind.when(F.col("name").isin(RAW_ELEMENTS), "raw").when(F.col("name").isin(VOID_ELEMENTS), "void")
    return x.select("doc_id", *keep, "nb", F.col("i").alias("k"), kind.otherwise("start").alias("kind"), "name", (F.col("e") - F.col("_n")).alias("s"), "e")


class Open:
    """The open elements of one page."""

    def __init__(self, implied: dict) -> None:
        self.implied, self.stack, self.places, self.n = implied, [], {}, 0

    def innermost(self, names) -> int:
        return max((self.places[x][-1] for x in names if self.places.get(x)), default=-1)

    def cut(self, at: int, end: int, out: list, closed: int | None = None) -> None:
        """End all elements from place ``at`` on: at ``end``, the outermost at
        ``closed`` if it is given."""
        while len(self.stack) > at:
            node = self.stack.pop()
            self.places[node[3]].pop()
            last = closed is not None and len(self.stack) == at
            out.append((*node, closed if last else end, "closed" if last else "implied"))

    def tag(self, kind: str, name: str, s: int, e: int, out: list) -> None:
        if kind == "end":
            at = self.innermost([name])
            if at >= 0:
                self.cut(at, s, out, e)
            return
        closes, scope = self.implied.get(name, ((), ()))
        at = self.innermost(closes)
        if at > self.innermost(scope):
            self.cut(at, s, out)
        node = (self.n, self.stack[-1][0] if self.stack else None, len(self.stack), name, s)
        self.n += 1
        if kind == "start":
            self.places.setdefault(name, []).append(len(self.stack))
            self.stack.append(node)
        else:
            out.append((*node, e, kind))

    def page_end(self, nb: int, out: list) -> None:
        while self.stack:
            out.append((*self.stack.pop(), nb, "page"))
        self.places = {}


def element_tree(pages: DataFrame, xml: bool = False) -> DataFrame:
    """Elements of ``pages(doc_id, text)``: ``doc_id, id`` (0-based pre-order),
    ``parent_id, depth, name, s, e`` (bytes, start tag to end tag) and how it
    ``ended``: ``closed`` by its tag, ``implied`` by another tag (it ends
    before that), ``page``, ``void`` or ``raw``.

    HTML's void elements, raw text elements and implied ends apply, unless
    ``xml``. A quoted attribute value may hold ``>`` but not ``<``. Comments,
    declarations and stray end tags are no nodes; what they hold belongs to
    the element around them. Memory is a batch and the open elements."""
    tags = page_tags(pages, keep=(), xml=xml)
    implied = {} if xml else {name: (closes, scope) for names, closes, scope in IMPLIED_ENDS for name in names}
    kind = tags.schema["doc_id"].dataType.simpleString()
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, nb, page, ids = object(), 0, Open(implied), None
        out: list = []

        def batch(docs: list) -> pa.RecordBatch:
            cols = [pa.array(docs, ids), *[pa.array([r[c] for r in out], t) for c, t in enumerate(kinds)]]
            return pa.RecordBatch.from_arrays(cols, ["doc_id", *TREE])

        for b in batches:
            ids, owners = b.column("doc_id").type, []
            cols = [b.column(c).to_pylist() for c in ("doc_id", "nb", "kind", "name", "s", "e")]
            for d, n, what, name, s, e in zip(*cols, strict=True):
                if d != doc:
                    page.page_end(nb, out)
                    owners += [doc] * (len(out) - len(owners))
                    doc, nb, page = d, n, Open(implied)
                page.tag(what, name, s, e, out)
                owners += [doc] * (len(out) - len(owners))
            yield batch(owners)
            out = []
        if ids is not None:
            page.page_end(nb, out)
            yield batch([doc] * len(out))

    ordered = tags.select("doc_id", "nb", "kind", "name", "s", "e").repartition("doc_id").sortWithinPartitions("doc_id", "s")
    return ordered.mapInArrow(run, f"doc_id {kind}, id int, parent_id int, depth int, name string, s long, e long, ended string")
