"""Learned byte-pair schemes (TOK-1, TOK-2): the token borders that a model's
vocabulary makes.

A vocabulary is a file of ranks (one base64 token and its rank a line). Texts
are split into pre-tokens by a regex in the JVM; only the corpus's distinct
pre-tokens are merged, once each, and what they become is joined back to where
they stand. Frequent pre-tokens are joined by a broadcast that is bounded
whatever the corpus, so no key of the shuffled join is hot."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanalign.functions.patterns import BPE_PRETOKEN
from spanalign.operators.offsets import running
from spanalign.session import written
from spanalign.sources.tables import TEXT_BYTES, by_doc, doc_partitions

PREFIX = "bpe:"
#: Entries of a vocabulary at most (the ranks travel to every task).
MAX_RANKS = 1 << 20
#: A pre-token is frequent if it is at least one in FREQUENT of all and has at
#: most SHORT bytes: at most FREQUENT rows for each vocabulary are broadcast.
FREQUENT, SHORT = 1 << 16, 64

# the tokens of a pre-token: bytes [s, e), the whole characters around them [ws, we), the same in characters [cs, ce)
PARTS = T.ArrayType(T.StructType([T.StructField(c, T.IntegerType()) for c in ("s", "e", "ws", "we", "cs", "ce")]))


def is_bpe(scheme: str) -> bool:
    return scheme.startswith(PREFIX)


def load_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file."""
    rows = spark.read.text(path).limit(MAX_RANKS + 1).collect()
    if len(rows) > MAX_RANKS:
        raise ValueError(f"{path}: more than {MAX_RANKS} ranks")
    pairs = (r["value"].split() for r in rows if r["value"].strip())
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Where the tokens of a pre-token end: of all neighbouring tokens those
    whose union has the lowest rank are merged first, the leftmost of equals.

    Tokens are a linked list over their start bytes, candidates a heap; a
    candidate is stale when one of its tokens has changed. n log n."""
    n = len(piece)
    if n == 1 or piece in ranks:
        return [n]
    end, before = list(range(1, n + 1)), list(range(-1, n))
    heap = []

    def offer(a: int, b: int) -> None:
        rank = ranks.get(piece[a:end[b]])
        if rank is not None:
            heapq.heappush(heap, (rank, a, b, end[b]))

    for a in range(n - 1):
        offer(a, a + 1)
    while heap:
        _, a, b, stop = heapq.heappop(heap)
        if end[a] != b or end[b] != stop:
            continue
        end[a], end[b] = stop, -1
        if stop < n:
            before[stop] = a
            offer(a, stop)
        if before[a] >= 0:
            offer(before[a], a)
    out, at = [], 0
    while at < n:
        at = end[at]
        out.append(at)
    return out


def with_characters(piece: bytes, ends: list[int]) -> list[dict]:
    """Byte offsets of the tokens, those of the characters that they touch, and
    the characters' numbers."""
    first = [i for i, b in enumerate(piece) if b & 0xC0 != 0x80]   # where characters start
    out, s, k = [], 0, 0
    for e in ends:
        while k + 1 < len(first) and first[k + 1] <= s:
            k += 1
        last = k
        while last + 1 < len(first) and first[last + 1] < e:
            last += 1
        we = first[last + 1] if last + 1 < len(first) else len(piece)
        out.append({"s": s, "e": e, "ws": first[k], "we": we, "cs": k, "ce": last + 1})
        s = e
    return out


def pretokens(text: str | Column = "text") -> Column:
    return F.regexp_extract_all(text, F.lit(BPE_PRETOKEN), F.lit(0))


def pretoken_counts(docs: DataFrame, by=()) -> DataFrame:
    """``piece, n`` for each distinct pre-token (and group): counted in the
    tasks first, so a frequent one is no hot key."""
    return docs.select(*by, F.explode(pretokens()).alias("piece")).groupBy(*by, "piece").agg(F.count(F.lit(1)).alias("n"))


def segments(counts: DataFrame, schemes) -> DataFrame:
    """Merge each distinct pre-token of ``counts(piece, n)`` under every scheme
    (``bpe:<path>``): ``piece, n, scheme_id, parts``."""
    ranks = [load_ranks(counts.sparkSession, s.removeprefix(PREFIX)) for s in schemes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pieces = [p.encode() for p in b.column("piece").to_pylist()]
            for k, r in enumerate(ranks):
                parts = pa.array([with_characters(p, merged(p, r)) for p in pieces], pa.list_(pa.struct([(c, pa.int32()) for c in ("s", "e", "ws", "we", "cs", "ce")])))
                yield pa.RecordBatch.from_arrays([b.column("piece"), b.column("n"), pa.array([k] * len(pieces), pa.int32()), parts], ["piece", "n", "scheme_id", "parts"])

    schema = T.StructType([T.StructField("piece", T.StringType()), T.StructField("n", T.LongType()), T.StructField("scheme_id", T.IntegerType()), T.StructField("parts", PARTS)])
    return counts.select("piece", "n").mapInArrow(run, schema)


def _names(schemes) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in schemes]), F.col("scheme_id") + 1)


def bpe_token_counts(docs: DataFrame, schemes, by=("grp",)) -> DataFrame:
    """Pre-tokens and tokens per group and vocabulary, without a row per
    token: the groups' counts of distinct pre-tokens meet their segments."""
    counts = written(pretoken_counts(docs, by), "pretokens")
    sizes = segments(counts.groupBy("piece").agg(F.sum("n").alias("n")), schemes).select("piece", "scheme_id", F.size("parts").alias("k"))
    x = counts.join(sizes, "piece")
    return x.groupBy(*by, _names(schemes).alias("scheme")).agg(F.sum("n").alias("n_pretokens"), F.sum(F.col("n") * F.col("k")).alias("n_tokens"))


FIELDS = ("e", "ws", "we", "cs", "ce")


def _field(name: str) -> Column:
    return F.transform("parts", lambda x: x[name])


def bpe_tokens(docs: DataFrame, schemes, keep=("grp",), whole_characters: bool = False, counted: DataFrame | None = None) -> DataFrame:
    """Token table of learned vocabularies for ``docs`` partitioned by doc_id:
    ``doc_id, scheme, scheme_id, tok_id, s, e, cs, ce, piece, is_last``.

    Tokens cover the text; ``cs, ce`` are the characters that a token touches
    and ``piece`` shows bytes of cut characters as U+FFFD. With
    ``whole_characters`` ``s, e`` are widened to those characters, as tokenizers
    report their offsets: the tokens of one character then have equal offsets
    and no longer cover the text without overlaps (``is_last`` is left out).
    ``counted``: the same texts as they are read, so that finding the distinct
    pre-tokens moves no text."""
    seg = written(segments(pretoken_counts(docs if counted is None else counted), schemes), "segments")
    # pre-tokens cover the texts, so their bytes are the texts' bytes
    n, size = seg.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") * F.octet_length("piece")), F.lit(0))).first()
    total = n / len(schemes)
    # one list for each field, so that only those which are asked for are moved
    lists = [f"_{c}s" for c in FIELDS]
    seg = seg.select("piece", "n", "scheme_id", *[_field(c).alias(f"_{c}s") for c in FIELDS])
    frequent = seg.filter((F.col("n") * FREQUENT >= total) & (F.octet_length("piece") <= SHORT)).drop("n")
    # outer: what drops texts without pre-tokens would run their regex before the exchange, which then is no longer the other branches' one
    x = docs.select("doc_id", *keep, pretokens().alias("_p")).select("doc_id", *keep, F.size("_p").alias("_n"), F.posexplode_outer("_p").alias("i", "piece"))
    x = x.filter("piece IS NOT NULL").select("doc_id", *keep, "i", "piece", (F.col("i") == F.col("_n") - 1).alias("_end"))
    x = x.join(F.broadcast(frequent), "piece", "left")
    # the others are looked up by a shuffled join and come back to their documents, a row for all vocabularies
    ids = range(len(schemes))
    row = seg.groupBy("piece").agg(*[F.max(F.when(F.col("scheme_id") == k, F.col(c))).alias(f"{c}{k}") for c in lists for k in ids])
    rest = x.filter(F.col("_es").isNull()).drop("scheme_id", *lists).join(row, "piece")
    rest = by_doc(rest, max(doc_partitions(docs.sparkSession), -(-size // (TEXT_BYTES * len(schemes)))))
    of = lambda c: F.array(*[f"{c}{k}" for k in ids])
    cols = ["doc_id", *keep, "_end", "i", "piece"]
    rest = rest.select("*", F.posexplode(of("_es")).alias("scheme_id", "_es")).select(*cols, "scheme_id", "_es", *[F.get(of(c), F.col("scheme_id")).alias(c) for c in lists[1:]])
    x = x.filter(F.col("_es").isNotNull()).select(*cols, "scheme_id", *lists).union(rest)
    w = running(["doc_id", "scheme_id"], ["i", *keep])
    before = lambda c: F.sum(c).over(w) - c
    # the last token of a pre-token ends where it ends
    x = x.select("*", before(F.element_at("_es", -1).cast("bigint")).alias("_b"), before(F.element_at("_ces", -1).cast("bigint")).alias("_c"),
                 before(F.size("_es")).alias("_t"))
    x = x.select("doc_id", *keep, "scheme_id", "piece", "_b", "_c", "_t", "_end", *lists, F.posexplode("_es").alias("j", "_e"))
    own = lambda c: F.get(c, F.col("j"))
    start = F.coalesce(F.get("_es", F.col("j") - 1), F.lit(0))
    low, high = (own("_wss"), own("_wes")) if whole_characters else (start, F.col("_e"))
    cut = F.substring(F.encode("piece", "UTF-8"), start + 1, F.col("_e") - start)
    last = [] if whole_characters else [(F.col("_end") & (F.col("j") == F.size("_es") - 1)).alias("is_last")]
    return x.select("doc_id", *keep, _names(schemes).alias("scheme"), "scheme_id", (F.col("_t") + F.col("j")).cast("int").alias("tok_id"),
                    (F.col("_b") + low).alias("s"), (F.col("_b") + high).alias("e"),
                    (F.col("_c") + own("_css")).alias("cs"), (F.col("_c") + own("_ces")).alias("ce"),
                    F.make_valid_utf8(cut.cast("string")).alias("piece"), *last)
