"""Extension points (UDF-1..3): a user's own span extractor or tokenizer.

A plug-in is a plain Python function ``text -> list of (type, s, e)`` or
``text -> list of (s, e)``. It runs inside Arrow-batched pandas UDFs on the
executors, is created once per task from the factory that travels with the
job (e.g. to load a parser or a tokenizer model there), and its offsets go
through the same cleaning as pre-tokenised input. Character
offsets are mapped to bytes with the vectorised ``char_to_byte``.

Each call has a deadline: a document on which the plug-in raises or runs out
of time becomes a row with a reason, and the job goes on. In SQL a plug-in is
a table function for lateral joins.
"""

from __future__ import annotations

import signal
import threading
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

SPAN_TYPE = T.ArrayType(T.StructType([T.StructField("type", T.StringType()),
                                      T.StructField("s", T.LongType()), T.StructField("e", T.LongType())]))
OFFSET_TYPE = T.ArrayType(T.StructType([T.StructField("s", T.LongType()), T.StructField("e", T.LongType())]))
#: Seconds that a plug-in may take for one document.
SECONDS = 10.0
#: Spans or tokens that a plug-in's column holds at once, about.
ITEMS = 1 << 16
#: Reasons of documents that a plug-in gave nothing for.
TIMEOUT, FAILED = "timeout", "failed"


class Late(BaseException):
    """Raised inside a plug-in whose time is up; not an Exception, so that its
    own handlers let it pass."""


def guarded(fn: Callable, seconds: float | None) -> Callable:
    """``fn`` with a deadline for each call: (result, None, None), or (None,
    reason, message) where it raises or is interrupted.

    An interval timer interrupts the call; it fires again and again in case
    that a plug-in catches everything. Native code is interrupted when it
    returns to Python. Workers run tasks in their main thread, where timers
    can interrupt; anywhere else ``seconds`` must be None."""
    if seconds is not None and threading.current_thread() is not threading.main_thread():
        raise RuntimeError("a deadline needs the worker's main thread: give seconds=None")

    def late(signum, frame):
        raise Late

    def call(text):
        before = signal.signal(signal.SIGALRM, late) if seconds is not None else None
        try:
            try:
                if seconds is not None:
                    signal.setitimer(signal.ITIMER_REAL, seconds, max(seconds / 10, 0.01))
                return fn(text), None, None
            finally:
                if seconds is not None:
                    signal.setitimer(signal.ITIMER_REAL, 0)
                    signal.signal(signal.SIGALRM, before)
        except Late:
            signal.setitimer(signal.ITIMER_REAL, 0)
            signal.signal(signal.SIGALRM, before)
            return None, TIMEOUT, f"more than {seconds} s"
        except Exception as x:  # whatever a plug-in raises is that document's failure
            return None, FAILED, f"{type(x).__name__}: {x}"[:200]
    return call


def _span_rows(found) -> list[dict]:
    return [{"type": ty, "s": int(s), "e": int(e)} for ty, s, e in found]


def _offset_rows(found) -> list[dict]:
    return [{"s": None if s is None else int(s), "e": None if e is None else int(e)} for s, e in found]


def _outcome_type(kind: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("found", kind), T.StructField("reason", T.StringType()), T.StructField("error", T.StringType())])


def plugin_udf(factory, rows: Callable, kind: T.DataType, seconds: float | None = SECONDS):
    """A column of (found, reason, error) from ``factory()``'s function; a null
    text gives three nulls."""
    @F.pandas_udf(_outcome_type(kind))
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        fn = factory()
        call = guarded(lambda t: rows(fn(t)), seconds)   # what a generator yields counts as the call's time
        for text in texts:
            out, n = [], 0
            for t in text:   # what is found is handed on as soon as it is much, however many documents a batch has
                out.append((None, None, None) if t is None else call(t))
                n += len(out[-1][0] or ())
                if n >= ITEMS:
                    yield pd.DataFrame(out, columns=["found", "reason", "error"])
                    out, n = [], 0
            if out:
                yield pd.DataFrame(out, columns=["found", "reason", "error"])
    return run


def span_extractor_udf(factory, seconds: float | None = SECONDS):
    """UDF-1: ``factory()`` returns ``fn(text) -> [(type, s, e), ...]`` with
    byte offsets (a parser binding plugs in here)."""
    return plugin_udf(factory, _span_rows, SPAN_TYPE, seconds)


def _offset_numbers(found) -> pa.Array:
    """Starts and ends, one after the other; pairs of whole numbers are taken
    over without an object for each."""
    found = list(found)
    try:
        if set(map(len, found)) <= {2}:
            return pa.array(np.fromiter(chain.from_iterable(found), np.int64, 2 * len(found)))
    except (TypeError, ValueError, OverflowError):   # nulls, or no such pairs: taken one by one
        pass
    return pa.array([v for r in _offset_rows(found) for v in (r["s"], r["e"])], pa.int64())


def _offset_outcomes(out: list) -> pa.StructArray:
    kind = to_arrow_type(_outcome_type(OFFSET_TYPE))
    lists = kind.field("found").type
    flat = pa.concat_arrays([pa.array([], pa.int64()), *(o[0] for o in out if o[0] is not None)])
    known, flat = flat.is_valid().to_numpy(zero_copy_only=False), flat.fill_null(0).to_numpy()
    pairs = pa.StructArray.from_arrays([pa.array(flat[i::2], mask=~known[i::2]) for i in range(2)], fields=[lists.value_type.field(i) for i in range(2)])
    ends = np.cumsum([0, *(0 if o[0] is None else len(o[0]) // 2 for o in out)])
    found = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pairs, type=lists, mask=pa.array([o[0] is None for o in out]))
    return pa.StructArray.from_arrays([found, *(pa.array([o[i] for o in out], pa.string()) for i in (1, 2))], fields=[kind.field(i) for i in range(3)])


def tokenizer_udf(factory, seconds: float | None = SECONDS):
    """UDF-2: ``factory()`` returns ``fn(text) -> [(s, e), ...]`` offsets
    (characters or bytes, see ``apply_tokenizer``). A column of (found, reason,
    error); a null text gives three nulls."""
    @F.arrow_udf(_outcome_type(OFFSET_TYPE))
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fn = factory()
        call = guarded(lambda t: _offset_numbers(fn(t)), seconds)   # what a generator yields counts as the call's time
        for text in texts:
            out, n = [], 0
            for t in text:   # handed on as soon as it is much, as in plugin_udf
                out.append(call(t.as_py()) if t.is_valid else (None, None, None))
                n += 0 if out[-1][0] is None else len(out[-1][0]) // 2
                if n >= ITEMS:
                    yield _offset_outcomes(out)
                    out, n = [], 0
            if out:
                yield _offset_outcomes(out)
    return run


def run_extractor(docs: DataFrame, factory, keep=("grp",), seconds: float | None = SECONDS) -> DataFrame:
    """The plug-in's outcome for each document: ``doc_id, n_bytes, found, reason,
    error``. ``extracted_spans`` and ``clean.rejected`` read it; write it first
    where both are wanted, so that the plug-in runs once."""
    out = span_extractor_udf(factory, seconds)("text")
    return docs.select("doc_id", *keep, F.octet_length("text").alias("n_bytes"), out.alias("_o")).select("doc_id", *keep, "n_bytes", "_o.*")


def run_tokenizer(docs: DataFrame, factory, keep=("grp",), seconds: float | None = SECONDS) -> DataFrame:
    """As ``run_extractor`` for a tokenizer, with the text."""
    out = tokenizer_udf(factory, seconds)("text")
    return docs.select("doc_id", *keep, "text", out.alias("_o")).select("doc_id", *keep, "text", "_o.*")


def extracted_spans(outcomes: DataFrame, keep=("grp",)) -> DataFrame:
    """Spans of the documents that a plug-in managed, ERROR types dropped (SPN-2 rules)."""
    from spanalign.operators.spans import spans_from_table
    x = outcomes.select("doc_id", *keep, F.posexplode("found").alias("span_id", "_sp"), F.col("n_bytes").alias("_nb"))
    x = x.select("doc_id", *keep, "span_id", "_sp.type", "_sp.s", "_sp.e", "_nb")
    return spans_from_table(x, span_id="span_id", text_bytes="_nb")


def apply_span_extractor(docs: DataFrame, factory, keep=("grp",), seconds: float | None = SECONDS) -> DataFrame:
    """Spans from a plug-in extractor. Documents on which it raises or takes
    longer than ``seconds`` have none; ``run_extractor`` tells which and why."""
    return extracted_spans(run_extractor(docs, factory, keep, seconds), keep)


def apply_tokenizer(docs: DataFrame, factory, scheme: str, unit: str = "char", keep=("grp",), seconds: float | None = SECONDS) -> DataFrame:
    """Token table from a plug-in tokenizer via TOK-2's cleaning/mapping; for
    documents that it fails on see ``apply_span_extractor``."""
    from spanalign.operators.tokens import tokens_from_table
    t = tokens_from_table(run_tokenizer(docs, factory, keep, seconds), "found", "text", unit=unit, keep=keep)
    return t.withColumn("scheme", F.lit(scheme))


def register_extractor(spark: SparkSession, name: str, factory, seconds: float | None = SECONDS) -> None:
    """UDF-1 in SQL: a table function ``name(text)`` for lateral joins,

        SELECT d.doc_id, p.* FROM docs d, LATERAL name(d.text) p

    with a row per span (span_id, type, s, e), or one row with reason and error
    where the plug-in fails. With ``pieces => true`` (a constant) the rows also
    have the span's text: the function's schema follows from its arguments."""
    from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf

    class Extract:
        @staticmethod
        def analyze(text: AnalyzeArgument, pieces: AnalyzeArgument | None = None) -> AnalyzeResult:
            text_, long_ = T.StringType(), T.LongType()   # type objects: names need a JVM to be read
            schema = T.StructType().add("span_id", T.IntegerType()).add("type", text_).add("s", long_).add("e", long_)
            if pieces is not None and pieces.value:
                schema = schema.add("piece", text_)
            return AnalyzeResult(schema.add("reason", text_).add("error", text_))

        def __init__(self):
            fn = factory()
            self.call = guarded(lambda t: _span_rows(fn(t)), seconds)

        def eval(self, text, pieces=False):
            if text is None:
                return
            found, reason, error = self.call(text)
            data, empty = text.encode() if pieces else b"", (None,) if pieces else ()
            if reason:
                yield (None, None, None, None, *empty, reason, error)
                return
            for i, r in enumerate(found):
                if r["type"] and not r["type"].startswith("ERROR") and 0 <= r["s"] <= r["e"]:
                    yield (i, r["type"], r["s"], r["e"], *((data[r["s"]:r["e"]].decode("utf-8", "replace"),) if pieces else ()), None, None)

    spark.udtf.register(name, udtf(Extract))


def word_class_runs(docs: DataFrame, word_class: str = r"[\p{L}\p{N}_]", keep=()) -> DataFrame:
    """UDF-3: the M1 word-character class as a parameter: runs of the given
    class (JVM regex) with byte offsets, usable as ``runs`` in the word-split
    and detail operators."""
    from spanalign.operators.tokens import _runs, bounded_runs
    neg = "[^" + word_class[1:] if word_class.startswith("[") and not word_class.startswith("[^") else None
    if neg is None:
        raise ValueError("word_class must be a positive character class like [...]")
    pat = bounded_runs(word_class, neg)
    x = docs.select("doc_id", *keep, F.posexplode(F.regexp_extract_all("text", F.lit(pat), F.lit(0))).alias("i", "piece"))
    return _runs(x, word_class, keep)
