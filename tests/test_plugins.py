"""Plug-ins that raise, hang or swallow interrupts lose exactly their documents."""

import time

import pytest
from pyspark.sql import functions as F

from spanalign.functions.udf import (FAILED, TIMEOUT, apply_span_extractor, apply_tokenizer, extracted_spans, guarded,
                                     register_extractor, run_extractor, run_tokenizer)
from spanalign.operators.clean import accepted, rejected


def factory():
    def spans(text):
        if "hang" in text:
            while True:
                pass
        if "stubborn" in text:   # catches whatever it can
            while True:
                try:
                    time.sleep(0.02)
                except Exception:
                    pass
        if "lazy" in text:   # a generator that fails while it is read
            def g():
                yield ("a", 0, 1)
                raise KeyError("late")
            return g()
        if "raise" in text:
            raise ValueError("no such thing " + "x" * 500)
        if "odd" in text:
            return [("a", "not a number", 1)]
        return [("word", 0, len(text.encode())), ("ERROR x", 0, 0)]
    return spans


TEXTS = {1: "fine", 2: "hang", 3: "raise", 4: "fine é", 5: None, 6: "stubborn", 7: "lazy", 8: "odd", 9: ""}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, "g", t) for i, t in TEXTS.items()], "doc_id long, grp string, text string").repartition(2)


def test_reasons(docs):
    out = run_extractor(docs, factory, seconds=0.4)
    got = {r.doc_id: (r.reason, r.error) for r in out.collect()}
    assert {i: r for i, (r, _) in got.items()} == {1: None, 2: TIMEOUT, 3: FAILED, 4: None, 5: None, 6: TIMEOUT, 7: FAILED, 8: FAILED, 9: None}
    assert got[3][1].startswith("ValueError: no such thing x") and len(got[3][1]) == 200 and got[2][1] == "more than 0.4 s"
    assert sorted(r.doc_id for r in rejected(out).collect()) == [2, 3, 6, 7, 8] and "reason" not in accepted(out).columns
    assert sorted((r.doc_id, r.type, r.e) for r in extracted_spans(out).collect()) == [(1, "word", 4), (4, "word", 7), (9, "word", 0)]
    assert sorted(r.doc_id for r in apply_span_extractor(docs, factory, seconds=0.4).collect()) == [1, 4, 9]


def test_tokenizers(docs):
    def tokens():
        return lambda t: 1 / 0 if t == "raise" else [(i, i + 1) for i in range(len(t))]
    out = run_tokenizer(docs, tokens, seconds=None)
    assert {r.doc_id: r.reason for r in out.collect()} == {i: FAILED if t == "raise" else None for i, t in TEXTS.items()}
    assert apply_tokenizer(docs, tokens, "own").count() == sum(len(t) for t in TEXTS.values() if t and t != "raise")


def test_guard_leaves_no_timer():
    call = guarded(lambda t: time.sleep(t) or t, 0.2)
    assert call(0.01) == (0.01, None, None)
    assert call(5)[1] == TIMEOUT
    time.sleep(0.5)   # no alarm is left
    assert call(0.0) == (0.0, None, None)


def test_table_function(spark, docs):
    register_extractor(spark, "own_spans", factory, seconds=0.4)
    docs.createOrReplaceTempView("own_docs")
    rows = spark.sql("SELECT d.doc_id, p.* FROM own_docs d, LATERAL own_spans(d.text) p").collect()
    assert sorted((r.doc_id, r.type, r.s, r.e) for r in rows if r.reason is None) == [(1, "word", 0, 4), (4, "word", 0, 7), (9, "word", 0, 0)]
    assert {r.doc_id: r.reason for r in rows if r.reason} == {2: TIMEOUT, 3: FAILED, 6: TIMEOUT, 7: FAILED, 8: FAILED}
    wide = spark.sql("SELECT p.* FROM own_docs d, LATERAL own_spans(d.text, pieces => true) p WHERE doc_id = 4")
    assert wide.columns == ["span_id", "type", "s", "e", "piece", "reason", "error"] and wide.first().piece == "fine é"
    assert docs.filter(F.col("text").isNull()).count() == 1 and not [r for r in rows if r.doc_id == 5]


def test_what_a_plugin_finds_is_handed_on_in_small_batches(spark, monkeypatch):
    from spanalign.functions import udf
    monkeypatch.setattr(udf, "ITEMS", 10)
    sizes = []
    run = udf.plugin_udf(lambda: lambda t: [(i, i + 1) for i in range(len(t))], udf._offset_rows, udf.OFFSET_TYPE, None)
    import pandas as pd
    for out in run.func(iter([pd.Series(["abcd"] * 7 + [None, ""]), pd.Series(["a" * 25, "b"])])):
        sizes.append((len(out), sum(len(f or ()) for f in out["found"])))
    assert sizes == [(3, 12), (3, 12), (3, 4), (1, 25), (1, 1)]


def test_offsets_stay_numbers(spark):
    def tokens():
        import numpy as np
        found = {"plain": [(0, 2), [2, 9]], "nulls": [(None, 1), (1, None), (1, 2)], "lazy": ((i, i + 1) for i in range(2)), "odd": [("0", 1.9), (np.int64(1), True + 1)],
                 "three": [(1, 2, 3)], "words": [("a", 1)], "large": [(0, 1 << 70)], "none": []}
        return lambda t: found[t.split()[0]]
    names = ["plain é", "nulls é", "lazy x", "odd x", "three", "words", "large", "none", None]
    d = spark.createDataFrame([(i, "g", t) for i, t in enumerate(names)], "doc_id long, grp string, text string").coalesce(1)
    out = {r.doc_id: r for r in run_tokenizer(d, tokens, seconds=None).collect()}
    assert {i: r.reason for i, r in out.items()} == {i: FAILED if i in (4, 5, 6) else None for i in range(9)} and out[8].found is None
    assert out[1].found == [(None, 1), (1, None), (1, 2)] and out[3].found == [(0, 1), (1, 2)] and out[7].found == []
    t = apply_tokenizer(d, tokens, "own", seconds=None)
    assert sorted((r.doc_id, r.tok_id, r.s, r.e, r.cs, r.ce) for r in t.collect()) == [
        (0, 0, 0, 2, 0, 2), (0, 1, 2, 8, 2, 7), (1, 0, 1, 2, 1, 2), (2, 0, 0, 1, 0, 1), (2, 1, 1, 2, 1, 2), (3, 0, 0, 1, 0, 1), (3, 1, 1, 2, 1, 2)]
    assert "lambda" not in t._jdf.queryExecution().executedPlan().toString()   # no function is called for each pair
