import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from spanalign.llm import search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items, k):
    own = [Counter(terms(t)) for _, t in rows]
    n = [sum(c.values()) for c in own]
    documents, length = sum(x > 0 for x in n), sum(n)
    df = Counter(t for c in own for t in c)
    out = []
    for item, text in sorted(set(items), key=str):
        scores = []
        for (doc, _), c, k_terms in zip(rows, own, n, strict=True):
            m = 50 + 50 * k_terms * documents // max(length, 1)
            s = sum(math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if s > 0:
                scores.append((-s, doc is None, doc or 0, doc))
        out += [(item, i + 1, x[3], -x[0]) for i, x in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def found(docs, items, k):
    return sorted((tuple(r) for r in search.search(docs, items, k).select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_search(spark, docs, no_docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    some = [t for _, t in rows if t][:40]
    texts = [" ".join(t.split()[i : i + 8]) for i, t in enumerate(some)] + ["ÀÉ b", "B c A", "no such-term", "", None, "z" * 200_000, "a b c " * 300, some[0]]
    items = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, "a"), (1, "another TEXT under an id")]
    df = spark.createDataFrame([(*r, 1, 2.0) for r in items], "item_id long, text string, score int, doc_id double")
    for k in (3, 50):
        assert found(docs, df, k) == brute(rows, items, k)
    assert found(no_docs, df, 3) == [] and found(docs, df.limit(0), 3) == []
    assert search.search(no_docs, df).columns == ["item_id", "rank", "doc_id", "score"]


def test_copies_and_ties(spark):
    rows = [(f"d{i:04}", "one two three four" if i % 3 else f"one other word {i}") for i in range(700)] + [(None, "one two three four")] * 3
    items = [(1, "one two"), (2, "four"), (3, "word 699 three")]
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(5)
    assert found(docs, spark.createDataFrame(items, "item_id int, text string"), 20) == brute(rows, items, 20)


def test_many_items(spark, docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    items = [(i, f"{chr(97 + i % 8)} {chr(97 + i % 7)}{chr(97 + i % 5)} {i}") for i in range(600)]
    assert found(docs, spark.createDataFrame(items, "item_id long, text string"), 5) == brute(rows, items, 5)


def test_bounds_hold():
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.3, size=n) % 50_000) for n in (0, 5, 300, 4000, 90_000)]
    hashes, of = search.tokens(pa.array(texts))
    n = np.bincount(of, minlength=len(texts))
    own = [np.unique(search.tokens(pa.array([" ".join(f"w{x}" for x in rng.integers(0, 50_000, 400))]))[0]) for _ in range(7)]
    queries = search.Queries(own, {int(h): int(h % 9000) for q in own for h in q}, len(texts), int(n.sum()))
    slots, repeats, cuts = search.sketched(hashes, of, len(texts))
    batch = pa.RecordBatch.from_arrays([pa.array(n), search.binaries(slots, cuts), search.binaries(repeats, cuts)], ["n", "slots", "repeats"])
    bounds, scores = queries.bounds()(batch), queries.scores()(pa.array(texts))
    assert (bounds >= scores).all() and (scores[1:] > 0).any()
    assert (bounds[1] == scores[1]).all()  # a short text's coordinates rarely meet
