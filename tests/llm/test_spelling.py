import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from spanalign.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def brute_counts(rows, typos):
    out = Counter()
    for doc, text in rows:
        for w in RUN.findall(text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if typos and h % typos == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1 :]
            out[w] += 1
    return out


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, least=5, often=3, typos=97):
    n = {w: c for w, c in brute_counts(rows, typos).items() if len(w) >= least and c >= often}
    near = {w: [v for v in n if is_near(v, w)] for w in n}
    best = {w: min(v, key=lambda x: (-n[x], x), default=None) for w, v in near.items()}
    form = {w: b if b is not None and n[b] >= 2 * n[w] else None for w, b in best.items()}
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out, key=str)


def made(seed=2, letters="abÀßé", words=500):
    """Words with few letters, so that many are near, some often: runs of one
    letter, ties, lengths from 1 to 40."""
    rng = random.Random(seed)
    some = ["".join(rng.choice(letters) for _ in range(rng.choice([1, 4, 5, 5, 6, 6, 7, 8, 13, 25, 40]))) for _ in range(words)]
    some += ["a" * k for k in range(1, 30)] + ["b" * 12 + "a" * k for k in range(9)]
    for w in list(some):
        k = rng.randrange(len(w))
        some += [w[:k] + rng.choice(letters) + w[k:], w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k + 1 :]]
    rows = []
    for doc in range(60):
        text = " ".join(rng.choice(some[: rng.choice([20, 200, len(some)])]).upper() if rng.random() < 0.1 else rng.choice(some[: rng.choice([20, 200, len(some)])]) for _ in range(400))
        rows.append((rng.choice([doc, doc, None]), text))
    return rows + [(1, None), (2, ""), (3, "x1y2 -- ÷×÷×÷ " * 5), rows[0]]


@pytest.mark.parametrize("crowd", [spelling.CROWD, 6])
def test_groups(spark, crowd):
    rows = made()
    df = spark.createDataFrame([(*r, 5, "w") for r in rows], "doc_id long, text string, n int, word string").repartition(4)
    got = sorted((tuple(r) for r in spelling.group(df, typos=97, crowd=crowd).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)
    want = brute(rows)
    assert got == want and any(r[1] != r[2] for r in want if r[1]) and sum(r[4] > 3 for r in want) > 20


def test_odd_documents(spark, docs, no_docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in spelling.group(docs, least=4, often=2).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)
    assert got == brute(rows, 4, 2, None)
    assert spelling.group(no_docs).count() == 0


def test_checksums():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    starts = np.sort(rng.integers(0, 4000, 50))
    ends = starts + rng.choice([0, 1, 5, 63, 64, 65, 900], 50)
    seeds = np.array([zlib.crc32(b"%d:" % i) for i in range(50)], dtype=np.uint32)
    want = [zlib.crc32(b"%d:" % i + data[a:b].tobytes()) for i, (a, b) in enumerate(zip(starts, ends, strict=True))]
    assert spelling.crc32s(data, starts, ends, seeds).tolist() == want


def test_long_words(spark):
    base = "".join(random.Random(4).choice("abc") for _ in range(3000))
    words = [base, base[:1500] + base[1501:], "d" + base, base + "d", base[:2000] + "d" + base[2001:]]
    rows = [(i, " ".join(words)) for i in range(3)] + [(9, base)] * 4
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in spelling.group(df).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)
    assert got == brute(rows, typos=None)
