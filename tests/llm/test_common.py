import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from spanalign.llm import common, textops


def test_components_of_random_graphs(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(200, 260)]
    hub = [(1000, 1000 + k) for k in range(1, 300)]
    pairs = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(90)] + chain + hub + [(-5, 7), (7, 7), (3, 2), (2, 3)]
    rng.shuffle(pairs)
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    want = {x: find(x) for x in root}
    got = common.components(spark.createDataFrame(pairs, "u long, v long")).collect()
    assert len(got) == len(want) and {r.node: r.label for r in got} == want
    assert common.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_bins_are_monotone_and_few(spark):
    n = sorted({0, 1, 2, *range(0, 3000, 7), *(2**k + d for k in range(2, 50) for d in (-1, 0, 1))})
    got = [r.b for r in spark.createDataFrame([(x,) for x in n], "n long").select("n", common.bin_of(F.col("n"), 16).alias("b")).orderBy("n").collect()]
    assert got == sorted(got) and got[:3] == [0, 1, 2] and max(got) < 64 * 16


def test_uniform_is_even_and_repeatable(spark):
    df = spark.range(20_000).select(common.uniform("id", seed=3).alias("u"), common.uniform("id", seed=4).alias("w"))
    r = df.agg(F.avg("u"), F.min("u"), F.max("u"), F.corr("u", "w")).first()
    assert abs(r[0] - 0.5) < 0.01 and 0 < r[1] and r[2] < 1 and abs(r[3]) < 0.03
    assert df.agg(F.sum("u")).first() == df.agg(F.sum("u")).first()


def test_word_count_by_the_ascii_rule(spark):
    texts = ["", " ", "a b", "\ta\x0b\x0cb\r\n", "é x y", None, "a\x1fb"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(common.word_count(F.col("t"))).collect()]
    assert got == [0, 0, 2, 2, 2, 0, 1]


def test_words_and_hashes_of_a_batch():
    texts = ["one two", "", None, "  three\tone ", "é x"]
    data, offsets = textops.raw(pa.array(texts).slice(0))
    starts, ends, of = textops.words(data, offsets)
    got = [(int(d), bytes(data[a:b]).decode()) for a, b, d in zip(starts, ends, of, strict=True)]
    assert got == [(i, w) for i, t in enumerate(texts) for w in (t or "").split()]
    h = textops.span_hashes(data, starts, ends)
    by = {}
    for (_, w), x in zip(got, h, strict=True):
        assert by.setdefault(w, x) == x
    assert len({int(x) for x in by.values()}) == len(by)
    part = pa.array(texts).slice(3)
    assert [bytes(textops.raw(part)[0]), list(textops.raw(part)[1])] == [b"  three\tone \xc3\xa9 x", [0, 12, 16]]


def test_slices_cover_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array([None if i % 9 == 0 else "x" * (i * i) for i in range(100)])], ["i", "text"])
    parts = list(textops.slices(iter([batch, batch.slice(0, 0)]), most=5000))
    assert len(parts) > 10 and np.concatenate([p.column("i").to_numpy() for p in parts]).tolist() == list(range(100))
