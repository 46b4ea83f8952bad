import math
import re
import zlib
from collections import defaultdict

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanalign.llm import mixing, packing, sharding


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def brute_targets(sizes):
    """The contract, round by round: share by weight, stop at twice the size, share the excess again."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, stopped = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in stopped]
        left = total - sum(2 * sizes[s] for s in stopped)
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s] + 1e-9}
        if not over:
            return {s: share.get(s, 2.0 * sizes[s]) for s in order}
        stopped |= over


def test_targets_match_rounds(spark):
    rng = np.random.default_rng(3)
    for _ in range(6):
        names = [f"s{i:02d}" for i in range(rng.integers(1, 9))] + [None]
        sizes = {n: int(rng.choice([0, 1, 5, 100, 1000])) for n in names}
        rows = [(n is None, n or "", v) for n, v in sizes.items()]
        got = mixing.targets(spark.createDataFrame(rows, "_null boolean, _source string, source_size long")).collect()
        want = brute_targets(sizes)
        for r in got:
            assert abs(r["target"] - want[None if r["_null"] else r["_source"]]) < 1e-6


def test_mix(spark, docs, no_docs):
    got = mixing.copies(docs).toPandas()
    rows = docs.select("doc_id", "text", "source").collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += words(r.text)
    want = brute_targets(sizes)
    assert sorted(got["size"]) == sorted(words(r.text) for r in rows)
    assert (got["copies"] <= 2).all()
    assert set(np.round(got["target"], 6)) == {round(v, 6) for v in want.values()}
    again = mixing.copies(docs).toPandas()
    key = ["doc_id", "_tie", "copies"]
    assert sorted(map(str, got[key].values.tolist())) == sorted(map(str, again[key].values.tolist()))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == got["copies"].sum()
    assert mixing.mix(no_docs).count() == 0


def test_taken_near_target(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 50)), f"s{i % 4 if i % 3 else 0}") for i in range(6000)]
    got = mixing.copies(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    for r in got.groupBy("source_size", "target").agg(F.sum(F.col("size") * F.col("copies")).alias("taken")).collect():
        assert abs(r["taken"] / r["target"] - 1) < 0.02


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=9), st.integers(1, 4))
def test_bounds_are_best(lengths, k):
    from itertools import combinations
    tops = sorted(set(lengths))
    count = [lengths.count(t) for t in tops]
    pad = lambda ends: sum(c * min(tops[e] for e in ends if tops[e] >= t) for t, c in zip(tops, count, strict=True))
    best = min(pad((*c, len(tops) - 1)) for n in range(min(k, len(tops))) for c in combinations(range(len(tops) - 1), n))
    got = packing.best_bounds(tops, count, k)
    assert got[-1] == len(tops) - 1 and len(got) <= k and pad(got) == best


def test_pack(spark, docs, no_docs):
    got = packing.pack(docs, buckets=5, budget=500).toPandas()
    rows = docs.select("text").collect()
    assert sorted(got["n_tokens"]) == sorted(words(r.text) + 1 for r in rows)
    assert (got["padded"] >= got["n_tokens"]).all() and got["bucket"].nunique() <= 5
    for (_, padded), g in got.groupby(["bucket", "padded"]):
        fit = max(1, 500 // padded)
        assert sorted(zip(g["batch"], g["slot"], strict=True)) == [(i // fit, i % fit) for i in range(len(g))]
    assert packing.pack(no_docs).count() == 0


def test_shards(spark, docs, no_docs):
    got = sharding.place(docs, shards=4, per_shard=8, sample=500).toPandas()
    rows = docs.select("doc_id", "text").collect()
    assert sorted(got["size"]) == sorted(len((r.text or "").encode()) + 1 for r in rows)
    assert sorted(got["text_crc32"]) == sorted(zlib.crc32((r.text or "").encode()) for r in rows)
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    full = sharding.shard(docs, shards=4, per_shard=8, sample=500)
    assert full.columns == [*docs.columns, "shard", "slot"] and full.count() == len(rows)
    assert full.select("shard", "slot").distinct().count() == len(rows)
    assert sharding.shard(no_docs).count() == 0


def test_shards_near_equal_with_a_hot_text(spark):
    rows = [(i, "the same text in very many documents" if i % 3 == 0 else f"text {i} " * (1 + i % 7)) for i in range(9000)]
    got = sharding.place(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    size = got.groupby("shard")["size"].sum()
    assert len(size) == 16 and size.max() / size.mean() < 1.03 and size.min() / size.mean() > 0.97


def test_equal_texts_share_a_shard_where_they_fit(spark):
    rows = [(i, f"text {i % 1500} of some length") for i in range(6000)]
    got = sharding.place(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert (got.groupby("text_crc32")["shard"].nunique() == 1).all()


def test_write_shards(spark, docs, tmp_path):
    sharding.write_shards(docs, str(tmp_path / "out"), shards=4, per_shard=8, sample=500)
    assert spark.read.parquet(str(tmp_path / "out")).count() == docs.count()


def test_only_a_text_that_overfills_a_range_is_split(spark):
    """A third of the rows are one text; the groups of two in its range stay together."""
    rows = [(i, f"text number {i // 2} of two") for i in range(8000)] + [(8000 + i, "hot " * 8) for i in range(4000)]
    got = sharding.place(spark.createDataFrame(rows, "doc_id long, text string"), shards=4, per_shard=8).toPandas()
    shards = got.groupby("text_crc32")["shard"].nunique()
    hot = zlib.crc32(("hot " * 8).encode())
    assert shards[hot] > 1 and (shards.drop(hot) == 1).all()
    size = got.groupby("shard")["size"].sum()
    assert size.max() <= 1.2 * size.mean() and size.min() >= 0.8 * size.mean()
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))


def xx(*values, seed=42):
    """Spark's xxhash64 of longs, ints (as numpy int32), booleans and strings; nulls are passed over."""
    h = seed
    for v in values:
        if v is None:
            continue
        data = v.encode() if isinstance(v, str) else np.int32(v).tobytes() if isinstance(v, (bool, np.int32)) else np.int64(v).tobytes()
        h = xxhash.xxh64_intdigest(data, seed=h % (1 << 64))
    return h - (1 << 64) if h >= 1 << 63 else h


def bin_number(n, steps=16):
    if n < steps:
        return n
    octave = int(math.floor(math.log2(n)))
    return octave * steps + max(0, min(steps - 1, int(n / 2.0**octave * steps) - steps))


def test_the_draw_is_replayed(spark, docs):
    """Every document's copies by the rule: places within the source by size
    and hash, one offset, a copy per integer boundary crossed."""
    rows = [(r.doc_id, r.text, r.source) for r in docs.select("doc_id", "text", "source").collect()]
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += words(t)
    goal, want = brute_targets(sizes), []
    for source, size in sizes.items():
        own = sorted(((bin_number(words(t)), xx(t, i) % 256, words(t), xx(t, i), (i is not None, i or 0)) for i, t, s in rows if s == source))
        u = ((xx(np.int32(0), source is None, source or "") % (1 << 64) >> 11) + 0.5) / float(1 << 53)
        each = goal[source] / size if size else 0.0
        for k, (_, _, n, tie, (some, i)) in enumerate(own):
            want.append((i if some else None, tie, n, min(math.floor(each * (k + 1) + u) - math.floor(each * k + u), math.ceil(each))))
    got = [tuple(r) for r in mixing.copies(docs).select("doc_id", "_tie", "size", "copies").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_places_are_replayed(spark):
    """Splitters, ranges, slices, shards and slots by the rules, from all rows."""
    rows = [(i, f"text {i // 3} of some length" + " more" * (i % 11)) for i in range(3000)] + [(3000 + i, "hot " * 9) for i in range(1500)] + [(None, None), (7777, "")]
    shards, per_shard, sample, overfull = 4, 16, 400, 8.0
    got = {(r.doc_id, r.text_crc32): (r.shard, r.slot) for r in sharding.place(spark.createDataFrame(rows, "doc_id long, text string"), shards, per_shard, sample, overfull).collect()}
    ranges = shards * per_shard
    all_ = [{"id": i, "text": t or "", "tie": xx(t, i), "size": len((t or "").encode()) + 1, "key": xx(t or "")} for i, t in rows]
    total = sum(r["size"] for r in all_)
    unit = lambda *v: ((xx(np.int32(0), *v) % (1 << 64) >> 11) + 0.5) / float(1 << 53)
    keys = sorted(r["key"] for r in all_ if unit(r["key"], r["tie"]) * total < r["size"] * sample)
    splits = sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)})
    held, hot = defaultdict(int), defaultdict(int)
    for r in all_:
        r["range"] = sum(s <= r["key"] for s in splits)
        held[r["range"]] += r["size"]
        hot[r["range"], r["key"]] += r["size"]
    most = overfull * total / ranges
    hot = {k: v for k, v in hot.items() if v > most and held[k[0]] > most}
    parts = lambda b: math.ceil(b * ranges / total) if b > most else 1
    rest = {k: parts(v - sum(b for (q, _), b in hot.items() if q == k)) for k, v in held.items()}
    for r in all_:
        if (r["range"], r["key"]) in hot:
            before = sum(parts(b) for (q, k), b in hot.items() if q == r["range"] and k < r["key"])
            r["slice"] = rest[r["range"]] + before + xx(np.int32(0), r["tie"]) % parts(hot[r["range"], r["key"]])
        else:
            r["slice"] = xx(np.int32(0), r["key"]) % rest[r["range"]]
    groups = defaultdict(list)
    for r in all_:
        groups[r["range"], r["slice"]].append(r)
    upto, slots = 0, defaultdict(int)
    for g in sorted(groups):
        size = sum(r["size"] for r in groups[g])
        upto += size
        shard = min(shards - 1, math.floor((upto - size / 2) * shards / total))
        for r in sorted(groups[g], key=lambda r: (r["key"], r["tie"], r["id"] is not None, r["id"] or 0)):
            assert got[r["id"], zlib.crc32(r["text"].encode())] == (shard, slots[shard])
            slots[shard] += 1
    assert len(hot) == 1 and len(got) == len(rows)
