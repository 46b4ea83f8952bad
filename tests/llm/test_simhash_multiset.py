import hashlib
import random

import numpy as np
import xxhash

from spanalign.llm import multiset, simhash


def brute_print(t):
    w = (t or "").encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hs = [xxhash.xxh64_intdigest(s, seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_groups(fps, most=2):
    """Root of each fingerprint by comparing all pairs."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= most:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_clusters(spark, docs, no_docs):
    rows = docs.select("doc_id", "text").collect()
    fps = [brute_print(r.text) for r in rows]
    roots = brute_groups(fps)
    low = {}
    for r, g in zip(rows, roots, strict=True):
        if r.doc_id is not None:
            low[g] = min(low.get(g, r.doc_id), r.doc_id)
    want = sorted(((r.doc_id, f"{f:016x}", low.get(g)) for r, f, g in zip(rows, fps, roots, strict=True)), key=str)
    got = sorted((tuple(r) for r in simhash.clusters(docs).select("doc_id", "fingerprint", "component_id").collect()), key=str)
    assert got == want
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert len(ids) == len(set(roots)) and set(low.values()) <= set(ids)
    assert simhash.clusters(no_docs).count() == 0 and simhash.deduplicated(no_docs).count() == 0


def near_prints(n, seed=5):
    """Chains and balls of fingerprints a few bits apart, and many that share a half."""
    rng = random.Random(seed)
    out = {0, (1 << 64) - 1}
    while len(out) < n:
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 4, 30])):
            out.add(x)
            x ^= sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3])))
    out |= {0xABCD1234 << 32 | rng.getrandbits(32) for _ in range(n // 4)}
    return sorted(out)


def linked_roots(links, fps):
    at = {f: i for i, f in enumerate(fps)}
    unsigned = lambda x: x & (1 << 64) - 1
    i = np.array([at[unsigned(r.u)] for r in links], dtype=np.int64)
    j = np.array([at[unsigned(r.v)] for r in links], dtype=np.int64)
    return simhash.lowest(len(fps), i, j).tolist()


def test_links_connect_all_pairs(spark):
    for most in (1, 2, 3):
        fps = near_prints(500)
        df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "_fp long")
        assert linked_roots(simhash.links(df, most).collect(), fps) == brute_groups(fps, most)


def test_crowded_variants_are_indexed_again(spark):
    fps = near_prints(500)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "_fp long")
    assert linked_roots(simhash.links(df, 2, crowd=3).collect(), fps) == brute_groups(fps)


def test_near_in_large_groups():
    rng = random.Random(1)
    fps = np.unique(np.array([rng.getrandbits(14) for _ in range(6000)], dtype=np.uint64))
    assert len(fps) > 2048
    i, j = simhash.near(fps, 2)
    assert simhash.lowest(len(fps), i, j).tolist() == brute_groups([int(f) for f in fps])


def test_compare(spark, docs, no_docs):
    rows = [(r.doc_id, r.text or "") for r in docs.filter("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "text").collect()]
    rows.sort(reverse=True)
    got = {r.doc_id: r for r in multiset.compare(spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, _block int, _tie string").select("doc_id", "text")).collect()}
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert [got[i].fingerprint] == multiset.printed(multiset.fingerprint_many([t]))
        assert [got[i].edited_fingerprint] == multiset.printed(multiset.fingerprint_many([edited]))
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        assert (got[i].near_next == 1) == (multiset.printed(multiset.fingerprint_many([nxt])) == [got[i].fingerprint])
    assert multiset.compare(docs).count() == docs.count()
    assert multiset.compare(no_docs).count() == 0
    one = multiset.compare(docs.filter("doc_id = 5")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_fingerprint_is_homomorphic():
    a, b, c = "first one here\nsecond", "third paragraph", "second\nfirst one here"
    whole, parts = multiset.fingerprint_many([a + "\n" + b]), multiset.fingerprint_many([a, b, c])
    one = lambda k: tuple(x[k : k + 1] for x in parts)
    same = lambda x, y: multiset.printed(x) == multiset.printed(y)
    assert same(whole, multiset.add(one(0), one(1)))
    assert same(one(0), multiset.subtract(whole, one(1)))
    assert same(one(0), one(2))  # order of paragraphs
    assert not same(multiset.fingerprint_many(["x\nx"]), multiset.fingerprint_many(["x"]))  # a multiset, not a set
    many = multiset.fingerprint_many(["p q r\n" * 70_000])  # lanes wrap
    assert same(many, multiset.add(multiset.fingerprint_many(["p q r\n" * 69_999]), multiset.fingerprint_many(["p q r"])))


def test_likeness_follows_the_share_in_common():
    rng = random.Random(3)
    text = lambda n: "\n".join(" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(20)) for _ in range(n))
    shared = [text(40) for _ in range(60)]
    for share in (0, 10, 20, 30):
        a = multiset.fingerprint_many([s for s in shared])
        b = multiset.fingerprint_many(["\n".join([*s.split("\n")[:share], text(40 - share)]) for s in shared])
        assert abs(multiset.likeness(a, b).mean() - share / 40) < 0.07


def test_likeness_of_long_repetitive_texts():
    line = multiset.fingerprint_many(["p q r\n" * n for n in (35_000, 40_000, 65_536, 70_000, 131_072)])
    one = lambda k: tuple(x[k : k + 1] for x in line)
    for i, j, want in ((0, 3, 0.8), (2, 4, 0.8), (1, 3, 1 - 9 / 65)):
        assert abs(multiset.likeness(one(i), one(j))[0] - want) < 1e-9
