import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanalign.llm import lattice, pii, quality


# ------------------------------------------------------------- quality
@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(4)
    good = [f"good{k}" for k in range(200)]
    rows, labels = [], []
    for i in range(1500):
        words = [rng.choice(good) for _ in range(rng.randint(5, 60))]
        kind = i % 10
        if kind == 0:
            words = ["spam"] * 40
        elif kind == 1:
            words[:3] = ["vile", "nasty", "vile"]
        rows.append((i, " ".join(words), 7, "x"))
        if i % 2 == (i // 10) % 2:
            labels.append((i, int(kind != 0), int(kind == 1)))
    rows += [(9001, None, 7, "x"), (9002, "", 7, "x"), (None, "good1 good2", 7, "x"), rows[5], rows[5]]
    return (spark.createDataFrame(rows, "doc_id long, text string, weight int, _key string"), spark.createDataFrame(labels + labels[:3] + [(77_777, 0, 1)], "doc_id long, quality int, toxic int"))


def test_quality_keeps_clean_and_rejects_the_rest(labelled):
    docs, labels = labelled
    every, kept = quality.sample(docs, labels)
    assert every.count() == docs.count()
    kept_ids = [r.doc_id for r in kept.select("doc_id").collect()]
    clean = [i for i in range(1500) if i % 10 > 1]
    assert sum(i in set(kept_ids) for i in clean) >= 0.99 * len(clean)
    assert sum(i % 10 <= 1 for i in kept_ids if i is not None and i < 9000) <= 0.02 * 300
    assert {9001, 9002} <= set(kept_ids)  # no grams: weight 0
    rows = quality.fit_and_keep(docs, labels)
    assert rows.columns == docs.columns and rows.count() == len(kept_ids)
    again = [r.doc_id for r in quality.sample(docs, labels)[1].select("doc_id").collect()]
    assert Counter(kept_ids) == Counter(again)


def test_quality_with_few_documents_to_a_telling_word(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(1000):
        words = [f"good{rng.randrange(60)}" for _ in range(rng.randint(10, 40))]
        if i % 10 == 0:  # each of the four words is in 25 documents
            words.insert(3, f"vile{i // 20 % 4}")
        rows.append((i, " ".join(words)))
        if i % 20 < 10:
            labels.append((i, 1, int(i % 10 == 0)))
    kept = {r.doc_id for r in quality.sample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))[1].select("doc_id").collect()}
    assert sum(i in kept for i in range(0, 1000, 10)) <= 2
    assert sum(i in kept for i in range(1000) if i % 10) >= 0.99 * 900


def test_weights_against_plain_counts(labelled):
    """The fitted log ratios, from sets of buckets and plain sums."""
    docs, labels = labelled
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    kinds = {}
    for r in labels.collect():
        q, t = kinds.get(r.doc_id, (1, 0))
        kinds[r.doc_id] = (min(q, r.quality), max(t, r.toxic))
    doc, bucket = quality.grams(pa.array([t for _, t in rows], pa.string()))
    held = {}
    for d, b in zip(doc.tolist(), bucket.tolist(), strict=True):
        held.setdefault(b, []).append(rows[d][0])
    clean = {i for i, k in kinds.items() if k == (1, 0)}
    table = {b: (sum(i in clean for i in ids), sum(i in kinds for i in ids), len(ids)) for b, ids in held.items()}
    shares = sorted(t / r for t, _, r in table.values() if r >= 200)
    by = (shares[(len(shares) - 1) // 2] + shares[len(shares) // 2]) / 2
    known = sum(i in kinds for i, _ in rows)
    base = math.asin(math.sqrt(sum(i in clean for i, _ in rows) / known))
    want = {}
    for b, (t, m, r) in table.items():
        w = math.log((t + quality.SMOOTH) / (r * by + quality.SMOOTH))
        z = 2 * math.sqrt(m + 0.5) * (math.asin(math.sqrt((t + 0.375) / (m + 0.75))) - base)
        if abs(z) >= quality.CLEAR and w * z > 0 or abs(w) >= quality.FAR:
            want[b] = w
    got = quality.fit(docs, labels)
    assert set(np.flatnonzero(got).tolist()) == set(want) and len(want) > 3
    assert all(abs(got[b] - w) < 1e-9 for b, w in want.items())


def test_quality_without_labels_or_rows(labelled):
    docs, labels = labelled
    assert quality.fit_and_keep(docs, labels.limit(0)).count() == docs.count()
    assert quality.fit_and_keep(docs.limit(0), labels).count() == 0


def test_grams_against_sets():
    texts = ["ab  cd ab!! x", "", " ", None, "é!é", "a b c d"]
    doc, bucket = quality.grams(pa.array(texts), orders=(1,))
    got = Counter(doc.tolist())
    runs = [set(re.findall(r"(?:[0-9A-Za-z]|[^\x00-\x7f])+|(?:(?![0-9A-Za-z]|[^\x00-\x7f])[^\x20\x09-\x0D])+", t or "")) for t in texts]
    assert [got[i] for i in range(len(texts))] == [len(r) + 2 * bool(r) for r in runs]


def test_top_is_exact(spark):
    rng = random.Random(9)
    rows = [(i, i, rng.choice([rng.gauss(0, 1), 0.0, 1e-9 * i, 50.0])) for i in range(5000)]
    df = spark.createDataFrame(rows, "doc_id long, _tie long, _key double")
    for k in (0, 1, 17, 2500, 4999, 5000, 6000):
        got = sorted(r["_key"] for r in quality.top(df, k, bins=7).collect())
        assert got == sorted(sorted((r[2] for r in rows), reverse=True)[:k])


# ------------------------------------------------------------- lattice
@pytest.fixture(scope="module")
def vocabulary():
    rng = np.random.default_rng(0)
    pieces = [lattice.MARK, "a", "b", "ab", "ba", lattice.MARK + "a", lattice.MARK + "ab", "aba", "é", "字", "▁▁"]
    p = rng.random(256 + len(pieces))
    return lattice.Vocabulary(pieces, p / p.sum())


def segmentations(word, vocabulary):
    """All edge sequences of a word: lists of piece numbers."""
    s = lattice.MARK + word
    number = {p: i + 256 for i, p in enumerate(vocabulary.pieces)}

    def go(i):
        if i == len(s):
            yield []
            return
        if i > 0:
            for rest in go(i + 1):
                yield [*s[i].encode(), *rest]
        for j in range(i + 1, len(s) + 1):
            part = s[i:j]
            if part in number and lattice.MARK not in (part if i else part[1:]):
                for rest in go(j):
                    yield [number[part], *rest]

    return list(go(0))


WORDS = ["a", "ab", "aba", "abab", "é字", "x", "a▁b", "bbaab"]


def test_marginals(vocabulary):
    log_p = np.log(vocabulary.scores)
    want = [math.log(sum(math.exp(log_p[s].sum()) for s in segmentations(w, vocabulary))) for w in WORDS]
    assert np.allclose(lattice.log_words(WORDS, vocabulary, log_p), want)


def test_expected_counts(vocabulary):
    log_p = np.log(vocabulary.scores)
    count = np.arange(1.0, len(WORDS) + 1)
    want = np.zeros(len(log_p))
    for w, c in zip(WORDS, count, strict=True):
        segs = segmentations(w, vocabulary)
        p = np.array([math.exp(log_p[s].sum()) for s in segs])
        for s, q in zip(segs, p / p.sum(), strict=True):
            np.add.at(want, s, c * q)
    assert np.allclose(lattice.expected(WORDS, count, vocabulary, log_p), want)


def test_long_word(vocabulary):
    log_p = np.log(vocabulary.scores)
    assert np.isfinite(lattice.log_words(["ab" * 5000], vocabulary, log_p)).all()


def test_scores(spark, docs, no_docs):
    rows = docs.select("doc_id", "text").collect()
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    split = lambda t: (t or "").encode().lower().split()
    count, ends = Counter(), 0
    for r in rows:
        if not out(r.doc_id):
            count.update(split(r.text))
            ends += 1
    n, v = sum(count.values()) + ends, len(count) + 1
    lg = lambda c: math.log10((c + 0.5) / (n + 0.5 * (v + 1)))
    want = sorted((str(r.doc_id), out(r.doc_id), len(split(r.text)) + 1, sum(count[w] > 0 for w in split(r.text)) + 1, n, round(sum(lg(count[w]) for w in split(r.text)) + lg(ends), 4)) for r in rows)
    scored = lattice.score(docs).collect()
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in scored)
    assert got == want
    vocabulary = lattice.Vocabulary.load(lattice.MODEL)
    log_p = lattice.train(spark.createDataFrame([(w.decode(), c) for w, c in count.items()], "word string, c long"), vocabulary)
    assert abs(np.exp(log_p).sum() - 1) < 1e-9
    parts = dict(zip(*(lambda ws: (ws, np.exp(lattice.log_words(ws, vocabulary, log_p)).tolist()))(sorted({w.decode() for r in rows for w in split(r.text) if len(w) < 1000})), strict=True))
    events, left = n + 2, lattice.DISCOUNT * len(count) + 1
    for r, s in ((r, s) for r in rows[:60] for s in scored if s.doc_id == r.doc_id and r.doc_id != 7):
        whole = sum(math.log10((max(count[w] - lattice.DISCOUNT, 0) + left * parts[w.decode()]) / events) for w in split(r.text)) + math.log10((ends + 1) / events)
        assert abs(whole - s.score) < 1e-6 * max(1, abs(whole)) or len([x for x in rows if x.doc_id == r.doc_id]) > 1
    assert lattice.score(no_docs).count() == 0


def test_scores_do_not_see_held_out_texts(spark):
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 1]
    base = [(i, f"alpha beta gamma {i % 3}") for i in range(60)]
    other = [(i, "changed words here" if i in ids else t) for i, t in base]
    one, two = ({r.doc_id: r.score for r in lattice.score(spark.createDataFrame(x, "doc_id long, text string")).collect()} for x in (base, other))
    assert all(abs(one[i] - two[i]) < 1e-9 for i in one if i not in ids)


# ------------------------------------------------------------- personal data
def brute_base(t):
    out = []
    patterns = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))
    for k, p in patterns:
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m.group())
            if k == "ip" and any(int(x) > 255 for x in m.group().split(".")) or k == "card" and not (13 <= len(d) <= 19 and pii.luhn(d)) or k == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((k, *m.span()))
    return out


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="aA0124559..@@-- +()%é", max_size=60))
def test_base_spans(t):
    assert pii.base(t) == brute_base(t)


def test_base_spans_in_long_runs():
    for t in ("1" * 300_000, "a" * 300_000, "1." * 150_000, "1 " * 150_000, "+1" * 150_000, "a@" * 150_000, "a@b." * 75_000, "+1" + " " * 300_000):
        pii.base(t)


TEXT = "call +1 (319) 555-5132 now. later (319) 555-5132 and card 4799134681044206, v 2.0 of 3,000 in 2024 by joe@mail.com"


@pytest.fixture(scope="module")
def field(spark):
    rng = random.Random(6)
    rows = []
    for i in range(400):
        words = [f"w{rng.choice('abcdef')}" for _ in range(30)] + ["2.0", "2024", "3,000"]
        words += [f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}", f"a{i}@m.org", f"{rng.randint(1, 255)}.2.3.{i % 250}"] * (i % 3 == 0)
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
    return pii.fit(spark.createDataFrame(rows, "doc_id long, text string"))


def test_field_carries_labels_to_equal_tokens(spark, field):
    base, all_ = pii.found([TEXT], field)[0]
    assert base == brute_base(TEXT)
    more = set(all_) - set(base)
    assert [TEXT[a:b] for _, a, b in more] == ["(319) 555-5132"] and {k for k, _, _ in more} == {"phone"}
    alone = "we meet at (319) 555-5132 in 2024, version 2.0 of 3,000"
    clean = pii.found(["in 2024, version 2.0 of 3,000", alone], field)
    assert clean[0] == ([], []) and set(clean[1][0]) == set()


def test_field_carries_labels_to_all_mentions(field):
    text = "call +1 (319) 555-5132 now" + " later (319) 555-5132 we said" * 20
    base, all_ = pii.found([text], field)[0]
    assert len(base) == 1
    assert [text[a:b] for _, a, b in sorted(set(all_) - set(base), key=lambda x: x[1])] == ["(319) 555-5132"] * 20
    late = "later (319) 555-5132 we said " * 20 + "call +1 (319) 555-5132 now"
    assert len(pii.found([late], field)[0][1]) == 21


def test_fitting_sample_of_many_documents(spark):
    ids = spark.range(1 << 23).withColumnRenamed("id", "doc_id")
    assert 1 <= pii.drawn(ids, 20_000 / 2.1e10).count() <= 30  # 8 expected


def test_field_reads_numbers_with_letters_around():
    assert set(pii.keys("tel:319-555-5132")) == set(pii.keys("319-555-5132")) and pii.keys("v2.0") == pii.keys("x123") == []
    nodes, text = pii.Nodes(), "call +1 (319) 555-5132 now, in a file tel:5555132 and again"
    nodes.add(0, text, pii.base(text))
    at = [text[a:b] for a, b in nodes.at]
    assert ("555-5132", "tel:5555132") in [(at[i], at[j]) for i, j in nodes.skip]


def test_detect_and_redact(spark, docs, no_docs, field):
    some = docs.union(docs.limit(1).withColumn("doc_id", F.lit(9999).cast("long")).withColumn("text", F.lit(TEXT)))
    got = pii.detect(some, field).collect()
    assert len(got) == some.count()
    mine = next(r for r in got if r.doc_id == 9999)
    assert (mine.n_email, mine.n_ip, mine.n_card, mine.n_phone) == (1, 0, 1, 1)
    assert mine.base == pii.joined(brute_base(TEXT)) and "phone:34:48" in mine.spans
    red = pii.redact(some, field)
    assert red.columns == some.columns
    assert red.filter("doc_id = 9999").first().text == "call <PHONE> now. later <PHONE> and card <CARD>, v 2.0 of 3,000 in 2024 by <EMAIL>"
    assert red.filter("doc_id = 152").first().text is None
    assert pii.detect(no_docs).count() == 0 and pii.redact(no_docs).count() == 0


def test_beliefs_on_a_tree_are_exact():
    """Without loops the passing gives the exact marginals: against the sum over all labellings."""
    from itertools import product
    nodes = pii.Nodes()
    nodes.add(0, "12 34 12", [])
    nodes.features = [[], [], []]
    nodes.chain, nodes.skip = [(0, 1)], [(0, 2)]
    rng = np.random.default_rng(1)
    n = len(pii.KINDS) + 1
    sym = lambda m: m + m.T
    model = {"names": {}, "unary": np.zeros((1, n)), "none": 0.4, "chain": sym(rng.normal(size=(n, n))), "skip": sym(rng.normal(size=(n, n)))}
    want = np.zeros((3, n))
    for y in product(range(n), repeat=3):
        p = math.exp(0.4 * sum(v == 0 for v in y) + model["chain"][y[0], y[1]] + model["skip"][y[0], y[2]])
        for i, v in enumerate(y):
            want[i, v] += p
    assert np.allclose(pii.beliefs(nodes, model, rounds=40), want / want.sum(axis=1, keepdims=True), atol=1e-6)


def test_long_texts_are_inferred_in_windows(field):
    """A mention in the first window labels bare ones in all later ones; what
    is in one window comes out as without windows."""
    filler = " ".join(["wa 2.0 of 2024 in wb 3,000"] * 150)
    text = "call +1 (319) 555-5132 now " + f" {filler} later (319) 555-5132 we said" * 6
    whole, small = pii.found([text], field)[0], pii.found([text], field, window=150)[0]
    assert whole == small and len(whole[1]) == 7
    both = pii.found([text, TEXT, "", text], field, window=150)
    assert both == [small, pii.found([TEXT], field)[0], ([], []), small]


def test_memory_does_not_follow_a_text(field):
    import tracemalloc
    peaks = []
    for n in (20_000, 200_000):
        text = " ".join(str((i * 7919) % 10_000_019) for i in range(n))
        tracemalloc.start()
        pii.found([text], field, window=4096)
        peaks.append(tracemalloc.get_traced_memory()[1] - 40 * len(text))  # the text, its spans and their joins follow it
        tracemalloc.stop()
    assert peaks[1] < 2 * max(peaks[0], 10_000_000)


@pytest.mark.parametrize("n", [100, 400, 1200])
def test_field_adds_planted_repeats(spark, n):
    """Numbers first with their mark, later without: what the field adds to the
    patterns, on a table of its own at three sizes."""
    rng = random.Random(n)
    rows, bare = [], {}
    for i in range(n):
        words = [f"w{rng.choice('abcdef')}" for _ in range(40)] + ["2.0", "2024", "3,000", f"{rng.randint(10, 99)}:{rng.randint(10, 59)}", str(rng.randint(100, 99_999))]
        rng.shuffle(words)
        if i % 2 == 0:
            number = f"({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
            words.insert(rng.randint(0, 10), f"call +1 {number} for")
            words.insert(rng.randint(20, len(words)), f"or {number} at")
            bare[i] = number
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    hits = extra = 0
    for r in pii.detect(df).collect():
        base = set(r.base.split(","))
        added = [s for s in r.spans.split(",") if s and s not in base]
        text = rows[r.doc_id][1]
        found = [text[int(a):int(b)] for _, a, b in (s.split(":") for s in added)]
        hits += bare.get(r.doc_id) in found
        extra += sum(x != bare.get(r.doc_id) for x in found)
    assert hits >= 0.9 * len(bare) and extra <= 0.05 * len(bare)


def test_long_words_in_blocks(monkeypatch):
    """A lattice made block by block gives the sums of one held whole."""
    vocabulary = lattice.Vocabulary.load(lattice.MODEL)
    log_p = np.log(vocabulary.scores)
    rng = random.Random(4)
    words = ["".join(rng.choice("theinganéß字▁😀") for _ in range(n)) for n in (1, 2, 30, 200, 700)]
    count = np.array([1.0, 2.0, 1.0, 3.0, 1.0])
    whole, sums = lattice.log_words(words, vocabulary, log_p), lattice.expected(words, count, vocabulary, log_p)
    monkeypatch.setattr(lattice, "LONG", 0)
    for cells in (lattice.CELLS, 100):
        monkeypatch.setattr(lattice, "CELLS", cells)
        assert np.allclose(lattice.log_words(words, vocabulary, log_p), whole)
        assert np.allclose(lattice.expected(words, count, vocabulary, log_p), sums)


def test_links_reach_mentions_in_every_window():
    import numpy as np
    from spanalign.llm import pii
    model = {"names": {}, "unary": np.zeros((1, 5)), "none": 3.0, "chain": np.zeros((5, 5)), "skip": np.where(np.eye(5, dtype=bool), 4.0, -4.0)}
    all_spans = lambda texts, window: [pii.joined(s) for _, s in pii.found(texts, model, window)]
    text = "call 319-555-5132 or 77 88 99 12 13 14 +1 (319) 555-5132 and 319-555-5132 then 15 16 17 18"
    whole = "phone:5:17,phone:39:56,phone:61:73"
    assert all_spans([text], 1 << 20) == [whole]
    for window in (2, 3, 4, 7):   # the sure mention stands in a later window than the first one
        assert all_spans([text], window) == [whole]
    before = "11 22 33 44 55 66 77 " * 3   # what stands before a text doesn't cut it
    assert all_spans([before, text, before], 25)[1] == whole
    # without a sure mention the first one is the hub, whichever window a mention is in
    bare = "319-555-5132 " + "77 " * 9 + "319-555-5132"
    nodes, full = pii.Nodes(), []
    full += nodes.windows(0, bare, [], 4)
    full.append(nodes)
    last = full[-1]
    i = max(k for k, own in enumerate(last.own) if own)
    assert {last.at[h] for h, k in last.skip if k == i} == {(0, 12)}
    assert len(full) > 2 and sum(sum(x.own) for x in full) == 11
