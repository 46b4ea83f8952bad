"""The pipeline's stages on a small folder of tables, each against a plain
version of its decisions, and run() against the stages one by one."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline as P
from spanalign.llm import pii

from .test_mixing_packing_sharding import brute_targets, words
from .test_simhash_multiset import brute_groups, brute_print

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    good = [f"good{k}" for k in range(300)]
    rows, labels = [], []
    for i in range(900):
        text = [rng.choice(good) for _ in range(rng.randint(8, 80))]
        kind = i % 9
        if kind == 0:
            text = ["spam"] * 30
        elif kind == 1:
            text[2:2] = ["vile", "nasty"]
        if i % 7 == 0:
            text.insert(3, f"joe{i}@mail.org")
        if i % 11 == 0:
            text.insert(1, f"+1 ({200 + i % 700}) 555-{1000 + i}")
        rows.append([i, " ".join(text), "en", f"src{i % 4 if i % 3 else 0}"])
        if i % 2 == (i // 9) % 2:
            labels.append((i, int(kind != 0), int(kind == 1)))
    for i in range(900, 960):  # copies, and copies but for one word
        text = rows[i - 800][1]
        rows.append([i, text if i % 2 else text + " more", "en", "src1"])
    rows += [[960, None, None, None], [961, "", "en", None], [962, "", "en", "src2"], [None, "no id", "en", "src2"], list(rows[5])]
    path = tmp_path_factory.mktemp("tables")
    docs = [(*r, None if r[1] is None else len(r[1])) for r in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.fixture(scope="module")
def steps(spark, folder, tmp_path_factory):
    """What each stage returned, written and read again."""
    out, docs = [], spark.read.parquet(f"{folder}/documents.parquet")
    out.append(docs)
    for name, stage in P.STAGES:
        path = f"{tmp_path_factory.mktemp('stage')}/{name}"
        stage(spark, out[-1], folder).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def rows_of(df):
    return Counter(tuple(r) for r in df.select(COLUMNS).collect())


def test_columns(steps):
    assert all(s.columns == COLUMNS for s in steps[:-1])


def test_quality_keeps_the_clean(steps):
    before, after = rows_of(steps[0]), rows_of(steps[1])
    assert not after - before
    kept = {r[0] for r in after}
    clean = [r[0] for r in before if r[1] is None or not re.search("spam|vile", r[1])]
    assert sum(i in kept for i in clean) >= 0.98 * len(clean)
    assert sum(bool(re.search("spam|vile", r[1] or "")) for r in after) <= 4


def test_near_duplicates_leave_one_of_each_group(steps):
    before, after = list(rows_of(steps[1]).elements()), rows_of(steps[2])
    assert not after - Counter(before)
    roots = brute_groups([brute_print(r[1]) for r in before])
    left = Counter(root for r, root in zip(before, roots, strict=True) for _ in range(1))
    low = {}
    for r, root in zip(before, roots, strict=True):
        if r[0] is not None:
            low[root] = min(low.get(root, r[0]), r[0])
    assert sum(after.values()) == len(left)
    assert {r[0] for r in after} >= set(low.values())


def test_personal_data_is_masked(steps):
    before, after = {(r[0], r[3]): r for r in rows_of(steps[2])}, {(r[0], r[3]): r for r in rows_of(steps[3])}
    assert before.keys() == after.keys()
    for k, (_, text, _, _, _) in before.items():
        got = after[k][1]
        if text is None:
            assert got is None and after[k][4] == 0
            continue
        assert after[k][4] == len(got)
        if pii.base(text):
            assert pii.base(got) == [] and ("<EMAIL>" in got or "<PHONE>" in got)
        else:
            assert got == text


def test_mix_takes_each_source_near_its_target(steps):
    before, after = rows_of(steps[3]), rows_of(steps[4])
    assert set(after) <= set(before) and all(n <= 2 * before[r] for r, n in after.items())
    size, taken = Counter(), Counter()
    for r in before.elements():
        size[r[3]] += words(r[1])
    for r in after.elements():
        taken[r[3]] += words(r[1])
    for s, t in brute_targets(dict(size)).items():
        assert abs(taken[s] - t) <= 0.1 * t + 80


def test_packing_places_every_row(steps, spark, folder):
    want = Counter((r[0], words(r[1]) + 1) for r in rows_of(steps[4]).elements())
    got = steps[5].collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == want
    for b in {r.bucket for r in got}:
        mine = [r for r in got if r.bucket == b]
        fit = max(1, 16_384 // mine[0].padded)
        assert sorted((r.batch, r.slot) for r in mine) == [(i // fit, i % fit) for i in range(len(mine))]
        assert all(r.n_tokens <= r.padded for r in mine)
    run = P.run(spark, folder)
    key = lambda rows: Counter((r.doc_id, r.n_tokens, r.bucket, r.padded) for r in rows)
    assert key(run.collect()) == key(got)
