import numpy as np
import pytest

from spanalign.llm import graph


def brute(ids, vectors):
    """Links and components of finite, non-zero vectors of one length."""
    v = graph.unit(vectors)
    hit = v @ v.T >= 0.95
    np.fill_diagonal(hit, False)
    root = np.arange(len(v))
    while True:
        new = np.minimum(root, np.where(hit, root[None, :], len(v)).min(axis=1))
        if (new == root).all():
            return hit.sum(axis=1), [min(i for i, r in zip(ids, root, strict=True) if r == k) for k in root]
        root = new


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(5)
    far = rng.normal(size=(900, 24))
    ball = rng.normal(size=24) + 0.12 * rng.normal(size=(500, 24))
    pairs = far[:120] + 0.15 * rng.normal(size=(120, 24))
    rows = np.concatenate([far, ball, pairs, far[:30], np.repeat(far[40:41], 200, axis=0)]).astype(np.float32)
    return rows[rng.permutation(len(rows))]


def test_near_duplicates(spark, cloud):
    rows = [(i + 10, v.tolist(), i) for i, v in enumerate(cloud)]
    bad = [(1, None, 0), (2, [0.0] * 24, 0), (3, [float("nan")] + [1.0] * 23, 0), (4, [None] + [1.0] * 23, 0), (5, [float("inf")] + [1.0] * 23, 0), (6, [], 0), (7, [1.0, 2.0], 0), (8, [2.0, 4.0], 0)]
    df = spark.createDataFrame(rows + bad + [(None, rows[0][1], 0)], "vec_id long, embedding array<float>, links int")
    got = {r.vec_id: r for r in graph.near_duplicates(df, plan=graph.Plan(block=256)).collect()}
    assert len(got) == df.count()
    for i in range(1, 7):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert (got[7].n_links, got[8].n_links, got[8].component_id, got[8].kept) == (1, 1, 7, False)
    assert (got[None].n_links, got[None].component_id, got[None].kept) == (0, None, False)
    links, components = brute([r[0] for r in rows], cloud)
    found = np.array([got[r[0]].n_links for r in rows])
    assert (found <= links).all() and found.sum() >= 0.98 * links.sum()
    same = np.mean([got[r[0]].component_id == c for r, c in zip(rows, components, strict=True)])
    assert same >= 0.98
    assert graph.near_duplicates(df.limit(0)).count() == 0


def test_search_reaches_all_in_range(cloud):
    v = graph.unit(np.unique(cloud, axis=0))
    plan = graph.Plan()
    got = graph.found(v, graph.pruned(v, plan), 0.95, plan)
    want = v @ v.T >= 0.95
    np.fill_diagonal(want, False)
    assert not (got & ~want).any() and got.sum() >= 0.98 * want.sum()


def test_audit_counts_missing_links(spark, cloud):
    rows = np.unique(cloud, axis=0)
    reps = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(rows)], "rep long, n long, v array<float>")
    links, _ = brute(range(len(rows)), rows)
    full = spark.createDataFrame([(i, int(n)) for i, n in enumerate(links)], "rep long, links long")
    assert graph.audit(reps, full, 0.95, 200) == 1.0
    assert graph.audit(reps, full.selectExpr("rep", "cast(floor(links / 2) as long) links"), 0.95, 200) < 0.6


def test_overlap_is_doubled_until_the_audit_is_content(spark, cloud):
    """A plan that finds too little by itself: one cluster a vector, few neighbours."""
    rows = [(i, v.tolist()) for i, v in enumerate(cloud[:600])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    poor = graph.Plan(block=64, overlap=1, degree=2, near=2, far=0, beam=1, medoids=1, audited=600)
    got = {r.vec_id: r.n_links for r in graph.near_duplicates(df, plan=poor).collect()}
    links, _ = brute(range(600), cloud[:600])
    assert sum(got.values()) >= 0.94 * links.sum()


def test_numbers_keep_their_precision(spark):
    """Doubles beyond the range of floats, and whole numbers."""
    pairs = [[1e300, 3e300], [3e300, 1e300], [1e-60, 3e-60], [3e-60, -1e-60], [1e-310, 3.05e-310], [5.0, 5.0]]
    df = spark.createDataFrame(list(enumerate(pairs)), "vec_id long, embedding array<double>")
    links, components = brute(range(len(pairs)), np.array(pairs))
    got = {r.vec_id: (r.n_links, r.component_id) for r in graph.near_duplicates(df).collect()}
    assert got == {i: (int(n), c) for i, (n, c) in enumerate(zip(links, components, strict=True))} and got[1][0] == 0 and got[0][0] == 2
    whole = spark.createDataFrame([(1, [1, 2]), (2, [2, 4]), (3, [2, -1])], "vec_id long, embedding array<int>")
    assert {r.vec_id: r.n_links for r in graph.near_duplicates(whole).collect()} == {1: 1, 2: 1, 3: 0}
