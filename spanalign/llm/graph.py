"""Embedding near-duplicates over a robust-pruned flat graph.

Vectors are dealt to overlapping cluster shards. Each shard builds a flat
graph of robust-pruned neighbours; a vector's lists from all its shards are
united. A greedy search from the shard's medoids leads each vector to its
surroundings, and from there expands over all neighbours in range. Each link
is verified in double precision, and recall is audited by brute force."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanalign.llm.common import components, cut, uniform


@dataclass(frozen=True)
class Plan:
    """Vectors in a block of a shard; numbers that the centroids are fitted on,
    about, at most; centroids at most; shards of a vector; neighbours kept, near
    and far candidates of a vector; slack of the pruning; beam and medoids of
    the search; vectors audited, about, at most, and the recall below which overlap and beam are
    doubled and all is done again."""

    block: int = 2048
    fit_numbers: int = 1 << 22
    centroids: int = 1 << 14
    overlap: int = 3
    degree: int = 24
    near: int = 48
    far: int = 16
    slack: float = 1.2
    beam: int = 32
    medoids: int = 8
    audited: int = 256
    recall: float = 0.95


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows over their length, in doubles; scaled first, so that no square overflows."""
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def centroids(sample: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """k directions by spherical k-means."""
    rows = unit(sample)
    rng = np.random.default_rng(0)
    c = rows[rng.choice(len(rows), size=min(k, len(rows)), replace=False)]
    for _ in range(rounds):
        nearest = np.concatenate([(rows[a : a + 4096] @ c.T).argmax(axis=1) for a in range(0, len(rows), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, nearest, rows)
        size = np.sqrt((total * total).sum(axis=1, keepdims=True))
        c = np.where(size > 1e-9, total / np.maximum(size, 1e-9), c)
    return c


def pruned(v: np.ndarray, plan: Plan) -> np.ndarray:
    """Neighbours of each row of ``v`` (row x degree, -1: none). Candidates are
    the nearest rows and some at random, so that the graph has long edges too;
    from the nearest on, a kept one drops those that it is nearer to, by the
    slack, than the row is."""
    m = len(v)
    near, far = min(plan.near, m - 1), min(plan.far, m - 1)
    rng = np.random.default_rng(m)
    out = np.full((m, plan.degree), -1, dtype=np.int64)
    if m < 2:
        return out
    for a in range(0, m, 512):
        rows = np.arange(a, min(m, a + 512))
        sim = v[rows] @ v.T
        sim[np.arange(len(rows)), rows] = -2
        pool = np.concatenate([np.argpartition(-sim, near - 1, axis=1)[:, :near], rng.integers(0, m, (len(rows), far))], axis=1)
        own = np.take_along_axis(sim, pool, axis=1)
        order = np.argsort(-own, axis=1, kind="stable")
        pool, own = np.take_along_axis(pool, order, axis=1), np.take_along_axis(own, order, axis=1)
        gap = np.sqrt(np.maximum(0, 2 - 2 * own))
        alive = own > -1.5
        alive[:, 1:] &= pool[:, 1:] != pool[:, :-1]
        each = v[pool]
        for k in range(plan.degree):
            pick = alive.argmax(axis=1)
            some = np.flatnonzero(alive.any(axis=1))
            if not len(some):
                break
            p = pool[some, pick[some]]
            out[rows[some], k] = p
            between = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("qd,qkd->qk", v[p], each[some])))
            alive[some] &= plan.slack * between > gap[some]
            alive[some, pick[some]] = False
    return out


def found(v: np.ndarray, graph: np.ndarray, least: float, plan: Plan) -> np.ndarray:
    """Which rows each row of ``v`` reaches in range (row x row, symmetric)."""
    m = len(v)
    mean = v.mean(axis=0)
    starts = [int((v @ mean).argmax())]  # the medoid, then those farthest from all before
    apart = v @ v[starts[0]]
    for _ in range(min(plan.medoids, m) - 1):
        starts.append(int(apart.argmin()))
        apart = np.maximum(apart, v @ v[starts[-1]])
    starts = np.unique(starts)
    hits = np.zeros((m, m), dtype=bool)
    for a in range(0, m, 512):
        me = np.arange(a, min(m, a + 512))
        seen, hit = np.zeros((len(me), m), dtype=bool), np.zeros((len(me), m), dtype=bool)
        rows = np.arange(len(me))[:, None]

        def meet(q: np.ndarray, x: np.ndarray, seen: np.ndarray = seen, hit: np.ndarray = hit, me: np.ndarray = me) -> np.ndarray:
            sim = np.empty(len(q))
            for b in range(0, len(q), 1 << 16):
                s = slice(b, b + (1 << 16))
                sim[s] = np.einsum("ij,ij->i", v[me[q[s]]], v[x[s]])
            seen[q, x] = True
            inside = sim >= least
            hit[q[inside], x[inside]] = True
            return sim

        beam = np.tile(np.append(starts, np.full(max(0, plan.beam - len(starts)), -1)), (len(me), 1))
        value = np.full(beam.shape, -np.inf)
        value[:, : len(starts)] = meet(np.repeat(rows[:, 0], len(starts)), np.tile(starts, len(me))).reshape(len(me), -1)
        done = beam < 0
        for again in (False, True):
            while True:
                best = np.where(done, -np.inf, value).argmax(axis=1)
                act = np.flatnonzero(~done.all(axis=1))
                if not len(act):
                    break
                done[act, best[act]] = True
                new = graph[beam[act, best[act]]]
                ok = (new >= 0) & ~seen[act[:, None], new]
                q, k = np.nonzero(ok)
                sim = np.full(new.shape, -np.inf)
                x = new[q, k]
                once = np.unique(act[q] * m + x, return_index=True)[1]
                q, k, x = q[once], k[once], x[once]
                sim[q, k] = meet(act[q], x)
                both, ids, fin = np.concatenate([value[act], sim], axis=1), np.concatenate([beam[act], new], axis=1), np.concatenate([done[act], ~np.isfinite(sim)], axis=1)
                top = np.argpartition(-both, plan.beam - 1, axis=1)[:, : plan.beam]
                value[act], beam[act], done[act] = (np.take_along_axis(z, top, axis=1) for z in (both, ids, fin))
            if again:
                break
            # a row that the search did not lead to itself starts again where it is
            lost = np.flatnonzero(~seen[np.arange(len(me)), me])
            done[lost], value[lost], beam[lost] = True, -np.inf, -1
            if not len(lost):
                break
            beam[lost, 0], done[lost, 0] = me[lost], False
            value[lost, 0] = meet(lost, me[lost])
        edge = hit.copy()
        while edge.any():  # all neighbours of what is in range, until nothing new is
            q, x = np.nonzero(edge)
            more = np.zeros_like(edge)
            for b in range(0, len(q), 1 << 16):
                near = graph[x[b : b + (1 << 16)]]
                ok = near >= 0
                more[np.repeat(q[b : b + (1 << 16)], graph.shape[1])[ok.ravel()], near[ok]] = True
            more &= ~seen
            before = hit.copy()
            meet(*np.nonzero(more))
            edge = hit & ~before
        hits[me] = hit
    hits |= hits.T
    np.fill_diagonal(hits, False)
    return hits


def dealt(reps: DataFrame, plan: Plan) -> DataFrame:
    """A row for each shard of each vector: ``_shard, _cluster, _block, _home,
    rep, n, clusters, v``.

    A vector goes to the ``overlap`` clusters of the nearest centroids. A
    cluster of more than a block is cut into blocks by hash, and each pair of
    its blocks is a shard, so that shards stay of one size while all pairs of
    a cluster meet. ``_home`` marks the one shard in which pairs of one block
    are counted."""
    n, dim = reps.agg(F.count("*"), F.max(F.size("v"))).first()
    share = plan.fit_numbers / max(1, n * (dim or 1))
    sample = reps.filter(uniform("rep", "v", seed=2) < share).select("v").toPandas()["v"]
    by_length: dict[int, list] = {}
    for x in sample:
        by_length.setdefault(len(x), []).append(x)
    fitted = {d: centroids(np.array(x), max(1, min(plan.centroids, round(n * len(x) / len(sample) / plan.block * plan.overlap)))) for d, x in by_length.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("v").to_pylist()
            near: list = [None] * len(v)
            for d in {len(x) for x in v}:
                some = [i for i, x in enumerate(v) if len(x) == d]
                c = fitted.get(d)
                if c is None:
                    best = np.zeros((len(some), 1), dtype=np.int64)
                else:
                    sim = unit(np.array([v[i] for i in some])) @ c.T
                    best = np.sort(np.argsort(-sim, axis=1, kind="stable")[:, : plan.overlap], axis=1)
                for i, row in zip(some, best.tolist(), strict=True):
                    near[i] = [d * (1 << 20) + x for x in row]  # clusters of one length have numbers of their own
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near, pa.list_(pa.int64()))], [*b.schema.names, "clusters"])

    placed = cut(reps.mapInArrow(run, f"rep long, n long, v {reps.schema['v'].dataType.simpleString()}, clusters array<long>"), "clusters")
    member = placed.select("*", F.explode("clusters").alias("_cluster"))
    blocks = member.groupBy("_cluster").agg(F.ceil(F.count("*") / plan.block).cast("int").alias("_blocks"))
    member = member.join(blocks, "_cluster").withColumn("_block", F.pmod(F.xxhash64("_cluster", "rep"), F.col("_blocks")).cast("int"))
    other = F.explode(F.when(F.col("_blocks") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda x: x != F.col("_block"))))
    member = member.select("*", other.alias("_other"))
    low, high = F.least("_block", "_other"), F.greatest("_block", "_other")
    home = (F.col("_blocks") <= 2) | (high == F.when(F.col("_block") < F.col("_blocks") - 1, F.col("_block") + 1).otherwise(F.col("_block"))) & (low == F.when(F.col("_block") < F.col("_blocks") - 1, F.col("_block")).otherwise(F.col("_block") - 1))
    return member.select(F.concat_ws("-", "_cluster", low, high).alias("_shard"), "_cluster", "_block", home.alias("_home"), "rep", "n", "clusters", "v")


def linked(members: DataFrame, least: float, plan: Plan) -> DataFrame:
    """``rep, links, label`` for each vector of each shard: the other vectors
    linked to it that are counted there, and the smallest of its group there."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        rep = pdf["rep"].to_numpy()
        graph = pruned(unit(np.stack(pdf["v"].to_numpy())), plan)
        return pd.DataFrame({"rep": rep, "near": [rep[g[g >= 0]] for g in graph]})

    lists = members.groupBy("_shard").applyInPandas(build, "rep long, near array<long>")
    united = lists.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep", ignore_index=True)
        rep, n = pdf["rep"].to_numpy(), pdf["n"].to_numpy()
        v = unit(np.stack(pdf["v"].to_numpy()))
        here = [np.searchsorted(rep, x) for x in pdf["near"]]
        here = [p[rep[np.minimum(p, len(rep) - 1)] == x] if len(x) else p for p, x in zip((np.minimum(p, len(rep) - 1) for p in here), pdf["near"], strict=True)]
        graph = np.full((len(rep), max(1, max(map(len, here)))), -1, dtype=np.int64)
        for i, p in enumerate(here):
            graph[i, : len(p)] = p
        hits = found(v, graph, least, plan)
        label = np.arange(len(rep))
        q, x = np.nonzero(np.triu(hits))
        while True:
            new = label.copy()
            np.minimum.at(new, q, label[x])
            np.minimum.at(new, x, label[q])
            new = new[new]
            if np.array_equal(new, label):
                break
            label = new
        # a pair is counted in its first common cluster, and a pair of one block in that block's home shard
        q, x = np.nonzero(hits)
        cluster, block, home = int(pdf["_cluster"].iloc[0]), pdf["_block"].to_numpy(), pdf["_home"].to_numpy()
        width = max(map(len, pdf["clusters"]))
        lists = np.array([[*c, *[-1] * (width - len(c))] for c in pdf["clusters"]])
        count = np.zeros(len(rep), dtype=np.int64)
        for a in range(0, len(q), 1 << 18):
            i, j = q[a : a + (1 << 18)], x[a : a + (1 << 18)]
            earlier = ((lists[i][:, :, None] == lists[j][:, None, :]) & (lists[i][:, :, None] >= 0) & (lists[i][:, :, None] < cluster)).any(axis=(1, 2))
            ok = ~earlier & ((block[i] != block[j]) | home[i])
            np.add.at(count, i[ok], n[j[ok]])
        return pd.DataFrame({"rep": rep, "links": count, "label": rep[label]})

    rows = members.join(united, "rep")
    return rows.groupBy("_shard").applyInPandas(search, "rep long, links long, label long")


def audit(reps: DataFrame, links: DataFrame, least: float, queries: int) -> float:
    """Recall of ``links(rep, links)`` for a bounded sample of vectors, each
    compared with all rows in blocks by brute force (nothing found is wrong,
    so ratios of counts are recalls): the lesser of that of all links and the
    mean of the vectors that have any, so that one dense group can't hide what
    sparse ones lose."""
    chosen = reps.filter(uniform("rep", "v", seed=3) < queries / max(1, reps.count())).select("rep", "v").toPandas()
    if not len(chosen):
        return 1.0
    ids, q = chosen["rep"].to_numpy(), {}
    for d in {len(x) for x in chosen["v"]}:
        some = np.array([i for i, x in enumerate(chosen["v"]) if len(x) == d])
        q[d] = (some, unit(np.stack(chosen["v"].to_numpy()[some])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(ids), dtype=np.int64)
        for b in batches:
            v, rep, n = b.column("v").to_pylist(), b.column("rep").to_numpy(), b.column("n").to_numpy()
            for d, (some, mine) in q.items():
                rows = np.array([i for i, x in enumerate(v) if len(x) == d], dtype=np.int64)
                if len(rows):
                    inside = (mine @ unit(np.array([v[i] for i in rows])).T >= least) & (ids[some][:, None] != rep[rows][None, :])
                    total[some] += inside @ n[rows]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], ["rep", "true"])

    true = reps.mapInArrow(run, "rep long, true long").groupBy("rep").agg(F.sum("true").alias("true"))
    both = true.join(links, "rep", "left").withColumn("got", F.coalesce("links", F.lit(0)))
    got, want, each = both.agg(F.sum("got"), F.sum("true"), F.avg(F.when(F.col("true") > 0, F.col("got") / F.col("true")))).first()
    return min(got / want, each) if want else 1.0


def near_duplicates(vectors: DataFrame, least: float = 0.95, plan: Plan = Plan()) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of
    ``vectors(vec_id, embedding)``.

    Equal embeddings stand for each other in the graph and count as links of
    one another. Vectors that are null, empty, zero or hold null or non-finite
    numbers, and rows without an id, link with nothing and are components of
    their own; vectors of different lengths don't link; rows that share an id
    share their links; other columns are not used; no rows give no rows.
    Numbers keep their own precision: floats as floats, others as doubles."""
    floats = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    e = F.col("embedding") if floats else F.col("embedding").cast("array<double>")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.coalesce(F.col("vec_id").isNotNull() & ~bad & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = vectors.select("vec_id", F.when(good, e).alias("v"))
    reps = cut(rows.filter("v is not null").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")).select("rep", "n", "v"), "vectors")
    while True:
        links = cut(linked(dealt(reps, plan), least, plan), "links")
        counts = links.groupBy("rep").agg(F.sum("links").alias("links"))
        recall = audit(reps, counts, least, plan.audited)
        if recall >= plan.recall:
            break
        if plan.overlap > 64:
            raise RuntimeError(f"recall {recall:.3f} with {plan.overlap} shards a vector")
        plan = replace(plan, overlap=plan.overlap * 2, beam=plan.beam * 2)
    label = components(links.select(F.col("rep").alias("u"), F.col("label").alias("v")))
    known = reps.join(counts, "rep", "left").join(label, F.col("rep") == F.col("node"), "left")
    known = known.select(F.col("v").alias("_v"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("label", "rep").alias("component_id"))
    out = rows.join(known, F.col("v") == F.col("_v"), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
