"""Embedding near-duplicates: graph, search and whole results against brute force."""

import math

import numpy as np
from fixtures import CLASHES
from pyspark.sql import functions as F

from tickloom.llm import graphdup as G
from tickloom.llm import queries as Q


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def brute(rows, threshold):
    """rows: (vec_id, vector or None); (vec_id, n_links, component) of every row."""
    good = [k for k, (i, v) in enumerate(rows) if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)]
    u = unit(np.array([rows[k][1] for k in good], float))
    linked = u @ u.T >= threshold
    comp = list(range(len(good)))
    while True:
        new = [min(comp[j] for j in np.flatnonzero(linked[i])) for i in range(len(good))]
        if new == comp:
            break
        comp = new
    least = {}
    for k, c in zip(good, comp, strict=True):
        least[c] = min(least.get(c, rows[k][0]), rows[k][0])
    out = {k: (int(linked[n].sum()) - 1, least[comp[n]]) for n, k in enumerate(good)}
    return sorted(((i, *out.get(k, (0, i))) for k, (i, _) in enumerate(rows)), key=str)


def vectors(seed=4, n=2200, dim=24):
    """Close groups, a group whose members are just linked, a chain, scaled and equal copies, and noise."""
    r = np.random.default_rng(seed)
    x = unit(r.normal(size=(n, dim)))
    x[100:700] = unit(x[100] + 0.02 * r.normal(size=(600, dim)))
    x[700:800] = unit(x[700] + 0.055 * r.normal(size=(100, dim)))
    x[800:860] = unit(x[800] + 0.09 * r.normal(size=(60, dim)))
    x[900:1000] = x[900]
    x[1000:1010] = x[100]
    for i in range(1020, 1050):
        x[i] = unit((math.cos(0.4) * x[i - 1] + math.sin(0.4) * unit(r.normal(size=(1, dim)))[0])[None])[0]
    return x * r.uniform(0.1, 9, (n, 1))


def test_graph_is_reachable_and_searched_in_range():
    r = np.random.default_rng(1)
    u = unit(np.concatenate([r.normal(size=(400, 16)), np.repeat(r.normal(size=(1, 16)), 60, 0) + 0.01 * r.normal(size=(60, 16))]))
    lists, medoid = G.build(u)
    seen, todo = {medoid}, [medoid]
    while todo:
        new = [j for j in lists[todo.pop()] if j not in seen]
        seen.update(new)
        todo += new
    assert len(seen) == len(u) and G.build(u[:1]) == ([[]], 0)
    flat = np.full((len(u), max(map(len, lists))), -1)
    for i, x in enumerate(lists):
        flat[i, : len(x)] = x
    q, reach = u[380:], np.full(80, math.acos(0.9))
    a, b, angle = G.range_search(u, np.zeros(len(u)), flat, np.full((80, 1), medoid), q, reach)
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(q @ u.T >= 0.9), strict=True)}
    got = set(zip(a.tolist(), b.tolist(), strict=True))
    assert got <= want and len(got) >= 0.95 * len(want) and np.allclose(np.cos(angle), (q[a] * u[b]).sum(1))


def test_balls_hold_linked_vectors_only():
    u = unit(vectors())
    pivot = G.balls_of(u, math.acos(0.9) / 2)
    assert (pivot[pivot] == pivot).all() and len(set(pivot[100:700])) < 60
    for p in set(pivot):
        own = u[pivot == p]
        assert (own @ own.T >= 0.9).all()


def test_whole_results_with_awkward_rows(spark):
    x = vectors()
    rows = [(3 * i + 7, v.tolist()) for i, v in enumerate(x)]
    rows += [(1, None), (2, [0.0] * 24), (3, [1.0, None] + [0.0] * 22), (4, [float("nan")] * 24), (5, [float("inf")] + [0.0] * 23), (None, x[0].tolist()), (None, None), (1, None), (9000, x[100].tolist()), (9000, x[5].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for c in (*CLASHES, "node", "vec", "shard"):
        df = df.withColumn(c, F.lit("x"))
    out = G.near_duplicates(df.repartition(7)).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in out), key=str) == brute(rows, 0.9)
    assert all(r.kept == (r.vec_id == r.component_id or r.vec_id is None) for r in out) and out[0].recall >= 0.995
    assert G.near_duplicates(df.limit(0)).count() == 0
    bad = G.near_duplicates(df.filter("vec_id < 5")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in bad) == [(1, 0, 1, True), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 0, 4, True)]


def test_query_on_whole_embeddings(spark):
    path = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in Q.op11(spark, path).collect()), key=str) == brute(rows, 0.9)
