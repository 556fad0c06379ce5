"""Fingerprints, nearest neighbours and the quality classifier."""

import hashlib
import math
import zlib

import numpy as np
import pyarrow.parquet as pq
from fixtures import CLASHES, LONG, ODD_TEXTS, awkward, texts
from pyspark.sql import functions as F

from tickloom.llm import ann, fingerprint, quality
from tickloom.llm import queries as Q

SF = "/root/testdata/sf0.001"


def brute_edit(docs):
    ids = sorted(docs)
    out = {}
    for k, i in enumerate(ids):
        t, following = docs[i], docs[ids[(k + 1) % len(ids)]]
        cut = len(t) // 4
        out[i] = t[: len(t) - cut] + following[:cut]
    return out


def common(a, b):
    return next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def check_edits(rows, docs):
    want = brute_edit(docs)
    assert {r.doc_id for r in rows} == docs.keys() and len(rows) == len(docs)
    by_text = {}
    for r in rows:
        t = docs[r.doc_id]
        assert (r.n_chars, r.edited_sha256, r.common_edited) == (len(t), hashlib.sha256(want[r.doc_id].encode()).hexdigest(), common(t, want[r.doc_id]))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint and by_text.setdefault(want[r.doc_id], r.edited_fingerprint) == r.edited_fingerprint
    assert len(set(by_text.values())) == len(by_text)


def test_fingerprint_query(spark):
    rows = Q.op6(spark, SF).collect()
    check_edits(rows, texts())
    long = [r for r in rows if r.n_chars > 400]
    assert np.mean([r.near_edited for r in long]) > 0.5 and np.mean([r.near_next for r in long]) < 0.1


def test_fingerprint_awkward_rows(spark):
    docs = dict(enumerate([*ODD_TEXTS, "same", "same", LONG[::-1]], -3))
    df = awkward(spark, [(i, t or None) for i, t in docs.items()])
    check_edits(fingerprint.fingerprint_edits(df, 3).collect(), docs)
    check_edits(fingerprint.fingerprint_edits(df, 40).collect(), docs)  # more ranges than rows
    one = fingerprint.fingerprint_edits(awkward(spark, [(5, "abcdefgh")])).collect()
    assert [(r.n_chars, r.edited_sha256) for r in one] == [(8, hashlib.sha256(b"abcdefab").hexdigest())]
    assert not fingerprint.fingerprint_edits(df.filter("doc_id = 99")).count()
    assert fingerprint.fingerprint_edits(awkward(spark, [(None, "x"), (1, "y"), (1, "y")])).count() == 3


def test_span_equality_and_extensions():
    a, b = (fingerprint.Prefix(fingerprint.code_points(t)) for t in ("xxabcabcabd", "abcabcabdyy"))
    assert fingerprint.common_extension(a, 2, b, 0) == 9 and fingerprint.common_extension(a, 5, b, 0) == 5 and fingerprint.common_extension(a, 0, b, 0) == 0
    assert fingerprint.equal_spans(a, 2, a, 5, 5) and not fingerprint.equal_spans(a, 2, a, 5, 6)


def vectors_of(path):
    t = pq.read_table(f"{path}/embeddings.parquet").to_pydict()
    return t["vec_id"], np.array(t["embedding"], np.float64)


def test_search_query_recall(spark):
    path = "/root/testdata/sf0.01"
    rows = Q.op9(spark, path).collect()
    ids, x = vectors_of(path)
    at = {i: k for k, i in enumerate(ids)}
    by = {}
    for r in rows:
        by.setdefault(r.query_id, []).append(r)
        assert math.isclose(r.score, float(x[at[r.query_id]] @ x[at[r.vec_id]]), abs_tol=1e-12) and r.vec_id != r.query_id
    assert by.keys() == {i for i in ids if i % 20 == 0}
    recall = []
    for q, got in by.items():
        got.sort(key=lambda r: r.rank)
        assert [r.rank for r in got] == list(range(1, 21)) and [(-r.score, r.vec_id) for r in got] == sorted((-r.score, r.vec_id) for r in got)
        s = x @ x[at[q]]
        s[at[q]] = -9
        recall.append(len({ids[k] for k in np.argsort(-s)[:20]} & {r.vec_id for r in got}) / 20)
    assert np.mean(recall) >= 0.9


def test_search_of_copies_norms_and_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(ann, "ENTRY_BLOCK", 16)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 6)) * rng.uniform(0.2, 3, (300, 1))
    x[100:200] = x[100]
    rows = [(i, [float(np.float32(a)) for a in v]) for i, v in enumerate(x)]
    rows += [(500, None), (501, [0.0] * 6), (502, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (503, [float("nan")] * 6), (504, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0]), (505, []), (None, [1.0] * 6), (506, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for c in CLASHES:
        df = df.withColumn(c, F.lit("x")) if c not in ("i", "j") else df.withColumn(c, F.lit(1))
    queries = df.filter("vec_id % 3 = 0 OR vec_id >= 500")
    got = ann.search(df, queries, k=5, reach=1.0).collect()
    exact = np.array([v for _, v in rows[:300]])
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    hits = 0
    for q in range(0, 300, 3):
        order = sorted((-math.fsum(exact[q] * v), i) for i, v in enumerate(exact) if i != q)[:5]
        assert len(by[q]) == 5
        hits += len({i for _, i in order} & {i for _, i in by[q]})
    assert by.keys() == set(range(0, 300, 3)) and hits >= 0.9 * 500
    assert sorted(by[102])[0][1] in range(300)
    few = ann.search(df.filter("vec_id < 4"), df.filter("vec_id < 4"), k=20).collect()
    assert len(few) == 12
    assert not ann.search(df.filter("vec_id = 999"), df, k=5).count() and not ann.search(df, df.filter("vec_id = 500"), k=5).count()


def test_walk_is_ordered():
    rng = np.random.default_rng(0)
    a, b = rng.random(7), rng.random(5)
    got = list(ann.walk(a, b))
    assert sorted(got) == [(i, j) for i in range(7) for j in range(5)]
    sums = [a[i] + b[j] for i, j in got]
    assert sums == sorted(sums)


def test_quality_held_out(spark):
    path = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in Q.op3(spark, path).collect()}
    labels = pq.read_table(f"{path}/labels.parquet").to_pydict()
    assert rows.keys() == texts(path).keys()
    right = [rows[i].predicted == q for i, q in zip(labels["doc_id"], labels["quality"], strict=True) if rows[i].held_out]
    assert len(right) > 30 and np.mean(right) > 0.95
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)


def test_quality_awkward_rows(spark):
    docs = awkward(spark, [(1, "fine words here"), (2, "JUNK!! JUNK!!"), (3, None), (4, ""), (4, ""), (None, "fine words"), (5, LONG), (6, "fine text here too")])
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (4, 7), (None, 1), (99, 1), (1, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    out = quality.score(docs, model, docs.columns, "_q").collect()
    assert len(out) == 8 and all(0 <= r._q <= 1 and r.key == "x" for r in out)
    assert {r._q for r in out if not r.text} == {0.5}
    assert len(quality.score(docs, quality.fit(docs, labels.limit(0))).collect()) == 8
    assert not quality.score(docs.filter("doc_id = 77"), model).count()


def brute_votes(model, text):
    """The score of one text: all cosines by a plain loop, the largest 15 with their ties, similarity to the power of 8."""
    x = quality.features([text])[0].astype(float)
    y = [math.fsum(x * model.basis[:, j]) for j in range(model.basis.shape[1])]
    size = math.sqrt(math.fsum(a * a for a in y))
    near = []
    for v, d, label in zip(model.vectors, model.digests, model.labels, strict=True):
        cos = round(math.fsum(a * b for a, b in zip(y, v, strict=True)) / max(size, 1e-12), 9)
        if d != quality.digest(text) and cos > 0:
            near.append((cos, label))
    near.sort(reverse=True)
    near = [p for p in near if p[0] >= near[min(15, len(near)) - 1][0]]
    total = sum(c**8 for c, _ in near)
    return sum(c**8 * label for c, label in near) / total if total > 1e-9 else model.prior


def test_quality_votes_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    known = texts()
    again = {10**6 + i: t for i, t in known.items() if i % 7 == 0} | {10**7 + i: t for i, t in known.items() if i % 21 == 0} | {-1: "", -2: "zzz", -3: LONG}
    rows = spark.createDataFrame([*known.items(), *again.items()], "doc_id long, text string")
    got = {r.doc_id: r.score for r in quality.score(rows.repartition(5), model).collect()}
    by_text = {}
    for i, t in (known | again).items():
        assert by_text.setdefault(t, got[i]) == got[i]
    for t, score in by_text.items():
        assert abs(score - brute_votes(model, t)) < 1e-6
    full, _, v = np.linalg.svd(np.stack([quality.features([t])[0] for i, t in sorted(known.items())][:60]).astype(float), full_matrices=False)
    small = quality.Model(np.stack([quality.features([t])[0] for i, t in sorted(known.items())][:60]), np.arange(60), np.arange(60) % 2)
    ours = small.basis[:, :10]
    assert full.shape[1] and np.linalg.norm(ours - v[:10].T @ (v[:10] @ ours)) < 0.05 * np.linalg.norm(ours)
