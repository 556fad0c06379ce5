"""Importance resampling and the filter audit against brute-force versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import permutations

from fixtures import LONG, ODD_TEXTS, awkward, texts
from pyspark.sql import functions as F

from tickloom.llm import interactions, resampling
from tickloom.llm import queries as Q

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
COLUMNS = ["doc_id", "n_features", "weight", "score", "rank"]


def features(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute_resample(docs, target, percent=5, least=20):
    """docs: (doc_id, text) rows; rows (doc_id, n_features, weight, score, rank)."""
    bucket = lambda f: zlib.crc32(f.encode("utf-8", "surrogatepass")) % 10000
    s, t = (Counter(bucket(f) for x in side for f in features(x)[1]) for side in ([x for _, x in docs], target))
    size, aim, out = sum(s.values()), sum(t.values()), []
    for i, text in docs:
        words, f = features(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (size + 10000) / ((s[b] + 1) * (aim + 10000)))) for b in map(bucket, f))
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    pool = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(pool[: percent * len(pool) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=str)


def rows_of(df, columns=COLUMNS):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_features_of_runs_by_linear_crcs():
    for text in [*ODD_TEXTS, "Ab1 É-x " * 50, "x" * 70_000 + " y " + "z" * 300]:
        words, f = features(text)
        assert [w.decode() for w in resampling.words_of(text)] == words
        assert resampling.feature_crcs(resampling.words_of(text)).tolist() == [zlib.crc32(x.encode()) for x in f]


def test_resampling_of_whole_documents(spark):
    docs = list(texts().items())
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert rows_of(Q.op12(spark, SF)) == brute_resample(docs, target)


def test_resampling_of_awkward_rows(spark):
    rows = [(i, t) for i, t in enumerate([None, *ODD_TEXTS])] + [(None, "null id " * 20), (40, LONG)] + [(50 + i % 7, f"some words {i} " * 12) for i in range(60)]
    target = ["some words", None, "", "中文 and31"]
    got = resampling.resample(awkward(spark, rows), awkward(spark, list(enumerate(target))), percent=30)
    assert rows_of(got) == brute_resample(rows, target, percent=30)
    empty = awkward(spark, []).limit(0)
    assert resampling.resample(empty, empty).count() == 0
    assert rows_of(resampling.resample(awkward(spark, rows), empty, percent=100)) == brute_resample(rows, [], percent=100)


def test_drawing_among_equal_scores_and_repeated_rows(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 2, 3, 10**12]), rng.choice([-5, 0, 7, 10**9])) for _ in range(300)]
    scored = spark.createDataFrame(rows, "doc_id long, score long").repartition(5).withColumn("row", F.monotonically_increasing_id()).persist()
    order = sorted(rows, key=lambda r: (-r[1], r[0] is None, r[0] or 0))
    for wanted in (0, 1, 37, 150, 299, 300):
        chosen, left = resampling.draw(scored, wanted)
        got = resampling.ranked(scored.filter(chosen)).orderBy("rank").collect()
        assert [(r.doc_id, r.score) for r in got] == order[:wanted] and [r["rank"] for r in got] == list(range(1, wanted + 1))
        assert scored.filter(left).count() == 300 - wanted
    assert resampling.ranked(scored.limit(0)).count() == 0


def brute_audit(docs, labels):
    """docs: (doc_id, source, text); labels: doc_id -> (good, toxic)."""
    first = {}
    for i, _, t in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    fails = []
    for i, source, t in docs:
        t = t or ""
        words = re.findall("[^\x20\x09-\x0d]+", t)
        f = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > first[t]}
        fails.append((source or "", {k for k, x in f.items() if x}, labels.get(i, (False, False))))
    out = []
    for part in {p for p, _, _ in fails}:
        own, rows, sums = [x for x in fails if x[0] == part], [], Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                sums[f] += len(gone)
                rows.append([part, "".join(order), step, len(left), len(gone), sum(f in x[1] for x in own) - len(gone), sum(x[1] == {f} for x in own), sum(x[2][0] for x in gone), sum(x[2][1] for x in gone)])
        out += [(*r, sums[r[1][r[2] - 1]]) for r in rows]
    return sorted(out)


AUDIT = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_audit_of_awkward_rows(spark):
    long = " ".join(f"w{i}" for i in range(300))
    rows = [(i, t) for i, t in enumerate([None, *ODD_TEXTS])] + [(None, "x"), (None, "x"), (30, long), (30, long), (31, long), (32, long + " #"), (33, "AB " * 300), (34, "AB " * 300), (35, "x"), (35, "y")]
    docs = awkward(spark, rows)
    labels = [(30, 1, 0), (31, None, 1), (31, 1, None), (33, 0, 1), (34, 0, 0), (None, 1, 1)]
    marks = {30: (True, False), 31: (True, True), 33: (False, True)}
    got = interactions.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    source = lambda i: None if i is None or i % 2 else "s"
    assert rows_of(got, AUDIT) == sorted(brute_audit([(i, source(i), t) for i, t in rows], marks), key=str)
    assert interactions.audit(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_audit_of_whole_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "text").collect()]
    marks = {r.doc_id: (r.quality == 1, r.toxic == 1) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = Q.op13(spark, SF)
    assert rows_of(got, AUDIT) == sorted(brute_audit(rows, marks), key=str)
