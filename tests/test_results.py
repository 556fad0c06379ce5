import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.functions import settings as S
from tickloom.operators import documents as D
from tickloom.operators import gates as G
from tickloom.operators import ledger as L
from tickloom.operators import reports as R
from tickloom.operators import selection as SEL
from tickloom.sources import bars as B
from tickloom.streaming.bars import stream_bars


def test_chunks_and_entities(spark):
    docs = spark.createDataFrame([(1, "Alpha Beta met gamma. Alpha Beta left! The end"), (2, ""), (3, "lower words only words here words")], "doc_id bigint, text string")
    ch = D.chunks(docs, size=4, overlap=1)
    assert [r.text for r in ch.filter("doc_id = 1").orderBy("chunk_no").collect()] == ["Alpha Beta met gamma.", "gamma. Alpha Beta left!", "left! The end"]
    ent = D.entities(D.chunks(docs))
    assert [r.entity for r in ent.filter("doc_id = 1").orderBy("pos").collect()] == ["Alpha Beta"]
    assert ent.filter("doc_id = 3").orderBy("pos").first().entity == "Words"
    assert D.entity_descriptions(ent).filter("entity = 'Alpha Beta'").first().description == "Alpha Beta: Alpha Beta met gamma"


def test_similarity_collapses_copies(spark):
    rows = [(f"c{i}", f) for i in range(30) for f in ("A", "B")] + [("x", "A"), ("y", "Z")]
    got = SEL.batch_similarity(spark.createDataFrame(rows, "policy_id string, feature string")).first()
    pairs = 32 * 31 / 2
    assert got.avg_jaccard == pytest.approx((30 * 29 / 2 + 30 * 0.5) / pairs) and got.collision_rate == pytest.approx(30 * 29 / 2 / pairs)


@pytest.mark.parametrize("threshold", [0.0, 0.5, 0.8, 1.0])
def test_similarity_join_equals_brute_force(spark, threshold):
    rng = random.Random(7)
    sets = {f"p{i:03d}": set(rng.sample([f"F{k}" for k in range(40)], rng.randint(1, 9))) | {"HOT"} for i in range(120)}
    for i in range(40):  # copies, and copies with one feature more
        sets[f"q{i:03d}"] = sets["p000"] | ({f"F{i}"} if i % 2 else set())
    rows = [(p, f) for p, fs in sets.items() for f in fs]
    genes = spark.createDataFrame([*rows, *rows[:50], ("null", None)], "policy_id string, feature string")
    j = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    got = {(r.p1, r.p2): r.jaccard for r in SEL.similar_policies(genes, threshold).collect()}
    assert got == pytest.approx({k: v for k, v in j.items() if v > threshold})
    if threshold == 0.8:  # all sets share HOT: every pair of genomes has a feature in common
        genomes, _ = SEL.genomes_of(genes)
        n = genomes.count()
        assert SEL.candidate_genomes(genomes, threshold).count() < n * (n - 1) / 2 / 20


def test_diverse_filter_is_the_sequential_one(spark):
    rng = random.Random(3)
    sets = {f"p{i:03d}": frozenset(rng.sample("abcdefgh", rng.randint(0, 6))) for i in range(150)}
    order = {p: (i * 37) % 50 for i, p in enumerate(sets)}  # ties of ord
    bad = {p for i, p in enumerate(sets) if i % 11 == 0}
    kept = []
    for p in sorted(sets, key=lambda p: (order[p], p)):
        if p not in bad and all(not sets[p] or len(sets[p] & sets[q]) / len(sets[p] | sets[q]) <= 0.5 for q in kept):
            kept.append(p)
    genes = spark.createDataFrame([(p, f) for p, fs in sets.items() for f in fs], "policy_id string, feature string")
    cand = spark.createDataFrame(list(order.items()), "policy_id string, ord int")
    compat = spark.createDataFrame([(p, -1.0 if p in bad else 0.0) for p in sets], "policy_id string, score double")
    assert {r.policy_id for r in SEL.filter_diverse(cand, genes, compat, 0.5).collect()} == set(kept)
    assert SEL.similar_policies(genes.limit(0), 0.5).count() == 0


def test_ledger_lines_skip_broken(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"exp_id": "a", "eval_score": 1.5}\n{broken\n{"exp_id": "b"}\n')
    got = L.read_ledger(spark, str(tmp_path / "l.jsonl"))
    assert {r.exp_id for r in got.collect()} == {"a", "b"}
    assert [r.exp_id for r in L.prune(got, 1).collect()] == ["a"]


def test_genome_text_and_policy_id(spark):
    g = F.create_map(F.lit("RSI"), F.create_map(F.lit("window"), F.lit(14.0)), F.lit("ADX"), F.create_map(F.lit("x"), F.lit(1.0)))
    row = spark.range(1).select(L.genome_text(g).alias("t"), L.policy_id(g, F.lit("r"), F.create_map(F.lit("k"), F.lit(1.0))).alias("p")).first()
    assert row.t == "ADX, RSI(14)" and row.p.startswith("pol_") and len(row.p) == 20


def test_priors_stay_normalised_and_move(spark):
    imp = spark.createDataFrame([("BULL", i, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0) for i in range(40)], "regime string, seq bigint, " + ", ".join(f"{c} double" for c in L.CATEGORIES))
    whole, parts = (L.priors(imp, b).orderBy("seq").collect() for b in (1000, 7))
    assert abs(sum(whole[-1][c] for c in L.CATEGORIES) - 1) < 1e-12 and whole[0].calibration != 0.5 and whole[-1].TREND > 0.3
    assert all(abs(a.TREND - b.TREND) < 1e-9 for a, b in zip(whole, parts))


def test_histogram_last_bin_is_closed(spark):
    df = spark.createDataFrame([("b", float(v)) for v in (0, 1, 1.5, 2, 3)], "batch_id string, v double")
    assert [r.n for r in R.histogram(df, ["batch_id"], "v", [0, 1, 2, 3]).orderBy("lo").collect()] == [1, 2, 2]


def test_union_ranges_keeps_first_and_asof_looks_back(spark):
    d = lambda i: dt.datetime(2024, 1, i)
    mk = lambda rows: spark.createDataFrame([("S", t, v, v, v, v, 1.0) for t, v in rows], "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double")
    u = B.union_ranges([mk([(d(1), 1.0), (d(2), 2.0)]), mk([(d(2), 9.0), (d(3), 3.0)])])
    assert [r.close for r in u.orderBy("ts").collect()] == [1.0, 2.0, 3.0]
    macro = spark.createDataFrame([(d(2), 5.0)], "ts timestamp_ntz, m double")
    assert [r.m for r in B.asof_join(u, macro).orderBy("ts").collect()] == [None, 5.0, 5.0]


def test_streaming_bars(spark, tmp_path):
    rows = [(1, dt.datetime(2024, 1, 1, 0, 5), 1.0), (2, dt.datetime(2024, 1, 1, 0, 50), 3.0), (3, dt.datetime(2024, 1, 1, 9, 0), 2.0)]
    spark.createDataFrame(rows, "id bigint, ts timestamp, v double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id bigint, ts timestamp, v double").parquet(str(tmp_path / "in"))
    out = stream_bars(stream, F.lit("S"), "ts", F.col("v"), F.lit(1), F.struct("ts", "id"))
    q = out.writeStream.outputMode("append").format("memory").queryName("bars_out").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("bars_out").collect()
    assert len(got) == 1 and (got[0].open, got[0].high, got[0].close, got[0].volume) == (1.0, 3.0, 3.0, 2.0)


def test_generations_number_experiments_by_time(spark):
    from tickloom.operators import ledger as L
    rows = [(f"e{i * 7 % 50:02d}", i % 4) for i in range(50)]
    got = L.generations(spark.createDataFrame(rows, "exp_id string, ts int").repartition(5)).collect()
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    assert sorted((r.generation, r.exp_id) for r in got) == [(k, e) for k, (e, _) in enumerate(order, 1)]
    assert L.generations(spark.createDataFrame([], "exp_id string, ts int")).count() == 0


def test_budgets_lie_inside_their_profile(spark):
    from tickloom.operators import windows as W
    rows = W.profile_budgets(spark.range(500).withColumnRenamed("id", "customer"), ["customer"]).collect()
    assert len(rows) == 1500 and len({r.customer for r in rows}) == 500
    for r in rows:
        assert r.k_up_min <= r.k_up <= r.k_up_max and r.k_down_min <= r.k_down <= r.k_down_max and r.h_min <= r.horizon <= r.h_max
    for name, *_ in W.PROFILES:
        own = [r for r in rows if r.profile_id == name]
        assert {r.horizon for r in own} == set(range(own[0].h_min, own[0].h_max + 1)) and len({r.k_up for r in own}) > 490
    again = W.profile_budgets(spark.range(499, -1, -1).withColumnRenamed("id", "customer"), ["customer"]).collect()
    assert sorted(again) == sorted(rows)


def test_scores_of_a_hot_group(spark):
    rng = random.Random(5)
    rows = [("hot", rng.gauss(0, 1), i % 7 == 0) for i in range(3000)] + [("ties", 1.0, False)] * 50 + [("few", 3.0, True), ("few", None, False), ("none", None, False)]
    df = spark.createDataFrame(rows, "k string, score double, violation boolean")
    got = {r.k: r for r in G.aggregate_scores(df, ["k"]).collect()}
    for k in ("hot", "ties", "few"):
        v = np.array([s for g, s, _ in rows if g == k and s is not None])
        assert got[k].median_score == pytest.approx(np.median(v)) and got[k].p10_score == pytest.approx(np.quantile(v, S.LOWER_Q))
    assert got["none"].median_score is None and G.aggregate_scores(df.limit(0), ["k"]).count() == 0


def test_a_return_that_meets_its_floor_does_not_hang_on_the_order_of_rows(spark, tmp_path):
    from tickloom.queries.result_queries import KEYS, metrics_table, staged
    cents = [3, 7, -9, 1, 8, -4, -6, 10, 2, -7, 5, -8, 6, -2, -6]  # sum 0: the excess return of supplier 53 is 0, its floor, whatever the order
    rows = [(sup, "A", float(sup), max(x, 0) / 100, max(-x, 0) / 100) for sup in (53, 53 * 5, 53 * 9) for x in cents * 3]
    for i in range(4):
        random.Random(i).shuffle(rows)
        path = f"{tmp_path}/{i}"
        spark.createDataFrame(rows, "l_suppkey bigint, l_returnflag string, l_quantity double, l_discount double, l_tax double").coalesce(1 + i).write.parquet(f"{path}/lineitem.parquet")
        assert {r.excess_return for r in metrics_table(spark, path).collect()} == {0.0}
        assert G.failures(staged(spark, path), KEYS).filter("code = 'FAIL_LOW_RETURN' and stage_id = 2").count() == 0


def test_the_document_index_writes_no_text_per_entity(spark, tmp_path):
    from pathlib import Path

    from tickloom.queries import document_queries as Q
    from tickloom.queries.base import QUERIES
    from tickloom.session import shared_folder
    rng = random.Random(2)
    words = [f"Name{chr(97 + i % 26)}{chr(97 + i // 26)}" if i % 5 == 0 else f"word{i}" for i in range(200)]
    texts = [" ".join(rng.choices(words, k=600)) for _ in range(60)] + ["", "only lower words in here here"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    folder = Path(shared_folder(spark).removeprefix("file:"))
    size = lambda: sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())
    before = size()
    edges = QUERIES["doc.graph"](spark, str(tmp_path))
    assert edges.count() > 0 and size() - before < 2 * sum(map(len, texts))
    ch, links = Q.linked(spark, str(tmp_path))
    idf = D.inverse_frequencies(D.texts_of(ch, *links))
    one, two = ({(r.text_key, r.term): r.weight for r in D.tfidf(D.texts_of(ch, *links), idf, head).collect()} for head in (50_000, 7))
    assert one == pytest.approx(two) and len(one) > 1000


def test_embedding_moves_texts_once_and_only_those_compared(spark, tmp_path, monkeypatch):
    from tickloom.queries import document_queries as Q
    texts = ["Alpha Beta met quality data. " * 200, "Gamma model. " + " ".join(f"word{i}" for i in range(700))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    compared, written, similarities, write = [], [], D.similarities, D.materialize
    monkeypatch.setattr(D, "similarities", lambda t, *a: compared.append(t) or similarities(t, *a))
    monkeypatch.setattr(D, "materialize", lambda df: written.append(df.columns) or write(df))
    assert Q.searched(spark, str(tmp_path))[2].count() > 0
    assert max(len(r.text) for r in compared[0].collect()) < 1000  # no chunk among them
    texts, idf, _ = Q.embedded(spark, str(tmp_path))
    written.clear()
    assert all(D.tfidf(texts, idf, head).count() > 700 for head in (50_000, 7))
    assert not any("text_key" in c for c in written)


def test_param_similarity_compares_classes(spark, monkeypatch):
    rng = random.Random(5)
    kinds = [(frozenset(rng.sample("abcdefg", rng.randint(2, 6))), rng.choice([1.0, 2.0, 4.0, None])) for _ in range(12)]
    own = {f"p{i:03d}": kinds[i % 12 if i % 3 else 0] for i in range(90)}
    own["p001"] = (own["p001"][0], 9.0)
    genes = spark.createDataFrame([(p, f) for p, (fs, _) in own.items() for f in fs], "policy_id string, feature string")
    rows = [(p, f, k, None if v is None else v * (i + 1)) for p, (fs, v) in own.items() for i, f in enumerate(sorted(fs)) for k in ("w", "x")]
    rows += [r for r in rows if r[0] in ("p000", "p002")]  # repeated rows count as often as they are there
    rows = [r for r in rows if r[0] != "p005"]  # no parameters: no pair
    params = spark.createDataFrame(rows, "policy_id string, feature string, param string, value double")
    want = {(r.p1, r.p2): r.param_similarity for r in SEL.param_similarity(params, SEL.similar_policies(genes, 0.5)).collect()}
    sizes, similar = [], SEL.param_similarity
    monkeypatch.setattr(SEL, "param_similarity", lambda p, pairs: sizes.append(pairs.count()) or similar(p, pairs))
    for block in (1024, 4):
        monkeypatch.setattr(SEL, "BLOCK", block)
        got = SEL.similar_params(genes, params, 0.5).collect()
        assert {(r.p1, r.p2): r.param_similarity for r in got} == pytest.approx(want) and len(got) == len(want)
    assert max(sizes) <= 15 * 16 / 2 < len(want) / 4


def test_selection_score_adds_the_robustness_of_the_windows_to_their_best(spark, tmp_path):
    import duckdb

    from tickloom.queries.base import ORACLE, QUERIES
    from tickloom.queries.result_queries import KEYS, samples, selection_scores
    rng = random.Random(11)
    rows = [(sup, flag, float(rng.randint(1, 50)), (4 + sup % 3 + rng.randint(0, 5 + 3 * w)) / 100, rng.randint(0, 8) / 100) for sup in range(1, 81) for w, flag in enumerate("ANR") for _ in range(rng.randint(20, 150))]
    rows += [(81, flag, 9.0, 0.05, 0.02) for flag in "ANR" for _ in range(90)]  # equal returns: equal windows, no deviation
    spark.createDataFrame(rows, "l_suppkey bigint, l_returnflag string, l_quantity double, l_discount double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    m = samples(spark, str(tmp_path)).drop("sharpe")
    both = m.join(G.reward(m, KEYS).select(*KEYS, "total", "is_rejected"), KEYS).join(G.distances(m).select(*KEYS, "soft_gate_score"), KEYS)
    own = {}
    for r in both.orderBy(*KEYS).collect():
        own.setdefault(r.policy_id, []).append((r.soft_gate_score if r.is_rejected else r.score, r.total, r.soft_gate_score, r.excess_return >= r.alpha_floor, r.is_rejected))
    want = {}
    for p, windows in own.items():
        best = max(windows, key=lambda w: w[0])  # the first of equals
        robust = sum(w[3] for w in windows) / len(windows) - sum(w[4] for w in windows) / len(windows)
        want[p] = (best[1], best[2], robust, best[1] + best[2] + robust)
    got = {r.policy_id: (r.performance, r.progress, r.robustness, r.score) for r in selection_scores(spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and all(got[p] == pytest.approx(want[p]) for p in want)
    assert len({round(w[2], 6) for w in want.values()}) >= 4 and any(max(w[1] for w in own[p]) > want[p][0] for p in want)  # the maxima need not be those of one window
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    df = QUERIES["score.selection"](spark, str(tmp_path))
    sql = con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLE['score.selection']})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(sql)
