"""No cap on rounds, lengths or shapes: chains longer than any former limit, deep scan levels, spoiled records."""

import numpy as np
from helpers import frame, make_bars, random_walk
from pyspark.sql import functions as F

import tickloom.operators.indicators  # noqa: F401
from tickloom.operators import documents as D
from tickloom.operators import ledger as L
from tickloom.operators.blocks import Grid
from tickloom.operators.engines import close_engine
from tickloom.operators.features import compute_genome
from tickloom.operators.gates import top_share
from tickloom.operators.quantiles import exact_quantiles, slot_edges, slot_of
from tickloom.operators.selection import filter_diverse


def test_filter_diverse_settles_a_long_chain(spark):
    n = 24  # neighbours share 9 of 11 features, so each is similar to the one before only; one link settles in a round
    genes = spark.createDataFrame([(f"P{i:03d}", f"F{j}") for i in range(n) for j in range(i, i + 10)], "policy_id string, feature string")
    ordered = spark.createDataFrame([(f"P{i:03d}", i) for i in range(n)], "policy_id string, ord int")
    none = spark.createDataFrame([], "policy_id string, score double")
    kept = sorted(r.policy_id for r in filter_diverse(ordered, genes, none, 0.8).collect())
    assert kept == [f"P{i:03d}" for i in range(0, n, 2)]


def test_activation_reaches_its_fixpoint(spark):
    n = 9
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}", "t") for i in range(n)] + [("n0", "x", "far")], "src string, dst string, text string")
    sims = spark.createDataFrame([("t", 0.7), ("far", 0.1)], "text string, cos double").select(F.xxhash64("text").alias("text_key"), "cos")
    sub = spark.createDataFrame([(f"n{i}", 0) for i in range(n + 1)] + [("x", 1)], "id string, hop int")
    got = {r.id: r.a for r in D.activate(sub, sub.filter("id = 'n0'"), edges, sims).collect()}
    assert got == {**{f"n{i}": 1.0 for i in range(n + 1)}, "x": 0.0}


def test_scans_over_many_levels_equal_pandas(spark):
    w = random_walk(1500, 3)
    bars = make_bars(spark, w.pop("closes"), **w)
    got = frame(compute_genome(bars, {"TREND_EMA_V1": {}, "MOMENTUM_MACD_V1": {"fast": 2, "slow": 3, "signal": 2}}, grid=Grid(4, 8, 4)))
    close = got["close"]
    np.testing.assert_allclose(got["TREND_EMA_V1__ema"], close.ewm(span=20, adjust=False).mean(), rtol=1e-9)
    assert np.isfinite(got.filter(like="MOMENTUM_MACD").iloc[-1].astype(float)).all()


def test_a_position_may_stay_open_over_many_blocks(spark):
    n = 400
    sig = make_bars(spark, [100.0] * n, entry=[i == 3 for i in range(n)], exit=[i == n - 5 for i in range(n)]).withColumn("policy_id", F.lit("p"))
    hold = spark.range(1).select(F.lit("base").alias("sample_id"), F.lit(0.5).alias("tp_pct"), F.lit(0.5).alias("sl_pct"), F.lit(100_000).alias("max_hold"), F.lit(0.0).alias("cost_bps"))
    t = frame(close_engine(sig, hold, block=40), "entry_idx")
    assert list(zip(t.entry_idx, t.exit_idx)) == [(3, n - 5)]


def test_one_field_of_another_type_spoils_a_record(spark, tmp_path):
    lines = ['{"exp_id":"A","stage":1}', '{"exp_id":"B","stage":"oops"}', '{"exp_id": broken', "", '{"exp_id":null,"stage":2}']
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    assert [r.exp_id for r in L.parse_ledger(df).select("exp_id").collect()] == ["A"]
    df.write.text(f"{tmp_path}/lines")
    assert [r.exp_id for r in L.read_ledger(spark, f"{tmp_path}/lines").select("exp_id").collect()] == ["A"]


def test_one_outlier_leaves_the_slots_even(spark):
    values = [float(i) for i in range(20_000)] + [1e9]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    slots = df.join(df.agg(slot_edges(F.col("v")).alias("e"))).groupBy(slot_of(F.col("v"), F.col("e")).alias("s")).count().agg(F.max("count")).first()[0]
    assert slots < 20_000 / 50
    got = {r.q: r.value for r in exact_quantiles(df.withColumn("k", F.lit(1)), ["k"], [("v", q) for q in (0.0, 0.25, 0.5, 0.99, 1.0)]).collect()}
    assert got == {q: float(np.quantile(values, q)) for q in got}
    same = spark.createDataFrame([(f"P{i:03d}", -100.0 + (i % 3)) for i in range(60)], "policy_id string, score double")
    assert [(r["rank"], r.policy_id) for r in top_share(same, 0.05).orderBy("rank").collect()] == [(1, "P002"), (2, "P005"), (3, "P008")]


def test_quantiles_hold_when_a_sketch_cuts_elsewhere_the_second_time(spark, monkeypatch):
    from tickloom.operators import quantiles

    def shaky(value):  # parts of a sketch arrive in any order, so each evaluation may give other edges
        cut = F.udf(lambda e: sorted(np.random.default_rng().choice(e, len(e) // 2, replace=False).tolist()), "array<double>").asNondeterministic()
        return cut(slot_edges(value))

    monkeypatch.setattr(quantiles, "slot_edges", shaky)
    values = [float((i * 7919) % 20_011) for i in range(20_000)]
    df = spark.createDataFrame([(v, 1) for v in values], "v double, k int")
    got = {r.q: r.value for r in exact_quantiles(df, ["k"], [("v", q) for q in (0.1, 0.5, 0.9)]).collect()}
    assert got == {q: float(np.quantile(values, q)) for q in (0.1, 0.5, 0.9)}
    scored = df.select(F.col("v").cast("string").alias("policy_id"), F.col("v").alias("score"))
    assert [r.score for r in top_share(scored, 0.01).orderBy("rank").collect()] == sorted(values, reverse=True)[:200]
