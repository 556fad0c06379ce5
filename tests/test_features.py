import numpy as np
import pandas as pd
import pytest
from helpers import frame, make_bars, random_walk
from pyspark.sql import functions as F

import tickloom.operators.indicators  # noqa: F401
import tickloom.operators.machines  # noqa: F401
from tickloom.operators.blocks import Grid, running, with_bar_idx
from tickloom.operators.features import REGISTRY, FeatureDef, compute_genome, resolve
from tickloom.operators.machines import supertrend_machine
from tickloom.operators.quantiles import exact_quantiles
from tickloom.operators.relay import relay

GENOME = {"TREND_EMA_V1": {}, "MOMENTUM_RSI_V1": {}, "TREND_TRIX_V1": {"length": 5}, "MOMENTUM_MACD_V1": {"fast": 3, "slow": 6, "signal": 4}, "VOLATILITY_KALMAN_V1": {}, "VOLATILITY_DONCHIAN_V1": {},
          "VOLUME_OBV_V1": {}, "TREND_ADX_V1": {"length": 5}}


def walk_bars(spark, n=300, symbol="S", seed=7):
    w = random_walk(n, seed)
    return make_bars(spark, w.pop("closes"), symbol, **w)


def test_ema_equals_pandas(spark):
    bars = walk_bars(spark)
    got = frame(compute_genome(bars, {"TREND_EMA_V1": {}}, grid=Grid(16, 64)))
    np.testing.assert_allclose(got["TREND_EMA_V1__ema"], got["close"].ewm(span=20, adjust=False).mean(), rtol=1e-12)


def test_block_size_does_not_matter(spark):
    bars = walk_bars(spark)
    one, many = (frame(compute_genome(bars, GENOME, grid=g)) for g in (Grid(256, 4096), Grid(32, 64)))
    for c in one.columns[7:]:
        np.testing.assert_allclose(one[c].astype(float), many[c].astype(float), rtol=1e-9, atol=1e-9, err_msg=c)


def test_input_order_and_future_bars_change_nothing(spark):
    bars = walk_bars(spark)
    full = frame(compute_genome(bars.orderBy(F.rand(3)), GENOME))
    cut = frame(compute_genome(bars.filter("bar_idx < 200"), GENOME))
    pd.testing.assert_frame_equal(full[full.bar_idx < 200][cut.columns].reset_index(drop=True), cut, rtol=1e-9)


def test_two_symbols_are_independent(spark):
    a, b = walk_bars(spark, 120, "A", 1), walk_bars(spark, 90, "B", 2)
    both = frame(compute_genome(a.unionByName(b), GENOME))
    alone = frame(compute_genome(b, GENOME))
    pd.testing.assert_frame_equal(both[both.symbol == "B"].reset_index(drop=True), alone, rtol=1e-9)


def test_flat_and_single_bars_do_not_fail(spark):
    flat = make_bars(spark, [0.0] * 40, "Z", volume=0.0).unionByName(make_bars(spark, [5.0], "ONE"))
    genome = {f: {} for f, d in REGISTRY.features.items() if d.native is None and not d.context and f != "USER"}
    got = compute_genome(flat, genome).toPandas()
    assert len(got) == 41


def test_warmup_zero(spark):
    got = frame(compute_genome(walk_bars(spark, 30), {"MOMENTUM_RSI_V1": {}}, warmup="zero"))
    assert (got["MOMENTUM_RSI_V1__rsi"][:13] == 0).all() and got["MOMENTUM_RSI_V1__rsi"][20] > 0


def test_supertrend_relay_matches_one_block(spark):
    bars = walk_bars(spark, 400).withColumns({"up": F.col("high") * 1.01, "dn": F.col("low") * 0.99}).select("symbol", "bar_idx", "up", "dn", "close")
    schema = "bar_idx bigint, trend double, upper double, lower double"
    whole, parts = (frame(relay(bars, supertrend_machine, schema, block=b)) for b in (10_000, 37))
    pd.testing.assert_frame_equal(whole, parts)


def test_running_and_bar_idx(spark):
    bars = walk_bars(spark, 200)
    got = frame(running(bars, {"s": ("sum", F.col("volume")), "m": ("max", F.col("close")), "l": ("last", F.when(F.col("bar_idx") % 7 == 0, F.col("close")))}, grid=Grid(8, 16)))
    np.testing.assert_allclose(got["s"], got["volume"].cumsum())
    np.testing.assert_allclose(got["m"], got["close"].cummax())
    np.testing.assert_allclose(got["l"], got["close"].where(got.bar_idx % 7 == 0).ffill())
    again = frame(with_bar_idx(bars.withColumnRenamed("bar_idx", "want").orderBy(F.rand(1))))
    assert (again["bar_idx"] == again["want"]).all()


def test_exact_quantiles(spark):
    rng = np.random.default_rng(3)
    vals = np.concatenate([rng.normal(size=500), [0.5] * 300])
    df = spark.createDataFrame(pd.DataFrame({"k": ["a"] * 800, "v": vals}))
    got = {r.q: r.value for r in exact_quantiles(df, ["k"], [("v", q) for q in (0.0, 0.1, 0.5, 0.77, 1.0)]).collect()}
    for q, v in got.items():
        assert abs(v - np.quantile(vals, q)) < 1e-12


def test_resolver_reasons():
    cols = ["MOMENTUM_RSI_V1__rsi", "X__a", "X__b", "Y__only"]
    assert resolve(cols, "MOMENTUM_RSI_V1") == "MOMENTUM_RSI_V1__rsi"
    for args, reason in (((cols, "NOPE"), "FEATURE_NOT_REGISTERED"), ((cols, "MOMENTUM_RSI_V1", "zzz"), "OUTPUT_KEY_UNDEFINED"), ((cols, "TREND_SMA_V1"), "COLUMN_NOT_FOUND")):
        with pytest.raises(LookupError, match=reason):
            resolve(*args)
    assert resolve(cols, "Y", lenient=True) == "Y__only"
    with pytest.raises(LookupError, match="AMBIGUOUS"):
        resolve(cols, "X", lenient=True)


def test_user_feature_needs_new_id():
    reg = REGISTRY.copy()
    with pytest.raises(ValueError):
        reg.add(FeatureDef("VMA", "X", lambda s: {}))
