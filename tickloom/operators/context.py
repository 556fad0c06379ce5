"""Market context features, regimes and the state vector."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.num import clip, div, sign
from tickloom.operators.blocks import GRID, Grid
from tickloom.operators.features import Scope, apply_layers
from tickloom.operators.indicators import adx_of
from tickloom.operators.quantiles import exact_quantiles
from tickloom.session import materialize
from tickloom.sources.bars import forward_fill, last_bars

EPS8, EPS9 = 1e-8, 1e-9


def with_columns_on(bars: DataFrame, build, grid: Grid = GRID, name: str = "ctx", keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Bars plus the columns a builder declares on a scope."""
    scope = Scope(name, keys)
    cols = build(scope)
    done = {n: scope.let("out_" + n, e) for n, e in cols.items()}
    df = apply_layers(bars, [scope], grid)
    return df.select(*bars.columns, *[e.alias(n) for n, e in done.items()])


def with_length(bars: DataFrame) -> DataFrame:
    """Number of bars of the symbol as ``n_bars``."""
    return bars.join(bars.groupBy("symbol").agg((F.max("bar_idx") + 1).alias("n_bars")), "symbol")


def simple_rsi(s: Scope, n: int = 14) -> Column:
    d = s.let("rd", s.diff("close"))
    gain = s.avg(F.when(d > 0, d).otherwise(0.0), n)
    loss = s.avg(F.when(d < 0, -d).otherwise(0.0), n)
    return s.let("srsi", 100 - 100 / (1 + gain / (loss + EPS8)))


CTX = ["CTX_VIX", "CTX_VIX_CHANGE", "CTX_TREND", "CTX_TREND_DIR", "CTX_MOMENTUM", "CTX_RSI_LEVEL", "CTX_REGIME",
       "CTX_REGIME_CAT", "CTX_VOL_REGIME", "CTX_VOLUME"]


def context_features(bars: DataFrame, grid: Grid = GRID) -> DataFrame:
    """The ten CTX_ columns, forward filled then zero filled."""
    has_vix = "vix_close" in bars.columns
    df = with_length(bars)

    def build(s: Scope):
        ret = s.let("ret", s.pct("close"))
        vol = F.col("vix_close") if has_vix else s.let("rv", s.std(ret, 20) * math.sqrt(252))
        ma20, ma50 = s.let("ma20", s.avg("close", 20)), s.let("ma50", s.avg("close", 50))
        ma200 = s.let("ma200", s.avg("close", 200))
        base = F.when(F.col("n_bars") > 200, ma200).otherwise(ma50)
        gap = lambda a, b: clip((a - b) / (b + EPS8), -0.5, 0.5) * 2
        vix = s.let("vix", clip((vol - 10) / 70, 0, 1) if has_vix else clip((vol - 0.1) / 0.4, 0, 1))
        trend = s.let("trend", clip((gap(F.col("close"), ma20) + gap(ma20, ma50) + gap(F.col("close"), base)) / 3, -1, 1))
        mom = s.let("mom", clip((s.pct("close", 5) * 0.6 + s.pct("close", 20) * 0.4) / 0.2, -1, 1))
        regime = s.let("reg", clip((1 - vix) * 0.3 + trend * 0.4 + mom * 0.3, -1, 1))
        ratio = clip(s.std(ret, 10) / (s.std(ret, 50) + EPS8), 0.5, 2.0)
        return {
            "CTX_VIX": vix, "CTX_VIX_CHANGE": clip(s.pct(vol, 5), -0.5, 0.5), "CTX_TREND": trend,
            "CTX_TREND_DIR": F.coalesce(sign(trend), F.lit(0.0)), "CTX_MOMENTUM": mom,
            "CTX_RSI_LEVEL": clip(simple_rsi(s) / 100, 0, 1), "CTX_REGIME": regime,
            "CTX_REGIME_CAT": F.when(regime < -0.3, -1.0).when(regime > 0.3, 1.0).otherwise(0.0),
            "CTX_VOL_REGIME": clip((ratio - 1) / 0.5, -1, 1),
            "CTX_VOLUME": clip(F.col("volume") / (s.avg("volume", 20) + EPS8) / 3, 0, 1),
        }

    return forward_fill(materialize(with_columns_on(df, build, grid).drop("n_bars")), CTX, grid=grid)


INJECTED = ["_CTX_TrendScore", "_CTX_VolRatio", "_CTX_PVCorr", "_CTX_ShockFlag"]


def trend_direction(s: Scope) -> Column:
    """+-0.5 for close against SMA50, +-0.5 for SMA50 against SMA200; undefined comparisons add nothing."""
    m50, m200 = s.let("m50", s.avg("close", 50)), s.let("m200", s.avg("close", 200))
    half = lambda a, b: F.when(a > b, 0.5).when(a < b, -0.5).otherwise(0.0)
    return s.let("dir", half(F.col("close"), m50) + half(m50, m200))


def injected_context(bars: DataFrame, grid: Grid = GRID) -> DataFrame:
    df = with_length(bars)

    def build(s: Scope):
        lr = s.let("lr", F.when((F.col("close") > 0) & (s.lag("close") > 0), F.ln(F.col("close") / s.lag("close"))))
        ratio = clip(s.std(lr, 20) / (s.std(lr, 100) + EPS9), 0, 5)
        band = s.avg("close", 20) - 2.5 * s.std("close", 20)
        return {
            "_CTX_TrendScore": F.when(F.col("n_bars") > 200, trend_direction(s)),
            "_CTX_VolRatio": F.coalesce(ratio, F.lit(1.0)),
            "_CTX_PVCorr": F.coalesce(s.corr("close", "volume", 20), F.lit(0.0)),
            "_CTX_ShockFlag": F.coalesce((F.col("close") < band).cast("double"), F.lit(0.0)),
        }

    return with_columns_on(df, build, grid).drop("n_bars")


def session_of(hour: Column) -> Column:
    """0 Asia, 1 London, 2 New York, 3 wrap."""
    return F.when(hour < 8, 0).when(hour < 14, 1).when(hour < 22, 2).otherwise(3)


def session(bars: DataFrame) -> DataFrame:
    return bars.withColumn("hour", F.hour("ts")).withColumn("session_id", session_of(F.hour("ts")))


def _regime_columns(bars: DataFrame, grid: Grid, current: bool) -> DataFrame:
    df = with_length(bars)
    have = set(bars.columns)

    def build(s: Scope):
        adx = F.coalesce(adx_of(s, 14)[0], F.lit(0.0))
        score = trend_direction(s) * (clip(adx / 50.0, None, 1) if current else clip(adx / 50.0, 0, 1))
        ret = s.let("ret", s.pct("close"))
        vol = s.let("vol", F.coalesce(div(s.std(ret, 20), s.std(ret, 100)), F.lit(1.0)))
        shock = F.coalesce(F.col("close") < s.avg("close", 20) - 2.5 * s.pstd("close", 20), F.lit(False))
        vix = F.col("vix_close") if "vix_close" in have else F.lit(20.0)
        if current:
            vix = F.when(vix == 0, 20.0).otherwise(vix)
        bond = F.col("us10y_close") if "us10y_close" in have else F.lit(4.0)
        hyg = F.lit(0.0)
        if "hyg_close" in have:
            m = s.let("hm", s.avg("hyg_close", 50))
            hyg = F.coalesce(div(F.col("hyg_close") - m, m), F.lit(0.0))
        out = {"trend_score": score, "vol_level": vol, "shock_flag": shock, "vix": vix, "bond": bond, "hyg": hyg}
        if current:
            out["corr_score"] = F.coalesce(s.corr("close", "volume", 20), F.lit(0.0))
            out["rotation"] = F.lit(0.0)
            if {"xlk_close", "xle_close"} <= have:
                ratio = s.let("ratio", F.col("xlk_close") / (F.col("xle_close") + EPS9))
                rm = s.let("rm", s.avg(ratio, 50))
                out["rotation"] = F.coalesce(div(ratio - rm, rm), F.lit(0.0))
        return out

    out = with_columns_on(df, build, grid)
    t, rot = F.col("trend_score"), F.col("rotation") if current else F.lit(0.0)
    panic = (F.col("vix") > 30) | F.col("shock_flag") | (t < -0.7) | (F.col("hyg") < -0.05)
    stag = (t < -0.1) & ((F.col("bond") > 4.2) | (rot < -0.05))
    label = (
        F.when(F.col("n_bars") < 50, "SIDEWAYS").when(panic, "PANIC").when(stag, "STAGFLATION")
        .when((t > 0.4) & (F.col("vix") < 25), "BULL_RUN").when((t > 0) & (F.col("vix") < 20) & (F.col("bond") < 4.0), "GOLDILOCKS")
        .when(F.col("vol_level") > 1.5, "HIGH_VOL").when(t < -0.2, "BEAR_TREND").otherwise("SIDEWAYS"))
    return out.withColumn("regime_label", label)


def regime_series(bars: DataFrame, grid: Grid = GRID) -> DataFrame:
    """Bars plus ``regime_label``; a symbol with fewer than 50 bars is SIDEWAYS throughout."""
    return _regime_columns(bars, grid, False).select(*bars.columns, "regime_label")


def regime_current(bars: DataFrame, grid: Grid = GRID) -> DataFrame:
    """State of the latest bar of each symbol."""
    df = _regime_columns(bars, grid, True).filter(F.col("bar_idx") == F.col("n_bars") - 1)
    short = F.col("n_bars") < 50
    pick = lambda c, dflt: F.when(short, F.lit(dflt)).otherwise(F.col(c)).alias(c)
    return df.select(
        "symbol", pick("trend_score", 0.0), pick("vol_level", 1.0), pick("corr_score", 0.0), pick("shock_flag", False),
        F.col("regime_label").alias("label"), F.hour("ts").alias("hour"), session_of(F.hour("ts")).alias("session_id"))


STATE = ["vix_norm", "vix_change", "trend_score", "momentum_rsi", "return_5d", "return_20d", "realized_vol", "bb_position",
         "volume_ratio", "yield_spread", "market_corr", "regime_score"]


def state_features(bars: DataFrame, grid: Grid = GRID) -> DataFrame:
    """Twelve raw state features, forward filled then zero filled."""
    have = set(bars.columns)

    def build(s: Scope):
        ret = s.let("ret", s.pct("close"))
        rv = s.let("rv", s.std(ret, 20) * math.sqrt(252))
        vix = F.col("vix_close") if "vix_close" in have else rv * 100
        ma, sd = s.let("ma", s.avg("close", 20)), s.let("sd", s.std("close", 20))
        trend = s.let("trend", (F.col("close") - ma) / (ma + EPS8))
        corr = s.let("corr", s.corr(s.let("mret", s.pct("spy_close")), ret, 20)) if "spy_close" in have else F.lit(0.8)
        return {
            "vix_norm": vix, "vix_change": s.pct(s.let("vx", vix), 5), "trend_score": trend, "momentum_rsi": simple_rsi(s),
            "return_5d": s.pct("close", 5), "return_20d": s.pct("close", 20), "realized_vol": rv,
            "bb_position": (F.col("close") - ma) / (2 * sd + EPS8),
            "volume_ratio": F.col("volume") / (s.avg("volume", 20) + EPS8),
            "yield_spread": F.col("t10y2y") if "t10y2y" in have else F.lit(0.0), "market_corr": corr,
            "regime_score": (1 - clip(vix / 50, 0, 1)) * 0.4 + clip(trend, -1, 1) * 0.4 + F.coalesce(corr, F.lit(0.0)) * 0.2,
        }

    return forward_fill(materialize(with_columns_on(bars, build, grid)), STATE, grid=grid)


def state_scaler(features: DataFrame) -> DataFrame:
    """Per symbol and feature: 1 % and 99 % quantile, mean, sample standard deviation."""
    features = materialize(features.select("symbol", *STATE))
    q = exact_quantiles(features, ["symbol"], [(n, x) for n in STATE for x in (0.01, 0.99)])
    bounds = q.groupBy("symbol", "col").agg(F.max(F.when(F.col("q") < 0.5, F.col("value"))).alias("min"),
                                            F.max(F.when(F.col("q") > 0.5, F.col("value"))).alias("max"))
    moments = features.groupBy("symbol").agg(*[F.avg(n).alias(f"m_{n}") for n in STATE], *[F.stddev_samp(n).alias(f"s_{n}") for n in STATE])
    long = moments.select("symbol", F.explode(F.array(*[
        F.struct(F.lit(n).alias("col"), F.col(f"m_{n}").alias("mean"), F.col(f"s_{n}").alias("std")) for n in STATE])).alias("e"))
    return bounds.join(long.select("symbol", "e.*"), ["symbol", "col"]).withColumnRenamed("col", "feature")


def state_encode(features: DataFrame, scaler: DataFrame, rows: int = 20, min_rows: int = 40) -> DataFrame:
    """Latest ``rows`` bars x 12 features scaled to [-1, 1], flattened row by row; zeros for short symbols."""
    size = features.groupBy("symbol").agg((F.max("bar_idx") + 1).alias("n"))
    recent = last_bars(features, rows).select("symbol", "bar_idx", F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(n).alias("feature"), F.col(n).alias("v")) for i, n in enumerate(STATE)])).alias("e"))
    scaled = recent.select("symbol", "bar_idx", "e.*").join(scaler.select("symbol", "feature", "min", "max"), ["symbol", "feature"])
    x = clip(2 * (F.col("v") - F.col("min")) / (F.col("max") - F.col("min") + EPS8) - 1, -1, 1)
    vec = scaled.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("bar_idx", "i", x.alias("x")))).alias("a"))
    flat = F.transform("a", lambda e: e["x"])
    empty = F.array_repeat(F.lit(0.0), rows * len(STATE))
    return size.join(vec, "symbol", "left").select("symbol", F.when(F.col("n") < min_rows, empty).otherwise(flat).alias("vector"))


def position_bucket(df: DataFrame, pnl: str = "pnl_pct", duration: str = "duration", confidence: str = "confidence") -> DataFrame:
    """State key from discretised profit, holding time and confidence."""
    p, d, q = F.col(pnl), F.col(duration), F.col(confidence)
    profit = (F.when(p < -0.02, "LOSS_BIG").when(p < 0, "LOSS_SMALL").when(p < 0.02, "PROFIT_SMALL")
              .when(p < 0.05, "PROFIT_MED").otherwise("PROFIT_BIG"))
    held = F.when(d < 5, "SHORT").when(d < 20, "MED").otherwise("LONG")
    sure = F.when(q >= 0.6, "HIGH").otherwise("LOW")
    return df.withColumn("state_key", F.concat_ws("_", profit, held, sure))
