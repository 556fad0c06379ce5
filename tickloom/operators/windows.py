"""Evaluation windows and risk samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import settings as S
from tickloom.functions.num import uniform
from tickloom.operators.context import with_columns_on

PLAN = ("symbol", "window_id", "w_start", "w_end")


def lengths(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg((F.max("bar_idx") + 1).alias("n"))


def contiguous(n: DataFrame, count: int, prefix: str, offset: Column | None = None, min_bars: int = S.MIN_WINDOW_BARS) -> DataFrame:
    """``count`` back-to-back windows of at least ``min_bars`` bars; the last takes the remainder."""
    off = F.lit(0) if offset is None else offset
    size = F.greatest(F.lit(min_bars), F.expr(f"n div {max(1, count)}"))
    w = n.select("symbol", "n", off.alias("off"), size.alias("size"), F.explode(F.sequence(F.lit(0), F.lit(max(1, count) - 1))).alias("i"))
    start = F.col("i") * F.col("size")
    end = F.when(F.col("i") == max(1, count) - 1, F.col("n")).otherwise(F.least(F.col("n"), start + F.col("size")))
    return (w.select("symbol", F.concat_ws("_", F.lit(prefix), F.col("i")).alias("window_id"), (F.col("off") + start).cast("bigint").alias("w_start"),
                     (F.col("off") + end).cast("bigint").alias("w_end")).filter(F.col("w_end") - F.col("w_start") >= min_bars))


def split_time(n: DataFrame, count: int, min_window: int) -> DataFrame:
    """Equal windows, fewer when bars are short: at most n div min_window, at least one."""
    usable = F.greatest(F.lit(1), F.least(F.lit(count), F.expr(f"n div {max(1, min_window)}")))
    k = F.when((F.lit(count) <= 1) | (F.col("n") <= min_window), 1).otherwise(usable)
    w = n.select("symbol", "n", k.alias("k"), F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("i")).filter(F.col("i") < F.col("k"))
    size = F.expr("n div k")
    end = F.when(F.col("i") == F.col("k") - 1, F.col("n")).otherwise((F.col("i") + 1) * size)
    return w.select("symbol", F.concat_ws("_", F.lit("W"), F.col("i")).alias("window_id"), (F.col("i") * size).cast("bigint").alias("w_start"), end.cast("bigint").alias("w_end"))


def reduced(n: DataFrame, slices: int = 3, slice_bars: int = 500, min_bars: int = S.MIN_WINDOW_BARS) -> DataFrame:
    """Evenly spaced, possibly overlapping slices."""
    length = F.least(F.lit(slice_bars), F.col("n"))
    top = F.greatest(F.lit(0), F.col("n") - length)
    step = F.greatest(F.lit(1), F.floor(top / max(1, slices - 1)))
    w = n.filter(length >= min_bars).select("symbol", length.alias("len"), top.alias("top"), step.alias("step"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("i"))
    start = F.least(F.col("top"), F.col("i") * F.col("step"))
    return w.select("symbol", F.concat_ws("_", F.lit("REDUCED"), F.col("i")).alias("window_id"), start.cast("bigint").alias("w_start"), (start + F.col("len")).cast("bigint").alias("w_end"))


def build(bars: DataFrame, mode: str = "full", stage_id: int = 1, lookback: int = 600) -> DataFrame:
    """Window plan of the fast, reduced or full evaluation of a stage."""
    n, (max_windows, _, max_splits) = lengths(bars), S.EVAL_CAPS[stage_id]
    if mode == "fast":
        short = n.select("symbol", F.greatest(F.lit(0), F.col("n") - lookback).alias("off"), F.least(F.lit(lookback), F.col("n")).alias("n"))
        return contiguous(short, min(2, max_windows), "FAST", F.col("off"))
    if mode == "reduced":
        return reduced(n, min(3, max_windows))
    return contiguous(n, min(S.stage(stage_id)["wf_splits"], max_splits, max_windows), "FULL")


def assign(bars: DataFrame, plan: DataFrame) -> DataFrame:
    """Bars of every window; a bar may belong to several."""
    per_symbol = plan.groupBy("symbol").agg(F.collect_list(F.struct("window_id", "w_start", "w_end")).alias("_w"))
    inside = F.filter("_w", lambda w: (F.col("bar_idx") >= w["w_start"]) & (F.col("bar_idx") < w["w_end"]))
    return bars.join(per_symbol, "symbol").withColumn("_x", F.explode(inside)).select(*bars.columns, "_x.window_id", "_x.w_start", "_x.w_end")


def scenarios(bars: DataFrame, size: int = 400) -> DataFrame:
    """Window ends with the largest absolute return (trend), the smallest return plus volatility (range) and the largest volatility."""
    def build_cols(s):
        ret = s.let("ret", F.coalesce(s.pct("close"), F.lit(0.0)))
        return {"abs_return": F.abs(s.pct("close", size)), "vol": s.std(ret, size)}

    m = with_columns_on(bars, build_cols).filter(F.col("abs_return").isNotNull() & F.col("vol").isNotNull())
    first = lambda score: F.max_by(F.struct("bar_idx", "abs_return"), F.struct(score, -F.col("bar_idx")))
    best = m.groupBy("symbol").agg(first(F.col("abs_return")).alias("trend"), first(-(F.col("abs_return") + F.col("vol"))).alias("range"), first(F.col("vol")).alias("volatile"))
    long = best.select("symbol", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.col(k).alias("b")) for k in ("trend", "range", "volatile")])).alias("e"))
    end = F.col("e.b.bar_idx")
    return long.select("symbol", F.col("e.name").alias("scenario"), F.greatest(F.lit(0), end - size + 1).cast("bigint").alias("start_idx"), end.alias("end_idx"), F.col("e.b.abs_return").alias("score"))


def risk_distributions(df: DataFrame, regime: Column) -> DataFrame:
    """Uniform ranges of target, stop and horizon from base values (NULL = configured range), adjusted by regime."""
    (ku0, ku1), (kd0, kd1), (h0, h1) = S.K_UP, S.K_DOWN, S.HORIZON_RANGE
    v = S.DAILY_VOL
    tp_lo, tp_hi = F.coalesce(F.col("base_tp") * 0.5, F.lit(ku0 * v)), F.coalesce(F.col("base_tp") * 1.5, F.lit(ku1 * v))
    sl_lo, sl_hi = F.coalesce(F.col("base_sl") * 0.5, F.lit(kd0 * v)), F.coalesce(F.col("base_sl") * 1.5, F.lit(kd1 * v))
    hl = F.greatest(F.lit(h0), F.coalesce((F.col("base_h") * 0.5).cast("int"), F.lit(h0)))
    hh = F.least(F.lit(h1), F.coalesce((F.col("base_h") * 1.5).cast("int"), F.lit(h1)))
    r = F.lower(regime)
    panic, bull = r.contains("panic"), r.contains("bull")
    return df.withColumns({
        "tp_low": tp_lo, "tp_high": F.when(~panic & bull, tp_hi * 1.2).otherwise(tp_hi), "sl_low": sl_lo, "sl_high": F.when(panic, sl_hi * 0.7).otherwise(sl_hi),
        "h_low": hl.cast("double"), "h_high": F.when(panic, F.least(hh, F.lit(10))).otherwise(hh).cast("double")})


def risk_samples(dist: DataFrame, key: list[str], n: int) -> DataFrame:
    """``n`` uniform draws per row; the draws are hashes of the key, so they are reproducible everywhere."""
    out = dist.withColumn("sample_no", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    u = lambda what: uniform(*[F.col(k).cast("string") for k in key], F.col("sample_no").cast("string"), F.lit(what))
    draw = lambda lo, hi, what: F.col(lo) + u(what) * (F.col(hi) - F.col(lo))
    return out.withColumns({
        "sample_id": F.concat(F.lit("s"), F.col("sample_no").cast("string")), "tp_pct": draw("tp_low", "tp_high", "tp"), "sl_pct": draw("sl_low", "sl_high", "sl"),
        "max_hold": draw("h_low", "h_high", "h").cast("int")})


def budget_jitter(base: DataFrame, key: list[str], n: int, jitter: float = 0.05) -> DataFrame:
    """The base budget and n - 1 jittered copies with derived stop loss, leverage and ratio."""
    (ku0, ku1), (kd0, kd1), (h0, h1) = S.K_UP, S.K_DOWN, S.HORIZON_RANGE
    d = base.withColumns({"_ku": F.coalesce("k_up", F.lit((ku0 + ku1) / 2)), "_kd": F.coalesce("k_down", F.lit((kd0 + kd1) / 2)),
                          "_h": F.coalesce(F.col("horizon").cast("int"), F.lit((h0 + h1) // 2))})
    d = d.withColumn("copy_no", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    u = lambda what: uniform(*[F.col(k).cast("string") for k in key], F.col("copy_no").cast("string"), F.lit(what))
    first = F.col("copy_no") == 0
    cl = lambda x, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), x))
    ku = F.when(first, F.col("_ku")).otherwise(cl(F.col("_ku") * (1 + jitter * (2 * u("up") - 1)), ku0, ku1))
    kd = F.when(first, F.col("_kd")).otherwise(cl(F.col("_kd") * (1 + jitter * (2 * u("dn") - 1)), kd0, kd1))
    lo = F.greatest(F.lit(h0), (F.col("_h") * (1 - jitter)).cast("int"))
    hi = F.greatest(lo + 1, F.least(F.lit(h1), (F.col("_h") * (1 + jitter)).cast("int")) + 1)
    h = F.when(first, F.col("_h")).otherwise(lo + F.floor(u("h") * (hi - lo)).cast("int"))
    d = d.withColumns({"r_k_up": ku, "r_k_down": kd, "r_horizon": h})
    return d.withColumns({
        "r_stop_loss": cl(F.col("r_k_down") * S.DAILY_VOL, 0.005, 0.05), "r_leverage": cl(0.5 + 1.0 / (F.col("r_k_down") + 0.5), 0.5, 1.5),
        "r_ratio": F.when(F.col("r_k_down") > 0, F.col("r_k_up") / F.col("r_k_down")).otherwise(1.0)}).drop("_ku", "_kd", "_h")


# Share of the configured range each profile covers (k_up, k_down, horizon).
PROFILES = [("SHORT_TERM", (0.0, 0.35), (0.0, 0.35), (0.0, 0.3)), ("BALANCED", (0.25, 0.7), (0.25, 0.7), (0.2, 0.6)), ("LONG_TERM", (0.6, 1.0), (0.6, 1.0), (0.5, 1.0))]


def with_profiles(df: DataFrame) -> DataFrame:
    """Every row with each risk profile and the sub-ranges it allows."""
    cut = lambda rng, f: (rng[0] + (rng[1] - rng[0]) * f[0], rng[0] + (rng[1] - rng[0]) * f[1])
    rows = []
    for name, u, d, h in PROFILES:
        (a, b), (c, e), (g, i) = cut(S.K_UP, u), cut(S.K_DOWN, d), cut(S.HORIZON_RANGE, h)
        rows.append(F.struct(F.lit(name).alias("profile_id"), F.lit(a).alias("k_up_min"), F.lit(b).alias("k_up_max"), F.lit(c).alias("k_down_min"),
                             F.lit(e).alias("k_down_max"), F.lit(round(g)).cast("bigint").alias("h_min"), F.lit(round(i)).cast("bigint").alias("h_max")))
    return df.withColumn("_p", F.explode(F.array(*rows))).select(*df.columns, "_p.*")


def profile_budgets(df: DataFrame, key: list[str]) -> DataFrame:
    """with_profiles() and, for every row and profile, a budget drawn inside the profile's ranges; key identifies a row."""
    u = lambda what: uniform(*[F.col(k).cast("string") for k in key], F.col("profile_id"), F.lit(what))
    draw = lambda c: F.col(f"{c}_min") + u(c) * (F.col(f"{c}_max") - F.col(f"{c}_min"))
    horizon = F.col("h_min") + F.floor(u("h") * (F.col("h_max") - F.col("h_min") + 1))
    return with_profiles(df).withColumns({"k_up": draw("k_up"), "k_down": draw("k_down"), "horizon": horizon.cast("bigint")})
