"""Trade, equity and window metrics as aggregations over result tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import settings as S
from tickloom.functions.num import clip, div
from tickloom.operators.blocks import GRID, GROUP_KEY, Grid, running
from tickloom.session import materialize



def zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def years(bars: Column) -> Column:
    return F.when(bars > 0, bars / S.BARS_PER_YEAR).otherwise(1.0)


def top_shares(trades: DataFrame, keys: list[str], ret: str, order: str = "entry_idx", block: int = 4096) -> DataFrame:
    """Sum of wins and share of the best one and best three; each block keeps its three best before they meet."""
    wins = trades.filter(F.col(ret) > 0)
    part = wins.groupBy(*keys, F.expr(f"{order} div {block}").alias("_b")).agg(
        F.sum(ret).alias("w"), F.slice(F.sort_array(F.collect_list(ret), asc=False), 1, 3).alias("best"))
    best = part.groupBy(*keys).agg(F.sum("w").alias("w"), F.slice(F.sort_array(F.flatten(F.collect_list("best")), asc=False), 1, 3).alias("best"))
    top3 = F.aggregate("best", F.lit(0.0), lambda a, v: a + v)
    ok = F.col("w") > 1e-9
    return best.select(*keys, F.when(ok, div(F.col("best")[0], "w")).otherwise(0.0).alias("top1_share"), F.when(ok, div(top3, "w")).otherwise(0.0).alias("top3_share"))


def trade_stats(trades: DataFrame, bars_total: DataFrame, keys: list[str], ret: str = "ret", order: str = "entry_idx") -> DataFrame:
    """Statistics of trade returns (a loss is < 0) for every key of ``bars_total(keys, bars_total)``."""
    r = F.col(ret)
    win, loss = F.when(r > 0, r), F.when(r < 0, r)
    agg = trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg((r > 0).cast("double")).alias("win_rate"), zero(F.avg(win)).alias("avg_win"), zero(F.avg(loss)).alias("avg_loss"),
        zero(F.sum(win)).alias("gp"), F.abs(zero(F.sum(loss))).alias("gl"), zero(div(F.median(win), F.abs(F.median(loss)))).alias("reward_risk"))
    out = bars_total.join(agg, keys, "left").join(top_shares(trades, keys, ret, order), keys, "left")
    n, wr = F.coalesce(F.col("n"), F.lit(0)), zero(F.col("win_rate"))
    return out.select(
        *keys, "bars_total", n.alias("trade_count"), wr.alias("win_rate"), zero(F.col("avg_win")).alias("avg_win"), zero(F.col("avg_loss")).alias("avg_loss"),
        F.when(F.col("gl") > 1e-9, div("gp", "gl")).when(F.col("gp") > 0, 100.0).otherwise(1.0).alias("profit_factor"),
        (wr * zero(F.col("avg_win")) - F.when(n > 0, (1 - wr) * F.abs(zero(F.col("avg_loss")))).otherwise(0.0)).alias("expectancy"),
        zero(F.col("reward_risk")).alias("reward_risk"), zero(F.col("top1_share")).alias("top1_share"), zero(F.col("top3_share")).alias("top3_share"),
        div(n, years(F.col("bars_total"))).alias("trades_per_year"), (n / F.greatest(F.col("bars_total"), F.lit(1))).alias("act_rate"))


def equity_stats(returns: DataFrame, keys: list[str], ret: str = "r", held: str | None = None, bench: Column | None = None, grid: Grid = GRID,
                 bars_per_year: float = S.BARS_PER_YEAR) -> DataFrame:
    """Compounded return, CAGR, drawdown and its longest run, volatility and CAGR / volatility of a return series.

    ``returns``: keys, bar_idx, ret and optionally a 0/1 ``held`` column.
    """
    grow = F.lit(1.0) + F.col(ret)
    df = running(materialize(returns), {"_log": ("sum", F.when(grow > 0, F.ln(grow)).otherwise(0.0)), "_dead": ("max", F.when(grow <= 0, 1.0).otherwise(0.0))}, tuple(keys), grid=grid)
    df = df.withColumn("_eq", F.when(F.col("_dead") > 0, 0.0).otherwise(F.exp("_log")))
    df = running(df, {"_peak": ("max", F.col("_eq"))}, tuple(keys), grid=grid)
    # a new peak can differ from the curve by rounding of exp(sum(ln)); such gaps are not drawdowns
    df = df.withColumn("_dd", F.when(F.col("_eq") >= F.col("_peak") * (1 - 1e-13), 0.0).otherwise(div("_eq", "_peak") - 1))
    df = running(materialize(df), {"_flat": ("max", F.when(F.col("_dd") >= 0, F.col("bar_idx"))), "_first": ("min", F.col("bar_idx"))}, tuple(keys), grid=grid)
    run = F.when(F.col("_dd") < 0, F.col("bar_idx") - F.coalesce(F.col("_flat"), F.col("_first") - 1)).otherwise(0)
    agg = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.max_by("_eq", "bar_idx").alias("_end"), F.abs(F.min("_dd")).alias("_mdd"), F.max(run).alias("mdd_duration"),
        F.stddev_pop(ret).alias("_sd"), (F.avg(F.col(held).cast("double")) if held else F.lit(0.0)).alias("exposure_ratio"))
    y = F.col("n") / bars_per_year
    cagr = F.when(F.col("_end") > 0, (F.pow("_end", 1.0 / y) - 1) * 100).otherwise(-100.0)
    vol = F.col("_sd") * math.sqrt(bars_per_year) * 100
    total = (F.col("_end") - 1) * 100
    return agg.select(
        *keys, total.alias("total_return_pct"), cagr.alias("cagr"), vol.alias("vol_pct"), F.when(vol > 1e-9, div(cagr, vol)).otherwise(0.0).alias("sharpe"),
        (F.col("_mdd") * 100).alias("max_drawdown_pct"), F.col("mdd_duration").cast("bigint").alias("mdd_duration"), "exposure_ratio",
        (total - (bench if bench is not None else F.lit(0.0))).alias("excess_return"))


def exit_reason(reason: Column) -> Column:
    """Canonical exit reason."""
    r = F.lower(F.trim(reason))
    return (F.when(r.isin("sl", "stop", "stop_loss"), "SL").when(r.isin("tp", "target", "take_profit"), "TP")
            .when(r.isin("horizon", "time", "eod", "expiry"), "HORIZON").when(r.isin("signal", "agentexit", "agent_exit", "agent exit", "rule"), "AGENT_EXIT")
            .otherwise("Other"))


REASONS = ("SL", "TP", "HORIZON", "AGENT_EXIT", "Other")


def next_entry(trades: DataFrame, keys: list[str], grid: Grid = GRID) -> DataFrame:
    """Trades plus ``next_entry``: within a block of bars the following trade, else the first trade of the next block."""
    blk = F.expr(f"entry_idx div {grid.group}")
    own = trades.withColumn(GROUP_KEY, blk)
    later = trades.groupBy(*keys, blk.alias(GROUP_KEY)).agg(F.min("entry_idx").alias("_gmin"))
    later = later.withColumn("_gnext", F.lead("_gmin").over(Window.partitionBy(*keys).orderBy(GROUP_KEY))).drop("_gmin")
    inside = Window.partitionBy(*keys, GROUP_KEY).orderBy("entry_idx")
    return own.join(later, [*keys, GROUP_KEY]).withColumn("next_entry", F.coalesce(F.lead("entry_idx").over(inside), F.col("_gnext"))).drop("_gnext", GROUP_KEY)


def cycles(trades: DataFrame, bars_total: DataFrame, keys: list[str], grid: Grid = GRID) -> DataFrame:
    """Trades with hold bars, re-entry gap and whether the cycle completed before the last bar."""
    t = next_entry(trades, keys, grid).join(bars_total, keys)
    gap = F.when(F.col("next_entry").isNotNull(), F.greatest(F.lit(0), F.col("next_entry") - F.col("exit_idx")))
    return t.withColumns({"reentry_gap": gap, "flat_gap": F.when(gap.isNotNull(), F.greatest(F.lit(0), gap - 1)),
                          "complete": F.col("exit_idx") < F.col("bars_total") - 1, "norm_reason": exit_reason(F.col("exit_reason"))})


def cycle_stats(cyc: DataFrame, bars_total: DataFrame, keys: list[str]) -> DataFrame:
    counts = [F.count_if(F.col("norm_reason") == r).alias(f"n_{r}") for r in REASONS]
    agg = cyc.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("entry_count"), F.count_if("complete").alias("cycle_count"), F.avg("bars").alias("avg_hold_bars"),
        F.percentile(F.col("bars").cast("double"), F.lit(0.95)).alias("p95_hold_bars"), F.min("entry_idx").alias("_first"), F.max_by("exit_idx", "entry_idx").alias("_lastx"),
        F.sum("flat_gap").alias("_gaps"), F.avg("flat_gap").alias("avg_flat_gap"), *counts)
    out = bars_total.join(agg, keys, "left")
    n = F.coalesce(F.col("entry_count"), F.lit(0))
    flat = F.when(n == 0, F.col("bars_total")).otherwise(F.greatest(F.lit(0), F.col("_first")) + F.greatest(F.lit(0), F.col("bars_total") - 1 - F.col("_lastx")) + F.coalesce("_gaps", F.lit(0)))
    return out.select(
        *keys, n.alias("entry_count"), F.coalesce("cycle_count", F.lit(0)).alias("cycle_count"), zero(F.col("avg_hold_bars")).alias("avg_hold_bars"),
        zero(F.col("p95_hold_bars")).alias("p95_hold_bars"), flat.alias("flat_bars"), zero(F.col("avg_flat_gap")).alias("avg_flat_gap"),
        *[zero(div(F.col(f"n_{r}"), n)).alias(f"ratio_{r.lower()}") for r in REASONS])


def aggregate_windows(windows: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and median return, mean Sharpe and drawdown, violation rate, p10 and sample deviation over the windows of a policy."""
    r = F.col("total_return_pct")
    return windows.groupBy(*keys).agg(
        F.avg(r).alias("mean_return"), F.median(r).alias("median_return"), F.avg("sharpe").alias("mean_sharpe"), F.avg("max_drawdown_pct").alias("mean_mdd"),
        F.avg(F.col("is_rejected").cast("double")).alias("violation_rate"), F.percentile(r, F.lit(0.1)).alias("score_p10"),
        zero(F.stddev_samp(r)).alias("score_std"), F.avg("complexity_score").alias("mean_complexity"))


FLAT_MEANS = ["win_rate", "reward_risk", "sharpe", "trades_per_year", "profit_factor", "top1_share", "excess_return", "invalid_action_rate", "exposure_ratio"]
FLAT_SUMS = ["trade_count", "cycle_count", "bars_total"]


def flat_metrics(windows: DataFrame, keys: list[str]) -> DataFrame:
    """One flat row per policy: means of rates, sums of counts, entry rate per bar."""
    out = windows.groupBy(*keys).agg(
        F.avg("total_return_pct").alias("total_return_pct"), F.avg("max_drawdown_pct").alias("mdd_pct"), *[F.avg(m).alias(m) for m in FLAT_MEANS],
        *[F.sum(s).cast("bigint").alias(s) for s in FLAT_SUMS])
    return (out.withColumn("entry_signal_rate", F.col("trade_count") / F.greatest(F.lit(1), F.col("bars_total")))
            .withColumnsRenamed({"trade_count": "n_trades", "bars_total": "oos_bars"}))


def prediction_trades(df: DataFrame, keys: list[str], pred: str = "pred", pnl: str = "net_pnl", target: int = 100, grid: Grid = GRID) -> DataFrame:
    """Trade starts where the prediction changes to non-zero, win rate on active bars, trade score."""
    from tickloom.operators.features import Scope, apply_layers

    scope = Scope("pred", tuple(keys))
    prev = scope.let("prev", F.coalesce(scope.lag(pred), F.lit(0)))
    marked = apply_layers(df, [scope], grid).withColumn("_start", (F.col(pred) != prev) & (F.col(pred) != 0))
    agg = marked.groupBy(*keys).agg(F.count_if("_start").alias("n_trades"), zero(F.avg(F.when(F.col(pred) != 0, (F.col(pnl) > 0).cast("double")))).alias("win_rate"))
    return agg.withColumn("trade_score", F.least(F.col("n_trades") / float(target), F.lit(1.0)))


def pnl_metrics(df: DataFrame, keys: list[str], pnl: str = "net_pnl", unit: str = "risk_unit", grid: Grid = GRID) -> DataFrame:
    """Return, drawdown (negative), volatility and mean gain / mean loss of profit times the risk unit."""
    r = clip(F.coalesce(F.col(pnl), F.lit(0.0)) * F.col(unit), -0.95, None)
    df = running(materialize(df.withColumn("_r", r)), {"_log": ("sum", F.log1p("_r"))}, tuple(keys), grid=grid).withColumn("_eq", F.exp("_log"))
    df = running(df, {"_peak": ("max", F.col("_eq"))}, tuple(keys), grid=grid)
    gain, loss = F.avg(F.when(F.col("_r") > 0, F.col("_r"))), F.abs(F.avg(F.when(F.col("_r") < 0, F.col("_r"))))
    return df.groupBy(*keys).agg(
        ((F.max_by("_eq", "bar_idx") - 1) * 100).alias("total_return_pct"), (F.min(div("_eq", "_peak") - 1) * 100).alias("mdd_pct"),
        (zero(F.stddev_samp("_r")) * 100).alias("volatility_pct"), F.when(loss > 0, zero(gain) / (loss + 1e-9)).otherwise(0.0).alias("reward_risk"),
        (F.max(unit) * 100).alias("stop_loss_pct"))


def eval_summary(rows: DataFrame, keys: list[str], q: float = S.LOWER_Q, floor: float = 0.25) -> DataFrame:
    """Medians over runs and windows, normalised by the median stop loss, and the weighted evaluation score."""
    scale = rows.groupBy(*keys).agg(F.greatest(F.median("stop_loss_pct"), F.lit(floor)).alias("risk_scale"))
    n = rows.join(scale, keys).withColumns({
        "nr": F.col("total_return_pct") / F.col("risk_scale"), "nm": F.abs("mdd_pct") / F.col("risk_scale"), "nv": F.col("volatility_pct") / F.col("risk_scale")})
    agg = n.groupBy(*keys).agg(
        F.max("risk_scale").alias("risk_scale"), F.median("total_return_pct").alias("return_median"), F.percentile("total_return_pct", F.lit(q)).alias("return_pctl"),
        F.avg("total_return_pct").alias("return_mean"), zero(F.stddev_samp("total_return_pct")).alias("return_std"), F.median("mdd_pct").alias("mdd_median"),
        F.median("volatility_pct").alias("vol_median"), F.median("reward_risk").alias("rr_median"), F.median("trade_score").alias("trade_score_median"),
        F.median("win_rate").alias("win_rate_median"), F.median("nr").alias("nr_med"), F.percentile("nr", F.lit(q)).alias("nr_q"), F.median("nm").alias("nm_med"),
        F.median("nv").alias("nv_med"))
    score = (100.0 * F.col("nr_med") + 0.8 * F.col("nr_q") - 30.0 * F.col("nm_med") - 5.0 * F.col("nv_med") + 0.1 * F.col("rr_median")
             + 2.0 * F.col("trade_score_median") + 5.0 * F.col("win_rate_median") * 100.0)
    return agg.withColumn("eval_score", score)
