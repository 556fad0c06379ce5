"""Positions, curves and statistics derived relationally from the trades of the engines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import settings as S
from tickloom.functions.num import clip, div
from tickloom.operators.blocks import GRID, Grid, running
from tickloom.session import materialize


def positions(bars: DataFrame, trades: DataFrame, keys: list[str], grid: Grid = GRID) -> DataFrame:
    """0/1 position after each bar: long on entry_idx <= i < exit_idx, and on the last bar of a trade still open there.

    Trades become +1 / -1 marks on their two bars and a running sum fills the interval, so no range join is needed.
    """
    marks = trades.select(*keys, F.explode(F.array(
        F.struct(F.col("entry_idx").alias("bar_idx"), F.lit(1.0).alias("d")),
        F.struct(F.col("exit_idx").alias("bar_idx"), F.when(F.col("open_at_end"), 0.0).otherwise(-1.0).alias("d")))).alias("m"))
    net = marks.select(*keys, "m.bar_idx", "m.d").groupBy(*keys, "bar_idx").agg(F.sum("d").alias("_d"))
    joined = materialize(bars.join(net, [*keys, "bar_idx"], "left"))
    out = running(joined, {"_pos": ("sum", F.coalesce("_d", F.lit(0.0)))}, keys=tuple(keys), grid=grid)
    return out.withColumn("position", F.col("_pos").cast("int")).drop("_d", "_pos")


def bar_returns(pos: DataFrame, keys: list[str], grid: Grid = GRID, start: Column | None = None) -> DataFrame:
    """Gross strategy return of each bar: previous position times the close-to-close return; 0 on the first bar."""
    from tickloom.operators.features import Scope, apply_layers

    scope = Scope("ret", tuple(keys))
    prev = scope.let("p", scope.lag("position"))
    pc = scope.let("c", scope.lag("close"))
    r = scope.let("r", F.coalesce(prev * div(F.col("close") - pc, pc), F.lit(0.0)))
    df = apply_layers(pos, [scope], grid)
    first = F.lit(False) if start is None else start
    return df.select(*pos.columns, F.when(first, 0.0).otherwise(r).alias("strategy_return"))


def equity_curve(ret: DataFrame, keys: list[str], col: str = "strategy_return", grid: Grid = GRID) -> DataFrame:
    """Compounded curve in percent, running peak and drawdown.

    The product is a running sum of logarithms; a return of -100 % or worse ends the curve at zero.
    """
    grow = F.lit(1.0) + F.col(col)
    df = running(materialize(ret), {"_log": ("sum", F.when(grow > 0, F.ln(grow)).otherwise(0.0)), "_dead": ("max", F.when(grow <= 0, 1.0).otherwise(0.0))},
                 keys=tuple(keys), grid=grid)
    df = df.withColumn("equity", F.when(F.col("_dead") > 0, 0.0).otherwise(F.exp("_log"))).drop("_log", "_dead")
    df = running(df, {"_peak": ("max", F.col("equity"))}, keys=tuple(keys), grid=grid)
    peak = F.greatest("_peak", F.lit(1.0))
    return df.withColumns({"equity_pct": (F.col("equity") - 1) * 100, "peak": peak, "drawdown": div("equity", peak) - 1}).drop("_peak")


def benchmark_return(first: Column, last: Column, exposure: Column, mode: str = "bh", fixed: float = 0.0) -> Column:
    """Benchmark of a window in percent: bh, fixed, cash, exposure or exposure_fixed."""
    bh = (div(last, first) - 1) * 100
    held = clip(exposure, 0, 1)
    value = {"fixed": F.lit(float(fixed)), "cash": F.lit(0.0), "exposure": bh * held, "exposure_fixed": F.lit(float(fixed)) * held}.get(mode, bh)
    return F.when(first == 0, 0.0).otherwise(value)


def trade_aggregates() -> dict[str, Column]:
    """Aggregates of the close engine over ``return_pct`` (a loss is <= 0)."""
    r = F.col("return_pct") / 100.0
    won, lost = F.sum(F.when(r > 0, r).otherwise(0.0)), F.abs(F.sum(F.when(r <= 0, r).otherwise(0.0)))
    grow = F.lit(1.0) + r
    product = F.when(F.min(grow) <= 0, 0.0).otherwise(F.exp(F.sum(F.when(grow > 0, F.ln(grow)))))
    return {
        "trade_count": F.count(F.lit(1)), "total_return": (product - 1) * 100, "win_rate": F.avg((r > 0).cast("double")),
        "profit_factor": F.when(lost > 0, div(won, lost)).otherwise(F.when(won > 0, 100.0).otherwise(1.0)),
        "avg_trade_return": F.avg(r) * 100,
    }


def action_flags(signals: DataFrame, prev_position: str = "prev_position") -> DataFrame:
    """Invalid and ignored actions per bar from raw signals and the position before the bar."""
    e, x, p = F.col("entry"), F.col("exit"), F.col(prev_position)
    return signals.withColumns({
        "is_action": e | x,
        "invalid_reason": F.when(e & x, "CONFLICT_ENTRY_EXIT"),
        "ignored_reason": F.when(e & x, None).when(e & (p == 1), "IGNORED_LONG_ENTER").when(x & (p == 0), "IGNORED_FLAT_EXIT"),
    })


def action_audit(flags: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, rates, first index and per-reason counts; the first five events are the lowest bar indices."""
    n, inv, ign = F.count_if("is_action"), F.count_if(F.col("invalid_reason").isNotNull()), F.count_if(F.col("ignored_reason").isNotNull())
    rate = lambda k: F.coalesce(div(k, n), F.lit(0.0))
    return flags.groupBy(*keys).agg(
        n.alias("total_action_bars"), inv.alias("invalid_count"), rate(inv).alias("invalid_rate"), ign.alias("ignored_count"), rate(ign).alias("ignored_rate"),
        F.min(F.when(F.col("invalid_reason").isNotNull(), F.col("bar_idx"))).alias("invalid_first"),
        F.min(F.when(F.col("ignored_reason").isNotNull(), F.col("bar_idx"))).alias("ignored_first"),
        F.count_if(F.col("ignored_reason") == "IGNORED_LONG_ENTER").alias("ignored_long_enter"),
        F.count_if(F.col("ignored_reason") == "IGNORED_FLAT_EXIT").alias("ignored_flat_exit"))


def first_events(flags: DataFrame, keys: list[str], kind: str, n: int = 5, grid: Grid = GRID) -> DataFrame:
    """First n invalid or ignored events per key: ranked by a running count, so no key is sorted whole."""
    col = f"{kind}_reason"
    hits = running(flags, {"_k": ("sum", F.when(F.col(col).isNotNull(), 1.0).otherwise(0.0))}, keys=tuple(keys), grid=grid)
    hits = hits.filter(F.col(col).isNotNull() & (F.col("_k") <= n))
    return hits.select(*keys, "bar_idx", F.col("_k").cast("int").alias("event_no"), F.col(col).alias("reason"),
                       F.when(F.col("prev_position") == 1, "LONG").otherwise("FLAT").alias("position_state"), "entry", "exit")


def trade_params(df: DataFrame) -> DataFrame:
    """tp_pct, sl_pct and horizon from a risk budget with fallbacks (columns may be NULL)."""
    sl0 = F.coalesce("sl_pct", "stop_loss")
    tp = F.coalesce(F.col("tp_pct"), sl0 * F.col("risk_reward_ratio"), F.col("k_up") * S.DAILY_VOL, F.lit(0.02))
    sl = F.coalesce(sl0, F.col("k_down") * S.DAILY_VOL, F.lit(0.01))
    return df.withColumns({"r_tp": F.greatest(tp, F.lit(0.001)), "r_sl": F.greatest(sl, F.lit(0.001)),
                           "r_horizon": F.greatest(F.coalesce(F.col("horizon").cast("int"), F.lit(20)), F.lit(1))})


def risk_unit(df: DataFrame, default: float = 0.01) -> DataFrame:
    """Per-trade risk unit and reward/risk ratio of a budget."""
    unit = F.coalesce(F.col("stop_loss"), clip(F.col("k_down") * S.DAILY_VOL, 0.001, 0.2), F.lit(default))
    return df.withColumns({"risk_unit": unit, "reward_risk": F.coalesce(F.col("risk_reward_ratio"), div("k_up", "k_down"))})


def compounded(df: DataFrame, keys: list[str], pnl: str = "net_pnl", unit: str = "risk_unit", grid: Grid = GRID) -> DataFrame:
    """Compounded curve of per-bar profit times the risk unit, floored at -95 % per bar."""
    r = clip(F.coalesce(F.col(pnl), F.lit(0.0)) * F.col(unit), -0.95, None)
    return equity_curve(df.withColumn("unit_return", r), keys, "unit_return", grid)


def fast_scores(signals: DataFrame, keys: list[str], grid: Grid = GRID) -> DataFrame:
    """Quick score per policy: 1000 x summed next-bar return on signal bars + 10 x mean / deviation; -99 without a signal."""
    from tickloom.operators.blocks import GROUP_KEY, core_only, with_lookahead

    nxt = F.lead("close").over(Window.partitionBy(*keys, GROUP_KEY).orderBy("bar_idx"))
    ahead = core_only(with_lookahead(signals, 1, grid).withColumn("_n", nxt)).filter(F.col("_n").isNotNull())
    r = F.col("entry").cast("double") * div(F.col("_n") - F.col("close"), "close")
    agg = ahead.withColumn("_r", r).groupBy(*keys).agg(
        F.sum("_r").alias("s"), F.avg("_r").alias("m"), F.stddev_pop("_r").alias("sd"), F.count_if("entry").alias("n"))
    sharpe = F.when(F.col("sd") > 1e-9, div("m", "sd")).otherwise(0.0)
    return agg.select(*keys, F.when(F.col("n") == 0, -99.0).otherwise(F.col("s") * 1000 + sharpe * 10).alias("score"))


def intrabar_equity(trades: DataFrame, keys: list[str], commission_type: str = "percent", commission: float = 0.0,
                    mode: str = "equity_pct", position_value: float = 1.0, initial: float = 1.0, grid: Grid = GRID) -> DataFrame:
    """Quantity, fees, profit and account equity per trade.

    Each trade changes the account by an affine map of the equity before it, so the account is a scan over trades.
    """
    from tickloom.operators.blocks import core_only, with_halo, with_bar_idx
    from tickloom.operators.scan import Scan, run_scans

    frac = {"percent": commission / 100.0, "bps": commission / 1e4, "fixed": 0.0}[commission_type]
    flat = commission if commission_type == "fixed" else 0.0
    numbered = with_bar_idx(trades.drop("bar_idx"), tuple(keys), "entry_idx", F.expr("entry_idx div 4096"))
    gain = F.col("exit_price") - F.col("entry_price")
    fee1 = (F.col("entry_price") + F.col("exit_price")) * frac
    if mode == "fixed_qty":
        a, b = F.lit(1.0), F.lit(position_value) * (gain - fee1) - 2 * flat
    else:
        share = min(max(position_value, 0.0), 1.0)
        a = F.lit(1.0) + F.when(F.col("entry_price") > 0, div(F.lit(share) * (gain - fee1), "entry_price")).otherwise(0.0)
        b = F.lit(-2.0 * flat)
    df = with_halo(numbered.withColumns({"_a": a, "_b": b}), 0, grid)
    df = core_only(run_scans(df, [Scan("equity", F.col("_a"), F.col("_b"), seed=F.lit(float(initial)))], tuple(keys), grid=grid))
    before = div(F.col("equity") - F.col("_b"), "_a")
    if mode == "fixed_qty":
        qty = F.when(F.col("entry_price") > 0, F.lit(float(position_value))).otherwise(0.0)
    else:
        qty = F.when(F.col("entry_price") > 0, div(before * min(max(position_value, 0.0), 1.0), "entry_price")).otherwise(0.0)
    df = df.withColumn("qty", qty)
    fees = F.col("qty") * fee1 + 2 * flat
    return df.withColumns({
        "pnl_gross": gain * F.col("qty"), "fees": fees, "pnl_net": gain * F.col("qty") - fees,
        "slippage": (F.col("entry_slip") + F.col("exit_slip")) * F.col("qty")}).withColumnRenamed("bar_idx", "trade_no").drop("_a", "_b")


MISMATCH = ["TRADE_COUNT_MISMATCH", "ENTRY_BAR_MISMATCH", "EXIT_BAR_MISMATCH", "ENTRY_PRICE_MISMATCH", "EXIT_REASON_MISMATCH", "EXIT_PRICE_MISMATCH"]


def compare_trades(reference: DataFrame, produced: DataFrame, keys: list[str], tolerance: float = 0.0005) -> DataFrame:
    """First mismatch per key between two trade lists joined on the trade ordinal."""
    cols = ["entry_idx", "exit_idx", "entry_price", "exit_price", "reason"]
    ref = reference.select(*keys, "trade_no", *[F.col(c).alias(f"r_{c}") for c in cols])
    got = produced.select(*keys, "trade_no", *[F.col(c).alias(f"p_{c}") for c in cols])
    counts = ref.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_ref")).join(got.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_got")), keys, "full")
    counts = counts.select(*keys, F.coalesce("n_ref", F.lit(0)).alias("n_ref"), F.coalesce("n_got", F.lit(0)).alias("n_got"))
    off = lambda c: F.abs(F.col(f"r_{c}") - F.col(f"p_{c}")) > tolerance * F.greatest(F.abs(F.col(f"r_{c}")), F.lit(1e-9))
    code = (F.when(F.col("r_entry_idx") != F.col("p_entry_idx"), 1).when(F.col("r_exit_idx") != F.col("p_exit_idx"), 2)
            .when(off("entry_price"), 3).when(F.col("r_reason") != F.col("p_reason"), 4).when(off("exit_price"), 5))
    pairs = ref.join(got, [*keys, "trade_no"], "full").withColumn("_c", code).filter(F.col("_c").isNotNull())
    first = pairs.groupBy(*keys).agg(F.min(F.struct("trade_no", "_c")).alias("f"))
    names = F.array(*[F.lit(m) for m in MISMATCH])
    j = counts.join(first, keys, "left")
    wrong_count = F.col("n_ref") != F.col("n_got")
    return j.select(*keys, "n_ref", "n_got", F.when(wrong_count, MISMATCH[0]).when(F.col("f").isNotNull(), names[F.col("f._c")]).otherwise("MATCH").alias("mismatch"),
                    F.when(~wrong_count, F.col("f.trade_no")).alias("trade_no"))
