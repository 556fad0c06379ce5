"""Calibration of the intrabar engine: execution scenarios as parameter rows of one pass, each held against its rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.backtest import intrabar_equity
from tickloom.operators.engines import intrabar_engine
from tickloom.session import materialize

KEYS = ["policy_id", "sample_id", "symbol"]
TICK = 0.01
TOLERANCE = 0.0005

# Scenario, overlay, fill timing, collision rule, commission in percent, slippage in ticks, target, stop, longest hold.
OVERLAYS = [
    ("timing", "next_open", "next_open", "stop_first", 0.0, 0.0, None, None, None),
    ("timing", "close", "close", "stop_first", 0.0, 0.0, None, None, None),
    ("cost", "next_open", "next_open", "stop_first", 0.1, 1.0, None, None, None),
    ("collision", "stop_first", "next_open", "stop_first", 0.0, 0.0, 0.002, 0.002, 30),
    ("collision", "target_first", "next_open", "target_first", 0.0, 0.0, 0.002, 0.002, 30),
]


def overlays(spark: SparkSession, rows=OVERLAYS) -> DataFrame:
    """One row per scenario (``policy_id``) and overlay (``sample_id``) with the engine's parameters."""
    df = spark.createDataFrame(rows, "policy_id string, sample_id string, timing string, priority string, commission double, slippage_value double, tp_pct double, sl_pct double, max_hold int")
    return df.withColumns({"slippage_mode": F.lit("ticks"), "tick_size": F.lit(TICK), "same_bar_reentry": F.lit(False)})


def calibrate(signals: DataFrame, params: DataFrame) -> DataFrame:
    """One row per scenario, overlay and symbol: totals of its trades and the first trade that breaks a rule.

    ``signals(policy_id, symbol, bar_idx, open, high, low, close, entry, exit)`` holds the signals of each scenario;
    ``params`` is the table of ``overlays``, joined on ``policy_id``. Rules by scenario:

    * ``timing``: a fill at the next open follows a signalled bar and has its open as price; a fill at the close is on the
      signalled bar and has its close (``ENTRY_BAR_MISMATCH``, ``ENTRY_PRICE_MISMATCH`` beyond 0.05 %).
    * ``cost``: net profit is the gross one less both commissions (``FEE_MISMATCH``), slippage is that of both fills
      (``SLIPPAGE_MISMATCH``), to a millionth.
    * ``collision``: the first trade leaves by the side that the collision rule favours (``EXIT_REASON_MISMATCH``).

    No trade at all is a ``TRADE_COUNT_MISMATCH`` except for ``cost``. Totals are in units of an account of 1 at the start.
    """
    signals = materialize(signals)
    trades = materialize(intrabar_engine(signals, params, keys=("policy_id", "symbol")))
    account = intrabar_equity(trades.join(params.select("policy_id", "sample_id", "commission", "timing", "priority", "slippage_value"), ["policy_id", "sample_id"]), KEYS, "percent", F.col("commission"))
    at = signals.select("policy_id", "symbol", F.col("bar_idx").alias("entry_idx"), F.col("open").alias("_open"), F.col("close").alias("_close"), F.col("entry").alias("_here"))
    before = signals.select("policy_id", "symbol", (F.col("bar_idx") + 1).alias("entry_idx"), F.col("entry").alias("_before"))
    on = ["policy_id", "symbol", "entry_idx"]
    j = account.join(at, on, "left").join(before, on, "left")
    next_open = F.col("timing") == "next_open"
    signalled = F.coalesce(F.when(next_open, F.col("_before")).otherwise(F.col("_here")), F.lit(False))
    price = F.when(next_open, F.col("_open")).otherwise(F.col("_close"))
    rate = F.col("commission") / 100
    net = F.col("qty") * (F.col("exit_price") - F.col("entry_price")) - F.col("qty") * F.col("entry_price") * rate - F.col("qty") * F.col("exit_price") * rate
    slipped = F.col("qty") * F.col("slippage_value") * (2 * TICK)
    off = lambda got, want: F.abs(F.col(got) - want) > 1e-6 * F.greatest(F.lit(1.0), F.abs(want))
    favoured = F.when(F.col("priority") == "target_first", "tp").otherwise("sl")
    is_ = lambda s: F.col("policy_id") == s
    code = (F.when(is_("timing") & ~signalled, "ENTRY_BAR_MISMATCH")
            .when(is_("timing") & (F.abs(F.col("entry_price") - price) > TOLERANCE * F.abs(price)), "ENTRY_PRICE_MISMATCH")
            .when(is_("cost") & off("pnl_net", net), "FEE_MISMATCH").when(is_("cost") & off("slippage", slipped), "SLIPPAGE_MISMATCH")
            .when(is_("collision") & (F.col("trade_no") == 0) & (F.col("reason") != favoured), "EXIT_REASON_MISMATCH"))
    sums = j.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("trade_count"), F.max_by("equity", "trade_no").alias("final_equity"), F.sum("fees").alias("total_fees"),
        F.sum("slippage").alias("total_slippage"), F.min(F.when(code.isNotNull(), F.struct("trade_no", code.alias("code")))).alias("f"))
    every = signals.select("policy_id", "symbol").distinct().join(params.select("policy_id", "sample_id"), "policy_id")
    out = every.join(sums, KEYS, "left")
    none = F.col("trade_count").isNull() & ~is_("cost")
    return out.select(
        F.col("policy_id").alias("scenario"), F.col("sample_id").alias("overlay"), "symbol", F.coalesce("trade_count", F.lit(0)).alias("trade_count"),
        F.coalesce("final_equity", F.lit(1.0)).alias("final_equity"), F.coalesce("total_fees", F.lit(0.0)).alias("total_fees"), F.coalesce("total_slippage", F.lit(0.0)).alias("total_slippage"),
        F.when(none, "TRADE_COUNT_MISMATCH").otherwise(F.coalesce("f.code", F.lit("MATCH"))).alias("mismatch"), F.col("f.trade_no").alias("trade_no"))
