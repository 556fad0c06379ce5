"""Policies and derived tables the registered queries share, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import backtest as BT
from tickloom.operators.engines import close_engine, state_gate
from tickloom.operators.features import compute_genome
from tickloom.operators.rules import policy_signals
from tickloom.queries.base import bars_d
from tickloom.session import materialize
from tickloom.queries.feature_queries import rsi_layers
from tickloom.queries.sqlkit import BARS_D, Rec, chain, lag, over, win

GENOME = {"MOMENTUM_RSI_V1": {"window": 14}, "VOLATILITY_DONCHIAN_V1": {}, "TREND_MACROSS_V1": {"fast": 20, "slow": 50}, "TREND_SMA_V1": {},
          "VOLATILITY_STD_V1": {}}
POLICIES = [
    {"policy_id": "mean_rev_rsi", "genome": ["MOMENTUM_RSI_V1"], "rules": {"entry": "MOMENTUM_RSI_V1 < 42", "exit": "MOMENTUM_RSI_V1 > 56", "timing": "volume > [q0.2]"},
     "tp": 0.20, "sl": 0.10, "hold": 30, "cost_bps": 5.0},
    {"policy_id": "range_donchian", "genome": ["VOLATILITY_DONCHIAN_V1", "TREND_SMA_V1"], "rules": {"entry": "close < TREND_SMA_V1 and low <= VOLATILITY_DONCHIAN_V1.lower", "exit": "close > TREND_SMA_V1"},
     "tp": 0.25, "sl": 0.15, "hold": 20, "cost_bps": 5.0},
    {"policy_id": "trend_cross", "genome": ["TREND_MACROSS_V1"], "rules": {"entry": "TREND_MACROSS_V1 cross_up 0", "exit": "TREND_MACROSS_V1 cross_down 0", "timing": "true or false"},
     "tp": 0.40, "sl": 0.20, "hold": 60, "cost_bps": 10.0},
    {"policy_id": "vol_break", "genome": ["VOLATILITY_STD_V1", "TREND_SMA_V1"],
     "rules": {"entry": "close > [q0.8] and not VOLATILITY_STD_V1 > [q0.9]", "exit": "close < [q0.3] or close < TREND_SMA_V1", "timing": "volume > [q0.3]",
               "hold_short": "VOLATILITY_STD_V1 > [q0.7]", "hold_long": "VOLATILITY_STD_V1 < [q0.2]"}, "tp": 0.15, "sl": 0.12, "hold": 40, "cost_bps": 5.0},
]


def policy_params(spark: SparkSession, sample: str = "base") -> DataFrame:
    rows = [(p["policy_id"], sample, p["tp"], p["sl"], p["hold"], p["cost_bps"]) for p in POLICIES]
    return spark.createDataFrame(rows, "policy_id string, sample_id string, tp_pct double, sl_pct double, max_hold int, cost_bps double")


def feature_frame(spark: SparkSession, sf: str) -> DataFrame:
    return compute_genome(bars_d(spark, sf), GENOME)


def raw_signals(spark: SparkSession, sf: str, timing: bool = True, keep=("close",)) -> DataFrame:
    return policy_signals(feature_frame(spark, sf), POLICIES, 1, keep=keep, timing=timing)


def gated_signals(spark: SparkSession, sf: str) -> DataFrame:
    return state_gate(raw_signals(spark, sf), policy_params(spark).drop("sample_id", "max_hold", "cost_bps"))


def base_trades(spark: SparkSession, sf: str, signals: DataFrame | None = None) -> DataFrame:
    """Trades of every policy on ungated signals with the policy's own exits."""
    sig = raw_signals(spark, sf) if signals is None else signals
    return close_engine(sig.drop("hold_min", "hold_max", "sample_id"), policy_params(spark))


KEYS = ["policy_id", "symbol", "sample_id"]


def signal_grid(spark: SparkSession, sf: str) -> DataFrame:
    return raw_signals(spark, sf).withColumn("sample_id", F.lit("base"))


def engine_positions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(signals with end-of-bar position, trades)."""
    grid = materialize(signal_grid(spark, sf))
    trades = base_trades(spark, sf, grid)
    pos = BT.positions(grid, trades, KEYS)
    return pos, trades


# -- SQL side ----------------------------------------------------------------------------------
# One row per policy, symbol and bar; `symbol` holds "policy|symbol" so that the recursion helper can be reused.

_layers = [*rsi_layers(14), {
    "dlow": win("min", "low", 20), "sma20": win("avg", "close", 20), "std20": win("stddev_samp", "close", 20),
    "mf": win("avg", "close", 20), "ms": win("avg", "close", 50)}, {"spread": "(mf - ms) / (ms + 1e-6::DOUBLE)"}, {"pspread": lag("spread")}]


def quant(col: str, q: float) -> str:
    return f"quantile_cont({col}, {q}) OVER (PARTITION BY symbol)"


_layers.append({"q_v2": quant("volume", 0.2), "q_v3": quant("volume", 0.3), "q_c8": quant("close", 0.8), "q_c3": quant("close", 0.3), "q_s9": quant("std20", 0.9),
                "q_s7": quant("std20", 0.7), "q_s2": quant("std20", 0.2)})
FEATURES_SQL, FEATURES_LAST = chain(BARS_D, *_layers)


def f(cond: str) -> str:
    return f"coalesce({cond}, false)"


RULES_SQL = {
    "mean_rev_rsi": (f("rsi < 42"), f("rsi > 56"), f("volume > q_v2"), "false", "false"),
    "range_donchian": (f"{f('close < sma20')} AND {f('low <= dlow')}", f("close > sma20"), "true", "false", "false"),
    "trend_cross": (f("pspread <= 0 AND spread > 0"), f("pspread >= 0 AND spread < 0"), "true", "false", "false"),
    "vol_break": (f"{f('close > q_c8')} AND NOT {f('std20 > q_s9')}", f"{f('close < q_c3')} OR {f('close < sma20')}", f("volume > q_v3"), f("std20 > q_s7"), f("std20 < q_s2")),
}
_union = "\nUNION ALL ".join(
    f"SELECT '{pid}' AS policy_id, symbol AS sym, '{pid}|' || symbol AS symbol, bar_idx, open, high, low, close, volume, ({e})::BOOLEAN AS e0, ({x})::BOOLEAN AS x0, ({t})::BOOLEAN AS timing, "
    f"({hs})::BOOLEAN AS hs, ({hl})::BOOLEAN AS hl, {p['tp']}::DOUBLE AS tp, {p['sl']}::DOUBLE AS sl, {p['hold']} AS mx, {p['cost_bps']}::DOUBLE / 10000 AS cost FROM {FEATURES_LAST}"
    for pid, (e, x, t, hs, hl) in RULES_SQL.items() for p in POLICIES if p["policy_id"] == pid)
SIGNALS_SQL = f"""{FEATURES_SQL},
sig0 AS MATERIALIZED ({_union}),
sig1 AS (SELECT *, bool_and(timing) OVER (PARTITION BY symbol) AS a_all, bool_or(timing) OVER (PARTITION BY symbol) AS a_any FROM sig0),
sig2 AS (SELECT *, CASE WHEN a_all THEN bar_idx % 4 = 0 WHEN NOT a_any THEN e0 OR x0 ELSE timing END AS act FROM sig1),
sig AS MATERIALIZED (SELECT *, e0 AND act AS entry, x0 AND act AS exit, CASE WHEN hs THEN 1 WHEN hl THEN 20 ELSE 5 END AS hmin, CASE WHEN hs THEN 5 WHEN hl THEN 60 ELSE 20 END AS hmax FROM sig2)"""


def engine_rec(entry: str = "entry", exit_: str = "exit", mn: str = "0", mx: str = "x.mx", conflict: bool = True) -> Rec:
    """Close engine (or state gate) as a recursion: position after the bar, entry bar, entry price, bars held, exit code."""
    ea = f"x.{entry} AND NOT x.{exit_}" if conflict else f"x.{entry}"
    xa = f"x.{exit_} AND NOT x.{entry}" if conflict else f"x.{exit_}"
    cap = f"greatest({mx}, {mn})"
    code = (f"(CASE WHEN r.pos = 0 THEN 0 WHEN ({xa}) AND r.held >= r.mn THEN 1 WHEN x.close >= r.ep * (1 + x.tp) THEN 2 WHEN x.close <= r.ep * (1 - x.sl) THEN 3 "
            f"WHEN r.held + 1 >= r.mh THEN 4 ELSE 0 END)")
    enters = f"(r.pos = 0 AND ({ea}))"
    e0 = ea.replace("x.", "")
    return Rec({
        "pos": (f"CASE WHEN {e0} THEN 1 ELSE 0 END", f"CASE WHEN {enters} THEN 1 WHEN r.pos = 1 AND {code} = 0 THEN 1 ELSE 0 END"),
        "en": ("0", f"CASE WHEN {enters} THEN x.bar_idx ELSE r.en END"), "ep": ("close", f"CASE WHEN {enters} THEN x.close ELSE r.ep END"),
        "held": ("0", f"CASE WHEN {enters} THEN 0 ELSE r.held + 1 END"), "mn": (mn.replace("x.", ""), f"CASE WHEN {enters} THEN {mn} ELSE r.mn END"),
        "mh": (cap.replace("x.", ""), f"CASE WHEN {enters} THEN {cap} ELSE r.mh END"), "code": ("0", code)})


RUN_SQL, RUN = chain(SIGNALS_SQL, engine_rec(), source="sig", tag="e")


def trades_of(run: str, tag: str = "trades") -> str:
    """CTEs with the trades of an engine run: exits with a code, then positions still open on the last bar."""
    return f"""{tag}_n AS (SELECT symbol, max(bar_idx) AS last FROM {run} GROUP BY 1),
{tag}_x AS (SELECT policy_id, sym, symbol, en::BIGINT AS entry_idx, bar_idx::BIGINT AS exit_idx, ep AS entry_price, close AS exit_price, cost,
    CASE code WHEN 1 THEN 'AGENT_EXIT' WHEN 2 THEN 'TP' WHEN 3 THEN 'SL' ELSE 'HORIZON' END AS exit_reason, false AS open_at_end FROM {run} WHERE code > 0
  UNION ALL SELECT policy_id, sym, symbol, en::BIGINT, bar_idx::BIGINT, ep, close, cost, 'HORIZON', true FROM {run} JOIN {tag}_n USING (symbol) WHERE pos = 1 AND bar_idx = last),
{tag} AS MATERIALIZED (SELECT *, ((exit_price * (1 - cost)) / (entry_price * (1 + cost)) - 1) * 100 AS return_pct, exit_idx - entry_idx AS bars FROM {tag}_x)"""


TRADES_SQL = f"{RUN_SQL},\n{trades_of(RUN)}"
BARS_TOTAL_SQL = f"nbars AS (SELECT policy_id, sym, symbol, max(bar_idx) + 1 AS bars_total FROM {RUN} GROUP BY ALL)"
