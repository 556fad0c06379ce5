import numpy as np
import pandas as pd
import pytest
from helpers import frame, make_bars, random_walk
from pyspark.sql import functions as F

from tickloom.operators import calibration as CAL
from tickloom.operators import backtest as BT
from tickloom.operators import gates as G
from tickloom.operators.engines import close_engine, intrabar_engine, state_gate
from tickloom.operators.metrics import trade_stats
from tickloom.operators.rules import compile_rule, evaluate_rules, text_complexity
from tickloom.functions import settings as S

CORE10 = [100, 105, 110, 108, 102, 110, 115, 120, 118, 125.0]
INV20 = [100, 110, 99, 108.9, 100, 120, 114, 131.1, 120, 132, 125.4, 137.9, 131, 144.1, 130, 143, 135.8, 149.3, 140, 154.0]


def signals(spark, closes, entries, exits, **cols):
    n = len(closes)
    e = [i in entries for i in range(n)]
    x = [i in exits for i in range(n)]
    return make_bars(spark, [float(c) for c in closes], entry=np.array(e), exit=np.array(x), **cols).withColumn("policy_id", F.lit("p"))


def params(spark, tp=None, sl=None, hold=None, cost=0.0):
    return spark.createDataFrame([("s", tp, sl, hold, cost)], "sample_id string, tp_pct double, sl_pct double, max_hold int, cost_bps double")


def run(spark, closes, entries, exits, **kw):
    return frame(close_engine(signals(spark, closes, entries, exits), params(spark, **kw)), "entry_idx")


def test_thresholds_and_missing_values(spark):
    feat = [10.0 * (i + 1) for i in range(10)]
    bars = make_bars(spark, CORE10, feature_a=feat)
    got = frame(evaluate_rules(bars, {"e": "feature_a > 25", "x": "feature_a > 75"}))
    assert got.e[2] and not got.e[1] and got.x[7] and not got.x[6]
    assert text_complexity("feature_a > 25") + text_complexity("feature_a > 75") == pytest.approx(3.4)
    holes = bars.withColumn("feature_a", F.when(F.col("bar_idx") != 2, F.col("feature_a")))
    got = frame(evaluate_rules(holes, {"above": "feature_a > 0", "other": "feature_a != 5", "inv": "not feature_a > 0"}))
    assert not got.above[2] and got.other[2] and got.inv[2]


def test_quantile_rule(spark):
    bars = make_bars(spark, INV20, feat=np.linspace(0, 1, 20).tolist())
    got = frame(evaluate_rules(bars, {"r": "feat > [q0.5]"}))
    assert got.r[10] and not got.r[9]


def test_unknown_names_fail_before_running(spark):
    bars = make_bars(spark, CORE10)
    with pytest.raises(LookupError):
        compile_rule("nothing_here > 3", bars.columns)
    with pytest.raises(ValueError):
        compile_rule("close > 3 and system", bars.columns)


def test_fill_timing(spark):
    t = run(spark, CORE10, {1}, {4})
    assert len(t) == 1 and t.entry_price[0] == 105 and t.exit_price[0] == 102
    assert t.return_pct[0] == pytest.approx((102 / 105 - 1) * 100)


def test_conflict_does_nothing(spark):
    assert len(run(spark, CORE10, {1}, {1})) == 0


def test_win_rate_and_profit_factor(spark):
    t = close_engine(signals(spark, CORE10, {0, 7}, {2, 8}), params(spark))
    row = t.groupBy("symbol").agg(*[v.alias(k) for k, v in BT.trade_aggregates().items()]).first()
    assert row.win_rate == 0.5 and row.profit_factor == pytest.approx(6.0)


def test_trade_product_is_total_return(spark):
    t = close_engine(signals(spark, INV20, {0, 10}, {4, 18}), params(spark))
    row = t.groupBy("symbol").agg(*[v.alias(k) for k, v in BT.trade_aggregates().items()]).first()
    assert row.total_return == pytest.approx(((100 / 100) * (140 / 125.4) - 1) * 100)


def test_curve_has_no_look_ahead(spark):
    sig = signals(spark, INV20, {5}, {6}).withColumn("sample_id", F.lit("s"))
    keys = ["policy_id", "symbol", "sample_id"]
    pos = BT.positions(sig, close_engine(sig.drop("sample_id"), params(spark)), keys)
    got = frame(BT.equity_curve(BT.bar_returns(pos, keys), keys))
    assert got.equity_pct[5] == 0 and got.equity_pct[6] == pytest.approx(-5) and got.equity_pct[7] == pytest.approx(-5)


def sequential(closes, entry, exit_, tp, sl, hold):
    """Plain loop over all bars, for comparison."""
    out, pos = [], None
    for i, c in enumerate(closes):
        if pos is not None:
            e, held = pos
            if exit_[i] and not entry[i]:
                out.append((e, i, "AGENT_EXIT")); pos = None
            else:
                held += 1
                why = "TP" if c >= closes[e] * (1 + tp) else "SL" if c <= closes[e] * (1 - sl) else "HORIZON" if held >= hold else None
                if why:
                    out.append((e, i, why)); pos = None
                else:
                    pos = (e, held)
        elif entry[i] and not exit_[i]:
            pos = (i, 0)
    if pos is not None:
        out.append((pos[0], len(closes) - 1, "HORIZON"))
    return out


@pytest.mark.parametrize("block", [8192, 50, 17])
def test_engine_equals_loop_for_any_block(spark, block):
    w = random_walk(500, 11)
    rng = np.random.default_rng(5)
    e, x = rng.random(500) < 0.3, rng.random(500) < 0.05
    sig = make_bars(spark, w["closes"], entry=e, exit=x).withColumn("policy_id", F.lit("p"))
    t = frame(close_engine(sig, params(spark, 0.03, 0.02, 25), block=block), "entry_idx")
    assert [(a, b, r) for a, b, r in zip(t.entry_idx, t.exit_idx, t.exit_reason)] == sequential(w["closes"], e, x, 0.03, 0.02, 25)


@pytest.mark.parametrize("entries,exits,want", [({9}, set(), [(9, 9)]), ({0}, {0}, []), (set(range(10)), set(), [(0, 3), (4, 7), (8, 9)])])
def test_engine_edges(spark, entries, exits, want):
    t = run(spark, CORE10, entries, exits, hold=3)
    assert list(zip(t.entry_idx, t.exit_idx)) == want


def test_state_gate_respects_min_hold(spark):
    sig = signals(spark, CORE10, {0, 1, 6}, {1, 3, 7}).withColumns({"hold_min": F.lit(2), "hold_max": F.lit(60)})
    g = frame(state_gate(sig, params(spark).select("tp_pct", "sl_pct")))
    assert list(g.bar_idx[g.entry]) == [0, 6] and list(g.bar_idx[g.exit]) == [3]


def tv(spark, bars, **kw):
    base = dict(sample_id="s", tp_pct=None, sl_pct=None, max_hold=None, timing="next_open", priority="stop_first", slippage_mode="ticks", slippage_value=0.0, tick_size=0.01, same_bar_reentry=False)
    base.update(kw)
    schema = "sample_id string, tp_pct double, sl_pct double, max_hold int, timing string, priority string, slippage_mode string, slippage_value double, tick_size double, same_bar_reentry boolean"
    return frame(intrabar_engine(bars, spark.createDataFrame([tuple(base.values())], schema)), "entry_idx")


def test_next_open_fill(spark):
    o = [10.0, 11, 12, 13]
    bars = signals(spark, [x + 0.2 for x in o], {1}, {2}, open=o, high=[x + 0.5 for x in o], low=[x - 0.5 for x in o])
    t = tv(spark, bars)
    assert len(t) == 1 and (t.entry_idx[0], t.exit_idx[0], t.entry_price[0]) == (2, 3, 12.0)


@pytest.mark.parametrize("priority,reason", [("stop_first", "sl"), ("target_first", "tp")])
def test_collision_priority(spark, priority, reason):
    hi, lo = [100.5, 101.5, 102.0] + [100.5] * 17, [99.5, 98.5, 98.0] + [99.5] * 17
    bars = signals(spark, [100.0] * 20, set(range(20)), set(), high=hi, low=lo)
    assert tv(spark, bars, tp_pct=0.01, sl_pct=0.01, priority=priority).reason[0] == reason


def test_trade_count_mismatch(spark):
    cols = "symbol string, trade_no bigint, entry_idx bigint, exit_idx bigint, entry_price double, exit_price double, reason string"
    ref = spark.createDataFrame([("S", 0, 1, 2, 11.0, 12.0, "signal")], cols)
    assert BT.compare_trades(ref, ref.limit(0), ["symbol"]).first().mismatch == "TRADE_COUNT_MISMATCH"


def metrics_row(spark, **kw):
    row = dict(policy_id="p", window_id="w", stage_id=2, trade_count=50, entry_count=50, exit_count=50, cycle_count=50, bars_total=126, win_rate=0.6, profit_factor=1.5, reward_risk=1.5, top1_share=0.1, trades_per_year=100.0,
               entry_signal_rate=0.4, invalid_action_rate=0.0, total_return_pct=10.0, max_drawdown_pct=5.0, vol_pct=2.0, sharpe=1.2, exposure_ratio=0.2, excess_return=1.0, complexity_score=1.0)
    row.update(kw)
    return G.with_stage(spark.createDataFrame(pd.DataFrame([row])), S.stage_spec(spark))


def test_gate_passes_and_fails(spark):
    assert G.validate(metrics_row(spark), ["policy_id", "window_id"]).first().passed
    bad = G.validate(metrics_row(spark, cycle_count=0), ["policy_id", "window_id"]).first()
    assert not bad.passed and bad.reason == "FAIL_NO_CYCLE"


def test_reward_extremes_and_saturation(spark):
    keys = ["policy_id", "window_id"]
    low = G.reward(metrics_row(spark, **{k: 0 for k in ("trade_count", "entry_count", "exit_count", "cycle_count")}, win_rate=0.0, profit_factor=0.0, exposure_ratio=0.0, entry_signal_rate=0.0, excess_return=0.0), keys).first()
    high = G.reward(metrics_row(spark, total_return_pct=30.0, profit_factor=2.0, excess_return=200.0), keys).first()
    some = G.reward(metrics_row(spark, excess_return=10.0), keys).first()
    assert low.total < -10 < 0 < high.total and some.return_component < high.return_component < 3.05


def test_no_trades_statistics(spark):
    t = close_engine(signals(spark, CORE10, set(), set()), params(spark)).withColumn("ret", F.col("return_pct") / 100)
    total = spark.createDataFrame([("S", 10)], "symbol string, bars_total bigint")
    row = trade_stats(t, total, ["symbol"]).first()
    assert row.trade_count == 0 and row.profit_factor == 1.0 and row.win_rate == 0.0


def test_calibration_scenarios(spark):
    rows = []
    for sym, high, low in (("BOTH", 101.5, 98.5), ("UP", 101.5, 99.9), ("CALM", 100.1, 99.9)):
        for i in range(20):
            for s in ("timing", "cost", "collision"):
                entry = {"timing": i % 6 == 2, "cost": i % 6 == 2, "collision": sym != "CALM"}[s]
                rows.append((s, sym, i, 100.0 + i % 3 / 100, high, low, 100.0, entry, s != "collision" and i % 6 == 4))
    sig = spark.createDataFrame(rows, "policy_id string, symbol string, bar_idx long, open double, high double, low double, close double, entry boolean, exit boolean")
    got = {(r.scenario, r.overlay, r.symbol): r for r in CAL.calibrate(sig, CAL.overlays(spark)).collect()}
    assert len(got) == 15
    seen = {k: r.mismatch for k, r in got.items()}
    assert seen["collision", "stop_first", "BOTH"] == seen["collision", "target_first", "BOTH"] == "MATCH"
    assert seen["collision", "stop_first", "UP"] == "EXIT_REASON_MISMATCH" and got["collision", "stop_first", "UP"].trade_no == 0
    assert seen["collision", "target_first", "UP"] == "MATCH"
    assert seen["collision", "stop_first", "CALM"] == "TRADE_COUNT_MISMATCH" and got["collision", "stop_first", "CALM"].trade_count == 0
    assert all(m == "MATCH" for (s, _, _), m in seen.items() if s != "collision")
    cost = got["cost", "next_open", "BOTH"]
    equity, fees, slips = 1.0, 0.0, 0.0
    for i in (3, 9, 15):  # signalled at 2, 8, 14, filled at the next open; left at the open after 4, 10, 16
        bought, sold = 100.0 + i % 3 / 100 + 0.01, 100.0 + (i + 2) % 3 / 100 - 0.01
        qty = equity / bought
        fee = qty * (bought + sold) * 0.001
        equity, fees, slips = equity + qty * (sold - bought) - fee, fees + fee, slips + qty * 0.02
    assert (cost.trade_count, cost.final_equity, cost.total_fees, cost.total_slippage) == (3, pytest.approx(equity), pytest.approx(fees), pytest.approx(slips))


def test_calibration_finds_a_fill_off_its_signal(spark):
    rows = [("timing", "X", i, 100.0, 101.0, 99.0, 102.0, i == 5, i == 8) for i in range(12)]
    sig = spark.createDataFrame(rows, "policy_id string, symbol string, bar_idx long, open double, high double, low double, close double, entry boolean, exit boolean")
    slipped = CAL.overlays(spark, [("timing", "slipped", "next_open", "stop_first", 0.0, 50.0, None, None, None)])
    r = CAL.calibrate(sig, slipped).first()
    assert (r.mismatch, r.trade_no, r.trade_count) == ("ENTRY_PRICE_MISMATCH", 0, 1)
    none = CAL.calibrate(sig.withColumn("entry", F.lit(False)), CAL.overlays(spark)).collect()
    assert {r.mismatch for r in none} == {"TRADE_COUNT_MISMATCH"}
