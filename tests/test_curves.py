"""Curve statistics from one row per trade against unrolled bars, and the records made of them."""

import numpy as np
import pandas as pd
import pytest

from tickloom.operators import curves as C
from tickloom.plans import evaluate as E
from tickloom.session import ship


def unrolled(r, trades):
    """sum, sum of squares, log growth, drawdown of the held bars of consecutive trades."""
    held = np.concatenate([r[a + 1 : b + 1] for a, b in trades]) if trades else np.zeros(0)
    if not len(held):
        return None
    log = np.cumsum(np.log(np.maximum(1 + held, 1e-12)))
    top = np.maximum(np.maximum.accumulate(log), 0)
    return held.sum(), (held**2).sum(), log[-1], (1 - np.exp(log - top)).max()


def test_range_summaries():
    rng = np.random.default_rng(2)
    r = rng.normal(0, 0.03, 77)
    r[40] = -1.0
    first = rng.integers(0, 77, 200)
    last = np.minimum(first + rng.integers(0, 77, 200), 76)
    got = C.range_summaries(r, first, last)
    for k, (a, b) in enumerate(zip(first, last, strict=True)):
        log = np.cumsum(np.log(np.maximum(1 + r[a : b + 1], 1e-12)))
        fall = max([0.0, *(log[i] - log[j] for i in range(len(log)) for j in range(i + 1, len(log)))])
        assert np.allclose(got[:, k], [r[a : b + 1].sum(), (r[a : b + 1] ** 2).sum(), log[-1], log.max(), log.min(), fall])


@pytest.mark.parametrize("block", [8, 64, 1024])
def test_held_stats_equal_unrolled_bars(spark, block):
    ship(spark)
    rng = np.random.default_rng(block)
    bars, trades, want = [], [], {}
    for symbol in "AB":
        n = 300
        r = np.concatenate([[0.0], rng.normal(0, 0.02, n - 1)])
        bars += [(symbol, i, float(x)) for i, x in enumerate(r)]
        for sample in range(6):
            cuts = np.sort(rng.choice(n, 2 * (sample * 4), replace=False))
            own = [(int(a), int(b)) for a, b in zip(cuts[::2], cuts[1::2], strict=True)]
            own = own + [(299, 299)] if sample == 5 and (not own or own[-1][1] < 299) else own
            own = [(0, 299)] if sample == 0 else own
            trades += [(symbol, sample, a, b) for a, b in own]
            want[symbol, sample] = unrolled(r, own)
    returns = spark.createDataFrame(bars, "symbol string, bar_idx long, r double")
    rows = spark.createDataFrame(trades, "symbol string, sample_id int, entry_idx long, exit_idx long")
    got = {(x.symbol, x.sample_id): (x.sum_r, x.sum_rr, x.log_growth, x.drawdown) for x in C.held_stats(returns, rows, ("symbol",), ("symbol", "sample_id"), block).collect()}
    assert got.keys() == {k for k, v in want.items() if v} and all(np.allclose(got[k], want[k]) for k in got)
    pieces = C.trade_pieces(returns, rows.select("symbol", "entry_idx", "exit_idx").distinct(), ("symbol",), block)
    assert pieces.count() == sum(b // block - (a + 1) // block + 1 for s, a, b in {(s, a, b) for s, _, a, b in trades} if b > a)


def scored(spark, rows):
    return spark.createDataFrame(pd.DataFrame(rows, columns=["policy_id", "symbol", "window_id", "sample_id", "total_return_pct", "passed", "reason", "score", "stage_id"]))


def test_records_of_experiments(spark):
    rows = [("a", "S", w, s, 5.0 - s, True, "PASS", 10.0 + s, 1) for w in "wxyz" for s in range(2)]
    rows += [("b", "S", w, s, -1.5, s == 0, "PASS" if s == 0 else "FAIL_PF", 1.0 - s, 1) for w in "wxyz" for s in range(2)]
    rows += [("c", "S", w, s, -3.0, False, "FAIL_MDD_BREACH", 0.0, 1) for w in "wxyz" for s in range(2)]
    got = {r.policy_id: r for r in E.experiment(scored(spark, rows)).collect()}
    assert (got["a"].approved, got["a"].reason_codes, got["a"].pbo) == (True, "", 0.0)
    assert got["b"].approved and got["b"].cpcv_worst == -1.5 and got["b"].pass_rate == 0.5  # between -2 and 0 is no reason
    assert got["c"].reason_codes == "FAIL_MDD_BREACH,CPCV_WORST_TOO_LOW" and not got["c"].approved
    swaps = [(p, "S", w, 0, 9.0 if (p == "a") == (w in "wx") else 1.0, True, "PASS", 1.0, 1) for p in "ab" for w in "wxyz"]
    assert {r.reason_codes for r in E.experiment(scored(spark, swaps)).collect()} <= {"", "PBO_TOO_HIGH"}
    lone = E.experiment(scored(spark, [r for r in rows if r[2] == "w"])).collect()
    assert {r.pbo for r in lone} == {None}
    qa = E.stage_qa(scored(spark, rows)).first()
    assert (qa.stage_id, qa.n, round(qa.pass_rate, 3), qa.status) == (1, 3, 0.667, "SOFT")
