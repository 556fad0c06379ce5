"""Evaluation of a batch of policies: policies x symbols x windows x risk samples as one set of tables.

Features are computed once for the union of the genomes; signals once per policy and window; risk samples
only multiply the parameters of the engine.  Everything after the engine is joins and aggregations.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions import settings as S
from tickloom.functions.num import div
from tickloom.operators import gates as G
from tickloom.operators import metrics as M
from tickloom.operators import windows as W
from tickloom.operators.backtest import benchmark_return
from tickloom.operators.context import with_columns_on
from tickloom.operators.curves import held_stats
from tickloom.operators.engines import close_engine, state_gate
from tickloom.operators.features import compute_genome
from tickloom.operators.labels import pbo
from tickloom.operators.reports import qa_report
from tickloom.operators.rules import policy_signals, text_complexity
from tickloom.session import materialize

PSW = ["policy_id", "symbol", "window_id"]
KEYS = [*PSW, "sample_id"]


def policy_table(bars: DataFrame, policies: list[dict]) -> DataFrame:
    rows = [(p["policy_id"], float(p["tp"]), float(p["sl"]), int(p["hold"]), float(p["cost_bps"]), float(sum(text_complexity(t) for t in p["rules"].values()))) for p in policies]
    return bars.sparkSession.createDataFrame(rows, "policy_id string, tp_pct double, sl_pct double, max_hold int, cost_bps double, complexity_score double")


def window_signals(bars: DataFrame, policies: list[dict], genome: dict, plan: DataFrame, stage_id: int) -> DataFrame:
    """Gated signals per policy, symbol and window; ``bar_idx`` counts from the window start."""
    frame = materialize(compute_genome(bars, genome))
    framed = W.assign(frame, plan)
    sig = policy_signals(framed, policies, stage_id, ("symbol", "window_id"), F.col("bar_idx") - F.col("w_start"), keep=("close", "w_start", "w_end"))
    sig = sig.withColumn("bar_idx", F.col("bar_idx") - F.col("w_start"))
    base = policy_table(bars, policies).select("policy_id", "tp_pct", "sl_pct")
    return materialize(state_gate(materialize(sig), base, tuple(PSW)))


def sample_params(bars: DataFrame, policies: list[dict], plan: DataFrame, regime: str, n: int) -> DataFrame:
    """Risk samples per policy and window."""
    pol = policy_table(bars, policies).withColumnsRenamed({"tp_pct": "base_tp", "sl_pct": "base_sl", "max_hold": "base_h"})
    ids = plan.groupBy().agg(F.array_sort(F.collect_set("window_id")).alias("_w"))  # a handful of window names
    per = pol.join(F.broadcast(ids)).withColumn("window_id", F.explode("_w")).drop("_w")
    s = W.risk_samples(W.risk_distributions(per, F.lit(regime)), ["policy_id", "window_id"], n)
    return materialize(s.select("policy_id", "window_id", "sample_id", "tp_pct", "sl_pct", "max_hold", "cost_bps"))


def sample_metrics(signals: DataFrame, closes: DataFrame, trades: DataFrame, params: DataFrame, policies: DataFrame, stage_id: int) -> DataFrame:
    """One metrics row per policy, symbol, window and sample, trades or not; closes: the bars of every window, counted from its start."""
    win = signals.groupBy(*PSW).agg(
        F.count(F.lit(1)).alias("bars_total"), F.avg(F.col("entry").cast("double")).alias("entry_signal_rate"), F.avg(F.col("act").cast("double")).alias("act_rate_bars"),
        F.min_by("close", "bar_idx").alias("_first"), F.max_by("close", "bar_idx").alias("_last"))
    total = win.join(params.select("policy_id", "window_id", "sample_id"), ["policy_id", "window_id"])
    t = trades.withColumn("ret", F.col("return_pct") / 100)
    stats = M.trade_stats(t, total.select(*KEYS, "bars_total"), KEYS).drop("bars_total")
    cyc = M.cycle_stats(M.cycles(t, total.select(*KEYS, "bars_total"), KEYS), total.select(*KEYS, "bars_total"), KEYS).select(*KEYS, "cycle_count", "entry_count", "avg_hold_bars")
    grow = 1 + F.col("ret")
    net = t.groupBy(*KEYS).agg((F.exp(F.sum(F.ln(F.greatest(grow, F.lit(1e-12))))) - 1).alias("net"), F.sum(F.col("exit_idx") - F.col("entry_idx") + F.col("open_at_end").cast("int")).alias("held"))
    # gross returns exist only on held bars; flat bars add nothing but a count
    returns = with_columns_on(closes, lambda s: {"r": F.coalesce(s.pct("close"), F.lit(0.0))}, keys=("symbol", "window_id")).select("symbol", "window_id", "bar_idx", "r")
    risk = held_stats(returns, t, ("symbol", "window_id"), tuple(KEYS)).select(*KEYS, F.col("sum_r").alias("_s"), F.col("sum_rr").alias("_ss"), F.col("drawdown").alias("_mdd"), F.col("log_growth").alias("_end"))
    j = total.join(stats, KEYS).join(cyc, KEYS).join(net, KEYS, "left").join(risk, KEYS, "left").join(F.broadcast(policies.select("policy_id", "complexity_score")), "policy_id")
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    n = F.col("bars_total") - 1
    sd = F.sqrt(F.greatest(z("_ss") / n - (z("_s") / n) * (z("_s") / n), F.lit(0.0)))
    cagr = (F.exp(z("_end") * S.BARS_PER_YEAR / n) - 1) * 100
    j = j.withColumns({"stage_id": F.lit(stage_id), "total_return_pct": z("net") * 100, "exposure_ratio": z("held") / F.col("bars_total"), "max_drawdown_pct": z("_mdd") * 100, "vol_pct": sd * math.sqrt(S.BARS_PER_YEAR) * 100,
                       "cagr": cagr, "invalid_action_rate": F.lit(0.0), "exit_count": F.col("entry_count")})
    j = j.withColumn("benchmark_pct", benchmark_return(F.col("_first"), F.col("_last"), F.col("exposure_ratio"), S.BENCHMARK_MODE, S.BENCHMARK_RETURN))
    return j.withColumns({"sharpe": F.when(F.col("vol_pct") > 1e-9, div("cagr", "vol_pct")).otherwise(0.0), "excess_return": F.col("total_return_pct") - F.col("benchmark_pct")}).drop("_first", "_last", "net", "held", "_s", "_ss", "_mdd", "_end")


def score_samples(metrics: DataFrame) -> DataFrame:
    """Pass flag, reason and sample score: the soft gate score where a hard gate fails."""
    staged = materialize(G.with_stage(metrics, S.stage_spec(metrics.sparkSession)))
    j = G.distances(G.validate(staged, KEYS))
    return j.withColumns({"violation": ~F.col("passed"), "score": F.when(F.col("passed"), G.sample_score()).otherwise(F.col("soft_gate_score"))})


def evaluate_samples(bars: DataFrame, policies: list[dict], genome: dict, plan: DataFrame, regime: str = "SIDEWAYS", stage_id: int = 1, samples: int = 5) -> DataFrame:
    """Scored metrics per policy, symbol, window and risk sample."""
    plan = materialize(plan)
    signals = window_signals(bars, policies, genome, plan, stage_id)
    params = sample_params(bars, policies, plan, regime, samples)
    trades = materialize(close_engine(signals, params, tuple(PSW)))
    closes = W.assign(bars, plan).select("symbol", "window_id", (F.col("bar_idx") - F.col("w_start")).alias("bar_idx"), "close")
    return materialize(score_samples(sample_metrics(signals, closes, trades, params, policy_table(bars, policies), stage_id)))


def window_results(scored: DataFrame) -> DataFrame:
    keys = [*PSW, "stage_id"]
    agg = G.aggregate_scores(scored, keys)
    return agg.join(scored.groupBy(*keys).agg(F.avg("excess_return").alias("avg_alpha")), keys)


def best_samples(scored: DataFrame) -> DataFrame:
    """Best sample per policy and symbol; earlier windows and samples win ties."""
    pick = F.min_by(F.struct("window_id", "sample_id", "score", "reason", "trade_count", "total_return_pct"), F.struct(-F.col("score"), F.col("window_id"), F.col("sample_id")))
    return scored.groupBy("policy_id", "symbol").agg(pick.alias("b")).select("policy_id", "symbol", "b.*")


def stage_scores(scored: DataFrame) -> DataFrame:
    """Module scores of a batch: window scores normalised across policies, then finalised per policy and symbol."""
    norm = G.normalize(window_results(scored).withColumnRenamed("score", "raw_score"), ["window_id"])
    return G.finalize(norm, ["policy_id", "symbol"], S.stage_spec(scored.sparkSession))


def stage_qa(scored: DataFrame) -> DataFrame:
    """QA summary of a batch by stage: pass rate, failures per category and status, from the best sample of every policy and symbol."""
    best = scored.groupBy("stage_id", "policy_id", "symbol").agg(F.min_by(F.struct("passed", "reason"), F.struct(-F.col("score"), F.col("window_id"), F.col("sample_id"))).alias("b"))
    taxonomy = scored.sparkSession.createDataFrame([(code, cat) for cat, codes in S.TAXONOMY.items() for code in codes], "code string, category string")
    return qa_report(best.select("stage_id", F.col("b.passed").alias("gate_pass"), F.col("b.reason").alias("reason")), taxonomy, "stage_id")


#: An experiment whose worst return (per cent) is lower, or whose probability of overfitting is higher, is rejected.
WORST_RETURN, MOST_OVERFIT = -2.0, 0.4


def overfitting(scored: DataFrame) -> DataFrame:
    """pbo: of the mean returns of all policies and symbols by window; windows are the folds, of which there are a handful, and a lone one gives null."""
    windows = [r["window_id"] for r in scored.select("window_id").distinct().orderBy("window_id").collect()]
    if len(windows) < 2:
        return scored.sparkSession.createDataFrame([(None,)], "pbo double")
    fold = F.array_position(F.array(*[F.lit(w) for w in windows]), F.col("window_id")) - 1
    by = scored.groupBy(F.concat_ws("|", "policy_id", "symbol").alias("policy_id"), fold.cast("int").alias("fold")).agg(F.avg("total_return_pct").alias("score"))
    whole = by.groupBy("policy_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(windows)).select("policy_id")
    return pbo(by.join(whole, "policy_id"), len(windows)).select("pbo")


def experiment(scored: DataFrame) -> DataFrame:
    """Record of an experiment: the spread of its samples, and why it is rejected (the hard gate of its best sample, its worst return, overfitting)."""
    best = F.min_by(F.struct("passed", "reason"), F.struct(-F.col("score"), F.col("window_id"), F.col("sample_id")))
    a = scored.groupBy("policy_id", "symbol").agg(F.avg("total_return_pct").alias("cpcv_mean"), F.min("total_return_pct").alias("cpcv_worst"), F.coalesce(F.stddev_samp("total_return_pct"), F.lit(0.0)).alias("cpcv_std"),
                                                  F.avg(F.col("passed").cast("double")).alias("pass_rate"), best.alias("_b"))
    a = a.join(F.broadcast(overfitting(scored)))  # a single row
    why = F.array_compact(F.array(F.when(~F.col("_b.passed"), F.col("_b.reason")), F.when(F.col("cpcv_worst") < WORST_RETURN, "CPCV_WORST_TOO_LOW"), F.when(F.col("pbo") > MOST_OVERFIT, "PBO_TOO_HIGH")))
    return a.withColumns({"approved": F.size(why) == 0, "reason_codes": F.concat_ws(",", why)}).drop("_b")
