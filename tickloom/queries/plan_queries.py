"""Composed evaluations and models (no SQL equivalent: the parts are checked one by one)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions import settings as S
from tickloom.functions.num import rnd
from tickloom.operators import backtest as BT
from tickloom.operators import calibration as CAL
from tickloom.operators import labels as L
from tickloom.operators import models as ML
from tickloom.operators import rules as R
from tickloom.operators import selection as SEL
from tickloom.operators import windows as W
from tickloom.operators.context import regime_series
from tickloom.operators.features import compute_genome
from tickloom.plans import evaluate as E
from tickloom.queries import demo as D
from tickloom.queries.base import bars_d, query
from tickloom.queries.feature_queries import rsi_layers
from tickloom.queries.report_queries import EVENTS_SQL, voled
from tickloom.queries.sqlkit import BARS_D, Rec, chain, r6
from tickloom.queries.trading_queries import CROSS, sma_cross
from tickloom.session import materialize


SAMPLES = S.EVAL_CAPS[1][1]  # risk samples of the first stage


def scored(spark, sf, plan=None, policies=None, samples=SAMPLES):
    bars = materialize(bars_d(spark, sf))
    plan = W.build(bars, "full", 1) if plan is None else plan(bars)
    return E.evaluate_samples(bars, policies or D.POLICIES, D.GENOME, plan, "BULL_RUN", 1, samples)


@query("pipe.policy_windows")
def policy_windows(spark, sf):
    return E.best_samples(scored(spark, sf)).withColumns({"score": rnd("score", 3), "total_return_pct": rnd("total_return_pct", 3)})


@query("pipe.stage")
def stage(spark, sf):
    return E.stage_scores(scored(spark, sf)).withColumn("score", rnd("score", 4))


@query("pipe.stage_qa")
def stage_qa(spark, sf):
    return E.stage_qa(scored(spark, sf)).withColumn("pass_rate", rnd("pass_rate"))


@query("pipe.experiment")
def experiment(spark, sf):
    s = scored(spark, sf, lambda b: W.contiguous(W.lengths(b), 4, "ALL"))
    return E.experiment(s).withColumns({c: rnd(c, 3) for c in ("cpcv_mean", "cpcv_worst", "cpcv_std", "pass_rate", "pbo")})


@query("pipe.scenarios")
def scenarios(spark, sf):
    to_plan = lambda b: W.scenarios(b, 400).select("symbol", F.col("scenario").alias("window_id"), F.col("start_idx").alias("w_start"), (F.col("end_idx") + 1).alias("w_end"))
    bars = materialize(bars_d(spark, sf))
    plan = materialize(to_plan(bars))
    res = E.window_results(E.evaluate_samples(bars, D.POLICIES, D.GENOME, plan, "SIDEWAYS", 1, SAMPLES))
    label = regime_series(bars).select("symbol", "bar_idx", "regime_label").join(plan.select("symbol", "window_id", (F.col("w_end") - 1).alias("bar_idx")), ["symbol", "bar_idx"]).drop("bar_idx")
    return res.join(label, ["symbol", "window_id"]).select("policy_id", "symbol", "window_id", "regime_label", rnd("score", 3).alias("score"), rnd("avg_alpha", 3).alias("avg_alpha"))


_sql = lambda v: "NULL" if v is None else repr(v)
_over = ", ".join("(" + ", ".join(_sql(v) for v in r) + ")" for r in CAL.OVERLAYS)
_cals, _call = chain(BARS_D, *CROSS, *rsi_layers(14), tag="c")
_in = "(r.pos = 0 AND r.pin = 1)"
_p0 = f"(CASE WHEN {_in} THEN 1 ELSE r.pos END)"
_e0 = f"(CASE WHEN {_in} THEN x.open + x.slip ELSE r.ep END)"
_sigx = f"({_p0} = 1 AND r.pout = 1)"
_held = f"(CASE WHEN {_in} THEN 0 ELSE r.held END + 1)"
_live = f"({_p0} = 1 AND NOT {_sigx})"
_up, _dn = f"coalesce(x.high >= {_e0} * (1 + x.tp), false)", f"coalesce(x.low <= {_e0} * (1 - x.sl), false)"
_sl = f"({_live} AND {_dn} AND (x.priority = 'stop_first' OR NOT {_up}))"
_tp = f"({_live} AND {_up} AND NOT {_sl})"
_tm = f"({_live} AND NOT {_sl} AND NOT {_tp} AND coalesce({_held} >= x.hold, false))"
_rest = f"({_live} AND NOT {_sl} AND NOT {_tp} AND NOT {_tm})"
_cx = f"({_rest} AND x.exit AND x.on_close)"
_open = f"({_rest} AND NOT {_cx})"
_new = f"({_p0} = 0 AND x.entry AND x.on_close)"
CAL_REC = Rec({
    "pos": ("CASE WHEN entry AND on_close THEN 1 ELSE 0 END", f"CASE WHEN {_open} OR {_new} THEN 1 ELSE 0 END"), "en": ("0", f"CASE WHEN {_in} OR {_new} THEN x.bar_idx ELSE r.en END"),
    "ep": ("close + slip", f"CASE WHEN {_new} THEN x.close + x.slip ELSE {_e0} END"), "held": ("0", f"CASE WHEN {_new} THEN 0 ELSE {_held} END"),
    "pin": ("CASE WHEN entry AND NOT on_close THEN 1 ELSE 0 END", f"CASE WHEN {_p0} = 0 AND x.entry AND NOT x.on_close AND x.bar_idx < x.last THEN 1 ELSE 0 END"),
    "pout": ("0", f"CASE WHEN {_open} AND x.exit AND NOT x.on_close AND x.bar_idx < x.last THEN 1 ELSE 0 END"),
    "code": ("0", f"CASE WHEN {_sigx} OR {_cx} THEN 1 WHEN {_sl} THEN 2 WHEN {_tp} THEN 3 WHEN {_tm} THEN 4 ELSE 0 END"),
    "px": ("0", f"CASE WHEN {_sigx} THEN x.open WHEN {_sl} THEN {_e0} * (1 - x.sl) WHEN {_tp} THEN {_e0} * (1 + x.tp) ELSE x.close END")})
CAL_RUN, CAL_LAST = chain(f"""{_cals}, ov(scenario, overlay, timing, priority, comm, ticks, tp, sl, hold) AS (VALUES {_over}),
calb AS MATERIALIZED (SELECT scenario || '|' || overlay || '|' || symbol AS symbol, bar_idx, open, high, low, close, max(bar_idx) OVER (PARTITION BY symbol) AS last, scenario, timing = 'close' AS on_close, priority, comm / 100 AS comm,
  ticks * {CAL.TICK} AS slip, tp, sl, hold, CASE scenario WHEN 'timing' THEN entry WHEN 'cost' THEN coalesce(rsi < 30, false) ELSE true END AS entry,
  CASE scenario WHEN 'timing' THEN exit WHEN 'cost' THEN coalesce(rsi > 70, false) ELSE false END AS exit FROM {_call} CROSS JOIN ov)""", CAL_REC, source="calb", tag="k")
CAL_SQL = f"""{CAL_RUN}, kx AS (SELECT symbol, scenario, on_close, priority, comm, slip, en, bar_idx AS xi, ep, px - slip AS xp, CASE code WHEN 1 THEN 'signal' WHEN 2 THEN 'sl' WHEN 3 THEN 'tp' ELSE 'time' END AS reason FROM {CAL_LAST} WHERE code > 0
  UNION ALL SELECT symbol, scenario, on_close, priority, comm, slip, en, bar_idx, ep, close - slip, 'eod' FROM {CAL_LAST} WHERE pos = 1 AND bar_idx = last),
kn AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY en, xi) - 1 AS k, 1 + ((xp - ep) - (ep + xp) * comm) / ep AS m FROM kx),
ke AS (SELECT *, product(m) OVER (PARTITION BY symbol ORDER BY k) AS eq FROM kn), kq AS MATERIALIZED (SELECT *, eq / m / ep AS qty FROM ke),
kc AS (SELECT q.*, CASE WHEN q.scenario = 'timing' AND NOT coalesce(CASE WHEN q.on_close THEN a.entry ELSE b.entry END, false) THEN 'ENTRY_BAR_MISMATCH'
    WHEN q.scenario = 'timing' AND abs(q.ep - CASE WHEN q.on_close THEN a.close ELSE a.open END) > {CAL.TOLERANCE} * a.close THEN 'ENTRY_PRICE_MISMATCH'
    WHEN q.scenario = 'collision' AND k = 0 AND reason <> CASE q.priority WHEN 'target_first' THEN 'tp' ELSE 'sl' END THEN 'EXIT_REASON_MISMATCH' END AS bad
  FROM kq q LEFT JOIN calb a ON a.symbol = q.symbol AND a.bar_idx = q.en LEFT JOIN calb b ON b.symbol = q.symbol AND b.bar_idx = q.en - 1),
ks AS (SELECT symbol, count(*) AS n, arg_max(eq, k) AS eq, sum(qty * (ep + xp) * comm) AS fees, sum(qty * 2 * slip) AS slips, min(k) FILTER (bad IS NOT NULL) AS trade_no, arg_min(bad, k) FILTER (bad IS NOT NULL) AS bad FROM kc GROUP BY 1)
SELECT scenario, split_part(g.symbol, '|', 2) AS overlay, split_part(g.symbol, '|', 3) AS symbol, coalesce(n, 0)::BIGINT AS trade_count, {r6('ln(coalesce(eq, 1))')} AS log_equity, {r6('ln(1 + coalesce(fees, 0))')} AS fees_slog,
  {r6('ln(1 + coalesce(slips, 0))')} AS slippage_slog, CASE WHEN n IS NULL AND scenario <> 'cost' THEN 'TRADE_COUNT_MISMATCH' ELSE coalesce(bad, 'MATCH') END AS mismatch, trade_no::BIGINT AS trade_no
FROM (SELECT DISTINCT symbol, scenario FROM calb) g LEFT JOIN ks ON ks.symbol = g.symbol"""


@query("pipe.calibration", CAL_SQL)
def calibration(spark, sf):
    """Five execution scenarios on all symbols: crossings without costs, reversions with costs, an entry on every bar with target and stop."""
    bars = materialize(bars_d(spark, sf))
    ohlc = ["symbol", "bar_idx", "open", "high", "low", "close"]
    rsi = R.evaluate_rules(compute_genome(bars, {"MOMENTUM_RSI_V1": {}}), {"entry": "MOMENTUM_RSI_V1 < 30", "exit": "MOMENTUM_RSI_V1 > 70"}).select("symbol", "bar_idx", "entry", "exit")
    parts = {"timing": sma_cross(bars), "cost": bars.join(rsi, ["symbol", "bar_idx"]), "collision": bars.withColumns({"entry": F.lit(True), "exit": F.lit(False)})}
    signals = reduce(DataFrame.unionByName, [df.select(F.lit(k).alias("policy_id"), *ohlc, "entry", "exit") for k, df in parts.items()])
    out = CAL.calibrate(signals, CAL.overlays(spark))
    return out.select("scenario", "overlay", "symbol", F.col("trade_count").cast("bigint").alias("trade_count"), rnd(F.log("final_equity")).alias("log_equity"), rnd(F.log1p("total_fees")).alias("fees_slog"),
                      rnd(F.log1p("total_slippage")).alias("slippage_slog"), "mismatch", F.col("trade_no").cast("bigint").alias("trade_no"))


@query("sel.two_stage")
def two_stage(spark, sf):
    """Quick scores promote elites and explorers, only they are evaluated; the others are marked filtered_out."""
    fast = BT.fast_scores(D.raw_signals(spark, sf), ["policy_id", "symbol"]).groupBy("policy_id").agg(F.avg("score").alias("score"))
    fast = materialize(fast)
    genes = spark.createDataFrame([(p["policy_id"], g) for p in D.POLICIES for g in p["genome"]], "policy_id string, feature string")
    promoted = materialize(SEL.elites_and_explorers(fast, genes, 1, 1))
    keep = {r.policy_id for r in promoted.select("policy_id").collect()}  # the promoted few are driver-side rule text
    full = E.stage_scores(scored(spark, sf, None, [p for p in D.POLICIES if p["policy_id"] in keep])).groupBy("policy_id").agg(F.max("score").alias("full_score"))
    j = fast.join(full, "policy_id", "left")
    return j.select("policy_id", rnd("score", 4).alias("fast_score"), rnd(F.coalesce("full_score", F.lit(-100.0)), 4).alias("full_score"), F.when(F.col("full_score").isNull(), "filtered_out").otherwise("evaluated").alias("status"))


FEATURES = ["MOMENTUM_RSI_V1__rsi", "TREND_SMA_V1__sma", "VOLATILITY_STD_V1__std", "TREND_MACROSS_V1__spread"]


def dataset(spark, sf):
    """Features with barrier labels (-1, 0, 1) and the folds of cross-validation over time."""
    bars = materialize(bars_d(spark, sf))
    lab = L.barrier_events(voled(spark, sf)).select("symbol", "bar_idx", "label")
    rows = compute_genome(bars, D.GENOME).join(lab, ["symbol", "bar_idx"]).select("symbol", "bar_idx", "label", *FEATURES)
    return materialize(ML.folded(rows, bars))


FOLDS_SQL = f"""{EVENTS_SQL}, sz AS (SELECT symbol, max(bar_idx) + 1 AS n FROM bars GROUP BY 1),
x AS (SELECT symbol, bar_idx, label, n // 3 AS size, floor(n * 0.01) AS gap, least(bar_idx // (n // 3), 2) AS own FROM lab JOIN sz USING (symbol)),
lf AS (SELECT x.*, f::INT AS fold FROM x, range(3) AS r(f) WHERE own <> f AND NOT (f < 2 AND bar_idx >= (f + 1) * size AND bar_idx < (f + 1) * size + gap))"""


@query("ml.dataset", f"""{FOLDS_SQL}, c AS (SELECT fold, label = 1 AS positive, count(*) AS n FROM lf GROUP BY ALL)
SELECT fold, positive, n::BIGINT AS n, {r6('sum(n) OVER (PARTITION BY fold) / (2 * n)')} AS weight FROM c""")
def class_weights(spark, sf):
    return ML.class_weights(dataset(spark, sf)).withColumn("weight", rnd("weight"))


@query("ml.direction")
def direction(spark, sf):
    df = dataset(spark, sf)
    out = ML.predict_direction(ML.train_direction(df, FEATURES), df)
    return out.select("symbol", "bar_idx", "fold", "label", *[rnd(c, 4).alias(c) for c in ("p_down", "p_flat", "p_up")], "direction")


@query("ml.tactical")
def tactical(spark, sf):
    return ML.out_of_fold_forest(dataset(spark, sf), FEATURES).select("symbol", "bar_idx", "fold", "label", rnd("p", 4).alias("p"))


@query("ml.guard")
def guard(spark, sf):
    df = dataset(spark, sf)
    sig, scale = L.guard_scale(F.col("p"))
    return ML.predict_guard(ML.train_guard(df, FEATURES), df).select("symbol", "bar_idx", "fold", "label", rnd("p", 4).alias("p"), sig.alias("signal"), rnd(scale, 4).alias("scale"))


@query("ml.importance")
def importance(spark, sf):
    imp = ML.importance(spark, ML.train_guard(dataset(spark, sf), FEATURES))
    by = imp.groupBy("category").agg(F.sum("importance").alias("importance"))
    return imp.select(F.lit("feature").alias("kind"), F.col("feature").alias("name"), rnd("importance", 4).alias("importance")).unionByName(by.select(F.lit("category").alias("kind"), F.col("category").alias("name"), rnd("importance", 4).alias("importance")))
