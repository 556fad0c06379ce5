"""Windows, samples, gates, scores and selection over result tables derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import settings as S
from tickloom.functions.num import exact_mean, rnd
from tickloom.operators import gates as G
from tickloom.operators import metrics as M
from tickloom.operators import selection as SEL
from tickloom.operators import windows as W
from tickloom.queries.base import bars_d, query, register, table
from tickloom.queries.sqlkit import BARS_D, pct, r6, win
from tickloom.queries.trading_queries import STAGE_SQL, big
from tickloom.session import materialize

# One metrics row per policy (supplier) and window (return flag), aggregated from line items.
MCOLS = ["win_rate", "profit_factor", "reward_risk", "top1_share", "trades_per_year", "entry_signal_rate", "invalid_action_rate", "total_return_pct", "max_drawdown_pct", "vol_pct", "sharpe",
         "exposure_ratio", "excess_return", "complexity_score"]
KEYS = ["policy_id", "window_id"]


def metrics_table(spark, sf):
    """Returns are 2,000 times a mean of cents, and often meet a threshold exactly: an exact sum divided once leaves that to no order of rows."""
    l = table(spark, sf, "lineitem").withColumn("r", F.col("l_discount") - F.col("l_tax"))
    a = l.groupBy(F.concat(F.lit("P"), F.col("l_suppkey").cast("string")).alias("policy_id"), F.col("l_returnflag").alias("window_id"), "l_suppkey").agg(
        F.count(F.lit(1)).alias("n"), exact_mean("r", 2000).alias("m2000"), exact_mean("r").alias("m"), F.stddev_samp("r").alias("sd"), F.sum(F.when(F.col("r") > 0, F.col("r")).otherwise(0.0)).alias("gp"),
        F.sum(F.when(F.col("r") < 0, -F.col("r")).otherwise(0.0)).alias("gl"), F.avg((F.col("r") > 0.02).cast("double")).alias("wr"), F.avg("l_quantity").alias("q"))
    k = F.col("l_suppkey")
    out = a.withColumns({
        "stage_id": (k % 4 + 1).cast("int"), "trade_count": (F.col("n") % 160).cast("bigint"), "bars_total": (F.lit(200) + k * 13 % 900).cast("bigint"), "win_rate": F.least(F.lit(1.0), F.col("wr") * (0.6 + (k % 9) / 10.0)),
        "profit_factor": F.col("gp") / (F.col("gl") + 0.001), "reward_risk": (k % 23) / 10.0, "top1_share": (k % 17) / 20.0, "entry_signal_rate": (k % 11) / 2000.0, "invalid_action_rate": F.when(k % 6 == 0, 0.1).otherwise(0.0),
        "total_return_pct": F.col("m2000") - (k % 37), "max_drawdown_pct": (k % 31) * 2.0, "vol_pct": F.col("sd") * 500, "sharpe": F.col("m") / F.col("sd"), "exposure_ratio": (k % 13) / 100.0,
        "excess_return": F.col("m2000") - (k % 53), "complexity_score": (k % 12) / 2.0})
    return out.withColumns({"cycle_count": F.greatest(F.lit(0), F.col("trade_count") - 3), "entry_count": F.col("trade_count"), "exit_count": F.col("trade_count"),
                            "trades_per_year": F.col("trade_count") / (F.col("bars_total") / 252.0)}).drop("n", "m", "m2000", "sd", "gp", "gl", "wr", "q", "l_suppkey")


METRICS_SQL = f"""{STAGE_SQL}, mraw AS (SELECT l_suppkey AS k, l_returnflag AS window_id, count(*) AS n, avg(l_discount - l_tax) AS m, stddev_samp(l_discount - l_tax) AS sd, sum(greatest(l_discount - l_tax, 0)) AS gp,
  sum(greatest(l_tax - l_discount, 0)) AS gl, avg((l_discount - l_tax > 0.02)::INT) AS wr FROM lineitem GROUP BY ALL),
mets0 AS (SELECT 'P' || k AS policy_id, window_id, (k % 4 + 1)::INT AS stage_id, n % 160 AS trade_count, 200 + k * 13 % 900 AS bars_total, least(1.0, wr * (0.6 + (k % 9) / 10.0)) AS win_rate, gp / (gl + 0.001) AS profit_factor,
  (k % 23) / 10.0 AS reward_risk, (k % 17) / 20.0 AS top1_share, (k % 11) / 2000.0 AS entry_signal_rate, CASE WHEN k % 6 = 0 THEN 0.1 ELSE 0.0 END AS invalid_action_rate, m * 2000 - (k % 37) AS total_return_pct,
  (k % 31) * 2.0 AS max_drawdown_pct, sd * 500 AS vol_pct, m / sd AS sharpe, (k % 13) / 100.0 AS exposure_ratio, m * 2000 - (k % 53) AS excess_return, (k % 12) / 2.0 AS complexity_score FROM mraw),
mets AS MATERIALIZED (SELECT *, greatest(0, trade_count - 3) AS cycle_count, trade_count AS entry_count, trade_count AS exit_count, trade_count / (bars_total / 252.0) AS trades_per_year FROM mets0 JOIN stage_spec USING (stage_id))"""
_e, _f = "(entry_count / (bars_total / 252.0))", "((entry_count + exit_count) / (bars_total / 252.0))"
_deg = "greatest(greatest(0, (5 - trade_count) / 5.0), greatest(0, (0.002 - entry_signal_rate) / 0.002), greatest(0, (0.01 - exposure_ratio) / 0.01))"
FAILS = [  # code, condition, relative distance, hard, absolute distance
    ("FAIL_NO_CYCLE", "cycle_count <= 0", "1.0", "true", "greatest(0, 1 - cycle_count)"), ("FAIL_INVALID_ACTION", "invalid_action_rate > 0", "invalid_action_rate", "true", "greatest(0, invalid_action_rate)"),
    ("FAIL_MIN_TRADES", f"{_e} < min_entries_per_year", f"(min_entries_per_year - {_e}) / min_entries_per_year", "true", f"greatest(0, min_entries_per_year - {_e})"),
    ("FAIL_MAX_TRADES", f"{_e} > max_entries_per_year", f"({_e} - max_entries_per_year) / max_entries_per_year", "true", f"greatest(0, {_e} - max_entries_per_year)"),
    ("FAIL_MIN_FLIPS", f"{_f} < min_flips_per_year", f"(min_flips_per_year - {_f}) / min_flips_per_year", "stage_id >= 3", f"greatest(0, min_flips_per_year - {_f})"),
    ("FAIL_MAX_FLIPS", f"{_f} > max_flips_per_year", f"({_f} - max_flips_per_year) / max_flips_per_year", "true", f"greatest(0, {_f} - max_flips_per_year)"),
    ("FAIL_LOW_EXPOSURE", "exposure_ratio < 0.02", "(0.02 - exposure_ratio) / 0.02", "true", "greatest(0, 0.02 - exposure_ratio)"),
    ("FAIL_LOW_RETURN", "excess_return < alpha_floor", "(alpha_floor - excess_return) / greatest(1, abs(alpha_floor))", "true", "greatest(0, alpha_floor - excess_return)"),
    ("FAIL_WINRATE_LOW", "win_rate < 0.3", "(0.3 - win_rate) / 0.3", "true", "greatest(0, 0.3 - win_rate)"), ("FAIL_WINRATE_HIGH", "win_rate > 0.85", "(win_rate - 0.85) / 0.85", "true", "greatest(0, win_rate - 0.85)"),
    ("FAIL_MDD_BREACH", "max_drawdown_pct > max_mdd_pct", "(max_drawdown_pct - max_mdd_pct) / max_mdd_pct", "true", "greatest(0, max_drawdown_pct - max_mdd_pct)"),
    ("FAIL_PF", "profit_factor < min_profit_factor", "(min_profit_factor - profit_factor) / min_profit_factor", "true", "greatest(0, min_profit_factor - profit_factor)"),
    ("FAIL_LUCKY_STRIKE", "top1_share > 0.6", "(top1_share - 0.6) / 0.6", "true", "greatest(0, top1_share - 0.6)"), ("FAIL_SIGNAL_DEGENERATE", f"{_deg} > 0", _deg, "signal_degeneracy_mode = 'hard'", f"greatest(0, {_deg})")]
FAIL_SQL = METRICS_SQL + ", fails AS MATERIALIZED (" + " UNION ALL ".join(
    f"SELECT policy_id, window_id, stage_id, {i} AS ord, '{code}' AS code, ({d})::DOUBLE AS distance, ({h})::BOOLEAN AS is_hard FROM mets WHERE {cond}" for i, (code, cond, d, h, _) in enumerate(FAILS)) + ")"
DIST_SQL = METRICS_SQL + ", dist AS MATERIALIZED (SELECT *, [" + ", ".join(f"({a})::DOUBLE" for *_, a in FAILS) + "] AS d FROM mets), gd AS MATERIALIZED (SELECT *, " + \
    "-(" + " + ".join((f"CASE WHEN stage_id < 3 THEN 0 ELSE d[{i + 1}] END" if code == "FAIL_MIN_FLIPS" else f"{1.5 if code == 'FAIL_SIGNAL_DEGENERATE' else 1.0} * d[{i + 1}]") for i, (code, *_r) in enumerate(FAILS)) + ") AS soft, " + \
    "CASE WHEN list_max(d) <= 0 THEN 'PASS' ELSE [" + ", ".join(f"'{x[0]}'" for x in FAILS) + "][list_position(d, list_max(d))] END AS nearest FROM dist)"


def staged(spark, sf):
    return G.with_stage(metrics_table(spark, sf), S.stage_spec(spark))


register("gate.failures", lambda spark, sf: G.failures(staged(spark, sf), KEYS).select(*KEYS, "code", rnd("distance").alias("distance"), "is_hard"),
         f"WITH {FAIL_SQL} SELECT policy_id, window_id, code, {r6('distance')} AS distance, is_hard FROM fails")
register("gate.distances", lambda spark, sf: G.distances(staged(spark, sf)).select(*KEYS, rnd("soft_gate_score").alias("soft_gate_score"), "nearest_gate", rnd(F.array_max("distances")).alias("max_distance")),
         f"WITH {DIST_SQL} SELECT policy_id, window_id, {r6('soft')} AS soft_gate_score, nearest AS nearest_gate, {r6('list_max(d)')} AS max_distance FROM gd")
register("gate.validate", lambda spark, sf: G.validate(staged(spark, sf), KEYS).select(*KEYS, "passed", "reason"),
         f"WITH {FAIL_SQL}, h AS (SELECT policy_id, window_id, arg_min(code, ord) AS code FROM fails WHERE is_hard GROUP BY ALL) SELECT policy_id, window_id, code IS NULL AS passed, coalesce(code, 'PASS') AS reason FROM mets LEFT JOIN h USING (policy_id, window_id)")
register("gate.violation", lambda spark, sf: staged(spark, sf).select(*KEYS, G.violation().alias("violation")),
         f"WITH {METRICS_SQL} SELECT policy_id, window_id, (invalid_action_rate > 0 OR cycle_count <= 0 OR trade_count < 15 OR max_drawdown_pct > 50)::BOOLEAN AS violation FROM mets")
register("gate.stage_pass", lambda spark, sf: staged(spark, sf).select(*KEYS, (F.size(G.stage_reasons()) == 0).alias("passed"), F.concat_ws("|", G.stage_reasons()).alias("reasons")),
         f"""WITH {METRICS_SQL}, x AS (SELECT policy_id, window_id, list_filter([CASE WHEN trades_per_year < min_trades_per_year THEN 'LOW_TRADES' END, CASE WHEN abs(max_drawdown_pct) > max_mdd_pct THEN 'MDD' END,
  CASE WHEN excess_return < alpha_floor THEN 'ALPHA_BELOW_FLOOR' END, CASE WHEN total_return_pct < target_return_pct THEN 'TARGET_RETURN' END, CASE WHEN profit_factor < min_profit_factor THEN 'LOW_PF' END], lambda v: v IS NOT NULL) AS r FROM mets)
  SELECT policy_id, window_id, len(r) = 0 AS passed, array_to_string(r, '|') AS reasons FROM x""")
register("gate.api_status", lambda spark, sf: staged(spark, sf).select(*KEYS, F.when(G.api_status() == "", "Approved").otherwise("Rejected").alias("status"), G.api_status().alias("reason")),
         f"""WITH {METRICS_SQL}, x AS (SELECT policy_id, window_id, CASE WHEN trade_count < 15 THEN 'MIN_TRADES' WHEN max_drawdown_pct > 50 THEN 'MAX_MDD' WHEN win_rate > 0.85 THEN 'WINRATE_HIGH' WHEN trade_count >= 30 AND win_rate < 0.3 THEN 'WINRATE_LOW'
  WHEN trade_count >= 20 AND reward_risk < 0.5 THEN 'RR_LOW' ELSE '' END AS reason FROM mets) SELECT policy_id, window_id, CASE WHEN reason = '' THEN 'Approved' ELSE 'Rejected' END AS status, reason FROM x""")


def fold_stats(spark, sf):
    m = metrics_table(spark, sf)
    return m.groupBy("policy_id").agg(F.avg("total_return_pct").alias("mean"), F.coalesce(F.stddev_samp("total_return_pct"), F.lit(0.0)).alias("sd"), F.min("total_return_pct").alias("worst"), F.avg("win_rate").alias("wr"),
                                      F.sum("trade_count").alias("n"), F.max("stage_id").alias("stage_id"))


FOLD_SQL = "folds AS (SELECT policy_id, avg(total_return_pct) AS mean, coalesce(stddev_samp(total_return_pct), 0) AS sd, min(total_return_pct) AS worst, avg(win_rate) AS wr, sum(trade_count) AS n FROM mets GROUP BY 1)"
STAB_SQL = "stab AS (SELECT *, sd / (abs(mean) + 1e-9::DOUBLE) AS ratio, n >= 30 AND wr >= 0.5 AND mean > 0 AND worst >= 0 AND sd / (abs(mean) + 1e-9::DOUBLE) <= 3 AS ok FROM folds)"


def stable(spark, sf):
    f = fold_stats(spark, sf)
    ok, ratio = G.stability(F.col("mean"), F.col("sd"), F.col("worst"), F.col("wr"), F.col("n"))
    return f.withColumns({"ok": ok, "ratio": ratio})


register("gate.stability", lambda spark, sf: stable(spark, sf).select("policy_id", "ok", rnd("ratio").alias("ratio")), f"WITH {METRICS_SQL}, {FOLD_SQL}, {STAB_SQL} SELECT policy_id, ok::BOOLEAN AS ok, {r6('ratio')} AS ratio FROM stab")
RR = "CASE WHEN reward_risk >= 2 THEN 50 WHEN reward_risk >= 1.5 THEN 25 + (reward_risk - 1.5) / 0.5 * 25 WHEN reward_risk >= 1 THEN (reward_risk - 1) / 0.5 * 25 ELSE -25 * (1 - reward_risk) END"
SCORE = (f"greatest(-100, total_return_pct * 200 + ({RR}) - max_drawdown_pct * 30 - vol_pct * 5 - (CASE WHEN trade_count < 100 THEN (100 - trade_count) * 0.2 ELSE 0 END) - (CASE WHEN win_rate > 0.8 THEN (win_rate - 0.8) * 50000 ELSE 0 END))")
SAMPLES_SQL = f"smp AS MATERIALIZED (SELECT *, {SCORE} AS score, (invalid_action_rate > 0 OR cycle_count <= 0 OR trade_count < 15 OR max_drawdown_pct > 50) AS viol FROM mets)"


def samples(spark, sf):
    return staged(spark, sf).withColumns({"score": G.sample_score(), "violation": G.violation()})


register("score.sample", lambda spark, sf: samples(spark, sf).select(*KEYS, rnd("score").alias("score")), f"WITH {METRICS_SQL}, {SAMPLES_SQL} SELECT policy_id, window_id, {r6('score')} AS score FROM smp")
AGG_SQL = """agg AS MATERIALIZED (SELECT stage_id, window_id, k10, median(score) AS med, quantile_cont(score, 0.2) AS q, coalesce(stddev_samp(score), 0) AS sd, avg(viol::INT) AS v, avg(excess_return) AS alpha
  FROM (SELECT *, substr(policy_id, 1, 2) AS k10 FROM smp) GROUP BY ALL), aggs AS MATERIALIZED (SELECT *, med + 0.8 * q - 5 * sd - 100 * v AS score FROM agg)"""


def window_scores(spark, sf):
    s = samples(spark, sf).withColumn("module", F.substring("policy_id", 1, 2))
    keys = ["module", "window_id", "stage_id"]
    agg = G.aggregate_scores(s, keys)
    return agg.join(s.groupBy(*keys).agg(F.avg("excess_return").alias("avg_alpha")), keys)


register("score.aggregate", lambda spark, sf: window_scores(spark, sf).select("module", "window_id", big("stage_id"), *[rnd(c).alias(c) for c in ("median_score", "p10_score", "std_score", "violation_rate", "score")]),
         f"WITH {METRICS_SQL}, {SAMPLES_SQL}, {AGG_SQL} SELECT k10 AS module, window_id, stage_id::BIGINT AS stage_id, {r6('med')} AS median_score, {r6('q')} AS p10_score, {r6('sd')} AS std_score, {r6('v')} AS violation_rate, {r6('score')} AS score FROM aggs")
NORM_SQL = """nrm AS MATERIALIZED (SELECT *, CASE WHEN coalesce(stddev_samp(score) OVER w, 0) <= 1e-12 THEN 0 ELSE (score - avg(score) OVER w) / stddev_samp(score) OVER w END AS z FROM aggs WINDOW w AS (PARTITION BY window_id))"""
normalized = lambda spark, sf: G.normalize(window_scores(spark, sf).withColumnRenamed("score", "raw_score"), ["window_id"])
register("score.normalize", lambda spark, sf: normalized(spark, sf).select("module", "window_id", big("stage_id"), rnd("normalized_score").alias("z")),
         f"WITH {METRICS_SQL}, {SAMPLES_SQL}, {AGG_SQL}, {NORM_SQL} SELECT k10 AS module, window_id, stage_id::BIGINT AS stage_id, {r6('z')} AS z FROM nrm")
register("score.finalize", lambda spark, sf: G.finalize(normalized(spark, sf), ["module"], S.stage_spec(spark)).select("module", rnd("score").alias("score")),
         f"""WITH {METRICS_SQL}, {SAMPLES_SQL}, {AGG_SQL}, {NORM_SQL}, f AS (SELECT k10, stage_id, median(z) AS m, quantile_cont(z, 0.2) AS q, coalesce(stddev_samp(z), 0) AS s, avg(v) AS v, min(alpha) AS worst FROM nrm GROUP BY ALL)
  SELECT k10 AS module, {r6("CASE WHEN worst < alpha_floor AND wf_gate_mode = 'hard' THEN -100 ELSE greatest(-100, m + 0.8 * q - 5 * s - 100 * v - CASE WHEN worst < alpha_floor THEN abs(worst - alpha_floor) * 10 ELSE 0 END) END")} AS score FROM f JOIN stage_spec USING (stage_id)""")
_pen = lambda i: "CASE code " + " ".join(f"WHEN '{k}' THEN {v[i]}" for k, v in G.PENALTY.items()) + " ELSE 0.0 END"
REWARD_SQL = f"""{FAIL_SQL}, fp AS (SELECT *, {_pen(0)} AS p, {_pen(1)} AS w FROM fails), fa AS (SELECT policy_id, window_id, count(*) FILTER (is_hard) AS nh, coalesce(sum(distance) FILTER (is_hard), 0) AS hd, sum(distance) AS ds,
  sum(p * (1 + 0.75 * distance) + w * pow(distance, 1.1)) AS rs, coalesce(sum(p + w * distance) FILTER (NOT is_hard), 0) AS ss, arg_min(code, ord) FILTER (is_hard) AS why FROM fp GROUP BY ALL),
rw AS (SELECT *, coalesce(nh, 0) > 0 AS rej, tanh(excess_return / 100) * 3 AS c1, CASE WHEN reward_risk >= 2 THEN 1 WHEN reward_risk >= 1.5 THEN 0.5 + (reward_risk - 1.5) WHEN reward_risk >= 1 THEN reward_risk - 1 ELSE -least(1, greatest(-1, (1 - reward_risk) * 2)) END AS c2,
  CASE WHEN top1_share <= 0.2 THEN 1 WHEN top1_share <= 0.4 THEN 0.5 ELSE 0 END AS c3, CASE WHEN trade_count >= 200 THEN 1 WHEN stage_id = 1 THEN sqrt(trade_count / 200.0) ELSE trade_count / 200.0 END AS c4,
  CASE WHEN max_drawdown_pct > 25 THEN -least(1, (max_drawdown_pct - 25) / 25) ELSE 0 END AS c5, CASE WHEN win_rate > 0.8 THEN -least(1, (win_rate - 0.8) / 0.2) ELSE 0 END AS c6, CASE WHEN complexity_score > 0 THEN -least(0.4, complexity_score * 0.03) ELSE 0 END AS c7,
  CASE WHEN top1_share > 0.6 THEN -least(1, (top1_share - 0.6) * 5) ELSE 0 END AS c8, CASE WHEN trade_count > 0 THEN tanh(total_return_pct / (trade_count * 0.1) / 3) ELSE 0 END AS c9 FROM mets LEFT JOIN fa USING (policy_id, window_id)),
rwd AS (SELECT *, CASE WHEN rej THEN greatest(-200, reject_base_penalty + coalesce(rs, 0)) ELSE (CASE stage_id WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END) * c1 + c2 + c3 + 1.5 * c4 + 0.5 * c5 + c6 + c7 + c8 + 0.1 + 0.3 * c9 + 0.5 * coalesce(ss, 0) END AS total FROM rw)"""
register("score.reward", lambda spark, sf: G.reward(staged(spark, sf), KEYS).select(*KEYS, *[rnd(c).alias(c) for c in ("total", "return_component", "rr_component", "trades_component", "distance_score")], "is_rejected", "rejection_reason", "replay_tag"),
         f"WITH {REWARD_SQL} SELECT policy_id, window_id, {r6('total')} AS total, {r6('CASE WHEN rej THEN -1 ELSE c1 END')} AS return_component, {r6('CASE WHEN rej THEN -1 ELSE c2 END')} AS rr_component, {r6('CASE WHEN rej THEN -1 ELSE c4 END')} AS trades_component, "
         f"{r6('coalesce(ds, 0)')} AS distance_score, rej AS is_rejected, why AS rejection_reason, CASE WHEN NOT rej THEN 'PASS' WHEN nh <= 2 AND hd <= 0.35 THEN 'NEAR_PASS' ELSE 'HARD_FAIL' END AS replay_tag FROM rwd")
register("score.reward_cpcv", lambda spark, sf: G.reward(staged(spark, sf), KEYS).join(staged(spark, sf).select(*KEYS, "top1_share"), KEYS).select(*KEYS, rnd(F.col("total") - F.greatest(F.lit(0.0), F.col("top1_share") - 0.3) * 0.5).alias("reward")),
         f"WITH {REWARD_SQL} SELECT policy_id, window_id, {r6('total - greatest(0, top1_share - 0.3) * 0.5')} AS reward FROM rwd")


def opportunity(spark, sf):
    m = metrics_table(spark, sf)
    a = m.groupBy("policy_id").agg(F.avg("total_return_pct").alias("total_return_pct"), F.sum("trade_count").alias("trade_count"), F.avg("trades_per_year").alias("trades_per_year"),
                                   F.avg((F.col("excess_return") > 0).cast("double")).alias("consistency"), F.max("stage_id").alias("stage_id"), (F.avg("exposure_ratio") * 20).alias("vol_level"))
    return G.opportunity_score(a.withColumn("cost_bps", F.lit(5.0)))


AOS_SQL = """oa AS (SELECT policy_id, avg(total_return_pct) AS tr, sum(trade_count) AS n, avg(trades_per_year) AS tpy, avg((excess_return > 0)::INT) AS cons, max(stage_id) AS stage_id, avg(exposure_ratio) * 20 AS vol FROM mets GROUP BY 1),
aos AS MATERIALIZED (SELECT *, CASE WHEN n <= 0 THEN 0 ELSE least(1, greatest(0, 0.4 * tanh(greatest(0, tr / (n * 0.05 + 0.1)) / 5) + 0.3 * tanh(tpy / 100) + 0.3 * cons)) END AS aos,
  CASE WHEN tr < n * 0.05 * 1.5 THEN 'LOW_NET_PnL' WHEN tpy < 15 THEN 'LOW_FREQUENCY' ELSE 'VIABLE' END AS viability FROM oa)"""
register("score.aos", lambda spark, sf: opportunity(spark, sf).select("policy_id", rnd("aos").alias("aos"), "viability"), f"WITH {METRICS_SQL}, {AOS_SQL} SELECT policy_id, {r6('aos')} AS aos, viability FROM aos")
register("score.budget", lambda spark, sf: G.reallocate(opportunity(spark, sf).withColumn("session_id", F.col("stage_id") - 1), ["stage_id"]).select("policy_id", rnd("weight", 9).alias("weight")),
         f"""WITH {METRICS_SQL}, {AOS_SQL}, e AS (SELECT *, exp((aos - max(aos) OVER (PARTITION BY stage_id)) / 0.1) * (CASE stage_id - 1 WHEN 1 THEN 1.2 WHEN 2 THEN 1.2 WHEN 0 THEN 0.8 ELSE 0.5 END) * (CASE WHEN vol < 0.7 THEN 1.5 WHEN vol > 2 THEN 0.5 ELSE 1 END) AS e FROM aos)
  SELECT policy_id, {r6('e / sum(e) OVER (PARTITION BY stage_id)', 9)} AS weight FROM e""")
robust = lambda spark, sf: G.robustness(window_scores(spark, sf).join(F.broadcast(S.stage_spec(spark).select("stage_id", "alpha_floor")), "stage_id"), ["module"], F.col("alpha_floor"))
ROB_SQL = "rob AS (SELECT k10 AS module, avg((alpha >= alpha_floor)::INT) - avg(v) AS robustness FROM aggs JOIN stage_spec USING (stage_id) GROUP BY 1)"
register("score.robustness", lambda spark, sf: robust(spark, sf).select("module", rnd("robustness").alias("robustness")), f"WITH {METRICS_SQL}, {SAMPLES_SQL}, {AGG_SQL}, {ROB_SQL} SELECT module, {r6('robustness')} AS robustness FROM rob")


def selection_scores(spark, sf):
    st = materialize(staged(spark, sf).drop("sharpe"))  # not read here, and a division by zero where all returns are equal
    reward = G.reward(st, KEYS).select(*KEYS, "total", "is_rejected")
    return G.selection_score(G.distances(st).join(reward, KEYS), ["policy_id"])


SELS_SQL = f"""{REWARD_SQL.replace(METRICS_SQL, DIST_SQL, 1)}, selw AS (SELECT *, row_number() OVER (PARTITION BY policy_id ORDER BY -(CASE WHEN rej THEN soft ELSE {SCORE} END), window_id) AS place FROM rwd JOIN (SELECT policy_id, window_id, soft FROM gd) USING (policy_id, window_id)),
selp AS (SELECT policy_id, max(total) FILTER (place = 1) AS performance, max(soft) FILTER (place = 1) AS progress, avg((excess_return >= alpha_floor)::INT) - avg(rej::INT) AS robustness FROM selw GROUP BY 1),
sels AS MATERIALIZED (SELECT *, performance + progress + robustness AS score FROM selp)"""
SELS = ("performance", "progress", "robustness", "score")
register("score.selection", lambda spark, sf: selection_scores(spark, sf).select("policy_id", *[rnd(c).alias(c) for c in SELS]), f"WITH {SELS_SQL} SELECT policy_id, {', '.join(f'{r6(c)} AS {c}' for c in SELS)} FROM sels")

# -- selection ---------------------------------------------------------------------------------


def scored(spark, sf):
    return fold_stats(spark, sf).select("policy_id", F.col("mean").alias("score"))


def genes(spark, sf):
    """Genome of a policy: the size classes of parts of which its supplier ships more than suppliers do on average."""
    p = table(spark, sf, "part").select("p_partkey", (F.col("p_size") % 9).alias("f"))
    l = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", "l_quantity")
    q = l.join(p, l.l_partkey == p.p_partkey).groupBy("l_suppkey", "f").agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("q"))
    mean = q.groupBy("f").agg(F.sum("q").alias("s"), F.count(F.lit(1)).alias("n"))
    more = q.join(mean, "f").filter(F.col("q") * F.col("n") > F.col("s"))
    return more.select(F.concat(F.lit("P"), F.col("l_suppkey").cast("string")).alias("policy_id"), F.concat(F.lit("G"), (F.col("f") % 3).cast("string"), F.lit("_F"), F.col("f").cast("string")).alias("feature"))


GENES_SQL = """gq AS (SELECT l_suppkey, p_size % 9 AS f, sum(l_quantity::DECIMAL(18,2)) AS q FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL), gm AS (SELECT f, sum(q) AS s, count(*) AS n FROM gq GROUP BY 1),
genes AS MATERIALIZED (SELECT 'P' || l_suppkey AS policy_id, 'G' || (f % 3) || '_F' || f AS feature FROM gq JOIN gm USING (f) WHERE q * n > s)"""
JAC_SQL = """gsz AS (SELECT policy_id, count(*) AS n FROM genes GROUP BY 1), jac AS MATERIALIZED (SELECT s.p1, s.p2, shared / (a.n + b.n - shared) AS j FROM (SELECT x.policy_id AS p1, y.policy_id AS p2, count(*) AS shared FROM genes x JOIN genes y USING (feature)
  WHERE x.policy_id <> y.policy_id GROUP BY ALL) s JOIN gsz a ON a.policy_id = p1 JOIN gsz b ON b.policy_id = p2)"""
register("sel.genome_jaccard", lambda spark, sf: SEL.batch_similarity(genes(spark, sf)).select(rnd("avg_jaccard").alias("avg_jaccard"), rnd("collision_rate").alias("collision_rate")),
         f"WITH {GENES_SQL}, {JAC_SQL}, t AS (SELECT count(*) * (count(*) - 1) / 2 AS c FROM gsz) SELECT {r6('coalesce(sum(j), 0) / max(c)')} AS avg_jaccard, {r6('count(*) FILTER (j > 0.8) / max(c)')} AS collision_rate FROM jac, t WHERE p1 < p2")
params = lambda spark, sf: genes(spark, sf).withColumns({"param": F.lit("window"), "value": (10 + F.substring("policy_id", 2, 9).cast("int") % 7).cast("double")})
PAR_SQL = "par AS (SELECT *, 10 + substr(policy_id, 2)::INT % 7 AS v FROM genes)"
PSIM_SQL = "psim AS MATERIALIZED (SELECT a.policy_id AS p1, b.policy_id AS p2, greatest(0, 1 - avg(abs(a.v - b.v) / greatest(abs(a.v), abs(b.v), 1e-6))) AS ps FROM par a JOIN par b ON a.feature = b.feature AND a.policy_id <> b.policy_id GROUP BY ALL)"
register("sel.param_similarity", lambda spark, sf: SEL.similar_params(genes(spark, sf), params(spark, sf), 0.6).select("p1", "p2", rnd("param_similarity").alias("param_similarity")),
         f"WITH {GENES_SQL}, {JAC_SQL}, {PAR_SQL}, {PSIM_SQL} SELECT p1, p2, {r6('ps')} AS param_similarity FROM psim JOIN jac USING (p1, p2) WHERE p1 < p2 AND j > 0.6")
SCORED_SQL = f"{METRICS_SQL}, {FOLD_SQL}, scored AS MATERIALIZED (SELECT policy_id, mean AS score FROM folds)"
register("sel.top_modules", lambda spark, sf: G.top_share(scored(spark, sf), 0.3).select("policy_id", big("rank")),
         f"WITH {SCORED_SQL} SELECT policy_id, rk::BIGINT AS rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, policy_id) AS rk, count(*) OVER () AS n FROM scored) WHERE rk <= greatest(1, round_even(n * 0.3, 0))")
register("sel.rank_key", lambda spark, sf: stable(spark, sf).orderBy(F.col("ok").desc(), F.col("mean").desc(), F.col("wr").desc(), F.col("n").desc(), F.col("ratio"), "policy_id").limit(25).select("policy_id", "ok", rnd("mean").alias("mean")),
         f"WITH {METRICS_SQL}, {FOLD_SQL}, {STAB_SQL} SELECT policy_id, ok::BOOLEAN AS ok, {r6('mean')} AS mean FROM stab ORDER BY ok DESC, mean DESC, wr DESC, n DESC, ratio, policy_id LIMIT 25")
register("sel.elite_explorer", lambda spark, sf: SEL.elites_and_explorers(scored(spark, sf), genes(spark, sf), 5, 5).select("policy_id", "role", rnd("max_sim").alias("max_sim")),
         f"""WITH {SCORED_SQL}, {GENES_SQL}, {JAC_SQL}, el AS (SELECT * FROM scored ORDER BY score DESC, policy_id LIMIT 5), rest AS (SELECT * FROM scored WHERE policy_id NOT IN (SELECT policy_id FROM el)),
  r AS (SELECT policy_id, score, coalesce((SELECT max(j) FROM jac WHERE p1 = rest.policy_id AND p2 IN (SELECT policy_id FROM el)), 0) AS ms FROM rest), ex AS (SELECT * FROM r ORDER BY ms, score DESC, policy_id LIMIT 5)
  SELECT policy_id, 'elite' AS role, {r6('0')} AS max_sim FROM el UNION ALL SELECT policy_id, 'explorer', {r6('ms')} FROM ex""")
register("sel.diverse_top_k", lambda spark, sf: SEL.diverse_top_k(scored(spark, sf), genes(spark, sf), params(spark, sf), 6).select(big("rank"), "policy_id"),
         f"""WITH RECURSIVE {SCORED_SQL}, {GENES_SQL}, {JAC_SQL}, {PAR_SQL}, {PSIM_SQL}, prs AS MATERIALIZED (SELECT a.policy_id AS p1, b.policy_id AS p2, coalesce(j, 0) AS j, coalesce(j > 0.7 AND ps > 0.9, false) AS near FROM scored a CROSS JOIN scored b
    LEFT JOIN jac ON jac.p1 = a.policy_id AND jac.p2 = b.policy_id LEFT JOIN psim ON psim.p1 = a.policy_id AND psim.p2 = b.policy_id WHERE a.policy_id <> b.policy_id),
  pick AS (SELECT 1 AS rank, (SELECT policy_id FROM scored ORDER BY score DESC, policy_id LIMIT 1) AS policy_id, [(SELECT policy_id FROM scored ORDER BY score DESC, policy_id LIMIT 1)] AS chosen
    UNION ALL SELECT rank + 1, nxt, list_append(chosen, nxt) FROM (SELECT p.rank, p.chosen, (SELECT s.policy_id FROM scored s JOIN prs ON prs.p1 = s.policy_id AND list_contains(p.chosen, prs.p2) WHERE NOT list_contains(p.chosen, s.policy_id)
      GROUP BY s.policy_id, s.score HAVING NOT bool_or(near) ORDER BY s.score + 0.5 * (1 - max(j)) DESC, s.policy_id LIMIT 1) AS nxt FROM pick p WHERE p.rank < 6) WHERE nxt IS NOT NULL)
  SELECT rank::BIGINT AS rank, policy_id FROM pick""")
register("sel.soft_gate_seed", lambda spark, sf: G.distances(staged(spark, sf)).groupBy("policy_id").agg(F.max("soft_gate_score").alias("soft")).orderBy(F.col("soft").desc(), "policy_id").limit(5).select("policy_id", rnd("soft").alias("soft")),
         f"WITH {DIST_SQL} SELECT policy_id, {r6('max(soft)')} AS soft FROM gd GROUP BY 1 ORDER BY max(soft) DESC, policy_id LIMIT 5")
RELATIONS = [("G0_F0", "G1_F1", "complement"), ("G0_F3", "G1_F4", "conflict"), ("G0_F6", "G2_F8", "complement"), ("G1_F7", "G2_F5", "conflict"), ("G1_F1", "G2_F2", "complement")]
REL_SQL = "rel AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{k}')" for a, b, k in RELATIONS) + ") t(f1, f2, kind))"
COMB_SQL = """pr AS (SELECT a.policy_id, a.feature AS f1, b.feature AS f2 FROM genes a JOIN genes b ON a.policy_id = b.policy_id AND a.feature < b.feature), gsz2 AS (SELECT policy_id, count(*) AS n FROM genes GROUP BY 1),
cs AS (SELECT policy_id, sum(CASE kind WHEN 'complement' THEN 0.8 WHEN 'conflict' THEN -1.5 ELSE 0 END - CASE WHEN split_part(pr.f1, '_', 1) = split_part(pr.f2, '_', 1) THEN 0.3 ELSE 0 END) AS s FROM pr LEFT JOIN rel ON rel.f1 = pr.f1 AND rel.f2 = pr.f2 GROUP BY 1),
comb AS MATERIALIZED (SELECT policy_id, n, greatest(-1, least(1, coalesce(s, 0) / n)) AS score FROM gsz2 LEFT JOIN cs USING (policy_id))"""
combos = lambda spark, sf: SEL.combination_scores(genes(spark, sf), spark.createDataFrame(RELATIONS, "f1 string, f2 string, kind string"))
register("feat.combination_score", lambda spark, sf: combos(spark, sf).select("policy_id", rnd("score").alias("score"), "status"),
         f"WITH {GENES_SQL}, {REL_SQL}, {COMB_SQL} SELECT policy_id, {r6('score')} AS score, CASE WHEN n < 2 THEN 'NEUTRAL' WHEN score < -0.2 THEN 'CONFLICTED' WHEN score > 0.4 THEN 'SYNERGETIC' ELSE 'HEALTHY' END AS status FROM comb")
ordered = lambda spark, sf: scored(spark, sf).select("policy_id", F.substring("policy_id", 2, 9).cast("int").alias("ord"))
register("sel.filter_diverse", lambda spark, sf: SEL.filter_diverse(ordered(spark, sf), genes(spark, sf), combos(spark, sf), 0.8, -0.3).select("policy_id"),
         f"""WITH RECURSIVE {SCORED_SQL}, {GENES_SQL}, {JAC_SQL}, {REL_SQL}, {COMB_SQL}, cand AS MATERIALIZED (SELECT policy_id, row_number() OVER (ORDER BY substr(policy_id, 2)::INT) AS o FROM scored WHERE policy_id NOT IN (SELECT policy_id FROM comb WHERE score < -0.3)),
  step AS (SELECT 0 AS o, []::VARCHAR[] AS kept UNION ALL SELECT c.o, CASE WHEN EXISTS (SELECT 1 FROM jac WHERE p1 = c.policy_id AND j > 0.8 AND list_contains(s.kept, p2)) THEN s.kept ELSE list_append(s.kept, c.policy_id) END FROM step s JOIN cand c ON c.o = s.o + 1)
  SELECT unnest(kept) AS policy_id FROM (SELECT kept FROM step ORDER BY o DESC LIMIT 1)""")

# -- windows and samples -----------------------------------------------------------------------

WOUT = "symbol, window_id, w_start::BIGINT AS w_start, w_end::BIGINT AS w_end"
LEN = f"{BARS_D}, n AS (SELECT symbol, max(bar_idx) + 1 AS n FROM bars GROUP BY 1)"


def contiguous_sql(count: int, prefix: str, n: str = "n", off: str = "0") -> str:
    return (f"SELECT symbol, '{prefix}_' || i AS window_id, {off} + i * greatest(120, {n} // {count}) AS w_start, {off} + CASE WHEN i = {count - 1} THEN {n} ELSE least({n}, (i + 1) * greatest(120, {n} // {count})) END AS w_end FROM n, range({count}) t(i)")


register("win.contiguous", lambda spark, sf: W.contiguous(W.lengths(bars_d(spark, sf)), 6, "FULL"), f"WITH {LEN}, w AS ({contiguous_sql(6, 'FULL')}) SELECT {WOUT} FROM w WHERE w_end - w_start >= 120")
register("win.split_time", lambda spark, sf: W.split_time(W.lengths(bars_d(spark, sf)), 4, 800),
         f"WITH {LEN}, k AS (SELECT *, greatest(1, least(4, n // 800)) AS k FROM n), w AS (SELECT symbol, 'W_' || i AS window_id, i * (n // k) AS w_start, CASE WHEN i = k - 1 THEN n ELSE (i + 1) * (n // k) END AS w_end FROM k, range(4) t(i) WHERE i < k) SELECT {WOUT} FROM w")
register("win.reduced", lambda spark, sf: W.reduced(W.lengths(bars_d(spark, sf))),
         f"WITH {LEN}, w AS (SELECT symbol, 'REDUCED_' || i AS window_id, least(greatest(0, n - 500), i * greatest(1, greatest(0, n - 500) // 2)) AS w_start, n FROM n, range(3) t(i)) SELECT symbol, window_id, w_start::BIGINT AS w_start, (w_start + least(500, n))::BIGINT AS w_end FROM w")
register("win.build", lambda spark, sf: W.build(bars_d(spark, sf), "fast", 1).unionByName(W.build(bars_d(spark, sf), "reduced", 1)).unionByName(W.build(bars_d(spark, sf), "full", 4)),
         f"WITH {LEN}, w AS ({contiguous_sql(2, 'FAST', 'least(600, n)', 'greatest(0, n - 600)')} UNION ALL SELECT symbol, 'REDUCED_' || i, least(n - 500, i * ((n - 500) // 2)), least(n - 500, i * ((n - 500) // 2)) + 500 FROM n, range(3) t(i) UNION ALL {contiguous_sql(5, 'FULL')}) "
         f"SELECT {WOUT} FROM w WHERE w_end - w_start >= 120")
register("win.scenarios", lambda spark, sf: W.scenarios(bars_d(spark, sf), 400).select("symbol", "scenario", big("start_idx"), big("end_idx"), rnd("score").alias("score")),
         f"""WITH {BARS_D}, r AS (SELECT *, coalesce({pct('close')}, 0) AS ret, abs({pct('close', 400)}) AS ar FROM bars), m AS (SELECT *, {win('stddev_samp', 'ret', 400)} AS vol FROM r), k AS (SELECT * FROM m WHERE ar IS NOT NULL AND vol IS NOT NULL),
  b AS (SELECT symbol, 'trend' AS scenario, arg_max(bar_idx, ar) AS e FROM k GROUP BY 1 UNION ALL SELECT symbol, 'range', arg_max(bar_idx, -(ar + vol)) FROM k GROUP BY 1 UNION ALL SELECT symbol, 'volatile', arg_max(bar_idx, vol) FROM k GROUP BY 1)
  SELECT b.symbol, scenario, greatest(0, e - 399)::BIGINT AS start_idx, e::BIGINT AS end_idx, {r6('k.ar')} AS score FROM b JOIN k ON k.symbol = b.symbol AND k.bar_idx = b.e""")


def distributions(spark, sf):
    k = F.col("s_suppkey")
    base = table(spark, sf, "supplier").select(F.concat(F.lit("P"), k.cast("string")).alias("policy_id"), F.when(k % 3 != 0, (k % 20 + 5) / 500.0).alias("base_tp"), F.when(k % 4 != 0, (k % 10 + 5) / 500.0).alias("base_sl"),
                                               F.when(k % 5 != 0, k % 40 + 2).alias("base_h"), F.element_at(F.array(F.lit("PANIC"), F.lit("BULL_RUN"), F.lit("SIDEWAYS")), (k % 3 + 1).cast("int")).alias("regime"))
    return W.risk_distributions(base, F.col("regime"))


DIS = ["tp_low", "tp_high", "sl_low", "sl_high", "h_low", "h_high"]
DIST2_SQL = """rb AS (SELECT 'P' || k AS policy_id, CASE WHEN k % 3 <> 0 THEN (k % 20 + 5) / 500.0 END AS bt, CASE WHEN k % 4 <> 0 THEN (k % 10 + 5) / 500.0 END AS bs, CASE WHEN k % 5 <> 0 THEN k % 40 + 2 END AS bh, ['PANIC', 'BULL_RUN', 'SIDEWAYS'][k % 3 + 1] AS rg FROM (SELECT s_suppkey AS k FROM supplier)),
rd AS MATERIALIZED (SELECT policy_id, coalesce(bt * 0.5, 0.0075)::DOUBLE AS tp_low, coalesce(bt * 1.5, 0.06)::DOUBLE * CASE WHEN rg = 'BULL_RUN' THEN 1.2 ELSE 1 END AS tp_high, coalesce(bs * 0.5, 0.0045)::DOUBLE AS sl_low, coalesce(bs * 1.5, 0.0375)::DOUBLE * CASE WHEN rg = 'PANIC' THEN 0.7 ELSE 1 END AS sl_high,
  greatest(3, coalesce(floor(bh * 0.5), 3))::DOUBLE AS h_low, CASE WHEN rg = 'PANIC' THEN least(10, least(30, coalesce(floor(bh * 1.5), 30))) ELSE least(30, coalesce(floor(bh * 1.5), 30)) END::DOUBLE AS h_high FROM rb)"""
register("smp.distributions", lambda spark, sf: distributions(spark, sf).select("policy_id", *[rnd(c).alias(c) for c in DIS]), f"WITH {DIST2_SQL} SELECT policy_id, {', '.join(f'{r6(c)} AS {c}' for c in DIS)} FROM rd")
U = lambda *parts: "(concat('0x', substr(md5(" + " || '|' || ".join(parts) + "), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
register("smp.risk_samples", lambda spark, sf: W.risk_samples(distributions(spark, sf), ["policy_id"], 30).select("policy_id", "sample_id", rnd("tp_pct").alias("tp_pct"), rnd("sl_pct").alias("sl_pct"), big("max_hold")),
         f"WITH {DIST2_SQL} SELECT policy_id, 's' || i AS sample_id, " + ", ".join(f"{r6(f'{a}_low + {U('policy_id', 'i::VARCHAR', q)} * ({a}_high - {a}_low)')} AS {a}_pct" for a, q in (("tp", "'tp'"), ("sl", "'sl'")))
         + f", floor(h_low + {U('policy_id', 'i::VARCHAR', chr(39) + 'h' + chr(39))} * (h_high - h_low))::BIGINT AS max_hold FROM rd, range(30) t(i)")


@query("smp.budget_jitter", f"""WITH jb AS (SELECT k AS id, CASE WHEN k % 7 <> 0 THEN (k % 9) / 2.0 ELSE 2.25 END AS ku, CASE WHEN k % 6 <> 0 THEN (k % 7) / 3.0 ELSE 1.4 END::DOUBLE AS kd, CASE WHEN k % 8 <> 0 THEN k % 20 + 4 ELSE 16 END AS h FROM (SELECT s_suppkey AS k FROM supplier)),
  c AS (SELECT *, greatest(3, floor(h * 0.95)::INT) AS lo FROM jb, range(4) t(i)), c2 AS (SELECT *, greatest(lo + 1, least(30, floor(h * 1.05)::INT) + 1) AS hi FROM c),
  x AS (SELECT id, i, CASE WHEN i = 0 THEN ku ELSE greatest(0.5, least(4.0, ku * (1 + 0.05 * (2 * {U('id::VARCHAR', 'i::VARCHAR', "'up'")} - 1)))) END AS u, CASE WHEN i = 0 THEN kd ELSE greatest(0.3, least(2.5, kd * (1 + 0.05 * (2 * {U('id::VARCHAR', 'i::VARCHAR', "'dn'")} - 1)))) END AS d,
    CASE WHEN i = 0 THEN h ELSE lo + floor({U('id::VARCHAR', 'i::VARCHAR', "'h'")} * (hi - lo))::INT END AS hz FROM c2)
  SELECT id, i::BIGINT AS copy_no, {r6('u')} AS k_up, {r6('d')} AS k_down, hz::BIGINT AS horizon, {r6('greatest(0.005, least(0.05, d * 0.015))')} AS stop_loss, {r6('greatest(0.5, least(1.5, 0.5 + 1 / (d + 0.5)))')} AS leverage, {r6('CASE WHEN d > 0 THEN u / d ELSE 1 END')} AS ratio FROM x""")
def budget_jitter(spark, sf):
    k = F.col("s_suppkey")
    base = table(spark, sf, "supplier").select(k.alias("id"), F.when(k % 7 != 0, (k % 9) / 2.0).alias("k_up"), F.when(k % 6 != 0, (k % 7) / 3.0).alias("k_down"), F.when(k % 8 != 0, k % 20 + 4).alias("horizon"))
    j = W.budget_jitter(base, ["id"], 4)
    return j.select("id", big("copy_no"), *[rnd(f"r_{c}").alias(c) for c in ("k_up", "k_down")], F.col("r_horizon").cast("bigint").alias("horizon"), *[rnd(f"r_{c}").alias(c) for c in ("stop_loss", "leverage", "ratio")])


@query("smp.profiles", f"""WITH p AS (SELECT * FROM (VALUES ('SHORT_TERM', 0.5, 1.725, 0.3, 1.07, 3, 11), ('BALANCED', 1.375, 2.95, 0.85, 1.84, 8, 19), ('LONG_TERM', 2.6, 4.0, 1.62, 2.5, 16, 30)) t(profile_id, a, b, c, d, e, f)),
  x AS (SELECT p.*, c_custkey AS id, c_mktsegment AS seg FROM customer, p) SELECT id AS customer, seg AS segment, profile_id, {r6('a')} AS k_up_min, {r6('b')} AS k_up_max, {r6('c')} AS k_down_min, {r6('d')} AS k_down_max, e::BIGINT AS h_min, f::BIGINT AS h_max,
    {r6(f"a + {U('id::VARCHAR', 'profile_id', repr('k_up'))} * (b - a)")} AS k_up, {r6(f"c + {U('id::VARCHAR', 'profile_id', repr('k_down'))} * (d - c)")} AS k_down, (e + floor({U('id::VARCHAR', 'profile_id', repr('h'))} * (f - e + 1)))::BIGINT AS horizon FROM x""")
def profiles(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("customer"), F.col("c_mktsegment").alias("segment"))
    out = W.profile_budgets(rows, ["customer"])
    return out.select("customer", "segment", "profile_id", *[rnd(c).alias(c) for c in ("k_up_min", "k_up_max", "k_down_min", "k_down_max")], "h_min", "h_max", rnd("k_up").alias("k_up"), rnd("k_down").alias("k_down"), "horizon")


# -- window aggregates -------------------------------------------------------------------------

rejected = lambda spark, sf: G.validate(staged(spark, sf), KEYS).withColumn("is_rejected", ~F.col("passed"))
REJ_SQL = f"{FAIL_SQL}, rj AS (SELECT m.*, EXISTS (SELECT 1 FROM fails f WHERE f.policy_id = m.policy_id AND f.window_id = m.window_id AND is_hard) AS rej FROM mets m)"
AW = {"mean_return": "avg(total_return_pct)", "median_return": "median(total_return_pct)", "mean_sharpe": "avg(sharpe)", "mean_mdd": "avg(max_drawdown_pct)", "violation_rate": "avg(rej::INT)", "score_p10": "quantile_cont(total_return_pct, 0.1)",
      "score_std": "coalesce(stddev_samp(total_return_pct), 0)", "mean_complexity": "avg(complexity_score)"}
register("met.aggregate_windows", lambda spark, sf: M.aggregate_windows(rejected(spark, sf), ["policy_id"]).select("policy_id", *[rnd(c).alias(c) for c in AW]), f"WITH {REJ_SQL} SELECT policy_id, {', '.join(f'{r6(e)} AS {c}' for c, e in AW.items())} FROM rj GROUP BY 1")
FM = {"total_return_pct": "avg(total_return_pct)", "mdd_pct": "avg(max_drawdown_pct)", **{m: f"avg({m})" for m in M.FLAT_MEANS}, "entry_signal_rate": "sum(trade_count) / greatest(1, sum(bars_total))"}
register("met.flat", lambda spark, sf: M.flat_metrics(staged(spark, sf), ["policy_id"]).select("policy_id", *[rnd(c).alias(c) for c in FM], "n_trades", "oos_bars", "cycle_count"),
         f"WITH {METRICS_SQL} SELECT policy_id, {', '.join(f'{r6(e)} AS {c}' for c, e in FM.items())}, sum(trade_count)::BIGINT AS n_trades, sum(bars_total)::BIGINT AS oos_bars, sum(cycle_count)::BIGINT AS cycle_count FROM mets GROUP BY 1")


def eval_rows(spark, sf):
    m = metrics_table(spark, sf)
    return m.select("policy_id", "total_return_pct", (-F.col("max_drawdown_pct")).alias("mdd_pct"), F.col("vol_pct").alias("volatility_pct"), "reward_risk", (F.col("exposure_ratio") * 20).alias("stop_loss_pct"), "win_rate",
                    F.least(F.col("trade_count") / 100.0, F.lit(1.0)).alias("trade_score"))


EV = ["risk_scale", "return_median", "return_pctl", "return_std", "mdd_median", "vol_median", "rr_median", "trade_score_median", "win_rate_median", "eval_score"]
register("met.eval_summary", lambda spark, sf: M.eval_summary(eval_rows(spark, sf), ["policy_id"]).select("policy_id", *[rnd(c).alias(c) for c in EV]),
         f"""WITH {METRICS_SQL}, x AS (SELECT *, greatest(0.25, median(exposure_ratio * 20) OVER (PARTITION BY policy_id)) AS sc, least(trade_count / 100.0, 1.0) AS ts FROM mets), a AS (SELECT policy_id, max(sc) AS risk_scale, median(total_return_pct) AS return_median, quantile_cont(total_return_pct, 0.2) AS return_pctl,
    coalesce(stddev_samp(total_return_pct), 0) AS return_std, median(-max_drawdown_pct) AS mdd_median, median(vol_pct) AS vol_median, median(reward_risk) AS rr_median, median(ts) AS trade_score_median, median(win_rate) AS win_rate_median,
    median(total_return_pct / sc) AS a1, quantile_cont(total_return_pct / sc, 0.2) AS a2, median(abs(max_drawdown_pct) / sc) AS a3, median(vol_pct / sc) AS a4 FROM x GROUP BY 1), b AS (SELECT *, 100 * a1 + 0.8 * a2 - 30 * a3 - 5 * a4 + 0.1 * rr_median + 2 * trade_score_median + 500 * win_rate_median AS eval_score FROM a)
  SELECT policy_id, {', '.join(f'{r6(c)} AS {c}' for c in EV)} FROM b""")
