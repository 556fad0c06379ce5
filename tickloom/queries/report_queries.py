"""Labels, cross-validation, calibration, risk, and batch / ledger analytics on tables derived from the given ones."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from tickloom.functions import settings as S
from tickloom.functions.num import rnd
from tickloom.operators import labels as L
from tickloom.operators import reports as R
from tickloom.operators.context import with_columns_on
from tickloom.operators.features import REGISTRY
from tickloom.queries.base import bars_d, query, register, table
from tickloom.queries.market_queries import ewm_std, ewm_std_layers
from tickloom.queries.result_queries import AGG_SQL, METRICS_SQL, SAMPLES_SQL, metrics_table, window_scores
from tickloom.queries.sqlkit import BARS_D, Rec, chain, r6
from tickloom.queries.trading_queries import big

# -- labels ------------------------------------------------------------------------------------
voled = lambda spark, sf: with_columns_on(bars_d(spark, sf), lambda s: {"vol": ewm_std(s, "v", s.pct("close"), 100)})
VOL_SQL, VOL = chain(BARS_D, *ewm_std_layers(100))
_touch = f"""vb AS MATERIALIZED (SELECT symbol, bar_idx, ts, close, vol, max(bar_idx) OVER (PARTITION BY symbol) AS last FROM {VOL}), fw AS MATERIALIZED (SELECT *, list(close) OVER (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN CURRENT ROW AND 20 FOLLOWING) AS p,
  list(ts) OVER (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN CURRENT ROW AND 20 FOLLOWING) AS tp FROM vb)"""
EVENTS_SQL = f"""{VOL_SQL}, {_touch}, hit AS (SELECT *, list_position(list_transform(p, lambda x: x >= close * (1 + vol)), true) - 1 AS u, list_position(list_transform(p, lambda x: x <= close * (1 - vol)), true) - 1 AS d FROM fw WHERE vol > 1e-5),
lab AS MATERIALIZED (SELECT *, CASE WHEN d IS NOT NULL AND (u IS NULL OR d <= u) THEN -1 WHEN u IS NOT NULL THEN 1 ELSE 0 END AS label FROM hit)"""
events = lambda spark, sf: L.barrier_events(voled(spark, sf))
register("lbl.barrier_events", lambda spark, sf: events(spark, sf).select("symbol", "bar_idx", big("label"), big("touch_idx"), rnd(2 * F.col("vol")).alias("width")),
         f"{EVENTS_SQL} SELECT symbol, bar_idx::BIGINT AS bar_idx, label::BIGINT AS label, (bar_idx + CASE label WHEN -1 THEN d WHEN 1 THEN u ELSE len(p) - 1 END)::BIGINT AS touch_idx, {r6('2 * vol')} AS width FROM lab")
register("lbl.barrier_bars", lambda spark, sf: L.barrier_bars(voled(spark, sf)).select("symbol", "bar_idx", big("label")),
         f"""{VOL_SQL}, {_touch}, rr AS (SELECT *, list_transform(list_filter(p, lambda x, i: date_diff('day', ts, tp[i]) <= 40), lambda x: x / close - 1) AS r, greatest(vol, 0.005) AS v FROM fw WHERE vol IS NOT NULL),
  h AS (SELECT *, list_position(list_transform(r, lambda x: x >= v), true) AS u, list_position(list_transform(r, lambda x: x <= -v), true) AS d FROM rr) SELECT symbol, bar_idx::BIGINT AS bar_idx,
  (CASE WHEN d IS NOT NULL AND (u IS NULL OR d <= u) THEN -1 WHEN u IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS label FROM h""")
register("lbl.imbalance", lambda spark, sf: L.imbalance(events(spark, sf), ["symbol"]).select("symbol", big("total"), rnd("min_share").alias("min_share"), "imbalanced"),
         f"{EVENTS_SQL}, c AS (SELECT symbol, label, count(*) AS n FROM lab GROUP BY ALL) SELECT symbol, sum(n)::BIGINT AS total, {r6('min(n) / sum(n)')} AS min_share, (min(n) / sum(n) < 0.1)::BOOLEAN AS imbalanced FROM c GROUP BY 1")
COMBOS = ", ".join(f"({i}, [{a}, {b}])" for i, (a, b) in enumerate(combinations(range(6), 2)))
register("cv.cpcv_split", lambda spark, sf: L.cpcv_split(bars_d(spark, sf)).groupBy("symbol", "split_no", "role").agg(F.count(F.lit(1)).alias("n"), F.min("bar_idx").alias("first"), F.max("bar_idx").alias("last")).withColumn("split_no", F.col("split_no").cast("bigint")),
         f"""WITH {BARS_D}, n AS (SELECT symbol, max(bar_idx) + 1 AS n FROM bars GROUP BY 1), c AS (SELECT * FROM (VALUES {COMBOS}) t(split_no, tests)), x AS (SELECT b.symbol, b.bar_idx, split_no, tests, least(b.bar_idx // (n // 6), 5) AS g, n // 6 AS sz, floor(n * 0.01) AS gap FROM bars b JOIN n USING (symbol), c),
  y AS (SELECT *, CASE WHEN list_contains(tests, g::INT) THEN 'test' WHEN len(list_filter(tests, lambda t: t < 5 AND bar_idx >= (t + 1) * sz AND bar_idx < (t + 1) * sz + gap)) > 0 THEN 'embargo' ELSE 'train' END AS role FROM x)
  SELECT symbol, split_no::BIGINT AS split_no, role, count(*)::BIGINT AS n, min(bar_idx)::BIGINT AS first, max(bar_idx)::BIGINT AS last FROM y GROUP BY ALL""")


def folds(spark, sf):
    """Score of every customer segment per ship month fold."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    j = o.join(c, o.o_custkey == c.c_custkey).withColumn("fold", F.month("o_orderdate") % 6)
    return j.groupBy(F.concat_ws("_", "c_mktsegment", "o_orderpriority").alias("policy_id"), "fold").agg((F.avg("o_totalprice") / 1000 - 150).alias("score"))


FOLDS_SQL = "fl AS MATERIALIZED (SELECT c_mktsegment || '_' || o_orderpriority AS policy_id, month(o_orderdate) % 6 AS fold, avg(o_totalprice) / 1000 - 150 AS score FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL)"
register("cv.cpcv_metrics", lambda spark, sf: L.cpcv_metrics(folds(spark, sf), ["policy_id"]).select("policy_id", *[rnd(c).alias(c) for c in ("cpcv_mean", "cpcv_worst", "cpcv_std")]),
         f"WITH {FOLDS_SQL} SELECT policy_id, {r6('avg(score)')} AS cpcv_mean, {r6('min(score)')} AS cpcv_worst, {r6('coalesce(stddev_samp(score), 0)')} AS cpcv_std FROM fl GROUP BY 1")
register("cv.rank_inversions", lambda spark, sf: L.rank_inversions(folds(spark, sf).withColumnRenamed("score", "rank"), ["policy_id"]).select("policy_id", rnd("inversions").alias("inversions")),
         f"WITH {FOLDS_SQL} SELECT a.policy_id, {r6('avg((b.score < a.score)::INT)')} AS inversions FROM fl a JOIN fl b ON a.policy_id = b.policy_id AND a.fold < b.fold GROUP BY 1")
_sub = ", ".join(f"({n}, {list(s)}, {[i for i in range(6) if i not in s]})" for n, s in enumerate(combinations(range(6), 3)))
register("cv.pbo", lambda spark, sf: L.pbo(folds(spark, sf), 6).select(rnd("pbo").alias("pbo"), "subsets"),
         f"""WITH {FOLDS_SQL}, sb AS (SELECT * FROM (VALUES {_sub}) t(n, a, b)), x AS (SELECT n, policy_id, avg(score) FILTER (list_contains(a, fold::INT)) AS i, avg(score) FILTER (list_contains(b, fold::INT)) AS o FROM fl, sb GROUP BY ALL),
  w AS (SELECT n, arg_max(o, i) AS win FROM x GROUP BY 1), p AS (SELECT n, avg((o <= win)::INT) AS pct FROM x JOIN w USING (n) GROUP BY 1) SELECT {r6('avg((pct <= 0.5)::INT)')} AS pbo, count(*)::BIGINT AS subsets FROM p""")
register("cal.brier_ece", lambda spark, sf: L.brier_ece(table(spark, sf, "lineitem").select("l_returnflag", (F.col("l_quantity") / 50.0).alias("p"), (F.col("l_linestatus") == "O").cast("int").alias("y")), ["l_returnflag"]).select("l_returnflag", rnd("brier").alias("brier"), rnd("ece").alias("ece")),
         f"""WITH x AS (SELECT l_returnflag, l_quantity / 50.0 AS p, (l_linestatus = 'O')::INT AS y FROM lineitem), b AS (SELECT l_returnflag, floor(p * 5) AS k, count(*) AS n, abs(sum(p) - sum(y)) AS g, sum(pow(p - y, 2)) AS se FROM x GROUP BY ALL)
  SELECT l_returnflag, {r6('sum(se) / sum(n)')} AS brier, {r6('sum(CASE WHEN k < 5 THEN g ELSE 0 END) / sum(n)')} AS ece FROM b GROUP BY 1""")


@query("ml.guard_scale", f"SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, (p >= 0.7)::INT::BIGINT AS signal, {r6('CASE WHEN p < 0.7 THEN 0 WHEN p >= 0.9 THEN 1 ELSE (p - 0.7) / 0.2 END')} AS scale FROM (SELECT *, l_quantity / 50.0 AS p FROM lineitem)")
def guard(spark, sf):
    sig, scale = L.guard_scale(F.col("l_quantity") / 50.0)
    return table(spark, sf, "lineitem").select("l_orderkey", big("l_linenumber"), "l_partkey", sig.cast("bigint").alias("signal"), rnd(scale).alias("scale"))


TAIL = ["mean", "std", "p95", "p99", "max"]
TAIL_SQL = f"tf AS (SELECT symbol, avg(vol) AS mean, stddev_pop(vol) AS std, quantile_cont(vol, 0.95) AS p95, quantile_cont(vol, 0.99) AS p99, max(vol) AS max FROM {VOL} WHERE vol IS NOT NULL GROUP BY 1)"
known = lambda spark, sf: voled(spark, sf).filter("vol is not null")
register("risk.tail_fit", lambda spark, sf: L.tail_fit(known(spark, sf), ["symbol"]).select("symbol", *[rnd(c).alias(c) for c in TAIL]), f"{VOL_SQL}, {TAIL_SQL} SELECT symbol, {', '.join(f'{r6(c)} AS {c}' for c in TAIL)} FROM tf")
register("risk.tail_score", lambda spark, sf: (lambda v: v.join(L.tail_fit(v, ["symbol"]).select("symbol", "p95"), "symbol").select("symbol", "bar_idx", rnd(F.try_divide("vol", "p95")).alias("tail_score")))(known(spark, sf)),
         f"{VOL_SQL}, {TAIL_SQL} SELECT symbol, bar_idx::BIGINT AS bar_idx, {r6('vol / nullif(p95, 0)')} AS tail_score FROM {VOL} JOIN tf USING (symbol) WHERE vol IS NOT NULL")
register("risk.assess", lambda spark, sf: known(spark, sf).select("symbol", "bar_idx", L.assess(F.col("vol"), F.lit(0.6)).alias("within_budget")), f"{VOL_SQL} SELECT symbol, bar_idx::BIGINT AS bar_idx, vol < 0.6 AS within_budget FROM {VOL} WHERE vol IS NOT NULL")

# -- episodes and batches: one episode per order, one batch per order month ----------------------


def episodes(spark, sf):
    o = table(spark, sf, "orders")
    k, ck = F.col("o_orderkey"), F.col("o_custkey")
    reasons = F.element_at(F.array(*[F.lit(c) for c in ("FAIL_NO_CYCLE", "FAIL_PF", "FAIL_MDD_BREACH", "FAIL_X", "FAIL_MIN_TRADES")]), (k % 5 + 1).cast("int"))
    df = o.select(
        (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("bigint").alias("batch_id"), k.alias("ord"), F.concat(F.lit("P"), ck.cast("string")).alias("policy_id"), F.concat(F.lit("T"), (ck % 7).cast("string")).alias("template"),
        (F.col("o_totalprice") / 1000 - 150).alias("score"), (ck % 12).alias("trade_count"), F.greatest(F.lit(0), ck % 12 - 2).alias("cycle_count"), ((k % 50) / 5000.0).alias("entry_rate"), ((ck % 30) * 8.0).alias("avg_hold_bars"), F.lit(250).alias("total_bars"),
        ((k % 9) / 2.0 + 1).alias("complexity"), ((ck % 11) / 10.0).alias("horizon_ratio"), (F.col("o_orderpriority") == "1-URGENT").alias("gate_pass"), reasons.alias("reason"), (F.floor(F.col("o_totalprice") / 20000) / 10).alias("reward"),
        F.when(k % 6 == 0, "PASS").otherwise(F.concat(F.lit("G"), (k % 4).cast("string"))).alias("nearest_gate"), ((k % 17) / 10.0).alias("distance"), F.when(k % 8 == 0, 0.3).otherwise(0.0).alias("invalid_rate"),
        F.concat(F.lit("TPL|"), F.col("o_orderstatus"), F.lit("|tp_0."), F.lpad((k % 90 + 10).cast("string"), 4, "0"), F.lit("_0.2000|sl_0."), F.when(k % 13 == 0, F.lit("x")).otherwise(F.lpad((k % 70 + 10).cast("string"), 4, "0")), F.lit("_0.1000|h_5_"), (k % 20 + 6).cast("string"), F.lit("|th|full|bps5")).alias("module_key"))
    return df.withColumn("tags", R.episode_tags())


EP_SQL = """ep0 AS (SELECT (year(o_orderdate) * 12 + month(o_orderdate))::BIGINT AS batch_id, o_orderkey AS ord, 'P' || o_custkey AS policy_id, 'T' || (o_custkey % 7) AS template, o_totalprice / 1000 - 150 AS score, o_custkey % 12 AS trade_count, greatest(0, o_custkey % 12 - 2) AS cycle_count,
  (o_orderkey % 50) / 5000.0 AS entry_rate, (o_custkey % 30) * 8.0 AS avg_hold_bars, (o_orderkey % 9) / 2.0 + 1 AS complexity, (o_custkey % 11) / 10.0 AS horizon_ratio, o_orderpriority = '1-URGENT' AS gate_pass,
  ['FAIL_NO_CYCLE', 'FAIL_PF', 'FAIL_MDD_BREACH', 'FAIL_X', 'FAIL_MIN_TRADES'][o_orderkey % 5 + 1] AS reason, floor(o_totalprice / 20000) / 10 AS reward, CASE WHEN o_orderkey % 6 = 0 THEN 'PASS' ELSE 'G' || (o_orderkey % 4) END AS nearest_gate, (o_orderkey % 17) / 10.0 AS distance,
  CASE WHEN o_orderkey % 8 = 0 THEN 0.3 ELSE 0.0 END AS invalid_rate, 'TPL|' || o_orderstatus || '|tp_0.' || lpad((o_orderkey % 90 + 10)::VARCHAR, 4, '0') || '_0.2000|sl_0.' || CASE WHEN o_orderkey % 13 = 0 THEN 'x' ELSE lpad((o_orderkey % 70 + 10)::VARCHAR, 4, '0') END || '_0.1000|h_5_' || (o_orderkey % 20 + 6) || '|th|full|bps5' AS module_key FROM orders),
ep AS MATERIALIZED (SELECT *, trade_count = 1 AND (avg_hold_bars / 250 >= 0.7 OR horizon_ratio >= 0.7) AS t1, entry_rate <= 0.002 AND complexity >= 4 AS t2, trade_count <= 1 OR entry_rate <= 0.001 AS t3 FROM ep0)"""
TAGS = "array_to_string(list_filter([CASE WHEN t1 THEN 'ONE_SHOT_HOLD' END, CASE WHEN t2 THEN 'OVER_FILTER' END, CASE WHEN t3 THEN 'RARE_SIGNAL' END], lambda x: x IS NOT NULL), ',')"
register("rep.tags", lambda spark, sf: episodes(spark, sf).groupBy(F.concat_ws(",", "tags").alias("tags")).agg(F.count(F.lit(1)).alias("n")), f"WITH {EP_SQL} SELECT {TAGS} AS tags, count(*)::BIGINT AS n FROM ep GROUP BY 1")
register("rep.episode", lambda spark, sf: episodes(spark, sf).select("batch_id", "ord", "policy_id", rnd("score").alias("score"), big("trade_count"), big("cycle_count"), rnd("reward").alias("reward"), "gate_pass", "nearest_gate", F.concat_ws(",", "tags").alias("tags")),
         f"WITH {EP_SQL} SELECT batch_id, ord, policy_id, {r6('score')} AS score, trade_count::BIGINT AS trade_count, cycle_count::BIGINT AS cycle_count, {r6('reward')} AS reward, gate_pass, nearest_gate, {TAGS} AS tags FROM ep")
_bins = ", ".join(f"({R.HOLD_BINS[i]}, {R.HOLD_BINS[i + 1]}, {'true' if i == len(R.HOLD_BINS) - 2 else 'false'})" for i in range(len(R.HOLD_BINS) - 1))
register("rep.histogram", lambda spark, sf: R.histogram(episodes(spark, sf), ["batch_id"], "avg_hold_bars", R.HOLD_BINS).select("batch_id", big("lo"), "n"),
         f"WITH {EP_SQL}, b AS (SELECT * FROM (VALUES {_bins}) t(lo, hi, fin)) SELECT batch_id, lo::BIGINT AS lo, count(*) FILTER (avg_hold_bars >= lo AND (avg_hold_bars < hi OR (fin AND avg_hold_bars <= hi)))::BIGINT AS n FROM ep, b GROUP BY ALL")
register("rep.summary_stats", lambda spark, sf: R.summary_stats(episodes(spark, sf), ["batch_id"], "score").select("batch_id", *[rnd(c).alias(c) for c in ("mean", "p10", "p90")]),
         f"WITH {EP_SQL} SELECT batch_id, {r6('avg(score)')} AS mean, {r6('quantile_cont(score, 0.1)')} AS p10, {r6('quantile_cont(score, 0.9)')} AS p90 FROM ep GROUP BY 1")
register("rep.topk_values", lambda spark, sf: R.top_values(episodes(spark, sf), ["batch_id"], "reward").select("batch_id", big("pos"), rnd("value").alias("value"), "n"),
         f"WITH {EP_SQL}, c AS (SELECT batch_id, round(reward, 3) AS value, count(*) AS n FROM ep GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY n DESC, value) AS pos FROM c) SELECT batch_id, pos::BIGINT AS pos, {r6('value')} AS value, n::BIGINT AS n FROM r WHERE pos <= 3")
register("rep.correlation", lambda spark, sf: R.correlation(episodes(spark, sf), ["batch_id"], "score", "trade_count").select("batch_id", rnd("value").alias("value"), "status"),
         f"WITH {EP_SQL} SELECT batch_id, {r6('CASE WHEN count(*) < 2 OR stddev_pop(score) = 0 OR stddev_pop(trade_count) = 0 THEN 0 ELSE corr(score, trade_count) END')} AS value, CASE WHEN count(*) < 2 THEN 'insufficient' WHEN stddev_pop(score) = 0 OR stddev_pop(trade_count) = 0 THEN 'constant' ELSE 'ok' END AS status FROM ep GROUP BY 1")
MK = ("tp_mid", "sl_mid", "h_mid", "rr_mid")
register("rep.module_key", lambda spark, sf: (lambda e: e.select("ord", *[rnd(v).alias(k) for k, v in R.module_params(F.col("module_key")).items()]))(episodes(spark, sf)),
         f"""WITH {EP_SQL}, p AS (SELECT ord, string_split(module_key, '|') AS a FROM ep), q AS (SELECT ord, (try_cast(split_part(a[3], '_', 2) AS DOUBLE) + try_cast(split_part(a[3], '_', 3) AS DOUBLE)) / 2 AS tp, (try_cast(split_part(a[4], '_', 2) AS DOUBLE) + try_cast(split_part(a[4], '_', 3) AS DOUBLE)) / 2 AS sl,
    (try_cast(split_part(a[5], '_', 2) AS DOUBLE) + try_cast(split_part(a[5], '_', 3) AS DOUBLE)) / 2 AS h FROM p), z AS (SELECT *, tp IS NOT NULL AND sl IS NOT NULL AND h IS NOT NULL AS ok FROM q)
  SELECT ord, {r6('CASE WHEN ok THEN tp END')} AS tp_mid, {r6('CASE WHEN ok THEN sl END')} AS sl_mid, {r6('CASE WHEN ok THEN h END')} AS h_mid, {r6('CASE WHEN ok THEN tp / sl END')} AS rr_mid FROM z""")
BT = ["gate_pass_rate", "median_trades", "median_cycles", "median_hold", "reward_mean", "reward_variance", "entry_rate_mean", "invalid_rate_mean", "distance_mean", "one_shot_rate", "rare_rate", "gate_ratio"]
BATCH_SQL = EP_SQL + """, gc AS (SELECT batch_id, nearest_gate, count(*) AS n, min(ord) AS fo FROM ep WHERE nearest_gate <> 'PASS' GROUP BY ALL), gt AS (SELECT batch_id, first(nearest_gate ORDER BY n DESC, fo) AS gate_focus, max(n) / sum(n) AS gate_ratio FROM gc GROUP BY 1),
bt0 AS (SELECT batch_id, count(*) AS episodes, avg(gate_pass::INT) AS gate_pass_rate, median(trade_count) AS median_trades, median(cycle_count) AS median_cycles, median(avg_hold_bars) AS median_hold, avg(reward) AS reward_mean, var_pop(reward) AS reward_variance, count(DISTINCT round(reward, 3)) AS reward_unique,
  avg(entry_rate) AS entry_rate_mean, avg(invalid_rate) AS invalid_rate_mean, avg(distance) AS distance_mean, avg(t1::INT) AS one_shot_rate, avg(t3::INT) AS rare_rate FROM ep GROUP BY 1),
bt AS MATERIALIZED (SELECT *, sqrt(reward_variance) < 1e-4 OR reward_unique < 3 AS collapsed FROM bt0 LEFT JOIN gt USING (batch_id)),
bc AS MATERIALIZED (SELECT *, sum(collapsed::INT) OVER (ORDER BY batch_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS cc FROM bt)"""
batches = lambda spark, sf: R.batch_report(episodes(spark, sf))
register("rep.batch", lambda spark, sf: batches(spark, sf).select("batch_id", "episodes", *[rnd(c).alias(c) for c in BT], "reward_unique", "gate_focus", "collapsed"),
         f"WITH {BATCH_SQL} SELECT batch_id, episodes::BIGINT AS episodes, {', '.join(f'{r6(c)} AS {c}' for c in BT)}, reward_unique::BIGINT AS reward_unique, gate_focus, collapsed FROM bt")
register("rep.gate_focus", lambda spark, sf: batches(spark, sf).select("batch_id", "gate_focus"), f"WITH {BATCH_SQL} SELECT batch_id, gate_focus FROM bt")
register("rep.deadlock", lambda spark, sf: (lambda d: d.select("batch_id", *[rnd(c).alias(c) for c in ("median_cycle", "mean_reward_variance", "mean_gate_pass")], "deadlock"))(R.deadlock(batches(spark, sf))),
         f"""WITH {BATCH_SQL}, d AS (SELECT batch_id, median(median_cycles) OVER w AS m, avg(reward_variance) OVER w AS v, avg(gate_pass_rate) OVER w AS g FROM bt WINDOW w AS (ORDER BY batch_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
  SELECT batch_id, {r6('m')} AS median_cycle, {r6('v')} AS mean_reward_variance, {r6('g')} AS mean_gate_pass, (m <= 1 AND v <= 1e-4 AND g <= 0.01)::BOOLEAN AS deadlock FROM d""")
register("rep.collapse_trend", lambda spark, sf: R.collapse_trend(batches(spark, sf)).select("batch_id", big("collapse_count"), "collapse_trend"), f"WITH {BATCH_SQL} SELECT batch_id, cc::BIGINT AS collapse_count, cc >= 3 AS collapse_trend FROM bc")
PAST = "OVER (ORDER BY batch_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"
register("rep.regression", lambda spark, sf: R.regression_signals(batches(spark, sf)),
         f"""WITH {BATCH_SQL} SELECT batch_id, median_cycles <= 1 AND reward_variance <= 1e-4 AND gate_pass_rate <= 0.01 AS r1, one_shot_rate >= 0.6 OR median_hold >= 150 AS r2, invalid_rate_mean >= 0.1 AS r3,
  coalesce(gate_ratio, 0) >= 0.8 AND coalesce(avg(distance_mean) {PAST} - distance_mean < 0.05, false) AS r4, cc >= 3 AS r5 FROM bc""")
register("rep.failure_mode", lambda spark, sf: R.failure_mode(batches(spark, sf)).withColumn("gate_trend", rnd("gate_trend")),
         f"""WITH {BATCH_SQL}, x AS (SELECT *, CASE WHEN median_trades <= 2 THEN 'trade_median_low' WHEN median_cycles <= 1 AND reward_variance <= 1e-4 AND gate_pass_rate <= 0.01 THEN 'deadlock_r1' WHEN cc >= 3 THEN 'reward_collapse_trend' ELSE 'none' END AS reason, gate_pass_rate - avg(gate_pass_rate) {PAST} AS tr FROM bc)
  SELECT batch_id, CASE reason WHEN 'none' THEN 'continue' WHEN 'trade_median_low' THEN 'stop' ELSE 'refactor' END AS action, reason, {r6('tr')} AS gate_trend FROM x""")
RULES = [("min_pass", "gate_pass_rate", ">=", 0.2), ("min_trades", "median_trades", ">=", 5.0), ("max_one_shot", "one_shot_rate", "<=", 0.05), ("max_invalid", "invalid_rate_mean", "<=", 0.04)]
_rt = "rules AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', {d})" for a, b, c, d in RULES) + ") t(rule, metric, op, threshold))"
register("rep.stage_rules", lambda spark, sf: R.stage_rules(batches(spark, sf), spark.createDataFrame(RULES, "rule string, metric string, op string, threshold double")),
         f"""WITH {BATCH_SQL}, {_rt}, u AS (SELECT batch_id, unnest([{{'metric': 'gate_pass_rate', 'v': gate_pass_rate}}, {{'metric': 'median_trades', 'v': median_trades::DOUBLE}}, {{'metric': 'one_shot_rate', 'v': one_shot_rate}}, {{'metric': 'invalid_rate_mean', 'v': invalid_rate_mean}}], recursive := true) FROM bt),
  j AS (SELECT *, CASE op WHEN '>=' THEN v >= threshold ELSE v <= threshold END AS ok FROM u JOIN rules USING (metric)) SELECT batch_id, bool_and(ok) AS passed, coalesce(string_agg(rule, ',' ORDER BY rule) FILTER (NOT ok), '') AS failed FROM j GROUP BY 1""")
QL = {"best_score": "max(score)", "mean_score": "avg(score)", "median_score": "median(score)", "mean_trades": "avg(trade_count)", "zero_trade_ratio": "avg((trade_count = 0)::INT)", "zero_cycle_ratio": "avg((cycle_count = 0)::INT)"}
register("rep.quality", lambda spark, sf: R.quality(episodes(spark, sf)).select("batch_id", *[rnd(c).alias(c) for c in QL]), f"WITH {EP_SQL} SELECT batch_id, {', '.join(f'{r6(e)} AS {c}' for c, e in QL.items())} FROM ep GROUP BY 1")


def stagnation(spark, sf):
    q = R.quality(episodes(spark, sf)).join(batches(spark, sf).select("batch_id", "gate_pass_rate", "rare_rate"), "batch_id")
    return R.stagnation(q.withColumns({"diversity": 0.3 + F.col("rare_rate"), "regime": F.floor(F.col("batch_id") / 5)}))


register("rep.stagnation", stagnation,
         f"""WITH {BATCH_SQL}, q AS (SELECT batch_id, {', '.join(f'{e} AS {c}' for c, e in QL.items())} FROM ep GROUP BY 1), h AS (SELECT q.*, gate_pass_rate, 0.3 + rare_rate AS dv, floor(batch_id / 5) AS rg FROM q JOIN bt USING (batch_id)),
  w AS (SELECT *, max(best_score) OVER (ORDER BY batch_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS rec, coalesce(max(best_score) OVER (ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 3 PRECEDING), first(best_score) OVER (ORDER BY batch_id)) AS past, coalesce(lag(rg) OVER (ORDER BY batch_id) <> rg, false) AS mv FROM h)
  SELECT batch_id, CASE WHEN rec - past >= 0.05 THEN CASE WHEN gate_pass_rate < 0.01 AND best_score < -50 THEN 'COLLAPSE' ELSE 'HEALTHY' END WHEN gate_pass_rate < 0.15 THEN 'PASS_RATE_TOO_LOW' WHEN dv < 0.4 THEN 'DIVERSITY_COLLAPSE'
    WHEN zero_trade_ratio > 0.4 OR mean_trades < 5 THEN 'NO_TRADE' WHEN mv THEN 'REGIME_MISMATCH' ELSE 'SPACE_TOO_NARROW' END AS cause FROM w""")
register("rep.template_summary", lambda spark, sf: R.template_summary(episodes(spark, sf), ["batch_id", "template"]).select("batch_id", "template", "n", "policy_id", rnd("score").alias("best_score"), big("trade_count")),
         f"WITH {EP_SQL} SELECT batch_id, template, count(*)::BIGINT AS n, last(policy_id ORDER BY score, ord) AS policy_id, {r6('max(score)')} AS best_score, last(trade_count ORDER BY score, ord)::BIGINT AS trade_count FROM ep GROUP BY ALL")
register("rep.walk_forward", lambda spark, sf: R.walk_forward(window_scores(spark, sf).withColumn("policy_id", F.concat("module", F.col("stage_id").cast("string"))), -30.0).select(*[rnd(c).alias(c) for c in ("consistent_share", "mean_min_alpha", "mean_std_alpha")]),
         f"WITH {METRICS_SQL}, {SAMPLES_SQL}, {AGG_SQL}, p AS (SELECT k10, stage_id, min(alpha) AS lo, stddev_pop(alpha) AS sd FROM aggs GROUP BY ALL) SELECT {r6('avg((lo >= -30)::INT)')} AS consistent_share, {r6('avg(lo)')} AS mean_min_alpha, {r6('avg(sd)')} AS mean_std_alpha FROM p")
TAX = [(code, cat) for cat, codes in S.TAXONOMY.items() for code in codes]
_tax = "tax AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in TAX) + ") t(code, category))"
register("rep.qa", lambda spark, sf: R.qa_report(episodes(spark, sf), spark.createDataFrame(TAX, "code string, category string")).withColumn("pass_rate", rnd("pass_rate")),
         f"""WITH {EP_SQL}, {_tax}, x AS (SELECT ep.*, coalesce(category, 'UNKNOWN_ISSUE') AS cat FROM ep LEFT JOIN tax ON code = reason) SELECT batch_id, {r6('avg(gate_pass::INT)')} AS pass_rate, count(*)::BIGINT AS n, count(*) FILTER (NOT gate_pass AND cat = 'SIGNAL_ISSUE')::BIGINT AS signal_issue,
  count(*) FILTER (NOT gate_pass AND cat = 'EDGE_ISSUE')::BIGINT AS edge_issue, count(*) FILTER (NOT gate_pass AND cat = 'RISK_ISSUE')::BIGINT AS risk_issue, count(*) FILTER (NOT gate_pass AND cat = 'UNKNOWN_ISSUE')::BIGINT AS unknown_issue,
  CASE WHEN 1 - avg(gate_pass::INT) > 0.9 OR avg(gate_pass::INT) < 0.01 THEN 'RIGID' ELSE 'SOFT' END AS status FROM x GROUP BY 1""")


@query("rep.score_ema", f"WITH RECURSIVE {EP_SQL}, q AS MATERIALIZED (SELECT batch_id, max(score) AS b, avg(score) AS m, row_number() OVER (ORDER BY batch_id) AS i FROM ep GROUP BY 1), r AS (SELECT i, batch_id, b AS eb, m AS em FROM q WHERE i = 1 UNION ALL SELECT q.i, q.batch_id, 0.8 * eb + 0.2 * q.b, 0.8 * em + 0.2 * q.m FROM r JOIN q ON q.i = r.i + 1) "
       f"SELECT batch_id, {r6('eb')} AS best_ema, {r6('em')} AS mean_ema FROM r")
def score_ema(spark, sf):
    from tickloom.operators.blocks import core_only, with_bar_idx, with_halo
    from tickloom.operators.scan import Scan, run_scans
    q = R.quality(episodes(spark, sf)).select(F.lit("all").alias("symbol"), "batch_id", "best_score", "mean_score")
    idx = with_halo(with_bar_idx(q, ts="batch_id", slot=F.expr("batch_id div 1000")), 0)
    ema = lambda c: Scan(f"{c}_ema", 0.8, 0.2 * F.col(c), seed=F.col(c))
    return core_only(run_scans(idx, [ema("best_score"), ema("mean_score")])).select("batch_id", rnd("best_score_ema").alias("best_ema"), rnd("mean_score_ema").alias("mean_ema"))


@query("rep.invalid_events", f"WITH {EP_SQL}, b AS (SELECT batch_id, policy_id, unnest(list_concat(CASE WHEN invalid_rate > 0 THEN [{{'t': 'invalid', 's': trade_count}}, {{'t': 'invalid', 's': trade_count + 1}}] ELSE [] END, CASE WHEN t3 THEN [{{'t': 'ignored', 's': cycle_count}}] ELSE [] END), recursive := true) FROM ep) SELECT batch_id, policy_id, t AS event_type, s::BIGINT AS step FROM b")
def invalid_events(spark, sf):
    """Both event arrays of an episode exploded into typed rows."""
    ev = lambda kind, step: F.struct(F.lit(kind).alias("event_type"), step.cast("bigint").alias("step"))
    e = episodes(spark, sf).withColumns({
        "invalid": F.when(F.col("invalid_rate") > 0, F.array(ev("invalid", F.col("trade_count")), ev("invalid", F.col("trade_count") + 1))),
        "ignored": F.when(F.array_contains("tags", "RARE_SIGNAL"), F.array(ev("ignored", F.col("cycle_count"))))})
    one = lambda c: e.select("batch_id", "policy_id", F.explode(c).alias("v")).select("batch_id", "policy_id", "v.*")
    return one("invalid").unionByName(one("ignored"))


@query("rep.evidence", f"WITH {EP_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY score DESC, ord) AS k FROM ep) SELECT batch_id, string_agg(policy_id, ',' ORDER BY k) FILTER (k <= 5) AS top5, {r6('avg(distance)')} AS distance_mean, {r6('max(distance)')} AS distance_max, {r6('avg(reward)')} AS reward_mean, {r6('var_pop(reward)')} AS reward_var, {r6('avg(horizon_ratio)')} AS horizon_ratio FROM r GROUP BY 1")
def evidence(spark, sf):
    """Top five snapshot (bounded per batch), distance, reward and exit statistics."""
    from pyspark.sql import Window
    e = episodes(spark, sf)
    top = e.withColumn("k", F.row_number().over(Window.partitionBy("batch_id").orderBy(F.col("score").desc(), "ord"))).filter("k <= 5")
    names = top.groupBy("batch_id").agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.struct("k", "policy_id"))), lambda s: s["policy_id"])).alias("top5"))
    st = e.groupBy("batch_id").agg(rnd(F.avg("distance")).alias("distance_mean"), rnd(F.max("distance")).alias("distance_max"), rnd(F.avg("reward")).alias("reward_mean"), rnd(F.var_pop("reward")).alias("reward_var"), rnd(F.avg("horizon_ratio")).alias("horizon_ratio"))
    return names.join(st, "batch_id")


@query("rep.log_summary", f"WITH {EP_SQL} SELECT nearest_gate AS gate, count(*)::BIGINT AS n, {r6('avg((distance > 0.8)::INT)')} AS fail_rate, CASE WHEN avg((distance > 0.8)::INT) > 0.5 THEN 'DOMINANT' ELSE 'OK' END AS finding FROM ep GROUP BY 1")
def log_summary(spark, sf):
    rate = F.avg((F.col("distance") > 0.8).cast("double"))
    return episodes(spark, sf).groupBy(F.col("nearest_gate").alias("gate")).agg(F.count(F.lit(1)).alias("n"), rnd(rate).alias("fail_rate"), F.when(rate > 0.5, "DOMINANT").otherwise("OK").alias("finding"))
