"""Rules, signals, backtests and performance metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import settings as S
from tickloom.functions.num import rnd
from tickloom.operators import backtest as BT
from tickloom.operators import context as C
from tickloom.operators import metrics as M
from tickloom.operators import rules as R
from tickloom.operators import windows as W
from tickloom.operators.engines import close_engine, intrabar_engine, signal_engine
from tickloom.operators.features import compute_genome
from tickloom.queries import demo as D
from tickloom.queries.base import bars_c, bars_d, bars_h, query, register, table
from tickloom.queries.feature_queries import rsi_layers
from tickloom.queries.sqlkit import BARS_D, BARS_H, Rec, chain, lag, r6, select, win

def slog(x):
    """Returns that compound over years span many magnitudes; sign(x) ln(1 + |x|) is compared instead."""
    x = F.col(x) if isinstance(x, str) else x
    return rnd(F.signum(x) * F.log1p(F.abs(x)))


def s_slog(e: str) -> str:
    return r6(f"sign({e}) * ln(1 + abs({e}))")


big = lambda c: F.col(c).cast("bigint").alias(c)
WITH = "WITH RECURSIVE "

# -- rules -------------------------------------------------------------------------------------


def rule_query(name: str, rules: dict, sql: dict, genome=None, layers=()):
    def run(spark, sf):
        df = bars_h(spark, sf)
        if genome:
            df = compute_genome(df, genome)
        return R.evaluate_rules(df, rules).select("symbol", "bar_idx", *rules)
    ctes, last = chain(BARS_H, *layers)
    register(name, run, f"{ctes} SELECT symbol, bar_idx::BIGINT AS bar_idx, {', '.join(f'({e})::BOOLEAN AS {n}' for n, e in sql.items())} FROM {last}")


SMA = [{"sma": win("avg", "close", 20)}]
rule_query("rule.compare", {"gt": "close > open", "lt": "TREND_SMA_V1 < 50", "ge": "TREND_SMA_V1 >= close", "ne": "TREND_SMA_V1 != 50"},
           {"gt": "close > open", "lt": "coalesce(sma < 50, false)", "ge": "coalesce(sma >= close, false)", "ne": "coalesce(sma <> 50, true)"}, {"TREND_SMA_V1": {}}, SMA)
rule_query("rule.cross", {"up": "close cross_up TREND_SMA_V1", "down": "close cross_down 40"},
           {"up": f"coalesce({lag('close')} <= {lag('sma')} AND close > sma, false)", "down": f"coalesce({lag('close')} >= 40 AND close < 40, false)"}, {"TREND_SMA_V1": {}}, SMA)
rule_query("rule.quantile", {"top": "close > [q0.75]", "calm": "TREND_SMA_V1 <= [q0.3]"},
           {"top": "close > quantile_cont(close, 0.75) OVER (PARTITION BY symbol)", "calm": "coalesce(sma <= quantile_cont(sma, 0.3) OVER (PARTITION BY symbol), false)"}, {"TREND_SMA_V1": {}}, SMA)
rule_query("rule.bool", {"mix": "not (close > open and volume > 2) or high >= 200", "always": "true", "never": ""},
           {"mix": "NOT (close > open AND volume > 2) OR high >= 200", "always": "true", "never": "false"})
rule_query("rule.text", {"r1": "MOMENTUM_RSI_V1 < 45 and close > 20 and volume >= 2", "r2": "MOMENTUM_RSI_V1.velocity > 0 and `close` < 80"},
           {"r1": "coalesce(rsi < 45, false) AND close > 20 AND volume >= 2", "r2": f"coalesce(rsi - {lag('rsi', 3)} > 0, false) AND close < 80"}, {"MOMENTUM_RSI_V1": {}}, rsi_layers(14))
rule_query("rule.normalize", {"flat": "close > 10 and close > 10 and volume > 1", "nested": "(close > 10 and (volume > 1))", "twice": "not not (close > 10 and volume > 1)"},
           {n: "close > 10 AND volume > 1" for n in ("flat", "nested", "twice")})


def conditions(spark, sf):
    """Condition rows derived from parts: policy = brand, tree by type, feature by container word."""
    p = table(spark, sf, "part")
    return p.select(F.col("p_brand").alias("policy_id"), F.when(F.col("p_size") % 2 == 0, "entry").otherwise("exit").alias("tree"),
                    F.concat(F.lit("F"), (F.col("p_size") % 7).cast("string")).alias("feature"), (F.col("p_size") % 4 + 1).alias("depth"), (F.col("p_size") % 3).alias("n_logic"))


COND_SQL = "conds AS (SELECT p_brand AS policy_id, CASE WHEN p_size % 2 = 0 THEN 'entry' ELSE 'exit' END AS tree, 'F' || (p_size % 7) AS feature, p_size % 4 + 1 AS depth, p_size % 3 AS n_logic FROM part)"


@query("rule.complexity", f"WITH {COND_SQL}, t AS (SELECT policy_id, tree, count(DISTINCT feature) AS nf, count(*) AS nc, max(n_logic) AS nl, max(depth) AS d FROM conds GROUP BY ALL) "
       f"SELECT policy_id, {r6('sum(nf + 0.5 * nc + 0.3 * nl + 0.2 * d)')} AS complexity FROM t GROUP BY 1")
def rule_complexity(spark, sf):
    return R.rule_complexity(conditions(spark, sf)).select("policy_id", rnd("complexity").alias("complexity"))


@query("rule.coverage", f"""WITH {COND_SQL}, cols AS (SELECT DISTINCT 'F' || (p_size % 6) || '__' || CASE WHEN p_size % 6 = 2 AND p_size % 4 = 0 THEN 'b' ELSE 'a' END AS column_name FROM part UNION SELECT 'F4'),
  pre AS (SELECT split_part(column_name, '__', 1) AS k, count(*) AS n FROM cols GROUP BY 1),
  j AS (SELECT c.policy_id, CASE WHEN EXISTS (SELECT 1 FROM cols x WHERE x.column_name = c.feature) THEN 'direct' WHEN n = 1 THEN 'fuzzy' WHEN n > 1 THEN 'ambiguous' ELSE 'unmatched' END AS kind
    FROM conds c LEFT JOIN pre ON pre.k = c.feature)
  SELECT policy_id, count(*) FILTER (kind = 'direct')::BIGINT AS direct, count(*) FILTER (kind = 'fuzzy')::BIGINT AS fuzzy, count(*) FILTER (kind = 'ambiguous')::BIGINT AS ambiguous,
    count(*) FILTER (kind = 'unmatched')::BIGINT AS unmatched, {r6("count(*) FILTER (kind IN ('direct', 'fuzzy')) / count(*)")} AS match_rate FROM j GROUP BY 1""")
def rule_coverage(spark, sf):
    p = table(spark, sf, "part")
    col = F.concat(F.lit("F"), (F.col("p_size") % 6).cast("string"), F.lit("__"), F.when((F.col("p_size") % 6 == 2) & (F.col("p_size") % 4 == 0), "b").otherwise("a"))
    cols = p.select(col.alias("column_name")).distinct().unionByName(spark.range(1).select(F.lit("F4").alias("column_name")))
    refs = conditions(spark, sf).select("policy_id", F.col("feature").alias("feature_key"))
    return R.coverage(refs, cols).withColumn("match_rate", rnd("match_rate"))


# -- signals -----------------------------------------------------------------------------------

SIG_COLS = "policy_id, sym AS symbol, bar_idx::BIGINT AS bar_idx"
register("sig.act_timing", lambda spark, sf: D.raw_signals(spark, sf).select("policy_id", "symbol", "bar_idx", "act"), f"{D.SIGNALS_SQL} SELECT {SIG_COLS}, act FROM sig")
register("sig.evaluate", lambda spark, sf: D.raw_signals(spark, sf).select("policy_id", "symbol", "bar_idx", "entry", "exit", "act", "hold_short", "hold_long"),
         f"{D.SIGNALS_SQL} SELECT {SIG_COLS}, entry, exit, act, hs AS hold_short, hl AS hold_long FROM sig")
register("sig.hold_bounds", lambda spark, sf: D.raw_signals(spark, sf).select("policy_id", "symbol", "bar_idx", big("hold_min"), big("hold_max")),
         f"{D.SIGNALS_SQL} SELECT {SIG_COLS}, hmin::BIGINT AS hold_min, hmax::BIGINT AS hold_max FROM sig")
GATE_SQL, GATE = chain(D.SIGNALS_SQL, D.engine_rec(mn="x.hmin", mx="x.hmax", conflict=False), source="sig", tag="g")
register("sig.state_gate", lambda spark, sf: D.gated_signals(spark, sf).select("policy_id", "symbol", "bar_idx", "entry", "exit"),
         f"{GATE_SQL} SELECT {SIG_COLS}, (pos = 1 AND en = bar_idx AND entry)::BOOLEAN AS entry, (code = 1)::BOOLEAN AS exit FROM {GATE}")


def sma_cross(df, fast=20, slow=50):
    def build(s):
        f, sl = s.let("f", s.avg("close", fast)), s.let("s", s.avg("close", slow))
        pf, ps = s.let("pf", s.lag(f)), s.let("ps", s.lag(sl))
        no = F.lit(False)
        return {"entry": F.coalesce((pf <= ps) & (f > sl), no), "exit": F.coalesce((pf >= ps) & (f < sl), no)}
    return C.with_columns_on(df, build)


CROSS = [{"f": win("avg", "close", 20), "s": win("avg", "close", 50)}, {"pf": lag("f"), "ps": lag("s")},
         {"entry": "coalesce(pf <= ps AND f > s, false)", "exit": "coalesce(pf >= ps AND f < s, false)"}]
_cx, _cxl = chain(BARS_D, *CROSS)
register("sig.sma_cross", lambda spark, sf: sma_cross(bars_d(spark, sf)).select("symbol", "bar_idx", "entry", "exit"), f"{_cx} SELECT symbol, bar_idx::BIGINT AS bar_idx, entry, exit FROM {_cxl}")
_rx, _rxl = chain(BARS_D, *rsi_layers(14))
register("sig.rsi_reversion", lambda spark, sf: R.evaluate_rules(compute_genome(bars_d(spark, sf), {"MOMENTUM_RSI_V1": {}}), {"entry": "MOMENTUM_RSI_V1 < 30", "exit": "MOMENTUM_RSI_V1 > 70"})
         .select("symbol", "bar_idx", "entry", "exit"), f"{_rx} SELECT symbol, bar_idx::BIGINT AS bar_idx, coalesce(rsi < 30, false) AS entry, coalesce(rsi > 70, false) AS exit FROM {_rxl}")


def predictions(spark, sf):
    """Daily predictions from all orders: +1 / 0 / -1 by the day's average price."""
    o = table(spark, sf, "orders").groupBy(F.date_trunc("day", "o_orderdate").alias("ts")).agg(F.avg("o_totalprice").alias("p"))
    return o.select("ts", F.when(F.col("p") > 155000, 1).when(F.col("p") < 145000, -1).otherwise(0).alias("pred"))


PRED_SQL = """preds AS (SELECT ts, CASE WHEN p > 155000 THEN 1 WHEN p < 145000 THEN -1 ELSE 0 END AS pred FROM (
  SELECT date_trunc('day', o_orderdate)::TIMESTAMP AS ts, avg(o_totalprice) AS p FROM orders GROUP BY 1)),
psig AS MATERIALIZED (SELECT b.*, coalesce(p.pred, 0) AS signal FROM bars b LEFT JOIN preds p USING (ts))"""


def prediction_signals(spark, sf):
    return bars_d(spark, sf).join(predictions(spark, sf), "ts", "left").withColumn("signal", F.coalesce("pred", F.lit(0))).drop("pred")


register("sig.from_predictions", lambda spark, sf: prediction_signals(spark, sf).select("symbol", "bar_idx", big("signal")),
         f"WITH {BARS_D}, {PRED_SQL} SELECT symbol, bar_idx::BIGINT AS bar_idx, signal::BIGINT AS signal FROM psig")


def constraints(df, observed=None):
    """Entry-rate feasibility of a stage (opportunity factor 1, 252 decisions a year)."""
    bounds = {k: v[1] for k, v in S.ENTRY_BOUNDS.items()}
    mx = F.create_map(*[F.lit(x) for kv in bounds.items() for x in kv])[F.col("stage_id")]
    need = F.col("min_entries_per_year") / S.BARS_PER_YEAR
    out = df.withColumns({"required_entry_rate": need, "bounds_max": mx, "feasibility_margin": F.try_divide(mx, need), "feasibility_ok": mx >= need * 1.2,
                          "recommended_min_rate": need * 0.8})
    if observed is None:
        return out
    opp = F.greatest(F.lit(0.01), F.least(observed, F.lit(1.0)))
    return out.withColumns({"recommended_opportunity": opp, "recommended_required_rate": F.col("min_entries_per_year") / (S.BARS_PER_YEAR * opp),
                            "opportunity_warn": F.abs(opp - 1.0) >= 0.2})


STAGE_SQL = "stage_spec AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(repr(v) for v in s) + ")" for s in S.STAGES) + ") t(" + ", ".join(S.STAGE_FIELDS) + "))"


@query("sig.entry_rate_constraints", f"""WITH {STAGE_SQL}, obs AS (SELECT (s_suppkey % 4 + 1)::INT AS stage_id, avg((s_acctbal > 5000)::INT) AS act FROM supplier GROUP BY 1),
  j AS (SELECT *, CASE stage_id WHEN 1 THEN 0.05 WHEN 2 THEN 0.04 WHEN 3 THEN 0.06 ELSE 0.08 END AS mx, min_entries_per_year / 252.0 AS need, greatest(0.01, least(act, 1.0)) AS opp FROM stage_spec JOIN obs USING (stage_id))
  SELECT stage_id::BIGINT AS stage_id, {r6('need')} AS required_entry_rate, {r6('mx')} AS bounds_max, {r6('mx / need')} AS feasibility_margin, (mx >= need * 1.2)::BOOLEAN AS feasibility_ok,
    {r6('need * 0.8')} AS recommended_min_rate, {r6('opp')} AS recommended_opportunity, {r6('min_entries_per_year / (252.0 * opp)')} AS recommended_required_rate, (abs(opp - 1.0) >= 0.2)::BOOLEAN AS opportunity_warn FROM j""")
def entry_constraints(spark, sf):
    obs = table(spark, sf, "supplier").groupBy((F.col("s_suppkey") % 4 + 1).cast("int").alias("stage_id")).agg(F.avg((F.col("s_acctbal") > 5000).cast("int")).alias("act"))
    out = constraints(S.stage_spec(spark).join(obs, "stage_id"), F.col("act"))
    cols = ["required_entry_rate", "bounds_max", "feasibility_margin", "recommended_min_rate", "recommended_opportunity", "recommended_required_rate"]
    return out.select(big("stage_id"), *[rnd(c).alias(c) for c in cols], "feasibility_ok", "opportunity_warn")


def prefilter(signals, policies, stage_id=1):
    """Entry hit rate per policy against the stage bounds, with reasons."""
    spec, (lo, hi), (ql, qh) = S.stage(stage_id), S.ENTRY_BOUNDS[stage_id], S.QUANTILE_BOUNDS[stage_id]
    lo = max(lo, spec["min_entries_per_year"] / S.BARS_PER_YEAR * 0.8)
    info = []
    for p in policies:
        terms = [m.groups() for m in R.TERM.finditer(p["rules"].get("entry") or "")]
        extreme = any(v.startswith("[q") and not ql < float(v[2:-1]) < qh for _, _, v in terms)
        info.append((p["policy_id"], len(terms) > spec["and_terms_max"], extreme))
    trees = signals.sparkSession.createDataFrame(info, "policy_id string, deep boolean, extreme boolean")
    rate = signals.groupBy("policy_id").agg(F.avg(F.col("entry").cast("double")).alias("hit_rate")).join(trees, "policy_id", "right")
    r = F.col("hit_rate")
    why = F.when(r.isNull(), "HIT_RATE_EMPTY").when(r < lo, "HIT_RATE_TOO_LOW").when(r > hi, "HIT_RATE_TOO_HIGH")
    notes = F.array_compact(F.array(why, F.when(F.col("deep"), "AND_DEPTH_TOO_HIGH"), F.when(F.col("extreme"), "EXTREME_Q_TOO_HIGH")))
    return rate.select("policy_id", F.coalesce(r, F.lit(0.0)).alias("hit_rate"), why.isNull().alias("kept"), F.when(why.isNotNull(), F.concat_ws(",", notes)).otherwise("").alias("reasons"))


register("sig.prefilter", lambda spark, sf: prefilter(D.raw_signals(spark, sf), D.POLICIES).withColumn("hit_rate", rnd("hit_rate")),
         f"""{D.SIGNALS_SQL}, hr AS (SELECT policy_id, avg(entry::INT) AS r FROM sig GROUP BY 1), lim AS (SELECT greatest(0.005, 2.0 / 252 * 0.8) AS lo),
  w AS (SELECT *, CASE WHEN r < lo THEN 'HIT_RATE_TOO_LOW' WHEN r > 0.05 THEN 'HIT_RATE_TOO_HIGH' END AS why, policy_id = 'vol_break' AS extreme FROM hr, lim)
  SELECT policy_id, {r6('r')} AS hit_rate, why IS NULL AS kept, CASE WHEN why IS NULL THEN '' ELSE why || CASE WHEN extreme THEN ',EXTREME_Q_TOO_HIGH' ELSE '' END END AS reasons FROM w""")

# -- backtests ---------------------------------------------------------------------------------

TRADE_OUT = (f"policy_id, sym AS symbol, entry_idx, exit_idx, {r6('entry_price')} AS entry_price, {r6('exit_price')} AS exit_price, {r6('return_pct')} AS return_pct, exit_reason, bars::BIGINT AS bars")


def show_trades(t):
    return t.select("policy_id", "symbol", "entry_idx", "exit_idx", *[rnd(c).alias(c) for c in ("entry_price", "exit_price", "return_pct")], "exit_reason", big("bars"))


register("bt.close_engine", lambda spark, sf: show_trades(D.base_trades(spark, sf)), f"{D.TRADES_SQL} SELECT {TRADE_OUT} FROM trades")
HELD_SQL, HELD = chain(D.SIGNALS_SQL, D.engine_rec(mn="x.hmin", mx="x.hmax"), source="sig", tag="h")
register("bt.close_engine_holds", lambda spark, sf: show_trades(close_engine(D.raw_signals(spark, sf), D.policy_params(spark))),
         f"{HELD_SQL},\n{D.trades_of(HELD)} SELECT {TRADE_OUT} FROM trades")
register("bt.positions", lambda spark, sf: D.engine_positions(spark, sf)[0].select("policy_id", "symbol", "bar_idx", big("position")),
         f"{D.RUN_SQL} SELECT policy_id, sym AS symbol, bar_idx::BIGINT AS bar_idx, pos::BIGINT AS position FROM {D.RUN}")
CURVE_LAYERS = [{"ret": f"coalesce(lag(pos) OVER (PARTITION BY symbol ORDER BY bar_idx) * (close - {lag('close')}) / nullif({lag('close')}, 0), 0)"},
                {"eq": "product(1 + ret) OVER (PARTITION BY symbol ORDER BY bar_idx ROWS UNBOUNDED PRECEDING)"},
                {"pk": "greatest(1.0, max(eq) OVER (PARTITION BY symbol ORDER BY bar_idx ROWS UNBOUNDED PRECEDING))"}]
CURVE_SQL, CURVE = chain(D.RUN_SQL, *CURVE_LAYERS, source=D.RUN, tag="c")


def curve(spark, sf):
    pos, trades = D.engine_positions(spark, sf)
    return BT.equity_curve(BT.bar_returns(pos, D.KEYS), D.KEYS), trades


register("bt.equity_curve", lambda spark, sf: curve(spark, sf)[0].select("policy_id", "symbol", "bar_idx", slog("equity_pct").alias("equity_slog")),
         f"{CURVE_SQL} SELECT policy_id, sym AS symbol, bar_idx::BIGINT AS bar_idx, {s_slog('((eq - 1) * 100)')} AS equity_slog FROM {CURVE}")
register("bt.drawdown", lambda spark, sf: curve(spark, sf)[0].groupBy("policy_id", "symbol").agg(rnd(F.abs(F.min("drawdown")) * 100).alias("mdd_pct"), slog(F.max("peak")).alias("peak_slog")),
         f"{CURVE_SQL} SELECT policy_id, sym AS symbol, {r6('abs(min(eq / pk - 1)) * 100')} AS mdd_pct, {s_slog('max(pk)')} AS peak_slog FROM {CURVE} GROUP BY ALL")
FLAG_SQL = f"""flags AS (SELECT *, coalesce(lag(pos) OVER (PARTITION BY symbol ORDER BY bar_idx), 0) AS pp FROM {D.RUN}),
acts AS (SELECT *, CASE WHEN entry AND exit THEN 'CONFLICT_ENTRY_EXIT' END AS inv, CASE WHEN entry AND exit THEN NULL WHEN entry AND pp = 1 THEN 'IGNORED_LONG_ENTER' WHEN exit AND pp = 0 THEN 'IGNORED_FLAT_EXIT' END AS ign FROM flags)"""


def flags(spark, sf):
    pos, _ = D.engine_positions(spark, sf)
    before = lambda s: {"prev_position": F.coalesce(s.lag("position"), F.lit(0))}
    return BT.action_flags(C.with_columns_on(pos, before, keys=tuple(D.KEYS)))


@query("bt.action_audit", f"""{D.RUN_SQL}, {FLAG_SQL} SELECT policy_id, sym AS symbol, count(*) FILTER (entry OR exit)::BIGINT AS total_action_bars, count(inv)::BIGINT AS invalid_count,
  {r6('coalesce(count(inv) / nullif(count(*) FILTER (entry OR exit), 0), 0)')} AS invalid_rate, count(ign)::BIGINT AS ignored_count, {r6('coalesce(count(ign) / nullif(count(*) FILTER (entry OR exit), 0), 0)')} AS ignored_rate,
  min(bar_idx) FILTER (inv IS NOT NULL)::BIGINT AS invalid_first, min(bar_idx) FILTER (ign IS NOT NULL)::BIGINT AS ignored_first,
  count(*) FILTER (ign = 'IGNORED_LONG_ENTER')::BIGINT AS ignored_long_enter, count(*) FILTER (ign = 'IGNORED_FLAT_EXIT')::BIGINT AS ignored_flat_exit FROM acts GROUP BY ALL""")
def action_audit(spark, sf):
    a = BT.action_audit(flags(spark, sf), D.KEYS).drop("sample_id")
    return a.withColumns({"invalid_rate": rnd("invalid_rate"), "ignored_rate": rnd("ignored_rate")})


register("bt.action_events", lambda spark, sf: BT.first_events(flags(spark, sf), D.KEYS, "ignored").select("policy_id", "symbol", "bar_idx", big("event_no"), "reason", "position_state"),
         f"""{D.RUN_SQL}, {FLAG_SQL}, ev AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_idx) AS k FROM acts WHERE ign IS NOT NULL)
  SELECT policy_id, sym AS symbol, bar_idx::BIGINT AS bar_idx, k::BIGINT AS event_no, ign AS reason, CASE WHEN pp = 1 THEN 'LONG' ELSE 'FLAT' END AS position_state FROM ev WHERE k <= 5""")


def summary(spark, sf):
    """One row per policy and symbol: trade statistics, exposure, drawdown, benchmark and excess."""
    cur, trades = curve(spark, sf)
    agg = BT.trade_aggregates()
    t = trades.groupBy(*D.KEYS).agg(*[v.alias(k) for k, v in agg.items()])
    b = cur.groupBy(*D.KEYS).agg(F.count(F.lit(1)).alias("bars"), F.avg(F.col("position").cast("double")).alias("exposure"), (F.abs(F.min("drawdown")) * 100).alias("mdd"),
                                 F.min_by("close", "bar_idx").alias("first"), F.max_by("close", "bar_idx").alias("last"))
    j = b.join(t, D.KEYS, "left").withColumns({"trade_count": F.coalesce("trade_count", F.lit(0)), "total_return": F.coalesce("total_return", F.lit(0.0)),
                                              "win_rate": F.coalesce("win_rate", F.lit(0.0)), "profit_factor": F.coalesce("profit_factor", F.lit(1.0)),
                                              "avg_trade_return": F.coalesce("avg_trade_return", F.lit(0.0))})
    j = j.withColumn("benchmark", BT.benchmark_return(F.col("first"), F.col("last"), F.col("exposure"), "exposure"))
    return j.withColumns({"trades_per_year": F.col("trade_count") / (F.col("bars") / 252.0), "excess": F.col("total_return") - F.col("benchmark")})


SUMMARY_SQL = f"""{CURVE_SQL}, {D.trades_of(D.RUN)},
ts AS (SELECT symbol, count(*) AS n, (product(1 + return_pct / 100) - 1) * 100 AS total, avg((return_pct > 0)::INT) AS wr, sum(greatest(return_pct, 0)) / 100 AS gp, abs(sum(least(return_pct, 0))) / 100 AS gl, avg(return_pct) AS av FROM trades GROUP BY 1),
bs AS (SELECT policy_id, sym, symbol, count(*) AS nb, avg(pos) AS ex, abs(min(eq / pk - 1)) * 100 AS mdd, arg_min(close, bar_idx) AS c0, arg_max(close, bar_idx) AS c1 FROM {CURVE} GROUP BY ALL),
summ AS (SELECT *, CASE WHEN c0 = 0 THEN 0 ELSE (c1 / c0 - 1) * 100 * ex END AS bench FROM bs LEFT JOIN ts USING (symbol))"""
WIDE = ("total_return", "excess", "avg_trade_return", "benchmark", "total_return_pct", "cagr")
SUM_COLS = {"total_return": "coalesce(total, 0)", "mdd": "mdd", "win_rate": "coalesce(wr, 0)", "profit_factor": "CASE WHEN gl > 0 THEN gp / gl WHEN gp > 0 THEN 100 ELSE 1 END", "exposure": "ex",
            "avg_trade_return": "coalesce(av, 0)", "trades_per_year": "coalesce(n, 0) / (nb / 252.0)", "benchmark": "bench", "excess": "coalesce(total, 0) - bench"}
register("bt.summary", lambda spark, sf: summary(spark, sf).select("policy_id", "symbol", big("trade_count"), *[(slog if c in WIDE else rnd)(c).alias(c) for c in SUM_COLS]),
         f"{SUMMARY_SQL} SELECT policy_id, sym AS symbol, coalesce(n, 0)::BIGINT AS trade_count, {', '.join(f'{(s_slog if c in WIDE else r6)(e)} AS {c}' for c, e in SUM_COLS.items())} FROM summ")


@query("bt.benchmark", f"""WITH {BARS_D}, a AS (SELECT symbol, arg_min(close, bar_idx) AS c0, arg_max(close, bar_idx) AS c1, avg((close > open)::INT) AS ex FROM bars GROUP BY 1)
  SELECT symbol, {r6('(c1 / c0 - 1) * 100')} AS bh, {r6('15.0')} AS fixed, {r6('0.0')} AS cash, {r6('(c1 / c0 - 1) * 100 * ex')} AS exposure, {r6('15.0 * ex')} AS exposure_fixed FROM a""")
def benchmark(spark, sf):
    a = bars_d(spark, sf).groupBy("symbol").agg(F.min_by("close", "bar_idx").alias("c0"), F.max_by("close", "bar_idx").alias("c1"), F.avg((F.col("close") > F.col("open")).cast("double")).alias("ex"))
    return a.select("symbol", *[rnd(BT.benchmark_return(F.col("c0"), F.col("c1"), F.col("ex"), m, 15.0)).alias(m) for m in ("bh", "fixed", "cash", "exposure", "exposure_fixed")])


# intrabar engine: SMA cross signals on daily bars, one parameter set with costs and slippage
TV = {"tp": 0.08, "sl": 0.06, "hold": 25, "comm": 0.05, "slip": 5.0}


def intrabar_trades(spark, sf, timing="next_open", priority="stop_first"):
    sig = sma_cross(bars_d(spark, sf)).withColumn("policy_id", F.lit("cross"))
    sig = sig.withColumns({"entry": F.col("entry") | (F.col("bar_idx") % 37 == 0), "exit": F.col("exit") | (F.col("bar_idx") % 53 == 0)})
    params = spark.range(1).select(F.lit("base").alias("sample_id"), F.lit(TV["tp"]).alias("tp_pct"), F.lit(TV["sl"]).alias("sl_pct"), F.lit(TV["hold"]).alias("max_hold"),
                                   F.lit(timing).alias("timing"), F.lit(priority).alias("priority"), F.lit("bps").alias("slippage_mode"), F.lit(TV["slip"]).alias("slippage_value"),
                                   F.lit(0.01).alias("tick_size"), F.lit(False).alias("same_bar_reentry"))
    return intrabar_engine(sig, params)


_slipf = TV["slip"] / 1e4
_fill = f"(x.open * (1 + {_slipf}))"
_in = "(r.pos = 0 AND r.pin = 1)"
_p0 = f"(CASE WHEN {_in} THEN 1 ELSE r.pos END)"
_e0 = f"(CASE WHEN {_in} THEN {_fill} ELSE r.ep END)"
_sigx = f"({_p0} = 1 AND r.pout = 1)"
_held = f"(CASE WHEN {_in} THEN 0 ELSE r.held END + 1)"
_live = f"({_p0} = 1 AND NOT {_sigx})"
_sl = f"({_live} AND x.low <= {_e0} * (1 - {TV['sl']}))"
_tp = f"({_live} AND NOT {_sl} AND x.high >= {_e0} * (1 + {TV['tp']}))"
_tm = f"({_live} AND NOT {_sl} AND NOT {_tp} AND {_held} >= {TV['hold']})"
_left = f"({_sigx} OR {_sl} OR {_tp} OR {_tm})"
_open = f"({_p0} = 1 AND NOT {_left})"
TV_REC = Rec({
    "pos": ("0", f"CASE WHEN {_open} THEN 1 ELSE 0 END"), "en": ("0", f"CASE WHEN {_in} THEN x.bar_idx ELSE r.en END"), "ep": ("0", _e0), "held": ("0", _held),
    "pin": ("CASE WHEN entry THEN 1 ELSE 0 END", f"CASE WHEN {_p0} = 0 AND x.entry AND x.bar_idx < x.last THEN 1 ELSE 0 END"),
    "pout": ("0", f"CASE WHEN {_open} AND x.exit AND x.bar_idx < x.last THEN 1 ELSE 0 END"),
    "code": ("0", f"CASE WHEN {_sigx} THEN 1 WHEN {_sl} THEN 2 WHEN {_tp} THEN 3 WHEN {_tm} THEN 4 ELSE 0 END"),
    "px": ("0", f"CASE WHEN {_sigx} THEN x.open WHEN {_sl} THEN {_e0} * (1 - {TV['sl']}) WHEN {_tp} THEN {_e0} * (1 + {TV['tp']}) ELSE x.close END")})
_tvs, _tvl = chain(BARS_D, *CROSS, {"last": "max(bar_idx) OVER (PARTITION BY symbol)", "entry2": "entry OR bar_idx % 37 = 0", "exit2": "exit OR bar_idx % 53 = 0"})
TV_BASE = f"{_tvs}, tvb AS MATERIALIZED (SELECT symbol, bar_idx, open, high, low, close, last, entry2 AS entry, exit2 AS exit FROM {_tvl})"
TV_RUN, TV_LAST = chain(TV_BASE, TV_REC, source="tvb", tag="v")
TV_TRADES = f"""{TV_RUN}, tvx AS (SELECT symbol, en::BIGINT AS entry_idx, bar_idx::BIGINT AS exit_idx, ep AS entry_price, px * (1 - {_slipf}) AS exit_price, ep / (1 + {_slipf}) * {_slipf} AS es, px * {_slipf} AS xs,
    CASE code WHEN 1 THEN 'signal' WHEN 2 THEN 'sl' WHEN 3 THEN 'tp' ELSE 'time' END AS reason FROM {TV_LAST} WHERE code > 0
  UNION ALL SELECT symbol, en::BIGINT, bar_idx::BIGINT, ep, close * (1 - {_slipf}), ep / (1 + {_slipf}) * {_slipf}, close * {_slipf}, 'eod' FROM {TV_LAST} WHERE pos = 1 AND bar_idx = last)"""
register("bt.tv_engine", lambda spark, sf: intrabar_trades(spark, sf).select("symbol", "entry_idx", "exit_idx", *[rnd(c).alias(c) for c in ("entry_price", "exit_price", "entry_slip", "exit_slip")], "reason"),
         f"{TV_TRADES} SELECT symbol, entry_idx, exit_idx, {r6('entry_price')} AS entry_price, {r6('exit_price')} AS exit_price, {r6('es')} AS entry_slip, {r6('xs')} AS exit_slip, reason FROM tvx")


def tv_equity(spark, sf, **kw):
    return BT.intrabar_equity(intrabar_trades(spark, sf, **kw), ["policy_id", "symbol", "sample_id"], "percent", TV["comm"])


_cf = TV["comm"] / 100
TV_EQ, TV_EQL = chain(f"{TV_TRADES}, tvn AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY entry_idx) - 1 AS bar_idx FROM tvx)",
                      Rec({"eq0": ("1.0", "r.eq1"), "eq1": (f"1.0 + (1.0 / entry_price) * ((exit_price - entry_price) - (entry_price + exit_price) * {_cf})",
                                                        f"r.eq1 + (r.eq1 / x.entry_price) * ((x.exit_price - x.entry_price) - (x.entry_price + x.exit_price) * {_cf})")}), source="tvn", tag="q")
register("bt.tv_equity", lambda spark, sf: tv_equity(spark, sf).select("symbol", big("trade_no"), *[rnd(c, 9).alias(c) for c in ("qty", "fees", "pnl_net", "slippage", "equity")]),
         f"{TV_EQ} SELECT symbol, bar_idx::BIGINT AS trade_no, {r6('eq0 / entry_price', 9)} AS qty, {r6(f'eq0 / entry_price * (entry_price + exit_price) * {_cf}', 9)} AS fees, {r6('eq1 - eq0', 9)} AS pnl_net, "
         f"{r6('eq0 / entry_price * (es + xs)', 9)} AS slippage, {r6('eq1', 9)} AS equity FROM {TV_EQL}")

# signal engine on prediction signals
SG = {"tp": 0.10, "sl": 0.07, "h": 12, "cost": 5.0}


def signal_trades(spark, sf):
    sig = prediction_signals(spark, sf).withColumn("policy_id", F.lit("pred")).withColumn("regime", F.when(F.col("close") > F.col("open"), "UP").otherwise("DOWN"))
    params = spark.range(1).select(F.lit("base").alias("sample_id"), F.lit(SG["tp"]).alias("tp_pct"), F.lit(SG["sl"]).alias("sl_pct"), F.lit(SG["h"]).alias("max_hold"), F.lit(SG["cost"]).alias("cost_bps"),
                                   F.lit("UP").alias("target_regime"))
    return signal_engine(sig, params)


_in = "(r.pos = 0 AND r.pend <> 0)"
_p0, _e0 = f"(CASE WHEN {_in} THEN r.pend ELSE r.pos END)", f"(CASE WHEN {_in} THEN x.open ELSE r.ep END)"
_held = f"(CASE WHEN {_in} THEN 1 ELSE r.held + 1 END)"
_goal, _stop = f"({_e0} * (1 + {_p0} * {SG['tp']}))", f"({_e0} * (1 - {_p0} * {SG['sl']}))"
_won = f"(CASE WHEN {_p0} > 0 THEN x.high >= {_goal} ELSE x.low <= {_goal} END)"
_lost = f"(CASE WHEN {_p0} > 0 THEN x.low <= {_stop} ELSE x.high >= {_stop} END)"
_code = f"(CASE WHEN {_p0} = 0 THEN 0 WHEN {_lost} THEN 1 WHEN {_won} THEN 2 WHEN {_held} >= {SG['h']} THEN 3 WHEN x.signal = 0 OR x.signal <> {_p0} THEN 4 ELSE 0 END)"
SG_REC = Rec({"pos": ("0", f"CASE WHEN {_code} > 0 THEN 0 ELSE {_p0} END"), "dir": ("0", _p0), "en": ("0", f"CASE WHEN {_in} THEN x.bar_idx ELSE r.en END"), "ep": ("0", _e0), "held": ("0", _held),
              "pend": ("signal", f"CASE WHEN {_p0} = 0 AND x.bar_idx < x.last THEN x.signal ELSE 0 END"), "code": ("0", _code),
              "px": ("0", f"CASE WHEN {_code} = 1 THEN {_stop} WHEN {_code} = 2 THEN {_goal} ELSE x.close END")})
SG_RUN, SG_LAST = chain(f"{BARS_D}, {PRED_SQL}, sgb AS MATERIALIZED (SELECT *, max(bar_idx) OVER (PARTITION BY symbol) AS last FROM psig)", SG_REC, source="sgb", tag="s")
SG_TRADES = f"""{SG_RUN}, sgx AS (SELECT symbol, en::BIGINT AS entry_idx, bar_idx::BIGINT AS exit_idx, dir::BIGINT AS direction, ep AS entry_price, px AS exit_price, CASE code WHEN 1 THEN 'SL' WHEN 2 THEN 'TP' WHEN 3 THEN 'HORIZON' ELSE 'AGENT_EXIT' END AS exit_reason,
    held::BIGINT AS bars, close > open AS ok FROM {SG_LAST} WHERE code > 0 UNION ALL SELECT symbol, en::BIGINT, bar_idx::BIGINT, dir::BIGINT, ep, close, 'HORIZON', held::BIGINT, close > open FROM {SG_LAST} WHERE pos <> 0 AND bar_idx = last)"""
_sgret = f"((exit_price / entry_price - 1) * direction - 2 * {SG['cost']} / 10000) * 100"
register("bt.signal_engine", lambda spark, sf: signal_trades(spark, sf).select("symbol", "entry_idx", "exit_idx", big("direction"), *[rnd(c).alias(c) for c in ("entry_price", "exit_price", "return_pct")], "exit_reason", big("bars"), "is_valid"),
         f"{SG_TRADES} SELECT symbol, entry_idx, exit_idx, direction, {r6('entry_price')} AS entry_price, {r6('exit_price')} AS exit_price, {r6(_sgret)} AS return_pct, exit_reason, bars, ok AS is_valid FROM sgx")


def budgets(spark, sf):
    """Risk budgets from suppliers with many missing fields."""
    s = table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    opt = lambda m, e: F.when(k % m != 0, e)
    return s.select(k.alias("id"), opt(2, (k % 50) / 1000.0).alias("sl_pct"), F.when(k % 5 == 1, 0.03).alias("tp_pct"), F.when(k % 3 == 0, (k % 40) / 1000.0).alias("stop_loss"), opt(4, 1.0 + (k % 5) / 4.0).alias("risk_reward_ratio"),
                    opt(7, (k % 9) / 2.0).alias("k_up"), opt(6, (k % 7) / 3.0).alias("k_down"), F.when(k % 8 != 0, (k % 30) - 2).alias("horizon"))


BUDGET_SQL = """bud AS (SELECT k AS id, CASE WHEN k % 2 <> 0 THEN (k % 50) / 1000.0 END AS sl_pct, CASE WHEN k % 5 = 1 THEN 0.03 END AS tp_pct, CASE WHEN k % 3 = 0 THEN (k % 40) / 1000.0 END AS stop_loss,
  CASE WHEN k % 4 <> 0 THEN 1.0 + (k % 5) / 4.0 END AS rr, CASE WHEN k % 7 <> 0 THEN (k % 9) / 2.0 END AS k_up, CASE WHEN k % 6 <> 0 THEN (k % 7) / 3.0 END AS k_down, CASE WHEN k % 8 <> 0 THEN (k % 30) - 2 END AS horizon FROM (SELECT s_suppkey AS k FROM supplier))"""
register("bt.trade_params", lambda spark, sf: BT.trade_params(budgets(spark, sf)).select("id", rnd("r_tp").alias("tp"), rnd("r_sl").alias("sl"), F.col("r_horizon").cast("bigint").alias("horizon")),
         f"""WITH {BUDGET_SQL} SELECT id, {r6('greatest(coalesce(tp_pct, coalesce(sl_pct, stop_loss) * rr, k_up * 0.015, 0.02), 0.001)')} AS tp,
  {r6('greatest(coalesce(sl_pct, stop_loss, k_down * 0.015, 0.01), 0.001)')} AS sl, greatest(coalesce(horizon, 20), 1)::BIGINT AS horizon FROM bud""")
register("bt.risk_unit", lambda spark, sf: BT.risk_unit(budgets(spark, sf)).select("id", rnd("risk_unit").alias("risk_unit"), rnd("reward_risk").alias("reward_risk")),
         f"WITH {BUDGET_SQL} SELECT id, {r6('coalesce(stop_loss, CASE WHEN k_down IS NOT NULL THEN greatest(0.001, least(0.2, k_down * 0.015)) END, 0.01)')} AS risk_unit, {r6('coalesce(rr, k_up / nullif(k_down, 0))')} AS reward_risk FROM bud")


def pnl_frame(spark, sf):
    """Per-bar profit in risk units: previous signal times the return over a 2 % stop."""
    def build(s):
        prev = F.coalesce(s.lag("signal"), F.lit(0))
        return {"pred": prev, "net_pnl": prev * F.coalesce(s.pct("close"), F.lit(0.0)) * 2}
    return C.with_columns_on(prediction_signals(spark, sf), build).withColumn("risk_unit", F.lit(0.05))


PNL_LAYERS = [{"pred": f"coalesce({lag('signal')}, 0)"}, {"pnl": f"pred * coalesce((close - {lag('close')}) / nullif({lag('close')}, 0), 0) * 2"}, {"ur": "greatest(pnl * 0.05, -0.95)"},
              {"eq": "product(1 + ur) OVER (PARTITION BY symbol ORDER BY bar_idx ROWS UNBOUNDED PRECEDING)"}, {"pk": "max(eq) OVER (PARTITION BY symbol ORDER BY bar_idx ROWS UNBOUNDED PRECEDING)"}]
PNL_SQL, PNL = chain(f"{BARS_D}, {PRED_SQL}", *PNL_LAYERS, source="psig")
register("bt.compounded", lambda spark, sf: BT.compounded(pnl_frame(spark, sf), ["symbol"]).select("symbol", "bar_idx", slog("equity_pct").alias("equity_slog")),
         f"{PNL_SQL} SELECT symbol, bar_idx::BIGINT AS bar_idx, {s_slog('((eq - 1) * 100)')} AS equity_slog FROM {PNL}")
register("bt.fast_score", lambda spark, sf: BT.fast_scores(D.raw_signals(spark, sf), ["policy_id", "symbol"]).select("policy_id", "symbol", rnd("score").alias("score")),
         f"""{D.SIGNALS_SQL}, nx AS (SELECT *, lead(close) OVER (PARTITION BY symbol ORDER BY bar_idx) AS nc FROM sig), rr AS (SELECT policy_id, sym, entry, entry::INT * (nc - close) / nullif(close, 0) AS r FROM nx WHERE nc IS NOT NULL)
  SELECT policy_id, sym AS symbol, {r6('CASE WHEN count(*) FILTER (entry) = 0 THEN -99 ELSE sum(r) * 1000 + CASE WHEN stddev_pop(r) > 1e-9 THEN avg(r) / stddev_pop(r) ELSE 0 END * 10 END')} AS score FROM rr GROUP BY ALL""")


def compare_inputs(spark, sf):
    """Reference: the engine's trades; produced: the same with symbol R shifted by one bar and symbol N missing its last trade."""
    ref = tv_equity(spark, sf).select("symbol", "trade_no", "entry_idx", "exit_idx", "entry_price", "exit_price", "reason")
    last = ref.groupBy("symbol").agg(F.max("trade_no").alias("m"))
    got = ref.join(last, "symbol").filter((F.col("symbol") != "N") | (F.col("trade_no") < F.col("m"))).drop("m")
    return ref, got.withColumn("exit_idx", F.when((F.col("symbol") == "R") & (F.col("trade_no") >= 5), F.col("exit_idx") + 1).otherwise(F.col("exit_idx")))


register("bt.compare_trades", lambda spark, sf: BT.compare_trades(*compare_inputs(spark, sf), ["symbol"]).select("symbol", "n_ref", "n_got", "mismatch", big("trade_no")),
         f"""{TV_TRADES}, ref AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY entry_idx) - 1 AS k, entry_idx, exit_idx, entry_price, exit_price, reason, count(*) OVER (PARTITION BY symbol) AS c FROM tvx),
  got AS (SELECT symbol, k, entry_idx, CASE WHEN symbol = 'R' AND k >= 5 THEN exit_idx + 1 ELSE exit_idx END AS exit_idx, entry_price, exit_price, reason FROM ref WHERE symbol <> 'N' OR k < c - 1),
  cmp AS (SELECT symbol, k AS trade_no, CASE WHEN r.entry_idx <> g.entry_idx THEN 1 WHEN r.exit_idx <> g.exit_idx THEN 2 WHEN abs(r.entry_price - g.entry_price) > 0.0005 * greatest(abs(r.entry_price), 1e-9) THEN 3 WHEN r.reason <> g.reason THEN 4
    WHEN abs(r.exit_price - g.exit_price) > 0.0005 * greatest(abs(r.exit_price), 1e-9) THEN 5 END AS code FROM ref r FULL JOIN got g USING (symbol, k)),
  bad AS (SELECT symbol, min(trade_no) AS trade_no, arg_min(code, trade_no) AS code FROM cmp WHERE code IS NOT NULL GROUP BY 1),
  n AS (SELECT symbol, a.c AS n_ref, coalesce(b.c, 0) AS n_got FROM (SELECT symbol, count(*) AS c FROM ref GROUP BY 1) a LEFT JOIN (SELECT symbol, count(*) AS c FROM got GROUP BY 1) b USING (symbol))
  SELECT symbol, n_ref::BIGINT AS n_ref, n_got::BIGINT AS n_got, CASE WHEN n_ref <> n_got THEN 'TRADE_COUNT_MISMATCH' WHEN code IS NULL THEN 'MATCH' ELSE ['ENTRY_BAR_MISMATCH', 'EXIT_BAR_MISMATCH', 'ENTRY_PRICE_MISMATCH', 'EXIT_REASON_MISMATCH', 'EXIT_PRICE_MISMATCH'][code] END AS mismatch,
    (CASE WHEN n_ref = n_got THEN trade_no END)::BIGINT AS trade_no FROM n LEFT JOIN bad USING (symbol)""")


@query("bt.invariants", f"""{TV_TRADES}, j1 AS MATERIALIZED (SELECT t.*, b.open AS eo FROM tvx t JOIN tvb b ON b.symbol = t.symbol AND b.bar_idx = t.entry_idx),
  j2 AS MATERIALIZED (SELECT t.*, p.entry AS sg FROM j1 t JOIN tvb p ON p.symbol = t.symbol AND p.bar_idx = t.entry_idx - 1),
  j3 AS MATERIALIZED (SELECT t.*, x.open AS xo, x.high AS xh, x.low AS xl FROM j2 t JOIN tvb x ON x.symbol = t.symbol AND x.bar_idx = t.exit_idx),
  chk AS (SELECT symbol, abs(entry_price - eo * (1 + {_slipf})) <= 1e-9 AS fill_ok, sg AS signal_ok, exit_idx >= entry_idx AS order_ok,
    reason NOT IN ('tp', 'sl') OR (exit_price + xs BETWEEN least(xl, xo, exit_price) - 1e-6 AND greatest(xh, xo, exit_price + xs) + 1e-6) AS range_ok FROM j3)
  SELECT symbol, count(*)::BIGINT AS trades, bool_and(fill_ok) AS fills_at_next_open, bool_and(signal_ok) AS follows_signal, bool_and(order_ok) AS exit_after_entry, bool_and(range_ok) AS exit_in_range FROM chk GROUP BY 1""")
def invariants(spark, sf):
    sig = sma_cross(bars_d(spark, sf)).withColumn("entry", F.col("entry") | (F.col("bar_idx") % 37 == 0))
    t = intrabar_trades(spark, sf)
    at = sig.select("symbol", F.col("bar_idx").alias("entry_idx"), F.col("open").alias("e_open"))
    before = sig.select("symbol", (F.col("bar_idx") + 1).alias("entry_idx"), F.col("entry").alias("signalled"))
    on = sig.select("symbol", F.col("bar_idx").alias("exit_idx"), F.col("open").alias("x_open"), F.col("high").alias("x_high"), F.col("low").alias("x_low"))
    j = t.join(at, ["symbol", "entry_idx"]).join(before, ["symbol", "entry_idx"]).join(on, ["symbol", "exit_idx"])
    raw = F.col("exit_price") + F.col("exit_slip")
    inside = ~F.col("reason").isin("tp", "sl") | raw.between(F.least("x_low", "x_open", "exit_price") - 1e-6, F.greatest(F.col("x_high"), F.col("x_open"), raw) + 1e-6)
    return j.groupBy("symbol").agg(F.count(F.lit(1)).alias("trades"), F.bool_and(F.abs(F.col("entry_price") - F.col("e_open") * (1 + _slipf)) <= 1e-9).alias("fills_at_next_open"),
                                   F.bool_and("signalled").alias("follows_signal"), F.bool_and(F.col("exit_idx") >= F.col("entry_idx")).alias("exit_after_entry"), F.bool_and(inside).alias("exit_in_range"))


# -- metrics -----------------------------------------------------------------------------------

PS = ["policy_id", "symbol"]


def totals(spark, sf):
    n = bars_d(spark, sf).groupBy("symbol").agg((F.max("bar_idx") + 1).alias("bars_total"))
    return n.withColumn("policy_id", F.explode(F.array(*[F.lit(p["policy_id"]) for p in D.POLICIES])))


TS_COLS = ["win_rate", "avg_win", "avg_loss", "profit_factor", "expectancy", "reward_risk", "top1_share", "top3_share", "trades_per_year", "act_rate"]
TSTAT_SQL = f"""{D.TRADES_SQL}, {D.BARS_TOTAL_SQL}, tr AS (SELECT *, return_pct / 100 AS r, row_number() OVER (PARTITION BY symbol ORDER BY return_pct DESC) AS rk FROM trades),
ta AS (SELECT symbol, count(*) AS n, avg((r > 0)::INT) AS wr, coalesce(avg(r) FILTER (r > 0), 0) AS aw, coalesce(avg(r) FILTER (r < 0), 0) AS al, coalesce(sum(r) FILTER (r > 0), 0) AS gp, abs(coalesce(sum(r) FILTER (r < 0), 0)) AS gl,
  median(r) FILTER (r > 0) AS mw, median(r) FILTER (r < 0) AS ml, sum(r) FILTER (rk <= 1 AND r > 0) AS t1, sum(r) FILTER (rk <= 3 AND r > 0) AS t3 FROM tr GROUP BY 1),
tj AS (SELECT *, coalesce(wr, 0) AS w FROM nbars LEFT JOIN ta USING (symbol))"""
TS_EXPR = {"win_rate": "w", "avg_win": "coalesce(aw, 0)", "avg_loss": "coalesce(al, 0)", "profit_factor": "CASE WHEN gl > 1e-9 THEN gp / gl WHEN gp > 0 THEN 100 ELSE 1 END",
           "expectancy": "CASE WHEN n IS NULL THEN 0 ELSE w * aw - (1 - w) * abs(al) END", "reward_risk": "coalesce(mw / nullif(abs(ml), 0), 0)", "top1_share": "CASE WHEN gp > 1e-9 THEN t1 / gp ELSE 0 END",
           "top3_share": "CASE WHEN gp > 1e-9 THEN t3 / gp ELSE 0 END", "trades_per_year": "coalesce(n, 0) / (bars_total / 252.0)", "act_rate": "coalesce(n, 0) / greatest(bars_total, 1)"}


def tstats(spark, sf):
    t = D.base_trades(spark, sf).withColumn("ret", F.col("return_pct") / 100)
    return M.trade_stats(t, totals(spark, sf), PS)


register("met.trades", lambda spark, sf: tstats(spark, sf).select(*PS, big("trade_count"), *[rnd(c).alias(c) for c in TS_COLS]),
         f"{TSTAT_SQL} SELECT policy_id, sym AS symbol, coalesce(n, 0)::BIGINT AS trade_count, {', '.join(f'{r6(TS_EXPR[c])} AS {c}' for c in TS_COLS)} FROM tj")
EQ_COLS = ["total_return_pct", "cagr", "vol_pct", "sharpe", "max_drawdown_pct", "exposure_ratio"]


def estats(spark, sf):
    pos, _ = D.engine_positions(spark, sf)
    ret = BT.bar_returns(pos, D.KEYS).filter("bar_idx > 0")
    return M.equity_stats(ret, D.KEYS, "strategy_return", "position").drop("sample_id")


ESTAT_LAYERS = [{"eq2": "product(1 + ret) OVER (PARTITION BY symbol ORDER BY bar_idx ROWS UNBOUNDED PRECEDING)"}, {"pk2": "max(eq2) OVER (PARTITION BY symbol ORDER BY bar_idx ROWS UNBOUNDED PRECEDING)"},
                {"dd": "CASE WHEN eq2 >= pk2 * (1 - 1e-13::DOUBLE) THEN 0 ELSE eq2 / pk2 - 1 END"}, {"lastflat": "max(CASE WHEN dd >= 0 THEN bar_idx END) OVER (PARTITION BY symbol ORDER BY bar_idx ROWS UNBOUNDED PRECEDING)"}]
ESTAT_SQL, ESTAT = chain(f"{CURVE_SQL}, est AS MATERIALIZED (SELECT policy_id, sym, symbol, bar_idx, ret, pos FROM {CURVE} WHERE bar_idx > 0)", *ESTAT_LAYERS, source="est", tag="x")
ESTAT_AGG = f"""{ESTAT_SQL}, ea AS (SELECT policy_id, sym, symbol, count(*) AS n, arg_max(eq2, bar_idx) AS e1, abs(min(dd)) * 100 AS mdd, max(CASE WHEN dd < 0 THEN bar_idx - coalesce(lastflat, 0) ELSE 0 END) AS dur, stddev_pop(ret) AS sd, avg(pos) AS ex FROM {ESTAT} GROUP BY ALL),
eb AS (SELECT *, (e1 - 1) * 100 AS total_return_pct, CASE WHEN e1 > 0 THEN (pow(e1, 252.0 / n) - 1) * 100 ELSE -100 END AS cagr, sd * sqrt(252) * 100 AS vol_pct, mdd AS max_drawdown_pct, ex AS exposure_ratio FROM ea),
es AS (SELECT *, CASE WHEN vol_pct > 1e-9 THEN cagr / vol_pct ELSE 0 END AS sharpe FROM eb)"""
register("met.equity", lambda spark, sf: estats(spark, sf).select(*PS, *[(slog if c in WIDE else rnd)(c).alias(c) for c in EQ_COLS], "mdd_duration"),
         f"{ESTAT_AGG} SELECT policy_id, sym AS symbol, {', '.join(f'{(s_slog if c in WIDE else r6)(c)} AS {c}' for c in EQ_COLS)}, dur::BIGINT AS mdd_duration FROM es")


@query("met.exit_reason", "SELECT CASE WHEN l_returnflag = 'A' THEN 'SL' WHEN l_returnflag = 'N' THEN 'HORIZON' ELSE 'Other' END AS reason, count(*)::BIGINT AS n FROM lineitem GROUP BY 1")
def norm_reason(spark, sf):
    raw = F.when(F.col("l_returnflag") == "A", " Stop_Loss ").when(F.col("l_returnflag") == "N", "EOD").otherwise("manual")
    return table(spark, sf, "lineitem").select(M.exit_reason(raw).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


CY = ["avg_hold_bars", "p95_hold_bars", "avg_flat_gap", "ratio_sl", "ratio_tp", "ratio_horizon", "ratio_agent_exit", "ratio_other"]
CYC_SQL = f"""{D.TRADES_SQL}, {D.BARS_TOTAL_SQL}, cy AS (SELECT *, lead(entry_idx) OVER (PARTITION BY symbol ORDER BY entry_idx) AS nx FROM trades JOIN nbars USING (policy_id, sym, symbol)),
cg AS (SELECT *, greatest(0, greatest(0, nx - exit_idx) - 1) AS fg FROM cy),
ca AS (SELECT symbol, count(*) AS n, count(*) FILTER (exit_idx < bars_total - 1) AS cc, avg(bars) AS ah, quantile_cont(bars, 0.95) AS p95, min(entry_idx) AS fe, max(exit_idx) AS lx, sum(CASE WHEN nx IS NOT NULL THEN fg END) AS gs, avg(CASE WHEN nx IS NOT NULL THEN fg END) AS ag,
  avg((exit_reason = 'SL')::INT) AS s1, avg((exit_reason = 'TP')::INT) AS s2, avg((exit_reason = 'HORIZON')::INT) AS s3, avg((exit_reason = 'AGENT_EXIT')::INT) AS s4 FROM cg GROUP BY 1),
cj AS (SELECT * FROM nbars LEFT JOIN ca USING (symbol))"""
CY_EXPR = ["ah", "p95", "ag", "s1", "s2", "s3", "s4", "0.0"]


def cycle_rows(spark, sf):
    tot = totals(spark, sf)
    return M.cycle_stats(M.cycles(D.base_trades(spark, sf), tot, PS), tot, PS)


register("met.cycles", lambda spark, sf: cycle_rows(spark, sf).select(*PS, big("entry_count"), big("cycle_count"), big("flat_bars"), *[rnd(c).alias(c) for c in CY]),
         f"{CYC_SQL} SELECT policy_id, sym AS symbol, coalesce(n, 0)::BIGINT AS entry_count, coalesce(cc, 0)::BIGINT AS cycle_count, (CASE WHEN n IS NULL THEN bars_total ELSE fe + (bars_total - 1 - lx) + coalesce(gs, 0) END)::BIGINT AS flat_bars, "
         f"{', '.join(f'{r6(f'coalesce({e}, 0)')} AS {c}' for c, e in zip(CY, CY_EXPR))} FROM cj")
register("met.pred_trades", lambda spark, sf: M.prediction_trades(pnl_frame(spark, sf), ["symbol"]).select("symbol", "n_trades", rnd("win_rate").alias("win_rate"), rnd("trade_score").alias("trade_score")),
         f"""{PNL_SQL}, pt AS (SELECT *, pred <> coalesce({lag('pred')}, 0) AND pred <> 0 AS st FROM {PNL}) SELECT symbol, count(*) FILTER (st)::BIGINT AS n_trades, {r6('coalesce(avg((pnl > 0)::INT) FILTER (pred <> 0), 0)')} AS win_rate,
  {r6('least(count(*) FILTER (st) / 100.0, 1.0)')} AS trade_score FROM pt GROUP BY 1""")
PWIDE = ("total_return_pct",)
PM = {"total_return_pct": "(arg_max(eq, bar_idx) - 1) * 100", "mdd_pct": "min(eq / pk - 1) * 100", "volatility_pct": "stddev_samp(ur) * 100",
      "reward_risk": "coalesce(avg(ur) FILTER (ur > 0), 0) / (abs(avg(ur) FILTER (ur < 0)) + 1e-9::DOUBLE)", "stop_loss_pct": "5.0"}
register("met.pnl", lambda spark, sf: M.pnl_metrics(pnl_frame(spark, sf), ["symbol"]).select("symbol", *[(slog if c in PWIDE else rnd)(c).alias(c) for c in PM]),
         f"{PNL_SQL} SELECT symbol, {', '.join(f'{(s_slog if c in PWIDE else r6)(e)} AS {c}' for c, e in PM.items())} FROM {PNL} GROUP BY 1")


WIN_COLS = ["win_rate", "profit_factor", "reward_risk", "trades_per_year"]


def window_row(spark, sf):
    """Trade, equity and cycle metrics of each policy and symbol in one row; everything reads one materialised signal grid."""
    pos, trades = D.engine_positions(spark, sf)
    tot = pos.groupBy(*D.KEYS).agg(F.count(F.lit(1)).alias("bars_total"))
    t = trades.withColumn("ret", F.col("return_pct") / 100)
    ts = M.trade_stats(t, tot, D.KEYS)
    eq = M.equity_stats(BT.bar_returns(pos, D.KEYS).filter("bar_idx > 0"), D.KEYS, "strategy_return", "position")
    cy = M.cycle_stats(M.cycles(trades, tot, D.KEYS), tot, D.KEYS).select(*D.KEYS, "cycle_count", "avg_hold_bars")
    return ts.join(eq, D.KEYS).join(cy, D.KEYS)


register("met.window", lambda spark, sf: window_row(spark, sf).select(*PS, big("trade_count"), big("cycle_count"), *[rnd(c).alias(c) for c in WIN_COLS], rnd("avg_hold_bars").alias("avg_hold_bars"), rnd("vol_pct").alias("vol_pct"), rnd("max_drawdown_pct").alias("max_drawdown_pct")),
         f"""WITH RECURSIVE {TSTAT_SQL.removeprefix('WITH RECURSIVE ')}, {CYC_SQL[CYC_SQL.index('cy AS ('):]}, {ESTAT_AGG[ESTAT_AGG.index('c0 AS '):]}
  SELECT tj.policy_id, tj.sym AS symbol, coalesce(tj.n, 0)::BIGINT AS trade_count, coalesce(cc, 0)::BIGINT AS cycle_count, {', '.join(f'{r6(TS_EXPR[c].replace("n IS", "tj.n IS").replace("coalesce(n,", "coalesce(tj.n,").replace("bars_total", "tj.bars_total"))} AS {c}' for c in WIN_COLS)},
  {r6('coalesce(ah, 0)')} AS avg_hold_bars, {r6('vol_pct')} AS vol_pct, {r6('max_drawdown_pct')} AS max_drawdown_pct FROM tj JOIN cj USING (symbol) JOIN es USING (symbol)""")
