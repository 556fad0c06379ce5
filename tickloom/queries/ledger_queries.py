"""Ledger readers and analytics on experiments derived from orders, and catalog queries."""

from __future__ import annotations


from pyspark.sql import functions as F

from tickloom.functions.num import rnd
from tickloom.operators import ledger as L
from tickloom.queries.base import query, register, table
from tickloom.queries.result_queries import FOLD_SQL, METRICS_SQL, fold_stats
from tickloom.queries.sqlkit import Rec, chain, r6
from tickloom.queries.trading_queries import big

CODES = ("CALIBRATION_BAD", "TURNOVER_TOO_HIGH", "DD_LIMIT_BREACH", "REGIME_DEPENDENT", "OTHER")
_code = "['" + "', '".join(CODES) + "']"


def records(spark, sf):
    """One experiment per order."""
    o = table(spark, sf, "orders")
    k, ck, p = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")
    pick = lambda i: F.element_at(F.array(*[F.lit(c) for c in CODES]), (i % 5 + 1).cast("int"))
    genome = F.map_from_arrays(F.transform(F.sequence(F.lit(0).cast("bigint"), k % 5), lambda i: F.concat(F.lit("F"), ((i * 3 + ck) % 10).cast("string"), F.lit("_"), i.cast("string"))),
                               F.transform(F.sequence(F.lit(0).cast("bigint"), k % 5), lambda i: F.when(i % 3 == 2, F.create_map(F.lit("mult"), F.lit(2.0))).otherwise(F.create_map(F.lit("window"), (ck % 30 + i).cast("double")))))
    return o.select(
        F.concat(F.lit("E"), F.lpad(k.cast("string"), 9, "0")).alias("exp_id"), F.col("o_orderdate").alias("ts"), F.col("o_orderpriority").alias("regime"), F.concat(F.lit("T"), (ck % 7).cast("string")).alias("template_id"),
        F.when(k % 9 != 0, F.round(p / 1000, 2)).alias("eval_score"), (p / 1000 - 150).alias("total_return_pct"), F.when(k % 3 != 0, p / 100000).alias("sharpe"), ((k % 20) * 3.0).alias("vol_pct"), ((ck % 100) / 100.0).alias("win_rate"), (ck % 60).alias("trade_count"),
        ((k % 33) * 2.0).alias("max_drawdown_pct"), ((ck % 21) / 10.0).alias("reward_risk"), F.when(k % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(pick(k), pick(ck))).alias("reason_codes"), genome.alias("genome"))


REC_SQL = f"""rec AS MATERIALIZED (SELECT 'E' || lpad(o_orderkey::VARCHAR, 9, '0') AS exp_id, o_orderdate AS ts, o_orderpriority AS regime, 'T' || (o_custkey % 7) AS template_id, CASE WHEN o_orderkey % 9 <> 0 THEN round(o_totalprice / 1000, 2) END AS eval_score, o_totalprice / 1000 - 150 AS total_return_pct,
  CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice / 100000 END AS sharpe, (o_orderkey % 20) * 3.0 AS vol_pct, (o_custkey % 100) / 100.0 AS win_rate, o_custkey % 60 AS trade_count, (o_orderkey % 33) * 2.0 AS max_drawdown_pct, (o_custkey % 21) / 10.0 AS reward_risk,
  CASE WHEN o_orderkey % 4 = 0 THEN [] ELSE [{_code}[o_orderkey % 5 + 1], {_code}[o_custkey % 5 + 1]] END AS reason_codes, o_orderkey AS k, o_custkey AS ck FROM orders),
flat AS MATERIALIZED (SELECT *, CASE WHEN trade_count < 15 THEN 'MIN_TRADES' WHEN max_drawdown_pct > 50 THEN 'MAX_MDD' WHEN win_rate > 0.85 THEN 'WINRATE_HIGH' WHEN trade_count >= 30 AND win_rate < 0.3 THEN 'WINRATE_LOW' WHEN trade_count >= 20 AND reward_risk < 0.5 THEN 'RR_LOW' ELSE '' END AS reason,
  coalesce(sharpe, total_return_pct / CASE WHEN vol_pct > 1e-9 THEN vol_pct END, 0) AS sh FROM rec), app AS MATERIALIZED (SELECT *, 3 * total_return_pct + 50 * win_rate + 0.1 * trade_count AS sc FROM flat WHERE reason = '')"""
flat = lambda spark, sf: L.flat(records(spark, sf))
register("led.flat", lambda spark, sf: L.generations(flat(spark, sf)).select("exp_id", "generation", "status", "reason", rnd("sharpe_shown").alias("sharpe"), rnd("total_return_pct").alias("total_return_pct")),
         f"WITH {REC_SQL} SELECT exp_id, row_number() OVER (ORDER BY ts, exp_id) AS generation, CASE WHEN reason = '' THEN 'Approved' ELSE 'Rejected' END AS status, reason, {r6('sh')} AS sharpe, {r6('total_return_pct')} AS total_return_pct FROM flat")
register("led.leaderboard", lambda spark, sf: L.leaderboard(flat(spark, sf)).select("regime", big("rank"), "exp_id"), f"WITH {REC_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY regime ORDER BY total_return_pct DESC, exp_id) AS rk FROM app) SELECT regime, rk::BIGINT AS rank, exp_id FROM r WHERE rk <= 3")
register("led.rejections", lambda spark, sf: L.rejections(records(spark, sf)), f"WITH {REC_SQL} SELECT reason_codes[1] AS code, count(*)::BIGINT AS n FROM rec WHERE len(reason_codes) > 0 GROUP BY 1")
register("led.kpis", lambda spark, sf: L.kpis(flat(spark, sf)).select("experiments", *[rnd(c).alias(c) for c in ("approval_rate", "best_sharpe", "best_win_rate", "best_return")]),
         f"WITH {REC_SQL} SELECT count(*)::BIGINT AS experiments, {r6('avg((reason = chr(0) OR length(reason) = 0)::INT)')} AS approval_rate, {r6('max(sh) FILTER (length(reason) = 0)')} AS best_sharpe, {r6('max(win_rate) FILTER (length(reason) = 0)')} AS best_win_rate, {r6('max(total_return_pct) FILTER (length(reason) = 0)')} AS best_return FROM flat")
register("led.best_overall", lambda spark, sf: L.best_overall(flat(spark, sf)).select("exp_id", rnd("score").alias("score")), f"WITH {REC_SQL} SELECT exp_id, {r6('sc')} AS score FROM app ORDER BY sc DESC, exp_id LIMIT 1")
register("led.search", lambda spark, sf: L.search(flat(spark, sf), "T3", ["exp_id", "template_id", "regime"]).select("exp_id", "template_id", rnd(L.overall_score()).alias("score")),
         f"WITH {REC_SQL} SELECT exp_id, template_id, {r6('3 * total_return_pct + 50 * win_rate + 0.1 * trade_count')} AS score FROM flat WHERE lower(exp_id) LIKE '%t3%' OR lower(template_id) LIKE '%t3%' OR lower(regime) LIKE '%t3%'")
register("led.best", lambda spark, sf: fold_stats(spark, sf).orderBy(F.col("mean").desc(), "policy_id").limit(1).select("policy_id", rnd("mean").alias("cpcv_mean")), f"WITH {METRICS_SQL}, {FOLD_SQL} SELECT policy_id, {r6('mean')} AS cpcv_mean FROM folds ORDER BY mean DESC, policy_id LIMIT 1")
GEN_SQL = "gn AS (SELECT exp_id, k, list_sort(list_transform(range(k % 5 + 1), lambda i: 'F' || ((i * 3 + ck) % 10) || '_' || i || CASE WHEN i % 3 <> 2 AND ck % 30 + i <> 0 THEN '(' || (ck % 30 + i) || ')' ELSE '' END)) AS g FROM rec)"
register("led.genome_text", lambda spark, sf: records(spark, sf).select("exp_id", L.genome_text(F.col("genome")).alias("genome_text")), f"WITH {REC_SQL}, {GEN_SQL} SELECT exp_id, CASE WHEN len(g) > 3 THEN g[1] || ', ' || g[2] || ' +' || (len(g) - 2) ELSE array_to_string(g, ', ') END AS genome_text FROM gn")
_fix = "fx AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{a}', '{b}', '{c}')" for i, (a, b, c) in enumerate(L.FIXES)) + ") t(o, code, target, change))"
register("led.fix_suggestions", lambda spark, sf: L.fix_suggestions(records(spark, sf), ["exp_id"]), f"WITH {REC_SQL}, {_fix}, x AS (SELECT exp_id, unnest(reason_codes) AS code FROM rec) SELECT exp_id, target, arg_max(change, o) AS change FROM x JOIN fx USING (code) GROUP BY ALL")


@query("led.feature_catalog", f"""WITH {REC_SQL}, u AS (SELECT exp_id, eval_score, 'F' || ((i * 3 + ck) % 10) || '_' || i AS feature FROM (SELECT *, unnest(range(k % 5 + 1)) AS i FROM rec))
  SELECT split_part(feature, '_', 1) AS category, count(DISTINCT feature)::BIGINT AS features, count(DISTINCT exp_id)::BIGINT AS experiments, {r6('avg(eval_score)')} AS mean_score FROM u GROUP BY 1""")
def feature_catalog(spark, sf):
    """Features by category as the genomes of all experiments use them."""
    used = records(spark, sf).select("exp_id", "eval_score", F.explode(F.map_keys("genome")).alias("feature"))
    return used.groupBy(F.split("feature", "_")[0].alias("category")).agg(F.countDistinct("feature").alias("features"), F.countDistinct("exp_id").alias("experiments"), rnd(F.avg("eval_score")).alias("mean_score"))


@query("led.diagnostics", f"WITH {REC_SQL}, l AS (SELECT regime AS stage, arg_max(exp_id, (ts, exp_id)) AS latest FROM rec GROUP BY 1), r AS (SELECT exp_id FROM rec ORDER BY ts DESC, exp_id DESC LIMIT 20) SELECT 'latest' AS kind, stage, latest AS exp_id FROM l UNION ALL SELECT 'recent', NULL, exp_id FROM r")
def diagnostics(spark, sf):
    r = records(spark, sf)
    latest = r.groupBy(F.col("regime").alias("stage")).agg(F.max_by("exp_id", F.struct("ts", "exp_id")).alias("exp_id"))
    return latest.select(F.lit("latest").alias("kind"), "stage", "exp_id").unionByName(L.recent(r, 20, "ts").select(F.lit("recent").alias("kind"), F.lit(None).cast("string").alias("stage"), "exp_id"))


@query("led.signal_report", f"""WITH {REC_SQL}, a AS (SELECT template_id, sum(greatest(total_return_pct, 0)) / nullif(sum(greatest(-total_return_pct, 0)), 0) AS pf, count(*) AS n, date_diff('day', min(ts), max(ts)) AS d FROM rec GROUP BY 1)
  SELECT template_id, {r6('pf')} AS profit_factor, {r6('n / (d / 365.25)')} AS trades_per_year, n::BIGINT AS n FROM a""")
def signal_report(spark, sf):
    r = F.col("total_return_pct")
    a = records(spark, sf).groupBy("template_id").agg(F.try_divide(F.sum(F.greatest(r, F.lit(0.0))), F.sum(F.greatest(-r, F.lit(0.0)))).alias("pf"), F.count(F.lit(1)).alias("n"), F.datediff(F.max("ts"), F.min("ts")).alias("d"))
    return a.select("template_id", rnd("pf").alias("profit_factor"), rnd(F.col("n") / (F.col("d") / 365.25)).alias("trades_per_year"), "n")


def importance(spark, sf):
    """Category importances per regime in record order, dense sequence per regime."""
    from tickloom.operators.blocks import with_bar_idx
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    df = o.select(F.col("o_orderpriority").alias("regime"), F.struct("o_orderdate", "o_orderkey").alias("o"), F.date_trunc("month", "o_orderdate").alias("m"), *[((k % (i + 3)) / 10.0).alias(c) for i, c in enumerate(L.CATEGORIES)])
    return with_bar_idx(df, ("regime",), "o", F.col("m")).withColumnRenamed("bar_idx", "seq")


_imp = ", ".join(f"((o_orderkey % {i + 3}) / 10.0)::DOUBLE AS x{i}" for i in range(6))
_tot = "(" + " + ".join(f"x.x{i}" for i in range(6)) + ")"
_nw = [f"least(0.40::DOUBLE, greatest(0.05::DOUBLE, 0.9::DOUBLE * r.w{i} + 0.1::DOUBLE * (0.01::DOUBLE + x.x{i}) / nullif({_tot}, 0)))" for i in range(6)]
_dot = " + ".join(f"r.w{i} * (0.01::DOUBLE + x.x{i}) / nullif({_tot}, 0)" for i in range(6))
_n1, _n2 = " + ".join(f"r.w{i} * r.w{i}" for i in range(6)), " + ".join(f"pow((0.01::DOUBLE + x.x{i}) / nullif({_tot}, 0), 2)" for i in range(6))
_init = lambda e: __import__("re").sub(r"r\.w\d", "(1.0::DOUBLE / 6)", e).replace("r.cal", "0.5::DOUBLE").replace("x.x", "x")
_cols = {f"w{i}": f"CASE WHEN {_tot} > 0 THEN {_nw[i]} / ({' + '.join(_nw)}) ELSE r.w{i} END" for i in range(6)}
_cols["cal"] = f"CASE WHEN {_tot} > 0 THEN 0.9::DOUBLE * r.cal + 0.1::DOUBLE * ({_dot}) / (sqrt({_n1}) * sqrt({_n2})) ELSE r.cal END"
PRIOR_SQL, PRIOR = chain(f"imp AS MATERIALIZED (SELECT o_orderpriority AS symbol, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) - 1 AS bar_idx, {_imp} FROM orders)", Rec({n: (_init(e), e) for n, e in _cols.items()}), source="imp")
register("led.priors", lambda spark, sf: L.priors(importance(spark, sf)).select("regime", "seq", rnd("calibration").alias("calibration"), *[rnd(c).alias(c.lower()) for c in L.CATEGORIES]),
         f"{PRIOR_SQL} SELECT symbol AS regime, bar_idx::BIGINT AS seq, {r6('cal')} AS calibration, {', '.join(f'{r6(f'w{i}')} AS {c.lower()}' for i, c in enumerate(L.CATEGORIES))} FROM {PRIOR}")

# -- readers and writers -------------------------------------------------------------------------


def ledger_lines(spark, sf):
    r = records(spark, sf)
    body = F.to_json(F.struct("exp_id", F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("timestamp"), F.lit(1).alias("stage"), "regime", "template_id", "eval_score", "genome", "reason_codes", F.create_map(F.lit("win_rate"), F.col("win_rate")).alias("metrics")))
    wrong = F.regexp_replace(body, '"stage":1', '"stage":"oops"')  # one field of another type spoils the record
    return r.select(F.when(F.col("exp_id").endswith("7"), F.lit('{"exp_id": broken')).when(F.col("exp_id").endswith("3"), wrong).otherwise(body).alias("value"))


LEDGER_SQL = f"WITH {REC_SQL} SELECT exp_id, regime, {r6('eval_score')} AS eval_score, len(reason_codes)::BIGINT AS n_reasons FROM rec WHERE exp_id NOT LIKE '%7' AND exp_id NOT LIKE '%3'"


@query("src.ledger_file", LEDGER_SQL)
def src_ledger_file(spark, sf):
    """The same lines through a file of JSON lines in the shared folder."""
    import uuid

    from tickloom.session import materialize, remove, shared_folder
    path = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    ledger_lines(spark, sf).write.text(path)
    out = materialize(L.read_ledger(spark, path).select("exp_id", "regime", rnd("eval_score").alias("eval_score"), F.size("reason_codes").cast("bigint").alias("n_reasons")))
    remove(spark, path)
    return out


@query("src.ledger", LEDGER_SQL)
def src_ledger(spark, sf):
    return L.parse_ledger(ledger_lines(spark, sf)).select("exp_id", "regime", rnd("eval_score").alias("eval_score"), F.size("reason_codes").cast("bigint").alias("n_reasons"))


register("src.logs", lambda spark, sf: L.recent(records(spark, sf), 50, "ts").select("exp_id", "regime"), f"WITH {REC_SQL} SELECT exp_id, regime FROM rec ORDER BY ts DESC, exp_id DESC LIMIT 50")
register("snk.prune", lambda spark, sf: L.prune(records(spark, sf), 100).select("exp_id", rnd("eval_score").alias("eval_score")), f"WITH {REC_SQL} SELECT exp_id, {r6('eval_score')} AS eval_score FROM rec ORDER BY coalesce(eval_score, -9999) DESC, exp_id LIMIT 100")


@query("snk.ledger", f"WITH {REC_SQL} SELECT regime, count(*)::BIGINT AS n FROM rec GROUP BY 1")
def snk_ledger(spark, sf):
    """Append to a partitioned parquet ledger below the checkpoint folder and read it back."""
    import uuid

    from tickloom.session import materialize, remove, shared_folder
    path = f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"
    r = records(spark, sf).select("exp_id", "regime", "eval_score", (F.length("regime") % 4).alias("stage"))
    L.append(r, path)
    out = materialize(spark.read.parquet(path).groupBy("regime").agg(F.count(F.lit(1)).alias("n")))
    remove(spark, path)
    return out


@query("prep.policy_id", """WITH p AS (SELECT p_partkey AS k, p_brand AS rules, p_size AS s FROM part) SELECT k AS part, 'pol_' || substr(sha256('{"genome":{"A_V1":{"length":' || printf('%.8f', (s / 3.0)::DOUBLE) || ',"window":' || printf('%.8f', s::DOUBLE) || '},"B_V1":{"fast":' || printf('%.8f', (k % 7)::DOUBLE) || '}},"risk_budget":{"k_down":' || printf('%.8f', 0.5::DOUBLE) || ',"k_up":' || printf('%.8f', (s / 10.0)::DOUBLE) || '},"rules":"' || rules || '"}'), 1, 16) AS policy_id FROM p""")
def prep_policy_id(spark, sf):
    k, s = F.col("p_partkey"), F.col("p_size")
    genome = F.create_map(F.lit("B_V1"), F.create_map(F.lit("fast"), (k % 7).cast("double")), F.lit("A_V1"), F.create_map(F.lit("window"), s.cast("double"), F.lit("length"), s / 3.0))
    budget = F.create_map(F.lit("k_up"), s / 10.0, F.lit("k_down"), F.lit(0.5))
    return table(spark, sf, "part").select(k.alias("part"), L.policy_id(genome, F.col("p_brand"), budget).alias("policy_id"))
