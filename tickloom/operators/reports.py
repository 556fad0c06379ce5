"""Batch and episode analytics: episodes roll up to batches, batches are compared with their history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.num import div
from tickloom.operators.quantiles import with_quantiles
from tickloom.session import materialize

# Histogram bins of the batch report.
TRADE_BINS = [0, 1, 2, 3, 5, 10, 20, 50, 100]
HOLD_BINS = [0, 1, 2, 5, 10, 20, 50, 100, 200, 500]


def episode_tags() -> Column:
    """ONE_SHOT_HOLD, OVER_FILTER, RARE_SIGNAL tags of an episode, sorted."""
    one = (F.col("trade_count") == 1) & ((F.col("avg_hold_bars") / F.greatest(F.col("total_bars"), F.lit(1)) >= 0.7) | (F.col("horizon_ratio") >= 0.7))
    rare = (F.col("trade_count") <= 1) | (F.col("entry_rate") <= 0.001)
    over = (F.col("entry_rate") <= 0.002) & (F.col("complexity") >= 4.0)
    return F.array_compact(F.array(F.when(one, "ONE_SHOT_HOLD"), F.when(over, "OVER_FILTER"), F.when(rare, "RARE_SIGNAL")))


def histogram(df: DataFrame, keys: list[str], value: str, bins: list[int]) -> DataFrame:
    """Counts per bin (left-closed, the last bin also right-closed): one conditional count per bin."""
    v = F.col(value)
    cells = []
    for i in range(len(bins) - 1):
        inside = (v >= bins[i]) & ((v <= bins[i + 1]) if i == len(bins) - 2 else (v < bins[i + 1]))
        cells.append(F.struct(F.lit(bins[i]).alias("lo"), F.count_if(inside).alias("n")))
    return df.groupBy(*keys).agg(F.array(*cells).alias("h")).select(*keys, F.explode("h").alias("e")).select(*keys, "e.lo", "e.n")


def summary_stats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    df = materialize(df.select(*keys, value))
    return with_quantiles(df.groupBy(*keys).agg(F.avg(value).alias("mean")), df, keys, p10=(value, 0.1), p90=(value, 0.9))


def top_values(df: DataFrame, keys: list[str], value: str, k: int = 3, digits: int = 3) -> DataFrame:
    """Most frequent rounded values (ties: smaller value first)."""
    n = df.groupBy(*keys, F.round(value, digits).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.col("n").desc(), "value")
    return n.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= k)


def correlation(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Pearson correlation with the status ok, insufficient or constant."""
    a = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(x).alias("sx"), F.stddev_pop(y).alias("sy"), F.covar_pop(x, y).alias("c"))
    status = F.when(F.col("n") < 2, "insufficient").when((F.col("sx") == 0) | (F.col("sy") == 0), "constant").otherwise("ok")
    return a.select(*keys, F.when(status == "ok", div("c", F.col("sx") * F.col("sy"))).otherwise(0.0).alias("value"), status.alias("status"))


def module_params(key: Column) -> dict[str, Column]:
    """Midpoints of target, stop and horizon parsed from a ``|``-separated module key; NULL when malformed."""
    def rng(part: int, prefix: str) -> tuple[Column, Column]:
        text = F.try_element_at(F.split(key, r"\|"), F.lit(part))
        bits = F.split(text, "_")
        num = lambda i: F.when(text.startswith(prefix), F.try_to_number(F.try_element_at(bits, F.lit(i)), F.lit("9999.9999")).cast("double"))
        return num(2), num(3)

    mid = {n: (lambda ab: (ab[0] + ab[1]) / 2)(rng(i, p)) for n, i, p in (("tp_mid", 3, "tp_"), ("sl_mid", 4, "sl_"), ("h_mid", 5, "h_"))}
    whole = mid["tp_mid"].isNotNull() & mid["sl_mid"].isNotNull() & mid["h_mid"].isNotNull()
    out = {n: F.when(whole, v) for n, v in mid.items()}
    out["rr_mid"] = F.when(whole, F.coalesce(div(mid["tp_mid"], mid["sl_mid"]), F.lit(0.0)))
    return out


def batch_report(ep: DataFrame, key: str = "batch_id") -> DataFrame:
    """One row per batch: rates, medians, reward spread, collapse flag, dominant gate and reason."""
    ep = materialize(ep)
    a = ep.groupBy(key).agg(
        F.count(F.lit(1)).alias("episodes"), F.avg(F.col("gate_pass").cast("double")).alias("gate_pass_rate"), F.avg("reward").alias("reward_mean"), F.var_pop("reward").alias("reward_variance"), F.countDistinct(F.round("reward", 3)).alias("reward_unique"),
        F.avg("entry_rate").alias("entry_rate_mean"), F.avg("invalid_rate").alias("invalid_rate_mean"), F.avg("distance").alias("distance_mean"),
        F.avg(F.array_contains("tags", "ONE_SHOT_HOLD").cast("double")).alias("one_shot_rate"), F.avg(F.array_contains("tags", "RARE_SIGNAL").cast("double")).alias("rare_rate"))
    a = with_quantiles(a, ep, [key], median_trades=("trade_count", 0.5), median_cycles=("cycle_count", 0.5), median_hold=("avg_hold_bars", 0.5))
    gates = ep.filter("nearest_gate <> 'PASS'").groupBy(key, "nearest_gate").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
    top = gates.groupBy(key).agg(F.max_by("nearest_gate", F.struct(F.col("n"), -F.col("first"))).alias("gate_focus"), (F.max("n") / F.sum("n")).alias("gate_ratio"))
    collapsed = (F.sqrt("reward_variance") < 1e-4) | (F.col("reward_unique") < 3)
    return a.join(top, key, "left").withColumn("collapsed", collapsed)


def history(n: int, key: str = "batch_id", current: bool = True):
    """Frame over the last n batches; batches are one row each, a short driver-sized series."""
    return Window.orderBy(key).rowsBetween(-(n - 1), 0) if current else Window.orderBy(key).rowsBetween(-n, -1)


def deadlock(batches: DataFrame) -> DataFrame:
    w = history(20)
    m, v, g = F.percentile("median_cycles", F.lit(0.5)).over(w), F.avg("reward_variance").over(w), F.avg("gate_pass_rate").over(w)
    return batches.select("batch_id", m.alias("median_cycle"), v.alias("mean_reward_variance"), g.alias("mean_gate_pass"), ((m <= 1.0) & (v <= 1e-4) & (g <= 0.01)).alias("deadlock"))


def collapse_trend(batches: DataFrame) -> DataFrame:
    n = F.sum(F.col("collapsed").cast("int")).over(history(5))
    return batches.withColumns({"collapse_count": n, "collapse_trend": n >= 3})


def regression_signals(batches: DataFrame) -> DataFrame:
    """R1 deadlock, R2 one shot, R3 invalid actions, R4 selection distortion, R5 reward collapse."""
    b = collapse_trend(batches)
    past = F.avg("distance_mean").over(history(5, current=False))
    stuck = F.coalesce(past - F.col("distance_mean") < 0.05, F.lit(False))
    return b.select(
        "batch_id", ((F.col("median_cycles") <= 1) & (F.col("reward_variance") <= 1e-4) & (F.col("gate_pass_rate") <= 0.01)).alias("r1"),
        ((F.col("one_shot_rate") >= 0.6) | (F.col("median_hold") >= 150)).alias("r2"), (F.col("invalid_rate_mean") >= 0.1).alias("r3"),
        ((F.coalesce("gate_ratio", F.lit(0.0)) >= 0.8) & stuck).alias("r4"), F.col("collapse_trend").alias("r5"))


def failure_mode(batches: DataFrame, max_trade_median: float = 2.0) -> DataFrame:
    """continue, stop or refactor with the reason, and the change against the mean of the last five batches."""
    b = collapse_trend(batches)
    dead = (F.col("median_cycles") <= 1) & (F.col("reward_variance") <= 1e-4) & (F.col("gate_pass_rate") <= 0.01)
    reason = F.when(F.col("median_trades") <= max_trade_median, "trade_median_low").when(dead, "deadlock_r1").when(F.col("collapse_trend"), "reward_collapse_trend").otherwise("none")
    action = F.when(reason == "none", "continue").when(reason == "trade_median_low", "stop").otherwise("refactor")
    return b.select("batch_id", action.alias("action"), reason.alias("reason"), (F.col("gate_pass_rate") - F.avg("gate_pass_rate").over(history(5, current=False))).alias("gate_trend"))


def stage_rules(batches: DataFrame, rules: DataFrame) -> DataFrame:
    """Rule table (rule, metric, op, threshold) against unpivoted batch metrics: passed flag and failed rules per batch."""
    names = ["gate_pass_rate", "median_trades", "one_shot_rate", "invalid_rate_mean"]
    long = batches.select("batch_id", F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("v")) for n in names])).alias("e")).select("batch_id", "e.*")
    ok = F.when(F.col("op") == ">=", F.col("v") >= F.col("threshold")).otherwise(F.col("v") <= F.col("threshold"))
    j = long.join(F.broadcast(rules), "metric").withColumn("ok", ok)
    return j.groupBy("batch_id").agg(F.bool_and("ok").alias("passed"), F.concat_ws(",", F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("rule"))))).alias("failed"))


def stagnation(batches: DataFrame) -> DataFrame:
    """Cause of missing progress over the history of best scores."""
    recent = F.max("best_score").over(history(3))
    past = F.coalesce(F.max("best_score").over(Window.orderBy("batch_id").rowsBetween(Window.unboundedPreceding, -3)), F.first("best_score").over(Window.orderBy("batch_id").rowsBetween(Window.unboundedPreceding, 0)))
    moved = F.coalesce(F.lag("regime").over(Window.orderBy("batch_id")) != F.col("regime"), F.lit(False))
    cause = (F.when(recent - past >= 0.05, F.when((F.col("gate_pass_rate") < 0.01) & (F.col("best_score") < -50), "COLLAPSE").otherwise("HEALTHY"))
             .when(F.col("gate_pass_rate") < 0.15, "PASS_RATE_TOO_LOW").when(F.col("diversity") < 0.4, "DIVERSITY_COLLAPSE")
             .when((F.col("zero_trade_ratio") > 0.4) | (F.col("mean_trades") < 5), "NO_TRADE").when(moved, "REGIME_MISMATCH").otherwise("SPACE_TOO_NARROW"))
    return batches.select("batch_id", cause.alias("cause"))


def quality(ep: DataFrame, key: str = "batch_id") -> DataFrame:
    ep = materialize(ep.select(key, "score", "trade_count", "cycle_count"))
    a = ep.groupBy(key).agg(F.max("score").alias("best_score"), F.avg("score").alias("mean_score"), F.avg("trade_count").alias("mean_trades"),
                            F.avg((F.col("trade_count") == 0).cast("double")).alias("zero_trade_ratio"), F.avg((F.col("cycle_count") == 0).cast("double")).alias("zero_cycle_ratio"))
    return with_quantiles(a, ep, [key], median_score=("score", 0.5))


def template_summary(ep: DataFrame, keys: list[str]) -> DataFrame:
    """Per template: count and the fields of its best episode (the last one on ties)."""
    return ep.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max_by(F.struct("policy_id", "score", "trade_count"), F.struct("score", "ord")).alias("b")).select(*keys, "n", "b.*")


def walk_forward(windows: DataFrame, floor: float) -> DataFrame:
    """Share of policies whose every window alpha reaches the floor; mean of the smallest alpha and of the deviation."""
    per = windows.groupBy("policy_id").agg(F.min("avg_alpha").alias("lo"), F.stddev_pop("avg_alpha").alias("sd"))
    return per.agg(F.avg((F.col("lo") >= floor).cast("double")).alias("consistent_share"), F.avg("lo").alias("mean_min_alpha"), F.avg("sd").alias("mean_std_alpha"))


def qa_report(ep: DataFrame, taxonomy: DataFrame, key: str = "batch_id") -> DataFrame:
    """Pass rate, failures per category and RIGID / SOFT status of a batch."""
    fails = ep.filter("not gate_pass").join(F.broadcast(taxonomy), ep.reason == taxonomy.code, "left")
    cats = fails.groupBy(key).agg(*[F.count_if(F.coalesce("category", F.lit("UNKNOWN_ISSUE")) == c).alias(c.lower()) for c in ("SIGNAL_ISSUE", "EDGE_ISSUE", "RISK_ISSUE", "UNKNOWN_ISSUE")])
    p = ep.groupBy(key).agg(F.avg(F.col("gate_pass").cast("double")).alias("pass_rate"), F.count(F.lit(1)).alias("n"))
    status = F.when((1 - F.col("pass_rate") > 0.9) | (F.col("pass_rate") < 0.01), "RIGID").otherwise("SOFT")
    return p.join(cats, key, "left").na.fill(0).withColumn("status", status)
