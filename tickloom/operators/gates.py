"""Validation gates and scores as projections over a metrics table joined with stage thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import settings as S
from tickloom.functions.num import clip, div
from tickloom.operators.quantiles import with_quantiles
from tickloom.session import materialize

CODES = ["FAIL_NO_CYCLE", "FAIL_INVALID_ACTION", "FAIL_MIN_TRADES", "FAIL_MAX_TRADES", "FAIL_MIN_FLIPS", "FAIL_MAX_FLIPS", "FAIL_LOW_EXPOSURE",
         "FAIL_LOW_RETURN", "FAIL_WINRATE_LOW", "FAIL_WINRATE_HIGH", "FAIL_MDD_BREACH", "FAIL_PF", "FAIL_LUCKY_STRIKE", "FAIL_SIGNAL_DEGENERATE"]


def c(n: str) -> Column:
    return F.col(n)


def below(value: Column, minimum: Column) -> Column:
    return F.when(minimum <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), div(minimum - value, minimum)))


def above(value: Column, maximum: Column) -> Column:
    return F.when(maximum <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), div(value - maximum, maximum)))


def with_stage(metrics: DataFrame, spec: DataFrame) -> DataFrame:
    """Metrics joined to their stage; ``stage_spec`` has four rows."""
    return metrics.join(F.broadcast(spec.drop("name")), "stage_id")


def _inputs() -> dict[str, Column]:
    years = F.when(c("bars_total") > 0, c("bars_total") / S.BARS_PER_YEAR).otherwise(1.0)
    t0, r0, p0 = S.DEGENERATE
    return {
        "entries": c("entry_count") / years, "flips": (c("entry_count") + c("exit_count")) / years,
        "degenerate": F.greatest(below(c("trade_count").cast("double"), F.lit(t0)), below(c("entry_signal_rate"), F.lit(r0)), below(c("exposure_ratio"), F.lit(p0)))}


def failures(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """One row per failed gate: code, relative distance, hard flag, order."""
    x = _inputs()
    hard3, soft = c("stage_id") >= 3, F.lit(True)
    rules = [
        (c("cycle_count") <= 0, F.lit(1.0), soft), (c("invalid_action_rate") > S.MAX_INVALID_RATE, c("invalid_action_rate") - S.MAX_INVALID_RATE, soft),
        (x["entries"] < c("min_entries_per_year"), below(x["entries"], c("min_entries_per_year")), soft),
        (x["entries"] > c("max_entries_per_year"), above(x["entries"], c("max_entries_per_year")), soft),
        (x["flips"] < c("min_flips_per_year"), below(x["flips"], c("min_flips_per_year")), hard3),
        (x["flips"] > c("max_flips_per_year"), above(x["flips"], c("max_flips_per_year")), soft),
        (c("exposure_ratio") < S.MIN_EXPOSURE, below(c("exposure_ratio"), F.lit(S.MIN_EXPOSURE)), soft),
        (c("excess_return") < c("alpha_floor"), (c("alpha_floor") - c("excess_return")) / F.greatest(F.lit(1.0), F.abs("alpha_floor")), soft),
        (c("win_rate") < S.WINRATE_MIN, below(c("win_rate"), F.lit(S.WINRATE_MIN)), soft), (c("win_rate") > S.WINRATE_MAX, above(c("win_rate"), F.lit(S.WINRATE_MAX)), soft),
        (c("max_drawdown_pct") > c("max_mdd_pct"), above(c("max_drawdown_pct"), c("max_mdd_pct")), soft),
        (c("profit_factor") < c("min_profit_factor"), below(c("profit_factor"), c("min_profit_factor")), soft),
        (c("top1_share") > S.TOP1_MAX, above(c("top1_share"), F.lit(S.TOP1_MAX)), soft),
        (x["degenerate"] > 0, x["degenerate"], c("signal_degeneracy_mode") == "hard")]
    cells = [F.when(hit, F.struct(F.lit(i).alias("ord"), F.lit(code).alias("code"), dist.alias("distance"), hard.alias("is_hard")))
             for i, (code, (hit, dist, hard)) in enumerate(zip(CODES, rules))]
    return metrics.select(*keys, "stage_id", F.explode(F.array_compact(F.array(*cells))).alias("f")).select(*keys, "stage_id", "f.*")


def failure_array() -> Column:
    """Distance of every gate in absolute units, in gate order."""
    x = _inputs()
    pos = lambda v: F.greatest(F.lit(0.0), v)
    return F.array(
        pos(1.0 - c("cycle_count")), pos(c("invalid_action_rate") - S.MAX_INVALID_RATE), pos(c("min_entries_per_year") - x["entries"]), pos(x["entries"] - c("max_entries_per_year")),
        pos(c("min_flips_per_year") - x["flips"]), pos(x["flips"] - c("max_flips_per_year")), pos(S.MIN_EXPOSURE - c("exposure_ratio")), pos(c("alpha_floor") - c("excess_return")),
        pos(S.WINRATE_MIN - c("win_rate")), pos(c("win_rate") - S.WINRATE_MAX), pos(c("max_drawdown_pct") - c("max_mdd_pct")), pos(c("min_profit_factor") - c("profit_factor")),
        pos(c("top1_share") - S.TOP1_MAX), pos(x["degenerate"]))


def distances(metrics: DataFrame) -> DataFrame:
    """Adds the distance array, the soft gate score and the nearest gate (first maximum)."""
    d = metrics.withColumn("distances", failure_array())
    weight = [F.when(c("stage_id") < 3, 0.0).otherwise(1.0) if code == "FAIL_MIN_FLIPS" else F.lit(1.5 if code == "FAIL_SIGNAL_DEGENERATE" else 1.0) for code in CODES]
    soft = -sum((w * c("distances")[i] for i, w in enumerate(weight)), F.lit(0.0))
    top = F.array_max("distances")
    names = F.array(*[F.lit(code) for code in CODES])
    nearest = F.when(top <= 0, "PASS").otherwise(F.element_at(names, F.array_position("distances", top).cast("int")))
    return d.withColumns({"soft_gate_score": soft, "nearest_gate": nearest})


def validate(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Pass flag and first hard failure per row."""
    hard = failures(metrics, keys).filter("is_hard").groupBy(*keys).agg(F.min_by("code", "ord").alias("first_fail"))
    return metrics.join(hard, keys, "left").withColumns({"passed": F.col("first_fail").isNull(), "reason": F.coalesce("first_fail", F.lit("PASS"))}).drop("first_fail")


def violation() -> Column:
    return ((c("invalid_action_rate") > S.MAX_INVALID_RATE) | (c("cycle_count") <= 0) | (c("trade_count") < S.MIN_TRADES) | (c("max_drawdown_pct") > S.MAX_MDD))


def stage_reasons() -> Column:
    """Requirement reasons of the current stage, in order; empty means passed."""
    return F.array_compact(F.array(
        F.when(c("trades_per_year") < c("min_trades_per_year"), "LOW_TRADES"), F.when(F.abs("max_drawdown_pct") > c("max_mdd_pct"), "MDD"),
        F.when(c("excess_return") < c("alpha_floor"), "ALPHA_BELOW_FLOOR"), F.when(c("total_return_pct") < c("target_return_pct"), "TARGET_RETURN"),
        F.when(c("profit_factor") < c("min_profit_factor"), "LOW_PF")))


def api_status() -> Column:
    """Reason a record is rejected; empty text means approved."""
    return (F.when(c("trade_count") < S.MIN_TRADES, "MIN_TRADES").when(c("max_drawdown_pct") > S.MAX_MDD, "MAX_MDD").when(c("win_rate") > S.WINRATE_MAX, "WINRATE_HIGH")
            .when((c("trade_count") >= 30) & (c("win_rate") < S.WINRATE_MIN), "WINRATE_LOW").when((c("trade_count") >= 20) & (c("reward_risk") < 0.5), "RR_LOW").otherwise(""))


def reward_risk_bonus() -> Column:
    rr = c("reward_risk")
    return (F.when(rr >= 2.0, 50.0).when(rr >= 1.5, 25.0 + (rr - 1.5) / 0.5 * 25.0).when(rr >= 1.0, (rr - 1.0) / 0.5 * 25.0).otherwise(-25.0 * (1.0 - rr)))


def sample_score() -> Column:
    """200 x return, reward/risk bonus, penalties for drawdown, volatility, few trades and a suspicious win rate."""
    n, wr = c("trade_count"), c("win_rate")
    few = F.when(n < 100, (100 - F.greatest(n, F.lit(0))) * 0.2).otherwise(0.0)
    high = F.when(wr > 0.80, (wr - 0.80) * 100.0 * 500.0).otherwise(0.0)
    return F.greatest(F.lit(S.SCORE_MIN), c("total_return_pct") * 200.0 + reward_risk_bonus() - c("max_drawdown_pct") * 30.0 - c("vol_pct") * 5.0 - few - high)


def robust_score(med: Column, q: Column, sd: Column, viol: Column) -> Column:
    return med + 0.8 * q - 5.0 * sd - 100.0 * viol


def aggregate_scores(samples: DataFrame, keys: list[str], score: str = "score", viol: str = "violation") -> DataFrame:
    samples = materialize(samples.select(*keys, score, viol))
    agg = samples.groupBy(*keys).agg(F.coalesce(F.stddev_samp(score), F.lit(0.0)).alias("std_score"), F.avg(F.col(viol).cast("double")).alias("violation_rate"))
    agg = with_quantiles(agg, samples, keys, median_score=(score, 0.5), p10_score=(score, S.LOWER_Q))
    return agg.withColumn("score", robust_score(c("median_score"), c("p10_score"), c("std_score"), c("violation_rate")))


def normalize(df: DataFrame, within: list[str], score: str = "raw_score") -> DataFrame:
    """z-score within each window from an aggregation joined back; 0 when the deviation vanishes."""
    stats = df.groupBy(*within).agg(F.avg(score).alias("_m"), F.stddev_samp(score).alias("_s"))
    z = F.when(F.coalesce(F.col("_s"), F.lit(0.0)) <= 1e-12, 0.0).otherwise(div(F.col(score) - F.col("_m"), F.col("_s")))
    return df.join(stats, within).withColumn("normalized_score", z).drop("_m", "_s")


def finalize(windows: DataFrame, keys: list[str], spec: DataFrame) -> DataFrame:
    """Module score with walk-forward consistency: hard mode rejects, soft mode subtracts 10 x the worst gap."""
    by = [*keys, "stage_id"]
    windows = materialize(windows.select(*by, "normalized_score", "violation_rate", "avg_alpha"))
    agg = windows.groupBy(*by).agg(F.coalesce(F.stddev_samp("normalized_score"), F.lit(0.0)).alias("s"), F.avg("violation_rate").alias("v"), F.min("avg_alpha").alias("worst"))
    agg = with_quantiles(agg, windows, by, m=("normalized_score", 0.5), q=("normalized_score", S.LOWER_Q))
    j = agg.join(F.broadcast(spec.select("stage_id", "alpha_floor", "wf_gate_mode")), "stage_id")
    bad = c("worst") < c("alpha_floor")
    base = robust_score(c("m"), c("q"), c("s"), c("v")) - F.when(bad, F.abs(c("worst") - c("alpha_floor")) * 10.0).otherwise(0.0)
    return j.select(*keys, F.when(bad & (c("wf_gate_mode") == "hard"), S.SCORE_MIN).otherwise(F.greatest(F.lit(S.SCORE_MIN), base)).alias("score"))


# Penalty per failed gate and weight of its distance when a policy is rejected.
PENALTY = {"FAIL_MIN_TRADES": (-10.0, -12.0), "FAIL_LOW_EXPOSURE": (-8.0, -10.0), "FAIL_LOW_RETURN": (-12.0, -12.0), "FAIL_WINRATE_LOW": (-8.0, -8.0),
           "FAIL_WINRATE_HIGH": (-10.0, -8.0), "FAIL_MDD_BREACH": (-20.0, -20.0), "FAIL_PF": (-10.0, -8.0), "FAIL_LUCKY_STRIKE": (-15.0, -12.0), "FAIL_SIGNAL_DEGENERATE": (-8.0, -10.0)}


def reward(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Reward with its components; a hard failure switches to the rejection branch (penalties, near-pass tag)."""
    look = lambda i: F.coalesce(F.create_map(*[x for k, v in PENALTY.items() for x in (F.lit(k), F.lit(v[i]))])[c("code")], F.lit(0.0))
    f = failures(metrics, keys).withColumns({"p": look(0), "w": look(1)})
    soft = ~c("is_hard")
    fa = f.groupBy(*keys).agg(
        F.count_if("is_hard").alias("n_hard"), F.sum(F.when(c("is_hard"), c("distance")).otherwise(0.0)).alias("hard_dist"), F.sum("distance").alias("distance_score"),
        F.sum(c("p") * (1 + 0.75 * c("distance")) + c("w") * F.pow("distance", 1.1)).alias("rejected_sum"),
        F.sum(F.when(soft, c("p") + c("w") * c("distance")).otherwise(0.0)).alias("soft_sum"), F.min_by("code", F.when(c("is_hard"), c("ord"))).alias("rejection_reason"))
    j = metrics.join(fa, keys, "left")
    n = c("trade_count").cast("double")
    rr = c("reward_risk")
    r_return = F.tanh(c("excess_return") / 100.0) * 3.0
    r_rr = F.when(rr >= 2.0, 1.0).when(rr >= 1.5, 0.5 + (rr - 1.5)).when(rr >= 1.0, rr - 1.0).otherwise(-clip((1 - rr) * 2.0, -1, 1))
    r_top = F.when(c("top1_share") <= 0.2, 1.0).when(c("top1_share") <= 0.4, 0.5).otherwise(0.0)
    share = n / 200.0
    r_trades = clip(F.when(n >= 200, 1.0).when(c("stage_id") == 1, F.sqrt(share)).otherwise(share), 0, 1)
    mdd = F.abs("max_drawdown_pct")
    r_mdd = F.when(mdd > 25.0, -clip((mdd - 25.0) / 25.0, -1, 1)).otherwise(0.0)
    r_win = F.when(c("win_rate") > 0.8, -clip((c("win_rate") - 0.8) / 0.2, -1, 1)).otherwise(0.0)
    r_cx = F.when(c("complexity_score") > 0, -clip(c("complexity_score") * 0.03, 0, 0.4)).otherwise(0.0)
    r_luck = F.when(c("top1_share") > S.TOP1_MAX, -clip((c("top1_share") - S.TOP1_MAX) * 5.0, -1, 1)).otherwise(0.0)
    cost = n * 10.0 * 0.01
    r_cost = F.when(cost > 0, F.tanh(div("total_return_pct", cost) / 3.0)).otherwise(0.0)
    w_return = F.when(c("stage_id") == 1, 1.0).when(c("stage_id") == 2, 2.0).otherwise(3.0)
    total = (w_return * r_return + r_rr + r_top + 1.5 * r_trades + 0.5 * r_mdd + r_win + r_cx + r_luck + 0.2 * 0.5 + 0.3 * r_cost + 0.5 * F.coalesce("soft_sum", F.lit(0.0)))
    rejected = F.coalesce(c("n_hard"), F.lit(0)) > 0
    lost = F.greatest(F.lit(-200.0), c("reject_base_penalty") + F.coalesce("rejected_sum", F.lit(0.0)))
    near = F.when((c("n_hard") <= 2) & (c("hard_dist") <= 0.35), "NEAR_PASS").otherwise("HARD_FAIL")
    part = lambda v: F.when(rejected, -1.0).otherwise(v)
    return j.select(
        *keys, F.when(rejected, lost).otherwise(total).alias("total"), part(r_return).alias("return_component"), part(r_rr).alias("rr_component"), part(r_top).alias("top_trades_component"),
        part(r_trades).alias("trades_component"), part(r_mdd).alias("mdd_penalty"), part(r_win).alias("winrate_penalty"), rejected.alias("is_rejected"), "rejection_reason",
        F.coalesce("distance_score", F.lit(0.0)).alias("distance_score"), F.when(rejected, near).otherwise("PASS").alias("replay_tag"))


def opportunity_score(df: DataFrame) -> DataFrame:
    """Alpha opportunity score and viability verdict from return, cost, frequency and share of windows with positive alpha."""
    n = c("trade_count")
    cost = n * c("cost_bps") * 0.01
    aos = clip(0.4 * F.tanh(F.greatest(F.lit(0.0), div("total_return_pct", cost + 0.1)) / 5.0) + 0.3 * F.tanh(c("trades_per_year") / 100.0) + 0.3 * c("consistency"), 0, 1)
    verdict = F.when(c("total_return_pct") < cost * 1.5, "LOW_NET_PnL").when(c("trades_per_year") < 15, "LOW_FREQUENCY").otherwise("VIABLE")
    return df.withColumns({"aos": F.when(n <= 0, 0.0).otherwise(aos), "viability": verdict})


def reallocate(df: DataFrame, within: list[str], aos: str = "aos", session: str = "session_id", vol: str = "vol_level", tau: float = 0.1) -> DataFrame:
    """Softmax weights of the opportunity scores times session and volatility multipliers, renormalised."""
    top = df.groupBy(*within).agg(F.max(aos).alias("_top"))
    ms = F.when(c(session).isin(1, 2), 1.2).when(c(session) == 0, 0.8).when(c(session) == 3, 0.5).otherwise(1.0)
    mv = F.when(c(vol) < 0.7, 1.5).when(c(vol) > 2.0, 0.5).otherwise(1.0)
    e = df.join(top, within).withColumn("_e", F.exp((c(aos) - c("_top")) / tau) * ms * mv)
    total = e.groupBy(*within).agg(F.sum("_e").alias("_sum"))
    return e.join(total, within).withColumn("weight", div("_e", "_sum")).drop("_e", "_sum", "_top")


def _robustness(floor: Column) -> Column:
    """Aggregate over windows: share with alpha at the floor or above, less the mean violation rate."""
    return F.avg((c("avg_alpha") >= floor).cast("double")) - F.avg("violation_rate")


def robustness(windows: DataFrame, keys: list[str], floor: Column) -> DataFrame:
    return windows.groupBy(*keys).agg(_robustness(floor).alias("robustness"))


def selection_score(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Performance, progress and robustness with their sum (all weights are 1). ``metrics``: one row per window, with its reward and soft gate score.

    Performance and progress are the reward and the soft gate score of one row, the best: it scores its soft gate score where a
    hard gate fails, and the earlier window wins ties. Robustness is that of all windows; a failed hard gate is a violation.
    """
    score = F.when(c("is_rejected"), c("soft_gate_score")).otherwise(sample_score())
    w = metrics.withColumns({"_loss": -score, "avg_alpha": c("excess_return"), "violation_rate": c("is_rejected").cast("double")})
    best = F.min_by(F.struct("total", "soft_gate_score"), F.struct("_loss", "window_id"))
    a = w.groupBy(*keys).agg(best.alias("_b"), _robustness(c("alpha_floor")).alias("robustness"))
    a = a.select(*keys, c("_b.total").alias("performance"), c("_b.soft_gate_score").alias("progress"), "robustness")
    return a.withColumn("score", c("performance") + c("progress") + c("robustness"))


def stability(mean: Column, sd: Column, worst: Column, wr: Column, n: Column, min_trades: int = 30) -> tuple[Column, Column]:
    """(passes, volatility ratio) of cross-validated returns."""
    ratio = sd / (F.abs(mean) + 1e-9)
    return (n >= min_trades) & (wr >= 0.5) & (mean > 0.0) & (worst >= 0.0) & (ratio <= 3.0), ratio


def top_share(df: DataFrame, share: float, score: str = "score", tie: str = "policy_id") -> DataFrame:
    """Best ``share`` of the rows (rounded, at least one) with their rank.

    Ranks come from counts of score buckets, cut at approximate percentiles, plus a rank inside the bucket, so the table is
    never sorted in one task.
    """
    from tickloom.operators.blocks import with_bar_idx
    from tickloom.operators.quantiles import slot_edges, slot_of

    df = materialize(df)
    keyed = df.withColumns({"_k": F.lit(0), "_o": F.struct((-F.col(score)).alias("a"), F.col(tie).alias("b"))})
    keyed = keyed.join(F.broadcast(df.agg(slot_edges(-F.col(score)).alias("_edges")).withColumn("_k", F.lit(0))), "_k")
    bucketed = materialize(keyed.withColumn("_bucket", slot_of(-F.col(score), F.col("_edges"))).drop("_edges"))  # a second sketch may cut elsewhere
    ranked = with_bar_idx(bucketed, ("_k",), "_o", F.col("_bucket")).drop("_bucket")
    cut = df.agg(F.greatest(F.lit(1), F.bround(F.count(F.lit(1)) * share).cast("int")).alias("_n")).withColumn("_k", F.lit(0))
    return ranked.join(cut, "_k").filter(F.col("bar_idx") < F.col("_n")).withColumn("rank", F.col("bar_idx") + 1).drop("_k", "_o", "_n", "bar_idx")
