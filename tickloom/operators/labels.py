"""Barrier labels, cross-validation splits and statistics, calibration and tail risk."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.num import div
from tickloom.operators.blocks import GRID, GROUP_KEY, Grid, core_only, with_lookahead
from tickloom.operators.quantiles import exact_quantiles


def barrier_events(bars: DataFrame, k_up: float = 1.0, k_down: float = 1.0, horizon: int = 20, min_ret: float = 1e-5, vol: str = "vol", grid: Grid = GRID) -> DataFrame:
    """First touch of close * (1 +- k vol) within the next ``horizon`` bars, event bar included; a tie is -1, no touch 0.

    The forward frame is bounded, so every group of bars only looks ahead into copies of the next rows.
    """
    ahead = with_lookahead(bars, horizon, grid)
    w = Window.partitionBy("symbol", GROUP_KEY).orderBy("bar_idx").rowsBetween(0, horizon)
    path = F.collect_list("close").over(w)
    up, dn = F.col("close") * (1 + k_up * F.col(vol)), F.col("close") * (1 - k_down * F.col(vol))
    df = ahead.withColumns({"_path": path, "_up": up, "_dn": dn})
    at = lambda cond: F.array_position(F.transform("_path", cond), True) - 1
    df = df.withColumns({"_u": at(lambda p: p >= F.col("_up")), "_d": at(lambda p: p <= F.col("_dn"))})
    hit_u, hit_d = F.col("_u") >= 0, F.col("_d") >= 0
    label = F.when(hit_d & (~hit_u | (F.col("_d") <= F.col("_u"))), -1).when(hit_u, 1).otherwise(0)
    touch = F.when(label == -1, F.col("_d")).when(label == 1, F.col("_u")).otherwise(F.size("_path") - 1)
    out = df.filter(F.col(vol) > min_ret).withColumns({"label": label, "touch_idx": F.col("bar_idx") + touch})
    return core_only(out.drop("_path", "_up", "_dn", "_u", "_d"))


def barrier_bars(bars: DataFrame, pt: float = 1.0, sl: float = 1.0, max_window: int = 20, min_ret: float = 0.005, vol: str = "vol", grid: Grid = GRID) -> DataFrame:
    """Variant limited to max_window + 1 bars and 2 * max_window calendar days, with a floor on the volatility."""
    ahead = with_lookahead(bars, max_window, grid)
    w = Window.partitionBy("symbol", GROUP_KEY).orderBy("bar_idx").rowsBetween(0, max_window)
    df = ahead.withColumn("_path", F.collect_list(F.struct("close", "ts")).over(w)).withColumn("_v", F.greatest(F.col(vol), F.lit(min_ret)))
    near = F.filter("_path", lambda p: F.datediff(p["ts"], F.col("ts")) <= 2 * max_window)
    df = df.withColumn("_ret", F.transform(near, lambda p: p["close"] / F.col("close") - 1))
    at = lambda cond: F.array_position(F.transform("_ret", cond), True) - 1
    df = df.withColumns({"_u": at(lambda r: r >= pt * F.col("_v")), "_d": at(lambda r: r <= -sl * F.col("_v"))})
    label = F.when((F.col("_d") >= 0) & ((F.col("_u") < 0) | (F.col("_d") <= F.col("_u"))), -1).when(F.col("_u") >= 0, 1).otherwise(0)
    return core_only(df.filter(F.col(vol).isNotNull()).withColumn("label", label).drop("_path", "_ret", "_u", "_d", "_v"))


def imbalance(labels: DataFrame, keys: list[str], floor: float = 0.1) -> DataFrame:
    """Share per label and whether any label of the key is rarer than ``floor``."""
    n = labels.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n"))
    t = n.groupBy(*keys).agg(F.sum("n").alias("total"), F.min("n").alias("least"))
    return t.select(*keys, "total", (F.col("least") / F.col("total")).alias("min_share"), (F.col("least") / F.col("total") < floor).alias("imbalanced"))


def cpcv_split(bars: DataFrame, groups: int = 6, test_groups: int = 2, embargo: float = 0.01) -> DataFrame:
    """Role of every bar in every combination of test groups: test, embargo (after a test block) or train."""
    n = bars.groupBy("symbol").agg((F.max("bar_idx") + 1).alias("n"))
    combos = F.array(*[F.struct(F.lit(i).alias("split_no"), F.array(*[F.lit(g) for g in c]).alias("tests")) for i, c in enumerate(combinations(range(groups), test_groups))])
    size, gap = F.expr(f"n div {groups}"), F.floor(F.col("n") * embargo)
    group = F.least(F.floor(F.col("bar_idx") / size), F.lit(groups - 1)).cast("int")
    df = bars.select("symbol", "bar_idx").join(n, "symbol").withColumns({"group_no": group, "_gap": gap, "_size": size, "_c": F.explode(combos)})
    after = F.exists("_c.tests", lambda g: (g < groups - 1) & (F.col("bar_idx") >= (g + 1) * F.col("_size")) & (F.col("bar_idx") < (g + 1) * F.col("_size") + F.col("_gap")))
    role = F.when(F.array_contains("_c.tests", F.col("group_no")), "test").when(after, "embargo").otherwise("train")
    return df.select("symbol", "bar_idx", "group_no", F.col("_c.split_no").alias("split_no"), role.alias("role"))


def cpcv_metrics(scores: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    return scores.groupBy(*keys).agg(F.avg(score).alias("cpcv_mean"), F.min(score).alias("cpcv_worst"), F.coalesce(F.stddev_samp(score), F.lit(0.0)).alias("cpcv_std"))


def rank_inversions(ranks: DataFrame, keys: list[str], order: str = "fold", rank: str = "rank") -> DataFrame:
    """Share of fold pairs i < j whose later rank is lower; a key has one row per fold, a handful."""
    seq = F.sort_array(F.collect_list(F.struct(order, rank)))
    df = ranks.groupBy(*keys).agg(F.transform(seq, lambda s: s[rank]).alias("r"))
    worse = F.aggregate(F.transform("r", lambda x, i: F.size(F.filter(F.slice("r", i + 2, F.size("r")), lambda y: y < x))), F.lit(0), lambda a, v: a + v)
    pairs = F.size("r") * (F.size("r") - 1) / 2
    return df.select(*keys, F.coalesce(div(worse, pairs), F.lit(0.0)).alias("inversions"))


def pbo(scores: DataFrame, folds: int, key: str = "policy_id", fold: str = "fold", score: str = "score") -> DataFrame:
    """Probability of backtest overfitting: share of balanced fold subsets whose in-sample winner ranks below the median outside.

    ``scores``: one row per candidate and fold.  One wide row per candidate, then one aggregation per subset.
    """
    wide = scores.groupBy(key).agg(*[F.max(F.when(F.col(fold) == i, F.col(score))).alias(f"f{i}") for i in range(folds)])
    subsets = list(combinations(range(folds), folds // 2))
    mean = lambda idx: sum((F.col(f"f{i}") for i in idx), F.lit(0.0)) / len(idx)
    cells = F.array(*[F.struct(F.lit(n).alias("subset"), mean(s).alias("inside"), mean([i for i in range(folds) if i not in s]).alias("outside")) for n, s in enumerate(subsets)])
    long = wide.select(key, F.explode(cells).alias("c")).select(key, "c.*")
    best = long.groupBy("subset").agg(F.max_by("outside", F.struct(F.col("inside"), F.col(key))).alias("win"))
    place = long.join(best, "subset").groupBy("subset").agg(F.avg((F.col("outside") <= F.col("win")).cast("double")).alias("pct"))
    return place.agg(F.avg((F.col("pct") <= 0.5).cast("double")).alias("pbo"), F.count(F.lit(1)).alias("subsets"))


def brier_ece(df: DataFrame, keys: list[str], p: str = "p", y: str = "y", bins: int = 5) -> DataFrame:
    """Brier score and expected calibration error over equal bins (a probability of 1 falls in none)."""
    x = df.withColumn("_bin", F.floor(F.col(p) * bins))
    per = x.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("n"), F.sum(p).alias("sp"), F.sum(F.col(y).cast("double")).alias("sy"), F.sum(F.pow(F.col(p) - F.col(y), 2)).alias("se"))
    gap = F.when(F.col("_bin") < bins, F.abs(F.col("sp") - F.col("sy"))).otherwise(0.0)
    return per.groupBy(*keys).agg((F.sum("se") / F.sum("n")).alias("brier"), (F.sum(gap) / F.sum("n")).alias("ece"))


def guard_scale(p: Column, threshold: float = 0.7, max_prob: float = 0.9) -> tuple[Column, Column]:
    """(signal, size scale) of a guard probability."""
    scale = F.when(p < threshold, 0.0).when(p >= max_prob, 1.0).otherwise((p - threshold) / (max_prob - threshold))
    return (p >= threshold).cast("int"), scale


def tail_fit(df: DataFrame, keys: list[str], vol: str = "vol") -> DataFrame:
    """Mean, population deviation, 95 % and 99 % quantile and maximum of volatility."""
    q = exact_quantiles(df, keys, [(vol, 0.95), (vol, 0.99)]).groupBy(*keys).agg(F.max(F.when(F.col("q") < 0.97, F.col("value"))).alias("p95"), F.max(F.when(F.col("q") > 0.97, F.col("value"))).alias("p99"))
    return df.groupBy(*keys).agg(F.avg(vol).alias("mean"), F.stddev_pop(vol).alias("std"), F.max(vol).alias("max")).join(q, keys)


def assess(sigma: Column, budget: Column) -> Column:
    return sigma < budget
