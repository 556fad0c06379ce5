"""Experiment ledger: readers, writers and analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.operators.gates import api_status
from tickloom.operators.relay import BLOCK, relay
from tickloom.session import materialize

RECORD = ("exp_id string, timestamp double, stage int, regime string, template_id string, eval_score double, genome map<string,map<string,double>>, "
          "reason_codes array<string>, metrics map<string,double>")
CATEGORIES = ("TREND", "MOMENTUM", "VOLATILITY", "VOLUME", "PRICE_ACTION", "PATTERN")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Experiments from a file of JSON lines; malformed lines are dropped, whichever columns are read."""
    return parse_ledger(spark.read.text(path))


def parse_ledger(lines: DataFrame, col: str = "value") -> DataFrame:
    """The same for lines already in a table."""
    rec = F.from_json(F.col(col), RECORD + ", _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return lines.select(rec.alias("r")).filter(F.col("r._corrupt_record").isNull() & F.col("r.exp_id").isNotNull()).select("r.*").drop("_corrupt_record")


def recent(df: DataFrame, n: int, order: str = "timestamp", tie: str = "exp_id") -> DataFrame:
    """Last n records (bounded top-k)."""
    return df.orderBy(F.col(order).desc(), F.col(tie).desc()).limit(n)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").partitionBy("stage").parquet(path)


def prune(df: DataFrame, n: int) -> DataFrame:
    """Top n by evaluation score; a missing score counts as -9999."""
    return df.orderBy(F.coalesce("eval_score", F.lit(-9999.0)).desc(), "exp_id").limit(n)


def genome_text(genome: Column) -> Column:
    """Sorted features with their main parameter, shortened to two plus a count when there are more than three."""
    def show(e: Column) -> Column:
        main = F.coalesce(*[F.try_element_at(e["value"], F.lit(k)) for k in ("window", "length", "fast")])
        return F.concat(e["key"], F.when(main.isNotNull() & (main != 0), F.concat(F.lit("("), main.cast("int").cast("string"), F.lit(")"))).otherwise(""))

    items = F.transform(F.array_sort(F.transform(F.map_entries(genome), lambda e: F.struct(e["key"].alias("key"), F.to_json(e["value"]).alias("j"), e["key"].alias("k")))), lambda s: s["key"])
    text = F.transform(items, lambda k: show(F.struct(k.alias("key"), genome[k].alias("value"))))
    n = F.size(text)
    return F.when(n > 3, F.concat(text[0], F.lit(", "), text[1], F.lit(" +"), (n - 2).cast("string"))).otherwise(F.concat_ws(", ", text))


def flat(df: DataFrame) -> DataFrame:
    """Flat experiment list with status, reason and Sharpe fallback."""
    why = api_status()
    ratio = F.try_divide("total_return_pct", F.when(F.col("vol_pct") > 1e-9, F.col("vol_pct")))
    return df.withColumns({"reason": why, "status": F.when(why == "", "Approved").otherwise("Rejected"), "sharpe_shown": F.coalesce("sharpe", ratio, F.lit(0.0))})


def generations(df: DataFrame, time: str = "ts") -> DataFrame:
    """Number of every experiment by (time, exp_id), from 1: rows are dealt by range of that order, and a number is the place in a range plus the rows of those before."""
    dealt = materialize(df.repartitionByRange(time, "exp_id").withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a range
    place = F.row_number().over(Window.partitionBy("_range").orderBy(time, "exp_id"))
    return dealt.join(F.broadcast(sizes.select("_range", before.alias("_before"))), "_range").withColumn("generation", (F.col("_before") + place).cast("bigint")).drop("_range", "_before")


def leaderboard(df: DataFrame, k: int = 3) -> DataFrame:
    """Top k approved per regime by return: each block of rows keeps its k best before regimes are ranked."""
    ok = df.filter("status = 'Approved'").withColumn("_b", F.pmod(F.xxhash64("exp_id"), F.lit(256)))
    best = lambda *keys: Window.partitionBy(*keys).orderBy(F.col("total_return_pct").desc(), "exp_id")
    few = ok.withColumn("_r", F.row_number().over(best("regime", "_b"))).filter(F.col("_r") <= k)
    return few.withColumn("rank", F.row_number().over(best("regime"))).filter(F.col("rank") <= k).drop("_b", "_r")


def rejections(df: DataFrame) -> DataFrame:
    return df.groupBy(F.try_element_at("reason_codes", F.lit(1)).alias("code")).agg(F.count(F.lit(1)).alias("n")).filter("code is not null")


def kpis(df: DataFrame) -> DataFrame:
    ok = F.col("status") == "Approved"
    return df.agg(F.count(F.lit(1)).alias("experiments"), F.avg(ok.cast("double")).alias("approval_rate"), F.max(F.when(ok, F.col("sharpe_shown"))).alias("best_sharpe"),
                  F.max(F.when(ok, F.col("win_rate"))).alias("best_win_rate"), F.max(F.when(ok, F.col("total_return_pct"))).alias("best_return"))


def overall_score() -> Column:
    return 3.0 * F.col("total_return_pct") + 50.0 * F.col("win_rate") + 0.1 * F.col("trade_count")


def best_overall(df: DataFrame) -> DataFrame:
    ok = df.filter("status = 'Approved'").withColumn("score", overall_score())
    return ok.orderBy(F.col("score").desc(), "exp_id").limit(1)


def search(df: DataFrame, text: str, columns: list[str]) -> DataFrame:
    needle = F.lit(text.lower())
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(c).contains(needle), F.lit(False))
    return df.filter(hit)


# Suggested change per rejection reason.
FIXES = [("CALIBRATION_BAD", "entry_threshold", "+0.02"), ("CALIBRATION_BAD", "calibration", "switch_calibrator"), ("TURNOVER_TOO_HIGH", "min_holding", "increase"), ("TURNOVER_TOO_HIGH", "entry_threshold", "+0.03"),
         ("DD_LIMIT_BREACH", "max_dd", "tighten"), ("DD_LIMIT_BREACH", "k", "-0.1"), ("REGIME_DEPENDENT", "template", "T08")]


def fix_suggestions(df: DataFrame, keys: list[str]) -> DataFrame:
    """Reason codes exploded and joined to the suggestions; the last suggestion for a target wins."""
    rules = df.sparkSession.createDataFrame([(i, *f) for i, f in enumerate(FIXES)], "ord int, code string, target string, change string")
    hit = df.select(*keys, F.explode("reason_codes").alias("code")).join(F.broadcast(rules), "code")
    return hit.groupBy(*keys, "target").agg(F.max_by("change", "ord").alias("change"))


def prior_machine(a: dict, p: dict, state, last: bool, emit):
    """Exponentially blended category weights with clamping, and the running cosine calibration.  State: weights, calibration."""
    n = len(CATEGORIES)
    if state is None:
        state = [1.0 / n] * n + [0.5]
    w, cal = list(state[:n]), state[n]
    imp = [a[c] for c in CATEGORIES]
    for i in range(len(a["seq"])):
        x = [0.01 + imp[j][i] for j in range(n)]
        total = sum(imp[j][i] for j in range(n))
        if total > 0:
            x = [v / total for v in x]
            dot, nw, nx = sum(u * v for u, v in zip(w, x)), sum(u * u for u in w) ** 0.5, sum(v * v for v in x) ** 0.5
            w = [min(0.40, max(0.05, 0.9 * u + 0.1 * v)) for u, v in zip(w, x)]
            cal = 0.9 * cal + 0.1 * dot / (nw * nx)
            s = sum(w)
            w = [u / s for u in w]
        if emit is not None:
            emit.append((int(a["seq"][i]), float(cal), *[float(u) for u in w]))
    return [*w, cal]


def priors(importance: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per regime and record: calibration and category weights.  ``importance``: regime, seq (dense from 0), one column per category."""
    cols = ", ".join(f"{c} double" for c in CATEGORIES)
    return relay(importance.select("regime", "seq", *CATEGORIES), prior_machine, f"seq bigint, calibration double, {cols}", ("regime",), "seq", block=block)


def policy_id(genome: Column, rules: Column, budget: Column) -> Column:
    """``pol_`` + 16 hex digits of the sha256 of canonical JSON (keys sorted, numbers to eight decimals)."""
    num = lambda v: F.format_string("%.8f", v)
    inner = lambda m: F.concat(F.lit("{"), F.concat_ws(",", F.transform(F.array_sort(F.map_keys(m)), lambda k: F.concat(F.lit('"'), k, F.lit('":'), num(m[k])))), F.lit("}"))
    outer = F.concat(F.lit("{"), F.concat_ws(",", F.transform(F.array_sort(F.map_keys(genome)), lambda k: F.concat(F.lit('"'), k, F.lit('":'), inner(genome[k])))), F.lit("}"))
    text = F.concat(F.lit('{"genome":'), outer, F.lit(',"risk_budget":'), inner(budget), F.lit(',"rules":"'), rules, F.lit('"}'))
    return F.concat(F.lit("pol_"), F.substring(F.sha2(text, 256), 1, 16))
