"""Stage thresholds and evaluation constants that results depend on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

STAGE_FIELDS = ("stage_id", "name", "target_return_pct", "alpha_floor", "min_trades_per_year", "max_mdd_pct", "min_profit_factor",
                "min_entries_per_year", "max_entries_per_year", "min_flips_per_year", "max_flips_per_year", "and_terms_max", "wf_splits",
                "wf_gate_mode", "reject_base_penalty", "signal_degeneracy_mode")
STAGES = [
    (1, "Discovery", 10.0, -60.0, 2.0, 50.0, 0.8, 2.0, 300.0, 4.0, 600.0, 2, 3, "soft", -10.0, "soft"),
    (2, "Survival", 30.0, 0.0, 8.0, 25.0, 1.1, 8.0, 250.0, 16.0, 500.0, 3, 3, "soft", -30.0, "hard"),
    (3, "Deployment", 60.0, 10.0, 12.0, 15.0, 1.3, 12.0, 200.0, 24.0, 400.0, 4, 5, "hard", -50.0, "hard"),
    (4, "RobustAlpha", 80.0, 15.0, 15.0, 12.0, 1.5, 15.0, 180.0, 30.0, 360.0, 4, 5, "hard", -60.0, "hard"),
]
# stage -> (short min, short max, medium min, medium max, long min, long max)
HOLD_BUCKETS = {1: (1, 5, 5, 20, 20, 60), 2: (1, 8, 8, 30, 30, 80), 3: (1, 10, 10, 50, 50, 120), 4: (1, 15, 15, 80, 80, 200)}
ENTRY_BOUNDS = {1: (0.005, 0.05), 2: (0.003, 0.04), 3: (0.001, 0.06), 4: (0.001, 0.08)}
QUANTILE_BOUNDS = {1: (0.1, 0.9), 2: (0.1, 0.9), 3: (0.05, 0.95), 4: (0.05, 0.95)}
EVAL_CAPS = {1: (3, 20, 3), 2: (4, 25, 4), 3: (6, 35, 5), 4: (8, 40, 6)}  # windows, risk samples, walk-forward splits
ACT_STRIDE = 4
BARS_PER_YEAR = 252.0
MIN_WINDOW_BARS = 120
BENCHMARK_MODE, BENCHMARK_RETURN = "exposure", 15.0
DAILY_VOL = 0.015
K_UP, K_DOWN, HORIZON_RANGE = (0.5, 4.0), (0.3, 2.5), (3, 30)
WINRATE_MIN, WINRATE_MAX, MIN_EXPOSURE, TOP1_MAX, TOP3_MAX = 0.30, 0.85, 0.02, 0.60, 0.85
MIN_TRADES, MAX_MDD, MAX_INVALID_RATE = 15, 50.0, 0.0
DEGENERATE = (5.0, 0.002, 0.01)  # trades, entry rate, share of time in market
SCORE_MIN, LOWER_Q = -100.0, 0.2

TAXONOMY = {
    "SIGNAL_ISSUE": ["FAIL_NO_CYCLE", "FAIL_INVALID_ACTION", "FAIL_MIN_TRADES", "FAIL_MAX_TRADES", "FAIL_MIN_FLIPS", "FAIL_MAX_FLIPS",
                     "FAIL_LOW_EXPOSURE", "FAIL_ZERO_EXPOSURE", "FAIL_OVER_EXPOSURE", "FAIL_SIGNAL_DEGENERATE"],
    "EDGE_ISSUE": ["FAIL_LOW_RETURN", "FAIL_NEG_ALPHA", "FAIL_PF", "FAIL_WINRATE_LOW", "FAIL_WINRATE_HIGH"],
    "RISK_ISSUE": ["FAIL_MDD_BREACH", "FAIL_LUCKY_STRIKE", "FAIL_WORST_WINDOW"],
    "COMPLEXITY_ISSUE": ["FAIL_COMPLEXITY_HIGH", "FAIL_AST_DEPTH"],
    "DATA_ISSUE": ["FAIL_QUANTILE_COLLISION", "FAIL_MISSING_DATA", "FAIL_FEATURE_COLLAPSE"],
}


def stage(stage_id: int) -> dict:
    return next(dict(zip(STAGE_FIELDS, s)) for s in STAGES if s[0] == stage_id)


def stage_spec(spark: SparkSession) -> DataFrame:
    types = ["int", "string", *["double"] * 9, "int", "int", "string", "double", "string"]
    return spark.createDataFrame(STAGES, ", ".join(f"{n} {t}" for n, t in zip(STAGE_FIELDS, types)))
