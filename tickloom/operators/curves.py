"""Curve statistics of held bars from one row per trade.

The bars that a trade holds are a range. A range is summarised by the sums of its returns and squared returns, its log growth, the highest and
the lowest point of the log curve from its start, and its worst fall; two ranges that follow each other combine into one. In
each block of bars the summaries of all ranges whose length is a power of two are made once, and a trade is read from at
most log2(block) of them, so no held bar is repeated for a trade or a sample. A trade over several blocks has one piece in each.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.session import materialize

BLOCK = 1024
PIECE = ("sum_r", "sum_rr", "growth", "peak", "low", "fall")


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Summaries (rows as in PIECE) of ranges followed by others."""
    return np.stack([a[0] + b[0], a[1] + b[1], a[2] + b[2], np.maximum(a[3], a[2] + b[3]), np.minimum(a[4], a[2] + b[4]), np.maximum.reduce([a[5], b[5], a[3] - a[2] - b[4]])])


def range_summaries(r: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Summaries of the returns from first to last (included) of each query."""
    log = np.log(np.maximum(1 + r, 1e-12))
    level = np.stack([r, r * r, log, log, log, np.zeros(len(r))])
    out = np.stack([np.zeros(len(first))] * 3 + [np.full(len(first), -np.inf), np.full(len(first), np.inf), np.zeros(len(first))])
    at, left, size = first.copy(), last - first + 1, 1
    while (left > 0).any():
        now = np.flatnonzero(left & size)
        if len(now):
            out[:, now] = combine(out[:, now], level[:, at[now]])
            at[now] += size
            left[now] -= size
        if (left > 0).any():
            level = combine(level[:, :-size], level[:, size:])
            size *= 2
    return out


def trade_pieces(returns: DataFrame, trades: DataFrame, keys: tuple[str, ...], block: int = BLOCK) -> DataFrame:
    """keys, entry_idx, exit_idx, bar_idx (the first bar of the piece) and PIECE of the bars after entry up to exit.

    returns: keys, bar_idx, r for every bar. trades: keys, entry_idx, exit_idx, distinct; a trade that ends where it began has no piece.
    """
    held = trades.filter("exit_idx > entry_idx").select(*keys, "entry_idx", "exit_idx")
    held = held.withColumn("_b", F.explode(F.sequence(F.expr(f"(entry_idx + 1) div {block}"), F.expr(f"exit_idx div {block}"))))
    held = held.withColumns({"_first": F.greatest(F.col("entry_idx") + 1, F.col("_b") * block), "_last": F.least(F.col("exit_idx"), (F.col("_b") + 1) * block - 1)})
    bars = returns.select(*keys, "bar_idx", "r").withColumn("_b", F.expr(f"bar_idx div {block}"))
    types = {f.name: f.dataType.simpleString() for f in held.schema}
    names = [*keys, "entry_idx", "exit_idx"]

    def run(bars: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(held) or not len(bars):
            return pd.DataFrame(columns=[*names, "bar_idx", *PIECE])
        bars = bars.sort_values("bar_idx")
        base = int(bars["bar_idx"].iloc[0])
        first = held["_first"].to_numpy()
        got = range_summaries(bars["r"].to_numpy(float), first - base, held["_last"].to_numpy() - base)
        return held[names].assign(bar_idx=first, **dict(zip(PIECE, got, strict=True)))

    schema = ", ".join([*[f"{n} {types[n]}" for n in names], "bar_idx long", *[f"{c} double" for c in PIECE]])
    return bars.groupBy(*keys, "_b").cogroup(held.groupBy(*keys, "_b")).applyInPandas(run, schema)


def held_stats(returns: DataFrame, trades: DataFrame, bar_keys: tuple[str, ...], keys: tuple[str, ...], block: int = BLOCK) -> DataFrame:
    """keys, sum_r, sum_rr, log_growth, drawdown (share lost from the highest point, at the start at least) over the bars that the trades of a key hold, in order.

    bar_keys, a part of keys, name the bars; trades of equal range on the same bars are read once. A key's rows here are its trades.
    """
    pieces = materialize(trade_pieces(materialize(returns), trades.select(*bar_keys, "entry_idx", "exit_idx").distinct(), bar_keys, block))
    rows = trades.select(*keys, "entry_idx", "exit_idx").join(pieces, [*bar_keys, "entry_idx", "exit_idx"])
    line = Window.partitionBy(*keys).orderBy("bar_idx")
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_at", F.coalesce(F.sum("growth").over(before), F.lit(0.0)))
    rows = rows.withColumn("_top", F.greatest(F.coalesce(F.max(F.col("_at") + F.col("peak")).over(before), F.lit(0.0)), F.lit(0.0)))
    fall = F.greatest("fall", F.col("_top") - F.col("_at") - F.col("low"), F.lit(0.0))
    return rows.groupBy(*keys).agg(F.sum("sum_r").alias("sum_r"), F.sum("sum_rr").alias("sum_rr"), F.sum("growth").alias("log_growth"), F.max(1 - F.exp(-fall)).alias("drawdown"))
