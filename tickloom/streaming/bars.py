"""The bar roll-up on a stream of ticks: the polling loop of a batch fetcher becomes a streaming aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stream_bars(ticks: DataFrame, symbol: Column, ts: str, price: Column, volume: Column, order: Column, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """OHLCV bars of closed windows; ticks later than the watermark are ignored, state is one row per open bar."""
    w = F.window(F.col(ts), width)
    return (
        ticks.withWatermark(ts, late)
        .select(symbol.alias("symbol"), F.col(ts), price.alias("_p"), volume.alias("_v"), order.alias("_o"))
        .groupBy("symbol", w.alias("_w"))
        .agg(F.min_by("_p", "_o").alias("open"), F.max("_p").alias("high"), F.min("_p").alias("low"), F.max_by("_p", "_o").alias("close"), F.sum("_v").cast("double").alias("volume"))
        .select("symbol", F.col("_w.start").alias("ts"), "open", "high", "low", "close", "volume")
    )
