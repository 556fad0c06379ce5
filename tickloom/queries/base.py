"""Registration of queries: a Spark callable and, where SQL can express it, the DuckDB equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.num import rnd
from tickloom.sources import bars as B

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, fn: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"query {name} registered twice")
    QUERIES[name] = fn
    if sql is not None:
        ORACLE[name] = sql


def query(name: str, sql: str | None = None):
    def wrap(fn):
        register(name, fn, sql)
        return fn
    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars_h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.hourly_bars(table(spark, sf_dir, "events"))


def bars_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.daily_bars(table(spark, sf_dir, "lineitem"))


def context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.order_context(table(spark, sf_dir, "orders"))


def bars_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.context_join(bars_d(spark, sf_dir), context(spark, sf_dir))


def rounded(df: DataFrame, cols: list[str], digits: int = 6, keys: tuple = ("symbol", "bar_idx")) -> DataFrame:
    return df.select(*keys, *[rnd(F.col(f"`{c}`"), digits).alias(c.split("__")[-1]) for c in cols])
