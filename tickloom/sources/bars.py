"""Bar tables: readers, roll-up of raw ticks, cleaning, context joins, selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions.num import div
from tickloom.operators.blocks import GRID, Grid, running, with_bar_idx
from tickloom.session import materialize

OHLCV = ["open", "high", "low", "close", "volume"]
KLINE_SCHEMA = "array<array<string>>"


def roll_up(ticks: DataFrame, symbol: Column, bucket: Column, price: Column, volume: Column, order: Column) -> DataFrame:
    """Raw ticks to OHLCV bars.  Partial aggregation happens map-side, so a hot symbol is no problem."""
    return (
        ticks.select(symbol.alias("symbol"), bucket.alias("ts"), price.alias("_p"), volume.alias("_v"), order.alias("_o"))
        .groupBy("symbol", "ts")
        .agg(F.min_by("_p", "_o").alias("open"), F.max("_p").alias("high"), F.min("_p").alias("low"),
             F.max_by("_p", "_o").alias("close"), F.sum("_v").cast("double").alias("volume"))
    )


def hourly_bars(events: DataFrame) -> DataFrame:
    """``events`` as hourly bars: symbol = event type, price = value, volume = number of events."""
    raw = roll_up(events, F.col("event_type"), F.date_trunc("hour", F.col("ts")), F.col("value"), F.lit(1),
                  F.struct("ts", "event_id"))
    return with_bar_idx(raw)


def daily_bars(lineitem: DataFrame) -> DataFrame:
    """``lineitem`` as daily bars: symbol = return flag, price = unit price, volume = quantity."""
    raw = roll_up(lineitem, F.col("l_returnflag"), F.date_trunc("day", F.col("l_shipdate")),
                  div("l_extendedprice", "l_quantity"), F.col("l_quantity"),
                  F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return with_bar_idx(raw, slot=F.date_trunc("quarter", F.col("ts")))


# Fixed mapping of the order priorities and states to context series and their scale.
CONTEXT_SERIES = [("o_orderpriority", "1-URGENT", "spy", 1000.0), ("o_orderpriority", "2-HIGH", "vix", 6500.0), ("o_orderpriority", "3-MEDIUM", "us10y", 36000.0),
                  ("o_orderpriority", "4-NOT SPECIFIED", "hyg", 2000.0), ("o_orderpriority", "5-LOW", "dx", 1500.0), ("o_orderstatus", "O", "btc", 5.0), ("o_orderstatus", "F", "uso", 2500.0)]


def order_context(orders: DataFrame) -> DataFrame:
    """Daily context closes from ``orders``, one ``<name>_close`` column per series."""
    return orders.groupBy(F.date_trunc("day", F.col("o_orderdate")).alias("ts")).agg(
        *[(F.avg(F.when(F.col(column) == value, F.col("o_totalprice"))) / scale).alias(f"{name}_close")
          for column, value, name, scale in CONTEXT_SERIES])


def read_ohlcv(df: DataFrame) -> DataFrame:
    """Lowercase columns, keep symbol, ts and OHLCV; missing volume becomes 0."""
    low = df.select([F.col(f"`{c}`").alias(c.lower()) for c in df.columns])
    if "volume" not in low.columns:
        low = low.withColumn("volume", F.lit(0.0))
    return low.select("symbol", "ts", *[F.col(c).cast("double") for c in OHLCV[:4]],
                      F.coalesce(F.col("volume").cast("double"), F.lit(0.0)).alias("volume"))


def parse_klines(payload: DataFrame, symbol: str = "symbol", body: str = "body") -> DataFrame:
    """JSON arrays of kline arrays (epoch-ms open time, then OHLCV as text) to bars."""
    row = payload.select(symbol, F.explode(F.from_json(F.col(body), KLINE_SCHEMA)).alias("k"))
    num = lambda i: F.expr(f"try_cast(k[{i}] as double)")
    return row.select(
        F.col(symbol).alias("symbol"),
        F.expr("timestamp_millis(try_cast(k[0] as bigint))").cast("timestamp_ntz").alias("ts"),
        *[num(i + 1).alias(n) for i, n in enumerate(OHLCV)])


def parse_csv_bars(df: DataFrame, symbol: Column | None = None) -> DataFrame:
    """Text bars with a date / datetime / timestamp column; rows with bad dates are dropped."""
    low = df.select([F.col(f"`{c}`").alias(c.lower()) for c in df.columns])
    stamp = next(c for c in ("date", "datetime", "timestamp") if c in low.columns)
    val = lambda n: F.expr(f"try_cast(`{n}` as double)") if n in low.columns else F.lit(None).cast("double")
    out = low.select(
        (symbol if symbol is not None else F.col("symbol")).alias("symbol"),
        F.expr(f"try_cast(`{stamp}` as timestamp_ntz)").alias("ts"),
        *[F.coalesce(val(n), val("close")).alias(n) for n in ("open", "high", "low")],
        val("close").alias("close"), F.coalesce(val("volume"), F.lit(0.0)).alias("volume"))
    return out.filter(F.col("ts").isNotNull())


def read_csv_bars(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    return parse_csv_bars(spark.read.option("header", True).csv(path), F.lit(symbol))


def union_ranges(parts: list[DataFrame]) -> DataFrame:
    """Concatenate ranges; of duplicate (symbol, ts) the one from the first range stays."""
    tagged = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    allrows = tagged[0]
    for t in tagged[1:]:
        allrows = allrows.unionByName(t)
    cols = [c for c in parts[0].columns if c not in ("symbol", "ts")]
    kept = allrows.groupBy("symbol", "ts").agg(F.min_by(F.struct(*cols), "_part").alias("_r"))
    return kept.select("symbol", "ts", *[F.col(f"_r.{c}").alias(c) for c in cols])


def forward_fill(df: DataFrame, cols: list[str], fill: float | None = 0.0, keys=("symbol",), idx="bar_idx",
                 grid: Grid = GRID) -> DataFrame:
    """Carry the last non-null value forward per symbol, then fill what is left."""
    out = running(df, {f"_f_{c}": ("last", F.col(c)) for c in cols}, keys=keys, idx=idx, grid=grid)
    done = {c: F.col(f"_f_{c}") if fill is None else F.coalesce(F.col(f"_f_{c}"), F.lit(fill)) for c in cols}
    return out.withColumns(done).drop(*[f"_f_{c}" for c in cols])


def clean(bars: DataFrame, grid: Grid = GRID) -> DataFrame:
    """Numeric coercion, forward fill, zero fill of the five price columns."""
    cast = bars.withColumns({c: F.expr(f"nanvl(try_cast(`{c}` as double), null)") for c in OHLCV})
    return forward_fill(cast, OHLCV, grid=grid)


def context_join(bars: DataFrame, context: DataFrame, grid: Grid = GRID) -> DataFrame:
    """Left join of ``<name>_close`` columns on the bar time, forward filled, then zero filled."""
    cols = [c for c in context.columns if c != "ts"]
    return forward_fill(materialize(bars.join(context, "ts", "left")), cols, grid=grid)


def asof_join(bars: DataFrame, series: DataFrame, grid: Grid = GRID) -> DataFrame:
    """Backward as-of join of a lower-frequency series on the bar time.

    The distinct bar times and the series are merged into one ordered timeline; a running ``last``
    replaces the inequality join.
    """
    cols = [c for c in series.columns if c != "ts"]
    times = bars.select("ts").distinct().select("ts", F.lit(1).alias("_tag"), *[F.lit(None).cast("double").alias(c) for c in cols])
    line = series.select("ts", F.lit(0).alias("_tag"), *cols).unionByName(times).withColumn("_k", F.lit(0))
    line = line.withColumn("_o", F.struct("ts", "_tag"))
    ordered = with_bar_idx(line, keys=("_k",), ts="_o", slot=F.date_trunc("quarter", F.col("ts")))
    filled = running(ordered, {f"_f_{c}": ("last", F.col(c)) for c in cols}, keys=("_k",), grid=grid)
    known = filled.filter(F.col("_tag") == 1).select("ts", *[F.col(f"_f_{c}").alias(c) for c in cols])
    return bars.join(known, "ts", "left")


def last_bars(bars: DataFrame, n: int) -> DataFrame:
    """Last ``n`` bars of every symbol, by position: one count per symbol instead of a ranking."""
    size = bars.groupBy("symbol").agg(F.max("bar_idx").alias("_last"))
    return bars.join(size, "symbol").filter(F.col("bar_idx") > F.col("_last") - n).drop("_last")


def slice_starts(bars: DataFrame, slices: int, size: int) -> DataFrame:
    """Start positions of evenly spaced slices per symbol."""
    n = bars.groupBy("symbol").agg((F.max("bar_idx") + 1).alias("n"))
    span = F.greatest(F.col("n") - size, F.lit(0))
    start = F.when(F.lit(slices) <= 1, span).otherwise(F.floor(F.col("i") * span / F.lit(max(slices - 1, 1))))
    return n.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).select(
        "symbol", "n", F.col("i").cast("int").alias("slice_no"), start.cast("bigint").alias("start"))


def reduced_bars(bars: DataFrame, slices: int, size: int) -> DataFrame:
    """De-duplicated union of evenly spaced slices: a bar stays when any slice covers it."""
    starts = slice_starts(bars, slices, size).groupBy("symbol").agg(F.collect_set("start").alias("_starts"))
    hit = F.exists("_starts", lambda s: (F.col("bar_idx") >= s) & (F.col("bar_idx") < s + size))
    return bars.join(starts, "symbol").filter(hit).drop("_starts")


def uptrend_scenario(bars: DataFrame) -> DataFrame:
    """Straight line of closes from 100 to 200 over each symbol."""
    n = bars.groupBy("symbol").agg(F.max("bar_idx").alias("_last"))
    return bars.join(n, "symbol").withColumn(
        "close", F.lit(100.0) + F.coalesce(div(F.col("bar_idx") * 100.0, F.col("_last")), F.lit(0.0))).drop("_last")


def zero_volume_scenario(bars: DataFrame) -> DataFrame:
    return bars.withColumn("volume", F.lit(0.0))


def signature(df: DataFrame) -> DataFrame:
    """Order-independent content hash of a table, the same in any engine: the sum of 60 bits of each row's md5 of its values as text
    (instants as seconds, numbers in millionths, missing values as an empty text)."""
    def text(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if kind.startswith("timestamp"):
            c = F.unix_timestamp(c.cast("timestamp"))
        elif kind in ("double", "float") or kind.startswith("decimal"):
            c = F.round(c * 1_000_000).cast("decimal(38,0)")
        return F.coalesce(c.cast("string"), F.lit(""))

    row = F.md5(F.concat_ws("|", *[text(n, k) for n, k in df.dtypes]))
    number = F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)")
    rows = df.agg(F.sum(number).alias("s"), F.count(F.lit(1)).alias("rows"))
    return rows.select(F.sha2(F.concat_ws("|", F.lit(",".join(df.columns)), F.coalesce("s", F.lit(0)).cast("string")), 256).alias("signature"), "rows")
