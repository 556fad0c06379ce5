"""Exact quantiles of large groups without gathering a group in one task.

Values are counted, each group is cut into slots at approximate percentiles of its distinct values (so
that no outlier crowds the rest into one slot), slot counts locate the slot that holds each wanted
rank, and only the rows of those slots are ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.session import materialize

SLOTS = 256


def slot_edges(value: Column) -> Column:
    """Aggregate: the approximate percentiles at which values are cut; a sketch of bounded size."""
    return F.percentile_approx(value, [i / SLOTS for i in range(1, SLOTS)], 4 * SLOTS)


def slot_of(value: Column, edges: Column) -> Column:
    """Number of edges below a value: grows with the value, the same for equal values."""
    return F.size(F.filter(edges, lambda e: e < value)).cast("bigint")


def exact_quantiles(df: DataFrame, keys: list[str], wanted: list[tuple[str, float]]) -> DataFrame:
    """(keys, col, q, value) with linear interpolation; ``wanted`` lists (column, q) pairs."""
    cols = list(dict.fromkeys(c for c, _ in wanted))
    long = df.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(c).alias("col"), F.col(f"`{c}`").cast("double").alias("v")) for c in cols])).alias("_e"))
    counts = (long.select(*keys, "_e.col", "_e.v").filter(F.col("v").isNotNull())
              .groupBy(*keys, "col", "v").agg(F.count(F.lit(1)).alias("n")))
    counts = materialize(counts)  # read four times below
    stats = counts.groupBy(*keys, "col").agg(F.array_distinct(slot_edges(F.col("v"))).alias("edges"), F.sum("n").alias("total"))
    stats = materialize(stats)  # a sketch depends on the order in which its parts arrive: counting and ordering need the same edges
    slotted = counts.join(stats, [*keys, "col"]).select(*keys, "col", "v", "n", slot_of(F.col("v"), F.col("edges")).alias("slot"))
    by_slot = slotted.groupBy(*keys, "col", "slot").agg(F.sum("n").alias("sn"))
    upto = Window.partitionBy(*keys, "col").orderBy("slot")
    by_slot = by_slot.withColumn("before", F.sum("sn").over(upto) - F.col("sn"))
    pairs = F.create_map(*[x for c in cols for x in (F.lit(c), F.array(*[F.lit(q) for cc, q in wanted if cc == c]))])
    ranks = stats.select(*keys, "col", "total", F.explode(pairs[F.col("col")]).alias("q"))
    pos = F.col("q") * (F.col("total") - 1)
    ranks = ranks.select(*keys, "col", "q", pos.alias("pos"), F.explode(F.array(F.floor(pos), F.ceil(pos))).alias("rank")).distinct()
    located = ranks.join(by_slot, [*keys, "col"]).filter(
        (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("sn")))
    located = materialize(located)  # a few rows per wanted quantile
    needed = located.select(*keys, "col", "slot", "before").distinct()
    inside = Window.partitionBy(*keys, "col", "slot").orderBy("v")
    placed = slotted.join(needed, [*keys, "col", "slot"]).withColumn("first", F.col("before") + F.sum("n").over(inside) - F.col("n"))
    hit = located.select(*keys, "col", "q", "pos", "rank", "slot").join(
        placed.select(*keys, "col", "slot", "v", "n", "first"), [*keys, "col", "slot"])
    hit = hit.filter((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n")))
    out = hit.groupBy(*keys, "col", "q").agg(F.min_by("v", "rank").alias("a"), F.max_by("v", "rank").alias("b"), F.max("pos").alias("pos"))
    return out.select(*keys, "col", "q", (F.col("a") + (F.col("pos") - F.floor("pos")) * (F.col("b") - F.col("a"))).alias("value"))


def with_quantiles(agg: DataFrame, df: DataFrame, keys: list[str], **wanted: tuple[str, float]) -> DataFrame:
    """``agg`` with one more column per ``name=(column, q)``; ``df`` is read once more, so let it be a written one."""
    q = exact_quantiles(df, keys, list(wanted.values()))
    wide = q.groupBy(*keys).agg(*[F.max(F.when((F.col("col") == c) & (F.col("q") == p), F.col("value"))).alias(n) for n, (c, p) in wanted.items()])
    return agg.join(wide, keys, "left")
