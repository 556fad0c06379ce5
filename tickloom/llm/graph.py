"""Connected components of a link table, by alternating stars over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.session import materialize


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node of the links (a, b).

    Large star: each node's larger neighbours go to its smallest neighbour; small star: its smaller ones and itself do. Both
    keep the components and end when every link points to its component's smallest node. Minima are combined
    before the shuffle and joined back, so a node of any degree is no group in a task. Rounds grow with the logarithm of
    the components' diameter.
    """
    edges = materialize(links.filter("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())
    while True:
        # a forest of stars has one link for each outer node, and no outer node is a centre
        ends = edges.select("v", F.lit(1).alias("out"), F.lit(0).alias("centre")).unionAll(edges.select(F.col("u").alias("v"), F.lit(0).alias("out"), F.lit(1).alias("centre")))
        if not ends.groupBy("v").agg(F.sum("out").alias("out"), F.max("centre").alias("centre")).filter("out > 1 OR out = 1 AND centre = 1").limit(1).count():
            break
        both = edges.unionAll(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = materialize(both.filter("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).filter("v <> u"))
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.when(F.col("u") == F.col("m"), F.col("v")).otherwise(F.col("u")).alias("v"), F.col("m").alias("u"))
        edges = materialize(small.filter("v <> u").distinct())
    stars = edges.select(F.col("v").alias("node"), F.col("u").alias("component"))
    return stars.unionAll(edges.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
