"""Classifiers on feature frames, trained and scored apart in time."""

from __future__ import annotations

import functools

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import boosting as B
from tickloom.operators.features import REGISTRY
from tickloom.operators.labels import cpcv_split
from tickloom.session import materialize

FOLDS = 3
DIRECTION = B.Params(rounds=100, rate=0.1, leaves=8, depth=3, min_rows=1)
GUARD = B.Params(rounds=1000, rate=0.05, leaves=31, balanced=True)


def folded(df: DataFrame, bars: DataFrame, folds: int = FOLDS) -> DataFrame:
    """The rows with `fold`, the block of time that scores them, and train_0, train_1, ...: whether a fold learns from them (neither in its block nor under its embargo)."""
    roles = cpcv_split(bars, folds, 1)
    learns = [F.max((F.col("split_no") == f) & (F.col("role") == "train")).alias(f"train_{f}") for f in range(folds)]
    return df.join(roles.groupBy("symbol", "bar_idx").agg(F.max("group_no").alias("fold"), *learns), ["symbol", "bar_idx"])


def train_columns(df: DataFrame) -> list[Column]:
    return [F.col(f"train_{f}") for f in range(sum(c.startswith("train_") for c in df.columns))]


def zero_filled(df: DataFrame, features: list[str]) -> DataFrame:
    return df.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features})


def train_direction(df: DataFrame, features: list[str], label: str = "label", params: B.Params = DIRECTION) -> B.Model:
    """Softmax boosting of down, flat and up (-1, 0, 1), a model for each fold; missing features are 0."""
    return B.fit(zero_filled(df, features).withColumn("_class", F.col(label) + 1), features, "_class", 3, train_columns(df), params)


def predict_direction(model: B.Model, df: DataFrame) -> DataFrame:
    """p_down, p_flat, p_up of each row by a model that hasn't seen its block of time, and direction, the likeliest (the lower on a tie)."""
    out = B.predict(model, zero_filled(df, model.features), F.col("fold"), df.columns)
    p = {c: F.col("p")[i] for i, c in enumerate(("p_down", "p_flat", "p_up"))}
    return out.withColumns(p | {"direction": (F.array_position("p", F.array_max("p")) - 2).cast("int")}).drop("p")


def train_guard(df: DataFrame, features: list[str], label: str = "label", params: B.Params = GUARD) -> B.Model:
    """Boosted gate of label 1 against the rest, classes weighted to balance, a model for each fold; missing features stay missing."""
    return B.fit(df.withColumn("_class", (F.col(label) == 1).cast("int")), features, "_class", 2, train_columns(df), params)


def predict_guard(model: B.Model, df: DataFrame) -> DataFrame:
    """p of each row by a model that hasn't seen its block of time."""
    return B.predict(model, df, F.col("fold")).withColumn("p", F.col("p")[1])


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """fold, positive, n, weight: rows that each fold learns from, by class of the guard, and the weight that balances them."""
    long = df.select((F.col(label) == 1).alias("positive"), F.explode(F.array(*[F.when(c, F.lit(f)) for f, c in enumerate(train_columns(df))])).alias("fold")).filter("fold IS NOT NULL")
    n = materialize(long.groupBy("fold", "positive").agg(F.count(F.lit(1)).alias("n")))
    total = n.groupBy("fold").agg(F.sum("n").alias("total"))
    return n.join(total, "fold").select("fold", "positive", "n", (F.col("total") / (2 * F.col("n"))).alias("weight"))


def out_of_fold_forest(df: DataFrame, features: list[str], label: str = "label", trees: int = 100) -> DataFrame:
    """The rows with p, the share of label 1 in a random forest of 100 trees of depth 5 that hasn't seen their block of time."""
    rows = zero_filled(df, features).withColumn("_y", (F.col(label) == 1).cast("double"))
    rows = materialize(VectorAssembler(inputCols=features, outputCol="_x").transform(rows))
    forest = RandomForestClassifier(featuresCol="_x", labelCol="_y", numTrees=trees, maxDepth=5, seed=42)
    scored = [forest.fit(rows.filter(c)).transform(rows.filter(F.col("fold") == f)) for f, c in enumerate(train_columns(df))]
    return functools.reduce(DataFrame.unionByName, scored).withColumn("p", vector_to_array("probability")[1]).select(*df.columns, "p")


def importance(spark: SparkSession, model: B.Model) -> DataFrame:
    """Share of the summed gain per feature, with its category."""
    gain = model.importance()
    of = lambda f: REGISTRY.features[f.split("__")[0]].category if f.split("__")[0] in REGISTRY.features else "OTHER"
    rows = [(f, of(f), float(w)) for f, w in zip(model.features, gain / max(gain.sum(), 1e-300), strict=True)]
    return spark.createDataFrame(rows, "feature string, category string, importance double")
