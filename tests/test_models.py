"""Boosting against a brute-force version, and models trained for real on small tables."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators import boosting as B
from tickloom.operators import models as ML
from tickloom.session import ship


def brute_tree(x, g, h, params):
    """Best-first growth by trying every value of every feature, missing values on either side; the value of each row."""
    def split(rows):
        best = None
        for missing_left in (False, True):
            for j in range(x.shape[1]):
                v = x[rows, j]
                for t in sorted(set(v[~np.isnan(v)])):
                    left = np.where(np.isnan(v), missing_left, v <= t)
                    a, b = rows[left], rows[~left]
                    if min(len(a), len(b)) < max(params.min_rows, 1) or min(h[a].sum(), h[b].sum()) < params.min_hessian:
                        continue
                    gain = sum(s * g[r].sum() ** 2 / h[r].sum() for s, r in ((1, a), (1, b), (-1, rows)))
                    if gain > (1e-9 if best is None else best[0] + 1e-9):
                        best = (gain, a, b)
        return best
    leaves = [(np.arange(len(g)), 0)]
    while len(leaves) < params.leaves:
        found = [(split(r) if d < params.depth else None) for r, d in leaves]
        best = max((i for i, s in enumerate(found) if s), key=lambda i: found[i][0], default=None)
        if best is None:
            break
        _, a, b = found[best]
        d = leaves.pop(best)[1]
        leaves += [(a, d + 1), (b, d + 1)]
    out = np.zeros(len(g))
    for r, _ in leaves:
        out[r] = -params.rate * g[r].sum() / h[r].sum()
    return out, len(leaves)


def table(n=160, seed=3):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 3)).round(1)
    x[r.random((n, 3)) < 0.1] = np.nan
    y = (np.nan_to_num(x[:, 0]) * np.nan_to_num(x[:, 1]) + 0.5 * np.isnan(x[:, 2]) + r.normal(size=n) > 0.2).astype(int)
    return x, y


def frame(spark, x, y, **more):
    df = pd.DataFrame({f"f{j}": x[:, j] for j in range(x.shape[1])} | {"y": y} | more)
    return spark.createDataFrame(df).replace(float("nan"), None)


def edges_of(x):
    return [np.unique(x[~np.isnan(x[:, j]), j]) for j in range(x.shape[1])]


@pytest.mark.parametrize("params", [B.Params(1, 0.3, 8, 3, 1), B.Params(1, 0.1, 31, 64, 5), B.Params(1, 0.1, 6, 64, 20, balanced=True)])
def test_one_round_against_brute_force(monkeypatch, params):
    monkeypatch.setattr(B, "_sum", lambda parts: parts)
    x, y = table()
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum())) if params.balanced else np.ones(len(y))
    p = 0.5 if params.balanced else y.mean()
    want, leaves = brute_tree(x, (p - y) * weight, np.full(len(y), p * (1 - p)) * weight, params)
    rounds = list(B.grow(x, y, np.ones((len(y), 1), bool), 2, edges_of(x), params))
    trees = pd.DataFrame([r for t in rounds for r in t], columns=[c.split()[0] for c in B.TREES.split(", ")])
    assert (trees["feature"][1:] < 0).sum() == leaves
    got = B.Model(trees, ["a", "b", "c"], 2, 1).margins(x, np.zeros(len(y), int))[:, 0]
    assert np.allclose(got, math.log(p / (1 - p)) + want, atol=1e-9)


def test_folds_side_by_side_are_the_models_of_each(spark):
    ship(spark)
    x, y = table(400)
    fold = np.arange(400) % 2
    df = frame(spark, x, y, fold=fold).repartition(3)
    names, params = ["f0", "f1", "f2"], B.Params(5, 0.2, 7, 64, 5)
    both = B.fit(df, names, "y", 2, [F.col("fold") != 0, F.col("fold") != 1], params)
    for f in (0, 1):
        alone = B.fit(df.filter(F.col("fold") != f), names, "y", 2, None, params)
        p, q = both.probabilities(x, np.full(400, f)), alone.probabilities(x, np.zeros(400, int))
        assert np.abs(p - q).mean() < 0.05  # bins of all rows against those of one half
    got = B.predict(both, df, F.col("fold")).toPandas()
    assert len(got) == 400 and np.allclose([sum(v) for v in got["p"]], 1)


def test_tasks_agree_on_the_same_trees(spark, monkeypatch):
    ship(spark)
    x, y = table(300)
    df, params = frame(spark, x, y), B.Params(1, 0.3, 4, 64, 5)
    one = B.fit(df, ["f0", "f1", "f2"], "y", 2, None, params).trees
    monkeypatch.setattr(B, "ROWS", 150)
    two = B.fit(df, ["f0", "f1", "f2"], "y", 2, None, params).trees
    assert one["feature"].tolist() == two["feature"].tolist() and np.allclose(one["value"], two["value"])


def test_direction_guard_and_forest_out_of_fold(spark):
    ship(spark)
    r = np.random.default_rng(5)
    n = 900
    x = r.normal(size=(n, 2))
    label = np.where(x[:, 0] > 0.5, 1, np.where(x[:, 1] > 0.5, -1, 0))
    bars = spark.createDataFrame([("S", i) for i in range(n)], "symbol string, bar_idx long")
    df = spark.createDataFrame(pd.DataFrame({"symbol": "S", "bar_idx": range(n), "label": label, "a": x[:, 0], "b": x[:, 1]})).withColumn("a", F.when(F.col("bar_idx") % 50 != 0, F.col("a")))
    rows = ML.folded(df, bars).cache()
    assert rows.filter("fold = 0 AND train_0 OR fold = 1 AND train_1").count() == 0 and rows.filter("train_0").count() == 591
    out = ML.predict_direction(ML.train_direction(rows, ["a", "b"]), rows).toPandas()
    assert np.allclose(out[["p_down", "p_flat", "p_up"]].sum(axis=1), 1) and (out["direction"] == out["label"]).mean() > 0.95
    guard = ML.train_guard(rows, ["a", "b"])
    assert guard.trees["round"].max() == 999
    scored = ML.predict_guard(guard, rows).toPandas()
    assert ((scored["p"] > 0.5) == (scored["label"] == 1)).mean() > 0.95
    gain = {r.feature: r.importance for r in ML.importance(spark, guard).collect()}
    assert gain["a"] > 0.8 and abs(sum(gain.values()) - 1) < 1e-9
    forest = ML.out_of_fold_forest(rows, ["a", "b"], trees=10).toPandas()
    assert len(forest) == n and ((forest["p"] > 0.5) == (forest["label"] == 1)).mean() > 0.95


def test_one_class_and_no_rows(spark):
    ship(spark)
    df = spark.createDataFrame([(1.0, 1), (2.0, 1), (None, 1)], "f0 double, y int")
    assert B.fit(df, ["f0"], "y", 2, None, B.Params(2)).probabilities(np.array([[1.0]]), np.zeros(1, int))[0, 1] > 0.99
    assert len(B.fit(df.limit(0), ["f0"], "y", 2, None, B.Params(1)).trees) == 2


def test_folds_of_a_small_table_are_tasks_of_their_own(spark, monkeypatch):
    ship(spark)
    x, y = table(300)
    df = frame(spark, x, y, fold=np.arange(300) % 3)
    names, params, folds = ["f0", "f1", "f2"], B.Params(2, 0.3, 4, 64, 5, balanced=True), [*[F.col("fold") != f for f in range(2)], F.lit(False)]
    monkeypatch.setattr(B, "ROWS", 150)
    together = B.fit(df, names, "y", 2, folds, params).trees
    monkeypatch.undo()

    def refuse(*_, **__):
        raise AssertionError("one task for all folds")

    monkeypatch.setattr(type(df), "mapInPandas", refuse)
    alone = B.fit(df, names, "y", 2, folds, params).trees
    assert alone[["round", "lane", "node", "feature"]].equals(together[["round", "lane", "node", "feature"]])
    assert np.allclose(alone["value"], together["value"]) and alone["lane"].max() == 2
