"""Trees against exhaustive search, and forests on known effects."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrystat.operators import trees


def exhaustive(x, y, depth, least):
    """(predictor, edge, left, right) or the mean, by trying every split."""
    def sse(v):
        return float(((v - v.mean()) ** 2).sum())

    best = (1e-9, None, None)
    for k in range(x.shape[1]):
        values = np.unique(x[:, k])
        for a, b in zip(values[:-1], values[1:], strict=True):
            left = x[:, k] <= (a + b) / 2
            if least <= left.sum() <= len(y) - least:
                saved = sse(y) - sse(y[left]) - sse(y[~left])
                if saved > best[0] * (1 + 1e-9):
                    best = (saved, k, (a + b) / 2)
    if depth == 0 or best[1] is None:
        return float(y.mean())
    left = x[:, best[1]] <= best[2]
    return best[1], best[2], exhaustive(x[left], y[left], depth - 1, least), exhaustive(x[~left], y[~left], depth - 1, least)


def nested(tree, node=0):
    if tree.feature[node] < 0:
        return trees.node_value(tree, node)
    return tree.feature[node], tree.edge[node], nested(tree, tree.left[node]), nested(tree, tree.left[node] + 1)


def alike(a, b):
    if not isinstance(a, tuple):
        return a == pytest.approx(b)
    return a[0] == b[0] and a[1] == pytest.approx(b[1]) and alike(a[2], b[2]) and alike(a[3], b[3])


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.integers(0, 30, 400), rng.integers(0, 12, 400), rng.integers(0, 3, 400)]).astype(float)
    y = 3 * (x[:, 0] > 11) + 2 * (x[:, 1] > 5) * (x[:, 0] > 11) + 0.3 * x[:, 2] + rng.normal(size=400)
    return x, y


@pytest.fixture(scope="module")
def rows(spark, data):
    made = [(*map(float, a), float(b), "ab"[int(b > 2)]) for a, b in zip(*data, strict=True)]
    return spark.createDataFrame([*made, (1.0, 1.0, 1.0, None, None)], "a double, b double, c double, y double, k string").repartition(4)


@pytest.mark.parametrize("least", [1, 15])
def test_regression_tree_equals_exhaustive_search(rows, data, least):
    tree = trees.cart(rows, "y", ["a", "b", "c"], depth=3, least=least)
    assert alike(nested(tree), exhaustive(*data, 3, least))
    got = trees.cart_predict(rows.where("y IS NOT NULL"), tree).select("a", "b", "c", "prediction").collect()
    leaf = tree.place(np.array([[r["a"], r["b"], r["c"]] for r in got]))
    assert [r["prediction"] for r in got] == pytest.approx([trees.node_value(tree, n) for n in leaf])


def test_classification_and_pruning(spark, rows, data):
    tree = trees.cart(rows, "k", ["a", "b", "c"], kind="class", depth=4, least=5)
    assert tree.levels == ["a", "b"]
    hits = trees.cart_predict(rows.where("k IS NOT NULL"), tree).where("prediction = k").count()
    assert hits > 320
    small = trees.pruned(tree, 5.0)
    assert 1 < len(small.leaves()) < len(tree.leaves())
    assert len(trees.pruned(tree, 1e9).leaves()) == 1
    assert small.stats[0].tolist() == tree.stats[0].tolist()
    told = trees.describe(spark, small).collect()
    assert sum(r["n"] for r in told if r["predictor"] is None) == 400
    assert told[0]["parent"] is None


def test_nulls_constant_and_empty(spark, rows):
    odd = rows.withColumns({"a": F.when(F.col("a") > 20, None).otherwise(F.col("a")), "d": F.lit(1.0)})
    tree = trees.cart(odd, "y", ["a", "d"], depth=2)
    assert trees.cart_predict(odd, tree).where("prediction IS NULL").count() == 0
    assert trees.cart(rows.where("false"), "y", ["a"]).leaves() == [0]
    assert trees.cart(rows, "y", ["a"], depth=0).leaves() == [0]


def test_many_values_are_cut_at_quantiles(spark):
    rows = spark.range(20_000).select((F.rand(3) * 100).alias("x")).withColumn("y", (F.col("x") > 37).cast("double"))
    tree = trees.cart(rows, "y", ["x"], depth=1, bins=64)
    assert abs(tree.edge[0] - 37) < 100 / 64


def test_split_is_by_hash(rows):
    learn, test = trees.prediction_split(rows, 0.7, seed=1)
    again, _ = trees.prediction_split(rows.repartition(2), 0.7, seed=1)
    assert learn.count() + test.count() == 401
    assert sorted(map(str, learn.collect())) == sorted(map(str, again.collect()))
    assert 230 < learn.count() < 330


def test_causal_forest_finds_who_gains(spark):
    rng = np.random.default_rng(2)
    n = 8000
    x, z = rng.uniform(size=n), rng.uniform(size=n)
    w = (rng.uniform(size=n) < 0.3 + 0.4 * z).astype(float)
    y = 2 * z + w * np.where(x > 0.5, 3.0, 0.0) + rng.normal(size=n)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(zip(x, z, w, y, strict=True))], "i long, x double, z double, w double, y double").repartition(3)
    forest = trees.causal_forest(df, "y", "w", ["x", "z"], trees=20, depth=3, keys=["i"])
    got = trees.causal_predict(df, forest).collect()
    assert len(got) == n
    high = np.mean([r["effect"] for r in got if r["x"] > 0.6])
    low = np.mean([r["effect"] for r in got if r["x"] < 0.4])
    assert abs(high - 3) < 0.35
    assert abs(low) < 0.35
    again = trees.causal_forest(df.repartition(7), "y", "w", ["x", "z"], trees=20, depth=3, keys=["i"])
    assert all(np.allclose(a, b) for a, b in zip(forest.sums, again.sums, strict=True))
    assert math.isfinite(high)


def test_trees_read_sums_where_bins_are_few(spark, monkeypatch):
    """Sums by bins give the trees, effects and predictions of the rows themselves, nulls included, and are far fewer."""
    rng = np.random.default_rng(4)
    n = 3000
    data = [(i, *[None if rng.random() < 0.05 else float(rng.integers(k)) for k in (40, 6, 3)], float(rng.random() < 0.5), float(rng.normal())) for i in range(n)]
    df = spark.createDataFrame(data, "i long, a double, b double, c double, w double, y double").repartition(3)
    df = df.withColumn("y", F.col("y") + F.coalesce(F.col("a") / 10, F.lit(1.0)) + F.col("w") * F.when(F.col("b") > 2, 3.0).otherwise(0.0))
    seen = []

    def noted(rows, *rest):
        seen.append(rows.count())
        return histograms(rows, *rest)

    histograms = trees._histograms
    monkeypatch.setattr(trees, "_histograms", noted)
    got = {}
    for most in (trees.MOST_SUMS, 0):
        monkeypatch.setattr(trees, "MOST_SUMS", most)
        seen.clear()
        tree = trees.cart(df, "y", ["b", "c"], depth=3, least=20)
        classes = trees.cart(df, "w", ["b", "c"], kind="class", depth=2, least=20)
        assert max(seen) <= 8 * 5 if most else min(seen) == n
        forest = trees.causal_forest(df, "y", "w", ["a", "b", "c"], trees=6, depth=2, bins=8, keys=["i"])
        effects = [r["effect"] for r in trees.causal_predict(df, forest).orderBy("i").collect()]
        got[most] = (tree, classes, forest, effects)
    (one, k1, f1, e1), (two, k2, f2, e2) = got.values()
    for x, z in [(one, two), (k1, k2), *zip(f1.trees, f2.trees, strict=True)]:
        assert (x.feature, x.edge, x.left) == (z.feature, z.edge, z.left)
        assert all(np.allclose(p, q) for p, q in zip(x.stats, z.stats, strict=True))
    assert all(np.allclose(p, q) for p, q in zip(f1.sums, f2.sums, strict=True))
    assert np.allclose(e1, e2)
    assert len(set(e1)) > 2


def test_effects_of_leaves_and_nulls(spark):
    tree = trees.Tree(["a"], [0, -1, -1], [0.5, math.inf, math.inf], [1, -1, -1], [np.zeros(3)] * 3)
    forest = trees.CausalForest([tree], [np.array([[0, 0, 0], [2, 4.0, 2.0], [1, 0, 0]])], ["a"])
    df = spark.createDataFrame([(0.0, "u"), (1.0, "v"), (None, "w")], "a double, other string")
    got = trees.causal_predict(df, forest)
    assert [tuple(r) for r in got.orderBy("other").collect()] == [(0.0, "u", 2.0), (1.0, "v", None), (None, "w", None)]
