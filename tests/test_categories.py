"""Correspondence analyses against decompositions of the whole indicator matrix."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrystat.operators import categories


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 3, 500)
    b = (a + (rng.random(500) < 0.4) * rng.integers(0, 4, 500)) % 4
    c = (b + rng.integers(0, 2, 500)) % 3
    return np.column_stack([a, b, c])


@pytest.fixture(scope="module")
def rows(spark, data):
    made = [(f"a{x}", int(y), f"c{z}") for x, y, z in data]
    return spark.createDataFrame([*made, (None, 1, "c0"), ("a1", None, "c0")], "a string, b int, c string").repartition(3)


def test_two_columns(spark, rows, data):
    fit = categories.correspondence(rows, "a", "b")
    table = np.array([[((data[:, 0] == i) & (data[:, 1] == j)).sum() for j in range(4)] for i in range(3)]) + np.eye(3, 4) * 0
    n = table.sum()
    expected = np.outer(table.sum(axis=1), table.sum(axis=0)) / n
    assert fit.total == pytest.approx(((table - expected) ** 2 / expected).sum() / n)
    assert fit.n == n
    # distances between profiles are those between coordinates
    profile = table / table.sum(axis=1, keepdims=True)
    distance = ((profile[0] - profile[1]) ** 2 / (table.sum(axis=0) / n)).sum()
    assert ((fit.coordinates[0] - fit.coordinates[1]) ** 2).sum() == pytest.approx(distance)
    told = fit.frame(spark).where("axis = 1").groupBy("column").agg(F.sum("contribution").alias("s")).collect()
    assert [r["s"] for r in told] == pytest.approx([1, 1])
    assert fit.inertias(spark).agg(F.sum("share")).first()[0] == pytest.approx(1)


def test_several_columns(rows, data):
    complete = rows.where("a IS NOT NULL AND b IS NOT NULL")
    fit = categories.multiple(rows, ["a", "b", "c"])
    z = np.column_stack([data[:, [j]] == k for j, m in enumerate((3, 4, 3)) for k in range(m)]).astype(float)
    p = z / z.sum()
    r, c = p.sum(axis=1), p.sum(axis=0)
    _, s, vt = np.linalg.svd((p - np.outer(r, c)) / np.sqrt(np.outer(r, c)), full_matrices=False)
    s = s[s > 1e-9]
    assert fit.inertia == pytest.approx(s**2)
    assert fit.total == pytest.approx(10 / 3 - 1)
    expected = vt[: len(s)].T / np.sqrt(c)[:, None] * s
    assert np.abs(fit.coordinates) == pytest.approx(np.abs(expected), abs=1e-8)
    got = categories.project(complete, fit, 1).agg(F.avg("axis1"), F.var_pop("axis1"), F.count("axis1")).first()
    assert got[:2] == pytest.approx((0, s[0] ** 2), abs=1e-9)
    assert got[2] == 500


def test_edges(spark, rows):
    with pytest.raises(ValueError, match="no complete rows"):
        categories.multiple(rows.where("false"), ["a", "b"])
    alone = categories.correspondence(rows.where("a = 'a1'"), "a", "b")
    assert alone.total == 0
    assert alone.inertias(spark).count() == 0
    weighted = categories.correspondence(rows.withColumn("w", F.lit(2.0)), "a", "b", weight="w")
    assert weighted.total == pytest.approx(categories.correspondence(rows, "a", "b").total)
    unknown = categories.project(rows.withColumn("a", F.lit("new")), categories.multiple(rows, ["a", "b"]), 1)
    assert unknown.where("axis1 IS NOT NULL").count() == 0
