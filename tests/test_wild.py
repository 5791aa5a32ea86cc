"""Wild cluster tests against a direct run over all sign patterns, and score tests under the null."""

import itertools

import numpy as np
import pytest

from quarrystat.functions import jets as J
from quarrystat.operators import mle, wild
from quarrystat.plans.spec import Spec


def made(spark, groups, effect=0.0, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        u = rng.normal()
        for _ in range(int(rng.integers(5, 15))):
            x, z = rng.normal() + u / 2, rng.normal()
            rows.append((f"g{g}", float(1 + effect * x + 0.5 * z + u + rng.normal()), float(x), float(z)))
    return spark.createDataFrame([*rows, (None, 1.0, 1.0, 1.0), ("g0", None, 1.0, 1.0)], "g string, y double, x double, z double").repartition(3), rows


def direct(rows, value, patterns):
    """The statistics of the sample and of each sign pattern, refitted row by row."""
    g = np.array([r[0] for r in rows])
    y, x = np.array([r[1] for r in rows]), np.column_stack([[r[2] for r in rows], [r[3] for r in rows], np.ones(len(rows))])
    inverse = np.linalg.inv(x.T @ x)
    names = sorted(set(g))
    rest = np.linalg.lstsq(x[:, 1:], y - value * x[:, 0], rcond=None)[0]
    fitted = value * x[:, 0] + x[:, 1:] @ rest
    u = y - fitted

    def t(v):
        b = inverse @ x.T @ v
        e = v - x @ b
        s = np.array([inverse[0] @ (x[g == n].T @ e[g == n]) for n in names])
        return (b[0] - value) / np.sqrt((s**2).sum())

    out = [t(y)]
    for signs in patterns(len(names)):
        w = dict(zip(names, signs, strict=True))
        out.append(t(fitted + u * np.array([w[n] for n in g])))
    return np.array(out)


def test_all_patterns(spark):
    df, rows = made(spark, 7, 0.4)
    test = wild.wild_cluster(df, Spec("y", ("x", "z")), "x", "g")
    assert test.exact
    assert test.clusters == 7
    for value in (0.0, 0.3, -1.0):
        expected = direct(rows, value, lambda n: itertools.product((1, -1), repeat=n))
        got = test.statistic(value)
        assert got[0] == pytest.approx(expected[0])
        assert np.sort(np.abs(got[1:])) == pytest.approx(np.sort(np.abs(expected[1:])), abs=1e-7)
        assert test.p_value(value) == pytest.approx((np.abs(expected[1:]) >= abs(expected[0]) * (1 - 1e-9)).mean())
    low, high = test.confidence_set(0.1)
    assert low < test.estimate < high
    assert test.p_value(low - 0.02) <= 0.1 < test.p_value(low + 0.02)
    assert test.p_value(high + 0.02) <= 0.1 < test.p_value(high - 0.02)


def test_many_clusters_repeat(spark):
    df, _ = made(spark, 40, 0.0, 3)
    one = wild.wild_cluster(df, Spec("y", ("x", "z")), "x", "g", draws=499)
    two = wild.wild_cluster(df.repartition(6), Spec("y", ("x", "z")), "x", "g", draws=499)
    assert not one.exact
    assert np.allclose(one.statistic(0.1), two.statistic(0.1))
    assert one.p_value(one.estimate) > 0.9
    assert one.p_value(one.estimate + 5) < 0.01
    with pytest.raises(ValueError, match="no term"):
        wild.wild_cluster(df, Spec("y", ("x",)), "z", "g")
    with pytest.raises(ValueError, match="two clusters"):
        wild.wild_cluster(df.where("g = 'g1'"), Spec("y", ("x",)), "x", "g")


def test_scores_of_a_likelihood(spark):
    rng = np.random.default_rng(5)
    rows = []
    for g in range(60):
        for _ in range(20):
            x, z = rng.normal(), rng.normal()
            rows.append((g, float(rng.random() < 1 / (1 + np.exp(-0.2 - 0.6 * x))), float(x), float(z)))
    df = spark.createDataFrame(rows, "g long, y double, x double, z double")
    problem = mle.Problem(lambda y, e: e[0] * y["y"] - J.softplus(e[0]), ("y",), (mle.Equation("y", ("x", "z")),))
    t, p = wild.score_test(df, problem, "x", "g")
    assert abs(t) > 4
    assert p < 0.01
    _, p = wild.score_test(df, problem, "x", "g", value=0.6)
    assert p > 0.02
    _, p = wild.score_test(df, problem, "z", "g")
    assert p > 0.02
