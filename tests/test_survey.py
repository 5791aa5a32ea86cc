"""Designs of several stages against a recursion over nested dictionaries; replicates against their closed forms."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrystat.operators import mle, survey
from quarrystat.operators.survey import Design, Stage

THREE = Design("w", (Stage("psu", "h", "N1"), Stage("ssu", None, "N2"), Stage("tsu", "h3", "N3")))


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(17)
    rows = []
    for h in range(3):
        for p in range(2 + h):
            for s in range(int(rng.integers(2, 4))):
                for t in range(4):
                    for _ in range(int(rng.integers(1, 3))):
                        y = 10 + h + 2 * rng.normal() + p
                        x = rng.normal() + 3
                        rows.append((h, p, s, t, t % 2, float(rng.uniform(1, 4)), 8 + h, 6, 9, float(y), float(x), "ab"[int(rng.random() < 0.4)], float(rng.random() < 1 / (1 + math.exp(1 - x / 2)))))
    schema = "h int, psu int, ssu int, tsu int, h3 int, w double, N1 int, N2 int, N3 int, y double, x double, k string, d double"
    return spark.createDataFrame([*rows, (None, 1, 1, 1, 1, 1.0, 8, 6, 9, 1.0, 1.0, "a", 0.0), (0, 1, 1, 1, 1, 1.0, 8, 6, 9, None, None, None, None)], schema).repartition(3)


def nested_variance(rows, z):
    """The variance of a total under THREE: each stage's spread, times the fractions of the stages above."""

    def spread(sums, population):
        m, f = len(sums), len(sums) / population
        return (1 - f) * m / (m - 1) * ((np.array(sums) - np.mean(sums)) ** 2).sum(), f

    def split(some, *keys):
        out: dict = {}
        for i in some:
            out.setdefault(tuple(rows[i][k] for k in keys), []).append(i)
        return out.values()

    total = 0.0
    for stratum in split(range(len(rows)), "h"):
        units = list(split(stratum, "psu"))
        v, f1 = spread([sum(z[i] for i in u) for u in units], rows[stratum[0]]["N1"])
        total += v
        for u in units:
            inner = list(split(u, "ssu"))
            v, f2 = spread([sum(z[i] for i in s) for s in inner], rows[u[0]]["N2"])
            total += f1 * v
            for s in inner:
                for third in split(s, "h3"):
                    last = list(split(third, "tsu"))
                    v, _ = spread([sum(z[i] for i in t) for t in last], rows[third[0]]["N3"])
                    total += f1 * f2 * v
    return total


def test_three_stages(sample):
    rows = sample.where("h IS NOT NULL AND y IS NOT NULL").collect()
    w, y, x = (np.array([r[c] for r in rows]) for c in ("w", "y", "x"))
    fit = survey.totals(sample, ["y", "x"], THREE)
    assert fit.beta == pytest.approx([w @ y, w @ x])
    assert fit.covariance[0, 0] == pytest.approx(nested_variance(rows, w * y))
    assert fit.df == 9 - 3
    mean = survey.means(sample, ["y"], THREE)
    assert mean.beta[0] == pytest.approx(w @ y / w.sum())
    assert mean.covariance[0, 0] == pytest.approx(nested_variance(rows, w * (y - mean.beta[0]) / w.sum()))
    ratio = survey.ratios(sample, [("y", "x")], THREE)
    assert ratio.covariance[0, 0] == pytest.approx(nested_variance(rows, w * (y - ratio.beta[0] * x) / (w @ x)))
    share = survey.proportions(sample, "k", THREE)
    assert share.names == ["a", "b"]
    assert sum(share.beta) == pytest.approx(1)


def test_a_variance_writes_strata_alone(sample, monkeypatch):
    """Units are summed stage by stage in one plan: what is written is a row for each stratum of the first stage, with and
    without units of the stage above in a task each."""
    rows = sample.where("h IS NOT NULL AND y IS NOT NULL")
    z = [r["w"] * r["y"] for r in rows.collect()]
    scores = survey._keyed(rows, THREE, [(F.col("w") * F.col("y")).alias("z0")])
    made = []
    monkeypatch.setattr(survey, "written", lambda df: made.append(df.count()) or df)
    for most in (survey.ROWS_OF_A_UNIT, 0):
        monkeypatch.setattr(survey, "ROWS_OF_A_UNIT", most)
        v, free = survey.variance(scores, THREE, 1)
        assert v[0, 0] == pytest.approx(nested_variance(rows.collect(), z))
        assert free == 9 - 3
    assert made == [3, 3]


@pytest.mark.parametrize("family", ["linear", "logit", "probit", "poisson"])
def test_regressions(sample, family):
    outcome = {"linear": "y", "logit": "d", "probit": "d", "poisson": "y"}[family]
    fit = survey.regression(sample, outcome, ("x",), THREE, family)
    rows = sample.where("h IS NOT NULL AND y IS NOT NULL").collect()
    w, y, x = (np.array([r[c] for r in rows]) for c in ("w", outcome, "x"))
    design = np.column_stack([x, np.ones(len(x))])
    eta = design @ fit.beta
    phi, big = np.exp(-eta**2 / 2) / math.sqrt(2 * math.pi), np.array([0.5 * math.erfc(-e / math.sqrt(2)) for e in eta])
    q = np.where(y > 0, 1.0, -1.0)
    mills = phi / np.where(q > 0, big, 1 - big) * q
    g = {"linear": lambda: y - eta, "logit": lambda: y - 1 / (1 + np.exp(-eta)), "probit": lambda: mills, "poisson": lambda: y - np.exp(eta)}[family]()
    h = {"linear": lambda: np.ones(len(y)), "logit": lambda: 1 / (2 + np.exp(eta) + np.exp(-eta)), "probit": lambda: mills * (eta + mills), "poisson": lambda: np.exp(eta)}[family]()
    assert np.abs(design.T @ (w * g)).max() < 0.02
    bread = np.linalg.inv(design.T @ (design * (w * h)[:, None]))
    z = (w * g)[:, None] * design @ bread
    for i in range(2):
        assert fit.covariance[i, i] == pytest.approx(nested_variance(rows, z[:, i]), rel=1e-3)


def test_lonely_units(spark):
    rows = spark.createDataFrame([(0, 0, 1.0, 2.0), (0, 1, 1.0, 4.0), (1, 2, 1.0, 9.0)], "h int, u int, w double, y double")
    with pytest.raises(ValueError, match="has one unit"):
        survey.totals(rows, ["y"], Design("w", (Stage("u", "h"),)))
    assert survey.totals(rows, ["y"], Design("w", (Stage("u", "h"),), "certainty")).covariance[0, 0] == pytest.approx(4)
    assert survey.totals(rows, ["y"], Design("w", (Stage("u", "h"),), "grand")).covariance[0, 0] == pytest.approx(4 + 16)
    with pytest.raises(ValueError, match="no rows"):
        survey.totals(rows.where("false"), ["y"], Design("w", (Stage("u", "h"),)))


@pytest.fixture(scope="module")
def halves(spark):
    rng = np.random.default_rng(5)
    rows = [(h, u, float(rng.uniform(1, 2)), float(rng.normal() + h + u), float(rng.uniform(1, 3))) for h in range(11) for u in range(2) for _ in range(int(rng.integers(2, 6)))]
    return spark.createDataFrame(rows, "h int, u int, w double, y double, x double").repartition(4)


PAIRED = Design("w", (Stage("u", "h"),))


def test_replicates_of_a_total_equal_its_linear_variance(halves):
    linear = survey.totals(halves, ["y", "x"], PAIRED)
    for fay in (0.0, 0.4):
        fit = survey.balanced(halves, survey.total_statistic(["y", "x"]), PAIRED, fay=fay)
        assert fit.beta == pytest.approx(linear.beta)
        assert np.allclose(fit.covariance, linear.covariance)
        assert fit.df == 11
    jack = survey.jackknifed(halves, survey.total_statistic(["y", "x"]), PAIRED)
    assert np.allclose(jack.covariance, linear.covariance)
    assert jack.df == 11


def test_replicates_of_means_and_regressions(halves):
    linear = survey.means(halves, ["y"], PAIRED)
    slope = survey.regression(halves, "y", ("x",), PAIRED)
    for method in (survey.balanced, survey.jackknifed, lambda *a: survey.bootstrapped(*a, draws=900)):
        fit = method(halves, survey.mean_statistic(["y"]), PAIRED)
        assert fit.beta == pytest.approx(linear.beta)
        assert fit.covariance[0, 0] == pytest.approx(linear.covariance[0, 0], rel=0.25)
        reg = method(halves, survey.regression_statistic("y", ("x",)), PAIRED)
        assert reg.beta == pytest.approx(slope.beta, rel=1e-6)
        assert reg.covariance[0, 0] == pytest.approx(slope.covariance[0, 0], rel=0.5)
    with pytest.raises(ValueError, match="two units"):
        survey.balanced(halves.where("h > 0 OR u = 0"), survey.mean_statistic(["y"]), PAIRED)


def test_replicate_weights_are_those_of_the_replicates(halves):
    made, number = survey.replicate_weights(halves, PAIRED, fay=0.3)
    assert number == 16
    sums = made.agg(*[F.sum(F.col("replicates")[i] * F.col("y")) for i in range(number)]).first()
    fit = survey.balanced(halves, survey.total_statistic(["y"]), PAIRED, fay=0.3)
    assert sum((s - fit.beta[0]) ** 2 for s in sums) / (number * 0.7**2) == pytest.approx(fit.covariance[0, 0])


@pytest.mark.parametrize("method", ["linear", "raking"])
def test_calibration(halves, method):
    goal = {"one": 150.0, "x": 310.0}
    rows = halves.withColumn("one", F.lit(1.0))
    got = survey.calibrate(rows, "w", goal, method=method)
    assert got.agg(F.sum("calibrated"), F.sum(F.col("calibrated") * F.col("x"))).first()[:] == pytest.approx((150, 310))
    if method == "raking":
        assert got.agg(F.min("calibrated")).first()[0] > 0
    fit = survey.calibrated_total(rows.withColumn("v", 2 * F.col("x") + 3), "v", goal, PAIRED, method=method)
    assert fit.beta[0] == pytest.approx(2 * 310 + 3 * 150)
    assert fit.covariance[0, 0] == pytest.approx(0, abs=1e-9)
    with pytest.raises(mle.NotConverged):
        survey.calibrate(rows.withColumn("also", F.lit(1.0)), "w", {"one": 1.0, "also": 2.0}, method=method)
