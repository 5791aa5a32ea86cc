"""Random intercepts against dense integration and against data of known effects."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrystat.operators import mle, random_effects


def panels(spark, kind, groups=150, sigma=0.9, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        u = rng.normal() * sigma
        for _ in range(900 if g == 0 else int(rng.integers(1, 15))):
            x = float(rng.normal())
            eta = 0.4 + 0.7 * x + u
            y = {"logit": lambda: float(rng.random() < 1 / (1 + math.exp(-eta))), "probit": lambda: float(eta + rng.normal() > 0), "poisson": lambda: float(rng.poisson(math.exp(eta))), "gaussian": lambda: eta + 1.5 * float(rng.normal())}[kind]()  # noqa: B023
            rows.append((f"g{g}", y, x, 1))
    rows += [(None, 1.0, 0.0, 1), ("g1", None, 0.0, 1), ("g2", 1.0, None, 1)]
    return spark.createDataFrame(rows, "g string, y double, x double, a int").repartition(5)


def dense(rows, beta, row):
    """The log likelihood by 4001 points over the effect."""
    at = np.linspace(-9, 9, 4001)
    total = 0.0
    groups: dict = {}
    for r in rows:
        groups.setdefault(r["g"], []).append((r["y"], r["x"]))
    for own in groups.values():
        y, x = np.array(own).T
        eta = beta[1] + beta[0] * x[:, None] + math.exp(beta[-1]) * at
        t = row(y[:, None], eta).sum(axis=0) - at**2 / 2 - 0.5 * math.log(2 * math.pi)
        top = t.max()
        total += math.log(np.exp(t - top).sum() * (at[1] - at[0])) + top
    return total


ROW = {
    "logit": lambda y, e: e * y - np.logaddexp(0, e),
    "poisson": lambda y, e: e * y - np.exp(e) - np.array([[math.lgamma(v + 1)] for v in y[:, 0]]),
}


@pytest.mark.parametrize("kind", ["logit", "poisson"])
def test_likelihood_and_its_maximum(spark, kind):
    df = panels(spark, kind)
    fit = getattr(mle, kind)(df, "y", ("x",), panel="g")
    assert fit.names == ["x", "_cons", "lnsigma_u"]
    assert np.all(np.abs(fit.beta - [0.7, 0.4, math.log(0.9)]) < [0.2, 0.35, 0.25])
    rows = df.na.drop().collect()
    top = dense(rows, fit.beta, ROW[kind])
    assert fit.metrics["loglik"] == pytest.approx(top, rel=1e-7)
    hessian = np.zeros((3, 3))
    h = 1e-3
    for i in range(3):
        for j in range(3):
            a, b = h * np.eye(3)[i], h * np.eye(3)[j]
            hessian[i, j] = sum(s * dense(rows, fit.beta + p * a + q * b, ROW[kind]) for s, p, q in ((1, 1, 1), (-1, 1, -1), (-1, -1, 1), (1, -1, -1))) / (4 * h * h)
        slope = (dense(rows, fit.beta + h * np.eye(3)[i], ROW[kind]) - dense(rows, fit.beta - h * np.eye(3)[i], ROW[kind])) / (2 * h)
        assert abs(slope) < 2e-2
    assert np.allclose(np.linalg.inv(-hessian), fit.covariance, rtol=2e-3, atol=1e-7)
    assert fit.metrics["groups"] == 150
    lr, p = random_effects.no_effects_test(fit)
    assert lr > 50
    assert p < 1e-6
    assert fit.effects.count() == 150


def test_a_linear_model_equals_its_closed_form(spark):
    df = panels(spark, "gaussian")
    fit = mle.gaussian(df, "y", ("x",), panel="g")
    at = dict(zip(fit.names, fit.beta, strict=True))
    s2, u2 = math.exp(2 * at["lnsigma:_cons"]), math.exp(2 * at["lnsigma_u"])
    groups: dict = {}
    for r in df.na.drop().collect():
        groups.setdefault(r["g"], []).append(r["y"] - at["y:x"] * r["x"] - at["y:_cons"])
    total = 0.0
    for own in groups.values():
        e, n = np.array(own), len(own)
        shrink = u2 / (s2 + n * u2)
        total -= 0.5 * (n * math.log(2 * math.pi) + (n - 1) * math.log(s2) + math.log(s2 + n * u2) + (e @ e - shrink * e.sum() ** 2) / s2)
    assert fit.metrics["loglik"] == pytest.approx(total, rel=1e-8)
    assert abs(u2 - 0.81) < 0.35
    effect = {r["g"]: r["effect"] for r in fit.effects.collect()}
    for g, own in list(groups.items())[:20]:
        assert effect[g] == pytest.approx(u2 / (s2 + len(own) * u2) * sum(own), abs=1e-4)


def test_other_models_take_panels(spark):
    df = panels(spark, "probit")
    fit = mle.probit(df, "y", ("x",), panel="g")
    assert np.all(np.abs(fit.beta - [0.7, 0.4, math.log(0.9)]) < 0.3)
    assert 0.3 < random_effects.share_of_variance(fit, 1.0) < 0.6
    counts = panels(spark, "poisson", seed=3).withColumn("y", F.least("y", F.lit(3.0)))
    cuts = mle.ordered_logit(counts, "y", ("x",), panel="g")
    assert cuts.names[-1] == "lnsigma_u"
    assert cuts.metrics["loglik"] > cuts.metrics["loglik_pooled"] + 20
    censored = mle.tobit(panels(spark, "gaussian"), "y", ("x",), low=0.0, panel="g")
    assert abs(censored.beta[0] - 0.7) < 0.15


def test_panels_that_do_not_differ_are_an_error(spark):
    rows = spark.createDataFrame([(g, float(y)) for g in range(40) for y in (0, 1)], "g long, y double")
    with pytest.raises(mle.NotConverged, match="don't differ"):
        mle.logit(rows, "y", (), panel="g")
    with pytest.raises(ValueError, match="no complete rows"):
        mle.logit(rows.where("false"), "y", (), panel="g")
