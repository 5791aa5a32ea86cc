"""Expectation-maximisation against closed forms and direct steps, Little's test, and pooled imputations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrystat.operators import imputation
from quarrystat.operators.linear import ols
from quarrystat.plans.spec import Spec


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(7)
    z = rng.normal(size=(900, 3)) @ np.array([[1, 0.6, 0.3], [0, 1, 0.5], [0, 0, 1]]) + [100, 5, -2]
    z[rng.random(900) < 0.3, 1] = np.nan
    z[rng.random(900) < 0.2, 2] = np.nan
    z[:5] = np.nan
    return z


@pytest.fixture(scope="module")
def rows(spark, data):
    return spark.createDataFrame([(i, *[None if math.isnan(v) else float(v) for v in r], "x") for i, r in enumerate(data)], "i long, a double, b double, c double, mean string").repartition(4)


def test_monotone_missing_has_a_closed_form(rows, data):
    fit = imputation.normal_em(rows, ["a", "b"])
    a, b = data[5:, 0], data[5:, 1]
    seen = ~np.isnan(b)
    slope = np.cov(a[seen], b[seen], bias=True)[0, 1] / a[seen].var()
    cut = b[seen].mean() - slope * a[seen].mean()
    assert fit.mean == pytest.approx([a.mean(), cut + slope * a.mean()], abs=1e-6)
    residual = (b[seen] - cut - slope * a[seen]).var()
    assert fit.covariance[1, 1] == pytest.approx(residual + slope**2 * a.var(), rel=1e-6)
    assert fit.n == 895


def test_general_patterns_reach_the_maximum(rows, data):
    fit = imputation.normal_em(rows, ["a", "b", "c"])

    def loglik(mean, cov):
        total = 0.0
        for r in data[5:]:
            o = ~np.isnan(r)
            d, s = r[o] - mean[o], cov[np.ix_(o, o)]
            total -= 0.5 * (o.sum() * math.log(2 * math.pi) + np.linalg.slogdet(s)[1] + d @ np.linalg.solve(s, d))
        return total

    top = loglik(fit.mean, fit.covariance)
    assert fit.loglik == pytest.approx(top, rel=1e-9)
    for i in range(3):
        for s in (-1e-3, 1e-3):
            assert loglik(fit.mean + s * np.eye(3)[i], fit.covariance) < top
            assert loglik(fit.mean, fit.covariance * (1 + s * np.outer(np.eye(3)[i], np.eye(3)[i]))) < top


def test_missing_at_random(rows):
    at_random = imputation.missing_at_random(rows, ["a", "b", "c"]).first()
    assert at_random["patterns"] == 4
    assert at_random["df"] == 3 + 2 + 2 + 1 - 3
    assert at_random["p_value"] > 0.001
    odd = rows.withColumn("b", F.when(F.col("a") < 100.5, F.col("b")))
    assert imputation.missing_at_random(odd, ["a", "b", "c"]).first()["p_value"] < 1e-6


def test_imputations_repeat_and_pool(rows, data):
    made = imputation.impute(rows, ["a", "b", "c"], ["i"], imputations=8)
    assert made.columns == ["i", "mean", "imputation", "a", "b", "c"]
    assert made.count() == 8 * 900
    again = imputation.impute(rows.repartition(2), ["a", "b", "c"], ["i"], imputations=8)
    one, two = ({(r["i"], r["imputation"]): r["b"] for r in t.collect()} for t in (made, again))
    assert one.keys() == two.keys()
    assert all(one[k] == pytest.approx(two[k], abs=1e-6) for k in one)
    assert all(one[i, m] == pytest.approx(data[i, 1]) for i in range(5, 900) if not math.isnan(data[i, 1]) for m in (1, 5))
    fits = [ols(made.where((F.col("imputation") == m) & (F.col("i") >= 5)), Spec("b", ("a",))) for m in range(1, 9)]
    fit = imputation.pooled(fits, 893)
    seen = ~np.isnan(data[:, 1])
    slope = np.cov(data[seen, 0], data[seen, 1])[0, 1] / data[seen, 0].var(ddof=1)
    at = fit.names.index("a")
    assert fit.beta[at] == pytest.approx(slope, abs=0.08)
    assert fit.covariance[at, at] > np.mean([f.covariance[at, at] for f in fits])
    assert 0.05 < fit.metrics["missing_information"] < 0.7
    assert fit.df < 893


def test_what_cannot_be_fitted_is_an_error(spark, rows):
    with pytest.raises(ValueError, match="no values"):
        imputation.normal_em(rows.withColumn("c", F.lit(None).cast("double")), ["a", "c"])
    with pytest.raises(ValueError, match="doesn't vary"):
        imputation.normal_em(rows.withColumn("c", F.lit(1.0)), ["a", "c"])
    with pytest.raises(ValueError):
        imputation.pooled([])
