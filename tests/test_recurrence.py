"""Ordered recurrences against plain loops, over one slice and over several that cut series."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrystat.functions import scan
from quarrystat.operators import recurrence as R
from quarrystat.operators.mle import NotConverged


def test_affine_steps_compose():
    rng = np.random.default_rng(0)
    for n in (1, 2, 7, 90):
        m, k = 3, 2
        a = np.stack([rng.normal(size=(m, k, k)) / 2, np.zeros((m, k, k))])
        steps = scan.Affine(a, (rng.random(n) < 0.1).astype(int), rng.normal(size=(n, m, k)))
        s = start = rng.normal(size=(m, k))
        for i, x in enumerate(scan.states(steps, start)):
            s = (a[steps.kind[i]] @ s[..., None])[..., 0] + steps.b[i]
            assert np.allclose(x, s)
        t, c = scan.composed(steps)
        assert np.allclose((t @ start[..., None])[..., 0] + c, s)


def test_kalman_elements_compose():
    rng = np.random.default_rng(1)
    for n in (1, 5, 60):
        k = 2
        q = rng.normal(size=(1, k, k))
        model = scan.Model(rng.normal(size=(1, k, k)) / 2, q @ np.swapaxes(q, 1, 2), rng.normal(size=(1, k)), np.array([0.3]), np.array([0.1]), np.ones((1, k)), np.eye(k)[None] * 3)
        y = np.where(rng.random(n) < 0.2, np.nan, rng.normal(size=n))
        first = rng.random(n) < 0.1
        a, p = np.zeros(k), np.eye(k)
        got = scan.filtered(model, y, first, a[None], p[None])
        for i in range(n):
            a, p = (model.a0[0], model.p0[0]) if first[i] else (model.f[0] @ a, model.f[0] @ p @ model.f[0].T + model.q[0])
            s = model.h[0] @ p @ model.h[0] + 0.3
            e = y[i] - 0.1 - model.h[0] @ a
            assert np.isclose(got.variance[i, 0], s)
            if not np.isnan(e):
                gain = p @ model.h[0] / s
                a, p = a + gain * e, p - np.outer(gain, model.h[0] @ p)
            assert np.allclose(got.mean[i, 0], a)
            assert np.allclose(got.spread[i, 0], p)
        mean, variance = scan.applied(scan.summary(model, y, first), np.zeros((1, k)), np.eye(k)[None])
        assert np.allclose(mean[0], a)
        assert np.allclose(variance[0], p)


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(4)
    rows = []
    for g, n in (("a", 400), ("b", 7), ("c", 1)):
        level = 10.0
        for t in range(n):
            level += rng.normal() / 3
            rows.append((g, t * 2, None if t % 50 == 9 else float(level + rng.normal()), 1))
    rows += [("a", None, 5.0, 1), (None, 3, 5.0, 1)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "g string, t long, y double, level long").repartition(3)


def by_group(series):
    groups: dict = {}
    for r in sorted((r for r in series.collect() if r["g"] and r["t"] is not None), key=lambda r: (r["g"], r["t"])):
        groups.setdefault(r["g"], []).append((r["t"], r["y"]))
    return groups


@pytest.mark.parametrize("per_slice", [1_000_000, 60])
@pytest.mark.parametrize("options", [{}, {"beta": 0.05}, {"beta": 0.05, "damping": 0.9}, {"beta": 0.02, "gamma": 0.1, "period": 4}])
def test_smoothing(series, per_slice, options):
    beta, gamma, period, damping = options.get("beta", 0.0), options.get("gamma", 0.0), options.get("period", 0), options.get("damping", 1.0)
    expected = {}
    for g, rows in by_group(series).items():
        level, trend, season = None, 0.0, [0.0] * period
        for i, (t, y) in enumerate(rows):
            if level is None:
                level, forecast = y, None
                if period:
                    season = [season[-1], *season[:-1]]
            else:
                forecast = level + damping * trend + (season[-1] if period else 0)
                e = 0.0 if y is None else y - forecast
                level, trend = level + damping * trend + 0.3 * e, damping * trend + beta * e
                if period:
                    season = [season[-1] + gamma * e, *season[:-1]]
            expected[g, t] = (forecast, level, trend)
    got = {(r["g"], r["t"]): (r["forecast"], r["level"], r["trend"]) for r in R.smooth(series, "y", "t", 0.3, ("g",), per_slice=per_slice, **options).collect()}
    assert got.keys() == expected.keys()
    for key, x in expected.items():
        assert got[key] == pytest.approx(x, abs=1e-9), key


def test_a_pulse_far_back_still_counts(spark):
    rows = spark.range(401).select(F.col("id").alias("t"), (F.col("id") == 0).cast("double").alias("y"))
    last = R.smooth(rows, "y", "t", 0.01, per_slice=100).where("t = 400").first()
    assert last["forecast"] == pytest.approx(0.99**399)


def test_a_repeated_time_is_an_error(spark):
    rows = spark.createDataFrame([(1, 1.0), (1, 2.0)], "t long, y double")
    with pytest.raises(Exception, match="a time repeats within a series"):
        R.smooth(rows, "y", "t", 0.5).collect()


def test_an_empty_table(spark):
    assert R.smooth(spark.createDataFrame([], "t long, y double"), "y", "t", 0.5).collect() == []


def test_moving_average(series):
    got = {(r["g"], r["t"]): r["average"] for r in R.moving_average(series, "y", "t", 3, 2, ("g",)).collect()}
    for g, rows in by_group(series).items():
        for i, (t, _) in enumerate(rows):
            seen = [y for _, y in rows[max(0, i - 3) : i + 3] if y is not None]
            assert got[g, t] == pytest.approx(sum(seen) / len(seen))


def test_fitted_weights_have_the_least_squares(series):
    fit = R.exponential_fit(series, "y", "t", ("g",), per_slice=150)

    def sse(alpha):
        total = 0.0
        for rows in by_group(series).values():
            level = None
            for _, y in rows:
                if level is None:
                    level = y
                elif y is not None:
                    total += (y - level) ** 2
                    level += alpha * (y - level)
        return total

    best = min(np.linspace(0.02, 0.98, 481), key=sse)
    assert fit.metrics["weight_alpha"] == pytest.approx(best, abs=0.003)


def garch_loglik(y, p, v0, skew=False):
    h, e, total = v0, math.sqrt(v0), 0.0
    e2, low = v0, v0 / 2
    for i, x in enumerate(y):
        if i:
            h = math.exp(p[1]) + p[2] * e2 + (p[3] * low if skew else 0) + p[-1] * h
        else:
            h = v0
        e = x - p[0]
        e2, low = e * e, e * e if e < 0 else 0.0
        total -= 0.5 * (math.log(2 * math.pi) + math.log(h) + e2 / h)
    return total


def test_garch(spark):
    rng = np.random.default_rng(3)
    h, y = 1.0, []
    for _ in range(3000):
        e = rng.normal() * math.sqrt(h)
        y.append(0.5 + e)
        h = 0.1 + 0.15 * e * e + 0.75 * h
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "t long, y double")
    fit = R.garch(rows, "y", "t", per_slice=1300)
    p = dict(zip(fit.names, fit.beta, strict=True))
    assert abs(p["arch1"] - 0.15) < 0.05
    assert abs(p["garch1"] - 0.75) < 0.1
    v0 = float(np.var(y))
    assert fit.metrics["loglik"] == pytest.approx(garch_loglik(y, fit.beta, v0), rel=1e-9)
    for i in range(4):  # no better place near by
        for s in (-1e-2, 1e-2):
            assert garch_loglik(y, fit.beta + s * np.eye(4)[i], v0) < fit.metrics["loglik"]
    robust = R.garch(rows, "y", "t", robust=True)
    assert np.allclose(robust.beta, fit.beta, atol=1e-4)
    assert np.all(np.abs(np.log(np.diag(robust.covariance) / np.diag(fit.covariance))) < 1)
    variances = R.garch_variance(rows, "y", "t", p, v0, per_slice=700).orderBy("t").collect()
    h = v0
    for i, r in enumerate(variances):
        assert r["variance"] == pytest.approx(h)
        h = math.exp(p["lnomega"]) + p["arch1"] * (y[i] - p["mean"]) ** 2 + p["garch1"] * h
    ahead = R.garch_forecast(fit, variances[-1]["variance"], (y[-1] - p["mean"]) ** 2, 400)
    assert ahead[0] == pytest.approx(variances[-1]["next"])
    assert ahead[-1] == pytest.approx(math.exp(p["lnomega"]) / (1 - p["arch1"] - p["garch1"]), rel=1e-3)


def test_asymmetric_garch_and_arch(spark):
    rng = np.random.default_rng(5)
    h, y = 1.0, []
    for _ in range(2500):
        e = rng.normal() * math.sqrt(h)
        y.append(e)
        h = 0.2 + 0.05 * e * e + (0.25 * e * e if e < 0 else 0) + 0.6 * h
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "t long, y double")
    fit = R.garch(rows, "y", "t", asymmetric=True)
    assert fit.names == ["mean", "lnomega", "arch1", "tarch1", "garch1"]
    assert fit.beta[3] > 0.1
    assert fit.metrics["loglik"] == pytest.approx(garch_loglik(y, fit.beta, float(np.var(y)), True), rel=1e-9)
    plain = R.garch(rows, "y", "t", arch=2, garch=0)
    assert plain.names == ["mean", "lnomega", "arch1", "arch2"]
    assert plain.metrics["loglik"] < fit.metrics["loglik"]


def test_garch_over_slices_that_cut_short_series(spark):
    """ARCH(2) and GARCH(1, 1) likelihoods by plain loops over the series of a panel, some shorter than the lags or a slice's rows."""
    rng = np.random.default_rng(9)
    lengths = [1, 2, 3, 700, 1, 5, 290, 2]
    data = [(g, i, float(rng.normal() * (2 + (i % 7 == 0)))) for g, n in enumerate(lengths) for i in range(n)]
    rows = spark.createDataFrame(data, "g int, t long, y double").repartition(5)
    v0 = float(np.var([y for _, _, y in data]))
    by = [[y for g, _, y in data if g == k] for k in range(len(lengths))]
    for per_slice in (5_000, 90):
        fit = R.garch(rows, "y", "t", ("g",), arch=2, garch=0, per_slice=per_slice)
        mean, omega, a1, a2 = fit.beta[0], math.exp(fit.beta[1]), *fit.beta[2:]
        total = 0.0
        for ys in by:
            squares = [v0, v0, *[(y - mean) ** 2 for y in ys]]
            for i in range(len(ys)):
                h = omega + a1 * squares[i + 1] + a2 * squares[i] if i else v0
                total -= 0.5 * (math.log(2 * math.pi) + math.log(h) + squares[i + 2] / h)
        assert fit.metrics["loglik"] == pytest.approx(total, rel=1e-11)
        both = R.garch(rows, "y", "t", ("g",), asymmetric=True, per_slice=per_slice)
        assert both.metrics["loglik"] == pytest.approx(sum(garch_loglik(ys, both.beta, v0, True) for ys in by), rel=1e-11)


def test_passes_of_garch_move_no_rows(spark):
    """Rows are laid out once: a pass over the slices neither shuffles nor sorts them, and knows the values before each."""
    rows = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").alias("t"), (F.col("id") * 1.0).alias("y"))
    series = R.packed(rows, "y", "t", ("g",), lags=2, per_slice=100)
    assert "Exchange" not in series.rows._jdf.queryExecution().executedPlan().toString()
    wrong = R.summed(series, None, lambda r, first, _: np.array([len(first), first.sum(), np.nansum(r["y-1"] != r["y"] - 3), np.isnan(r["y-2"]).sum()], float))
    assert list(wrong) == [1000, 3, 3, 6]  # the first row of a series has no lag, the first two no second one


def dense_arma_loglik(y, mean, ar, ma, sigma):
    """The normal density with the covariance matrix of an ARMA process from a long moving average."""
    n, far = len(y), 4000
    psi = np.zeros(far)
    for i in range(far):
        psi[i] = (1.0 if i == 0 else ma[i - 1] if i <= len(ma) else 0.0) + sum(ar[j] * psi[i - 1 - j] for j in range(len(ar)) if i - 1 - j >= 0)
    gamma = np.array([psi[: far - k] @ psi[k:] for k in range(n)]) * sigma**2
    cov = gamma[np.abs(np.subtract.outer(np.arange(n), np.arange(n)))]
    seen = ~np.isnan(y)
    e, cov = (y - mean)[seen], cov[np.ix_(seen, seen)]
    return -0.5 * (seen.sum() * math.log(2 * math.pi) + np.linalg.slogdet(cov)[1] + e @ np.linalg.solve(cov, e))


def test_arima_has_the_exact_likelihood(spark):
    rng = np.random.default_rng(9)
    x, e = [0.0], rng.normal(size=500) * 2
    for i in range(1, 500):
        x.append(0.6 * x[-1] + e[i] + 0.4 * e[i - 1])
    y = np.array(x) + 3
    y[[17, 18, 200]] = np.nan
    rows = spark.createDataFrame([(i, None if np.isnan(v) else float(v)) for i, v in enumerate(y)], "t long, y double")
    order = R.Arima(p=1, q=1)
    parameters = {"_cons": 2.5, "ar1": 0.5, "ma1": 0.3, "lnsigma": 0.5}
    got = R.arima_filter(rows, "y", "t", order, parameters, per_slice=90).agg(F.sum("loglik")).first()[0]
    assert got == pytest.approx(dense_arma_loglik(y, 2.5, [0.5], [0.3], math.exp(0.5)), rel=1e-9)
    fitted = R.arima(rows, "y", "t", order, per_slice=260)
    b = fitted.fit.beta
    assert fitted.fit.names == ["_cons", "ar1", "ma1", "lnsigma"]
    assert np.all(np.abs(b - [3, 0.6, 0.4, math.log(2)]) < [0.8, 0.12, 0.15, 0.1])
    top = dense_arma_loglik(y, b[0], [b[1]], [b[2]], math.exp(b[3]))
    assert fitted.fit.metrics["loglik"] == pytest.approx(top, rel=1e-9)
    for i in range(4):
        for s in (-1e-2, 1e-2):
            c = b + s * np.eye(4)[i]
            assert dense_arma_loglik(y, c[0], [c[1]], [c[2]], math.exp(c[3])) < top
    ahead = R.arima_forecast(rows, fitted, 200).orderBy("step").collect()
    assert ahead[-1]["forecast"] == pytest.approx(b[0], abs=1e-6)
    variance = math.exp(2 * b[3]) * (1 + (b[1] + b[2]) ** 2 / (1 - b[1] ** 2))
    assert ahead[-1]["std_error"] == pytest.approx(math.sqrt(variance), rel=1e-6)
    assert ahead[0]["std_error"] == pytest.approx(math.exp(b[3]), rel=1e-6)


def test_differences_seasons_and_predictors(spark):
    rng = np.random.default_rng(2)
    n = 420
    w = rng.normal(size=n)
    x = rng.normal(size=n)
    y = np.cumsum(w + np.r_[0, 0.5 * w[:-1]]) + 2 * x
    rows = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(y, x, strict=True))], "t long, y double, x double")
    fit = R.arima(rows, "y", "t", R.Arima(d=1, q=1), predictors=("x",), constant=False, per_slice=200).fit
    assert fit.names == ["x", "ma1", "lnsigma"]
    assert abs(fit.beta[0] - 2) < 0.1
    assert abs(fit.beta[1] - 0.5) < 0.12
    walk = R.arima(rows.withColumn("y", F.col("y") - 2 * F.col("x")), "y", "t", R.Arima(d=1), constant=False)
    ahead = R.arima_forecast(rows.withColumn("y", F.col("y") - 2 * F.col("x")), walk, 9).orderBy("step").collect()
    assert ahead[8]["std_error"] == pytest.approx(3 * ahead[0]["std_error"], rel=1e-9)  # a random walk
    assert ahead[8]["forecast"] == pytest.approx((y - 2 * x)[-1])
    season = R.Arima(p=1, sp=1, season=4)
    got = R.arima_filter(rows, "x", "t", season, {"_cons": 0.0, "ar1": 0.5, "sar1": 0.3, "lnsigma": 0.0}).agg(F.sum("loglik")).first()[0]
    assert got == pytest.approx(dense_arma_loglik(x, 0.0, [0.5, 0, 0, 0.3, -0.15], [], 1.0), rel=1e-8)
    with pytest.raises(ValueError, match="not stationary"):
        R.arima_filter(rows, "x", "t", R.Arima(p=1), {"_cons": 0.0, "ar1": 1.5, "lnsigma": 0.0})


def test_unobserved_components(series):
    fit = R.components(series.where("g = 'a'"), "y", "t", per_slice=130)
    assert fit.names == ["lnvar_irregular", "lnvar_level"]
    assert np.all(np.abs(fit.beta - [0.0, math.log(1 / 9)]) < [0.4, 0.9])
    v = dict(zip(["irregular", "level"], np.exp(fit.beta), strict=True))
    rows = R.components_filter(series, "y", "t", v, ("g",), variance=fit.metrics["variance"], middle=5.0, per_slice=50).collect()
    got = {(r["g"], r["t"]): (r["prediction"], r["variance"], r["level"]) for r in rows}
    for g, own in by_group(series).items():
        a, p = 5.0, 1e6 * fit.metrics["variance"]
        for i, (t, y) in enumerate(own):
            if i:
                p += v["level"]
            s = p + v["irregular"]
            ahead = a
            if y is not None:
                a, p = a + p / s * (y - a), p - p * p / s
            assert got[g, t] == pytest.approx((ahead, s, a), rel=1e-7)
    trend = R.components_filter(series, "y", "t", v | {"slope": 0.01, "seasonal": 0.02}, ("g",), variance=1.0, season=4)
    assert set(trend.columns) == {"g", "t", "prediction", "variance", "level", "slope", "season"}


def test_what_has_no_maximum_is_an_error(spark):
    rows = spark.range(30).select(F.col("id").alias("t"), F.lit(1.0).alias("y"))
    with pytest.raises(ValueError, match="no variance"):
        R.garch(rows, "y", "t")
    with pytest.raises(NotConverged):
        R.newton(lambda p: p[:, 0], np.zeros(1))
