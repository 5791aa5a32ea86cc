"""Likelihood models: data made from known coefficients, plain formulas as a check of jets, and failures that must show."""

import math

import numpy as np
import pyarrow as pa
import pytest

from quarrystat.functions import jets as J
from quarrystat.operators import mle

N = 6_000
RNG = np.random.default_rng(12)
X, Z = RNG.standard_normal(N), RNG.standard_normal(N)
NORMAL = RNG.standard_normal(N)
LOGISTIC = np.log(RNG.random(N)) - np.log1p(-RNG.random(N))
U = RNG.random(N)
U2 = RNG.random(N)
ETA = 0.4 + 0.6 * X


def logistic():
    u = RNG.random(N)
    return np.log(u) - np.log1p(-u)


def made(spark, **columns):
    return spark.createDataFrame(pa.table({"x": X, "z": Z, **{k: np.asarray(v, float) for k, v in columns.items()}})).repartition(3)


def near(fit, **want):
    se = dict(zip(fit.names, np.sqrt(np.diag(fit.covariance)), strict=True))
    got = dict(zip(fit.names, fit.beta, strict=True))
    for name, value in want.items():
        key = name if name in got else next(n for n in got if n.replace(":", "_") == name)
        assert 0 < se[key] < 0.5, (key, se[key])
        assert abs(got[key] - value) < 4.5 * se[key], (key, got[key], value, se[key])


def test_special_functions():
    v = np.array([-30.0, -8.0, -3.0, -1.0, 0.0, 0.5, 2.9, 3.1, 9.0])
    assert J.log_normal_cdf(v) == pytest.approx([math.log(0.5 * math.erfc(-x / math.sqrt(2))) for x in v], rel=1e-11, abs=1e-15)
    g = np.array([0.05, 0.7, 1.0, 4.2, 9.99, 33.0])
    low, d1, d2 = J.gammas(g)
    assert low == pytest.approx([math.lgamma(x) for x in g], rel=1e-12, abs=1e-13)
    h = 1e-5
    assert d1 == pytest.approx([(math.lgamma(x + h) - math.lgamma(x - h)) / (2 * h) for x in g], rel=1e-6)
    assert d2 == pytest.approx((J.gammas(g + h)[1] - J.gammas(g - h)[1]) / (2 * h), rel=1e-6)


def test_jets_match_differences():
    rng = np.random.default_rng(3)
    at = [rng.standard_normal(5) * 0.5 for _ in range(3)]

    def f(a, b, c):
        return J.log_binormal(a, b, J.tanh(c)) + J.lgamma(J.exp(a)) * J.softplus(b) / (J.exp(c) + 1.0) - J.log1mexp(J.exp(b)) * J.log_ndtr(a - c)

    out, h = f(*J.Jet.variables(at)), 1e-5
    for i in range(3):
        up, down = [x.copy() for x in at], [x.copy() for x in at]
        up[i] += h
        down[i] -= h
        a, b = f(*J.Jet.variables(up)), f(*J.Jet.variables(down))
        assert out.g[i] == pytest.approx((a.v - b.v) / (2 * h), rel=1e-6, abs=1e-8)
        assert out.h[i] == pytest.approx((a.g - b.g) / (2 * h), rel=1e-5, abs=1e-7)


def test_binary_models(spark):
    df = made(spark, l=(ETA + logistic() > 0), p=(ETA + NORMAL > 0), c=(U < -np.expm1(-np.exp(ETA))), h=(ETA + NORMAL * np.exp(0.4 * Z) > 0))
    near(mle.logit(df, "l", ("x",)), x=0.6, _cons=0.4)
    near(mle.probit(df, "p", ("x",), robust=True), x=0.6, _cons=0.4)
    near(mle.cloglog(df, "c", ("x",)), x=0.6, _cons=0.4)
    near(mle.het_probit(df, "h", ("x",), ("z",)), h_x=0.6, lnsigma_z=0.4)
    fit = mle.logit(df, "l", ("x",))
    effect = mle.margins(df, fit, ("x",), "logit")
    p = 1 / (1 + np.exp(-(fit.beta[1] + fit.beta[0] * X)))
    assert effect.beta[0] == pytest.approx((p * (1 - p)).mean() * fit.beta[0], rel=1e-9)
    assert mle.predict(df, fit, ("x",), "logit").agg({"predicted": "sum"}).first()[0] == pytest.approx(df.agg({"l": "sum"}).first()[0], rel=1e-7)
    ratio, se = mle.nlcom(fit, lambda b: b["x"] / b["_cons"])
    assert ratio == pytest.approx(fit.beta[0] / fit.beta[1]) and se > 0


def test_counts(spark):
    mu = np.exp(ETA)
    rng = np.random.default_rng(5)
    count, mixed = rng.poisson(mu), rng.poisson(mu * rng.gamma(2.0, 0.5, N))
    gone = rng.random(N) < 1 / (1 + np.exp(0.8 - 0.5 * Z))
    positive = rng.random(N) < 1 / (1 + np.exp(-0.3 - 0.5 * Z))
    cut = count.copy()
    while (cut == 0).any():
        cut = np.where(cut == 0, rng.poisson(mu), cut)
    exposure = rng.uniform(1, 4, N)
    df = made(spark, c=count, m=mixed, zc=np.where(gone, 0, count), zm=np.where(gone, 0, mixed), hc=np.where(positive, cut, 0), t=cut, e=exposure, ec=rng.poisson(mu * exposure))
    near(mle.poisson(df, "c", ("x",)), x=0.6, _cons=0.4)
    near(mle.exposed_poisson(df, "ec", "e", ("x",)), x=0.6, _cons=0.4)
    near(mle.negative_binomial(df, "m", ("x",)), m_x=0.6, lnalpha__cons=math.log(0.5))
    near(mle.zero_inflated_poisson(df, "zc", ("x",), ("z",)), zc_x=0.6, inflate_z=0.5, inflate__cons=-0.8)
    near(mle.zero_inflated_negative_binomial(df, "zm", ("x",), ("z",)), zm_x=0.6, inflate_z=0.5)
    near(mle.hurdle_poisson(df, "hc", ("x",), ("z",)), hc_x=0.6, positive_z=0.5, positive__cons=0.3)
    near(mle.truncated_poisson(df, "t", ("x",)), x=0.6, _cons=0.4)
    near(mle.truncated_negative_binomial(df.where("m > 0"), "m", ("x",)), m_x=0.6)


def test_ordered_and_multinomial(spark):
    latent, probit = 0.7 * X + logistic(), 0.7 * X + NORMAL
    noise = -np.log(-np.log(np.random.default_rng(8).random((3, N))))
    choice = np.argmax([noise[0], 0.3 + 0.5 * X + noise[1], -0.2 - 0.4 * X + noise[2]], axis=0)
    df = made(spark, l=np.digitize(latent, [-1, 0.2, 1.5]), p=np.digitize(probit, [-1, 0.2, 1.5]), m=choice)
    near(mle.ordered_logit(df, "l", ("x",)), l_x=0.7, cut1__cons=-1, cut2__cons=0.2, cut3__cons=1.5)
    near(mle.ordered_probit(df, "p", ("x",)), p_x=0.7, cut1__cons=-1, cut2__cons=0.2, cut3__cons=1.5)
    fit = mle.multinomial_logit(df, "m", ("x",))
    near(fit, **{"1_x": 0.5, "1__cons": 0.3, "2_x": -0.4, "2__cons": -0.2})


def test_limited_outcomes(spark):
    y = 1 + 0.5 * X + 1.5 * NORMAL
    rng = np.random.default_rng(9)
    v = rng.standard_normal(N)
    e = 0.6 * v + 0.8 * rng.standard_normal(N)
    seen = 0.3 + 0.8 * Z + v > 0
    second = 0.2 - 0.5 * Z + 0.6 * NORMAL + 0.8 * rng.standard_normal(N) > 0
    df = made(spark, y=y, c=np.maximum(y, 0), lo=np.floor(y), hi=np.floor(y) + 1, s=seen, o=1 + 0.5 * X + 1.2 * e, b1=(0.3 + 0.5 * X + NORMAL > 0), b2=second, ob=(0.2 + 0.5 * X + e > 0), f=1 + 0.5 * X + 0.4 * NORMAL - np.abs(0.9 * v))
    near(mle.gaussian(df, "y", ("x",)), y_x=0.5, y__cons=1, lnsigma__cons=math.log(1.5))
    near(mle.tobit(df, "c", ("x",), low=0.0), c_x=0.5, c__cons=1, lnsigma__cons=math.log(1.5))
    near(mle.truncated_regression(df, "y", ("x",), low=0.0), y_x=0.5, y__cons=1, lnsigma__cons=math.log(1.5))
    near(mle.interval_regression(df, "lo", "hi", ("x",)), model_x=0.5, model__cons=1, lnsigma__cons=math.log(1.5))
    near(mle.selection(df, "o", ("x",), "s", ("z",)), o_x=0.5, o__cons=1, select_z=0.8, athrho__cons=math.atanh(0.6), lnsigma__cons=math.log(1.2))
    near(mle.selection_probit(df, "ob", ("x",), "s", ("z",)), ob_x=0.5, select_z=0.8, select__cons=0.3)
    near(mle.bivariate_probit(df, "b1", ("x",), "b2", ("z",)), b1_x=0.5, b2_z=-0.5, athrho__cons=math.atanh(0.6))
    near(mle.frontier(df, "f", ("x",)), f_x=0.5, lnsig_v__cons=math.log(0.4), lnsig_u__cons=math.log(0.9))
    near(mle.quantile_regression(df, "y", ("x",)), x=0.5, _cons=1)


def test_fractions_and_gamma(spark):
    rng = np.random.default_rng(10)
    p = 1 / (1 + np.exp(-ETA))
    df = made(spark, b=np.clip(rng.beta(p * 5, (1 - p) * 5), 1e-6, 1 - 1e-6), g=rng.gamma(2.0, np.exp(ETA) / 2))
    near(mle.beta_regression(df, "b", ("x",)), b_x=0.6, b__cons=0.4, lnphi__cons=math.log(5))
    near(mle.fraction_logit(df, "b", ("x",), robust=True), x=0.6, _cons=0.4)
    near(mle.gamma_log(df, "g", ("x",), robust=True), x=0.6, _cons=0.4)


def test_survival_models(spark):
    rng = np.random.default_rng(11)
    e, end = rng.exponential(1.0, N), rng.uniform(0.5, 4, N)
    rate = np.exp(-0.5 + 0.5 * X)
    times = {"exponential": e / rate, "weibull": (e / rate) ** (1 / 1.4), "gompertz": np.log1p(0.3 * e / rate) / 0.3, "lognormal": np.exp(0.3 + 0.5 * X + 0.8 * NORMAL), "loglogistic": np.exp(0.3 + 0.5 * X + 0.6 * logistic())}
    shape = {"weibull": math.log(1.4), "gompertz": 0.3, "lognormal": math.log(0.8), "loglogistic": math.log(0.6)}
    for kind, t in times.items():
        df = made(spark, t=np.minimum(t, end), d=t <= end)
        fit = mle.survival_regression(df, "t", "d", ("x",), kind)
        near(fit, **({"x": 0.5} if kind == "exponential" else {"_t_x": 0.5, "shape__cons": shape[kind]}))
        low = np.floor(t * 2) / 2
        cells = spark.createDataFrame(pa.table({"x": X, "low": np.minimum(low, 4.0), "high": pa.array([float(v) if v <= 4 else None for v in low + 0.5])}))
        near(mle.interval_survival(cells, "low", "high", ("x",), kind), **({"x": 0.5} if kind == "exponential" else {"_t_x": 0.5, "shape__cons": shape[kind]}))


def test_conditional_logit_and_clusters(spark):
    rng = np.random.default_rng(13)
    x = rng.standard_normal((2_000, 3))
    chosen = np.argmax(0.8 * x - np.log(-np.log(rng.random(x.shape))), axis=1)
    df = spark.createDataFrame(pa.table({"g": np.repeat(np.arange(2_000), 3), "x": x.ravel(), "y": (np.arange(3)[None, :] == chosen[:, None]).ravel().astype(float)}))
    near(mle.conditional_logit(df, "y", ("x",), "g"), x=0.8)
    twice = df.union(df)
    a, b = mle.logit(df, "y", ("x",), robust=True), mle.logit(twice.withColumn("row", df["g"] * 0), "y", ("x",), robust=True)
    assert a.beta == pytest.approx(b.beta, rel=1e-8) and b.covariance * 2 == pytest.approx(a.covariance, rel=1e-3)
    wide = mle.logit(twice, "y", ("x",), cluster="g")
    assert np.diag(wide.covariance)[0] > np.diag(b.covariance)[0]


def test_failures_show(spark):
    df = spark.createDataFrame([(float(i), float(i > 5)) for i in range(12)], "x double, y double")
    with pytest.raises(mle.NotConverged):
        mle.logit(df, "y", ("x",))
    with pytest.raises(mle.NotConverged):
        mle.poisson(df, "x", ("y", "y * 2"))
    with pytest.raises(ValueError):
        mle.logit(df.limit(0), "y", ("x",))
