"""Operators against numpy, closed forms and invariances; every query with SQL against DuckDB."""

import math
import os
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrystat import queries as registered
from quarrystat.functions import dist
from quarrystat.operators import descriptive, likelihood, linear, network, panel, prepare, series, survival
from quarrystat.plans.spec import Spec, expression, formula

DATA = "/root/testdata/sf0.001"


def test_distributions():
    assert dist.normal_sf(1.959963984540054) == pytest.approx(0.025, rel=1e-12)
    assert dist.t_sf(2.228138851964939, 10) == pytest.approx(0.025, rel=1e-9)
    assert dist.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, rel=1e-9)
    assert dist.f_sf(3.4928284767356315, 2, 20) == pytest.approx(0.05, rel=1e-9)
    assert dist.critical(0.05, 10) == pytest.approx(2.228138851964939, rel=1e-9)
    assert dist.t_sf(1.3, 1e7) == pytest.approx(dist.normal_sf(1.3), rel=1e-5)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(14)
    n = 137
    x = rng.standard_normal((n, 3)) + [0, 50, -3]
    y = x @ [1.0, -2.0, 0.5] + 3 + rng.standard_normal(n) * (1 + np.abs(x[:, 0]))
    g, f = rng.integers(0, 7, n), rng.integers(1, 4, n)
    b = (rng.random(n) < 1 / (1 + np.exp(-x[:, 0]))).astype(float)
    data = [(*map(float, r), float(v), int(k), float(w), float(z)) for r, v, k, w, z in zip(x, y, g, f, b, strict=True)]
    return spark.createDataFrame(data, "x1 double, x2 double, x3 double, y double, g int, f double, b double").persist(), x, y, g, f, b


def normal_equations(x, y):
    x = np.column_stack([x, np.ones(len(x))])
    inverse = np.linalg.inv(x.T @ x)
    beta = inverse @ x.T @ y
    return x, inverse, beta, y - x @ beta


@pytest.mark.parametrize("kind", ["nonrobust", "HC0", "HC1", "HC2", "HC3", "cluster"])
def test_ols_matches_normal_equations(rows, kind):
    df, x, y, g, _, _ = rows
    fit = linear.ols(df, Spec("y", ("x1", "x2", "x3"), kind, ("g",) if kind == "cluster" else ()))
    x, inverse, beta, e = normal_equations(x, y)
    n, k = x.shape
    h = np.einsum("ij,jk,ik->i", x, inverse, x)
    if kind == "nonrobust":
        v = inverse * (e @ e) / (n - k)
    elif kind == "cluster":
        s = np.array([(x[g == c] * e[g == c, None]).sum(0) for c in np.unique(g)])
        v = inverse @ s.T @ s @ inverse * len(s) / (len(s) - 1) * (n - 1) / (n - k)
    else:
        u = e / {"HC0": 1, "HC1": 1, "HC2": np.sqrt(1 - h), "HC3": 1 - h}[kind]
        v = inverse @ (x * u[:, None] ** 2).T @ x @ inverse * (n / (n - k) if kind == "HC1" else 1)
    assert fit.beta == pytest.approx(beta, rel=2e-8)
    assert fit.covariance == pytest.approx(v, rel=2e-7)


def test_line_by_hand(spark):
    """Points on 4 - x / 2, moved by 3, -1, -1, -1 (which x and the constant cannot explain)."""
    df = spark.createDataFrame([(float(x), 4 - x / 2 + d) for x, d in zip((0, 6, 2, -8), (3, -1, -1, -1), strict=True)], "x double, y double")
    fit = linear.ols(df, Spec("y", ("x",)))
    assert fit.beta == pytest.approx([-0.5, 4.0], rel=1e-12)
    assert fit.metrics["rss"] == pytest.approx(12.0, rel=1e-12)


def test_frequency_weights_are_repeated_rows(spark, rows):
    df, *_ = rows
    spec = Spec("y", ("x1", "x2"), "HC1", weights="f", weight_type="fweight")
    repeated = df.select("*", F.explode(F.sequence(F.lit(1), F.col("f").cast("int"))))
    a, b = linear.ols(df, spec), linear.ols(repeated, Spec("y", ("x1", "x2"), "HC1"))
    assert a.beta == pytest.approx(b.beta, rel=1e-9) and a.covariance == pytest.approx(b.covariance, rel=1e-9)


def test_collinear_terms_are_left_out_and_missing_raises(spark, rows):
    df, *_ = rows
    fit = linear.ols(df.withColumn("twice", F.col("x1") * 2), Spec("y", ("x1", "twice", "x2")))
    assert fit.beta[1] == 0 and fit.metrics["df_model"] == 2
    with pytest.raises(ValueError):
        linear.ols(df.withColumn("x1", F.when(F.col("g") > 0, F.col("x1"))), Spec("y", ("x1",), missing="raise"))


def test_two_absorbed_effects_match_dummies(spark, rows):
    df, x, y, g, f, _ = rows
    fit = linear.areg(df, Spec("y", ("x1", "x3")), ["g", "f"])
    d = np.column_stack([x[:, [0, 2]], *[(g == c) for c in np.unique(g)], *[(f == c) for c in np.unique(f)[1:]]]).astype(float)
    beta, rss, *_ = np.linalg.lstsq(d, y, rcond=None)
    assert fit.beta == pytest.approx(beta[:2], rel=1e-6)
    v = np.linalg.inv(d.T @ d)[:2, :2] * rss[0] / (len(y) - d.shape[1])
    assert fit.covariance == pytest.approx(v, rel=1e-5)


def test_instruments_recover_least_squares(rows):
    df, *_ = rows
    same = linear.ivregress(df.withColumn("z", F.col("x1")), Spec("y", ("x2",)), ("x1",), ("z",))
    direct = linear.ols(df, Spec("y", ("x1", "x2")))
    assert dict(zip(same.names, same.beta, strict=True)) == pytest.approx(dict(zip(direct.names, direct.beta, strict=True)), rel=1e-6)


@pytest.mark.parametrize("family", ["logit", "probit", "cloglog", "poisson"])
def test_likelihood_scores_vanish(rows, family):
    df, x, _, _, f, b = rows
    y = f if family == "poisson" else b
    fit = likelihood.fit(df, Spec("f" if family == "poisson" else "b", ("x1", "x3")), family)
    z = np.column_stack([x[:, [0, 2]], np.ones(len(x))])
    eta = z @ fit.beta
    cdf = np.array([1 - dist.normal_sf(v) for v in eta])
    pdf = np.exp(-eta * eta / 2) / math.sqrt(2 * math.pi)
    m = np.exp(eta)
    score = {"logit": y - 1 / (1 + np.exp(-eta)), "probit": pdf * (y - cdf) / (cdf * (1 - cdf)), "poisson": y - m, "cloglog": np.where(y > 0, m * np.exp(-m) / -np.expm1(-m), -m)}[family]
    assert np.abs(z.T @ score).max() < 1e-5


def test_wald_and_lincom(rows):
    df, *_ = rows
    fit = linear.ols(df, Spec("y", ("x1", "x2")))
    est, se, p = fit.lincom({"x1": 1.0})
    f, pf = fit.test([{"x1": 1.0}])
    assert f == pytest.approx((est / se) ** 2) and pf == pytest.approx(p)


def test_formula(rows):
    spec = formula("y ~ x1*x2 + C(g) + log(x2) + I(x1^2) - 1")
    assert spec.predictors == ("x1", "x2", "x1:x2", "log(x2)", "I(x1^2)") and spec.categorical == ("g",) and not spec.intercept
    with pytest.raises(ValueError):
        expression("__import__('os')")
    assert formula("y ~ I(x1 + x3) + I(x1 - 1)").predictors == ("I(x1 + x3)", "I(x1 - 1)")
    assert formula("y ~ x1*C(g)").predictors == ("x1", "x1:C(g)") and formula("y ~ x1*C(g)").categorical == ("g",)
    fit = linear.ols(rows[0], formula("y ~ x1*C(g) + I(x2 - 50)"))
    assert len(fit.names) == 1 + 6 + 1 + 6 + 1
    assert linear.ols(rows[0], formula("y ~ I(x1 + x3)")).beta[0] == pytest.approx(np.polyfit(rows[1][:, 0] + rows[1][:, 2], rows[2], 1)[0])


def test_beta_and_its_tails_by_other_ways():
    """Against sums of binomial terms, symmetry, and closed forms."""
    for n in (5, 40, 300):
        for k in range(1, n, max(1, n // 7)):
            for p in (0.02, 0.3, 0.5, 0.9):
                upper = sum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p)) for j in range(k, n + 1))
                assert dist.beta_tail(k, n - k + 1, p) == pytest.approx(upper, rel=1e-10, abs=1e-14)
    assert dist.beta_tail(0.5, 0.5, 0.3) == pytest.approx(2 / math.pi * math.asin(math.sqrt(0.3)), rel=1e-12)
    assert dist.beta_tail(7.5, 0.5, 0.99) + dist.beta_tail(0.5, 7.5, 0.01) == pytest.approx(1, rel=1e-12)
    assert dist.t_sf(40.0, 3) == pytest.approx(0.5 * dist.beta_tail(1.5, 0.5, 3 / 1603), rel=1e-12)
    assert dist.f_sf(1.0, 1e6, 1e6) == pytest.approx(0.5, rel=1e-6)


def test_two_effects_drop_singletons_and_count_mobility_groups(spark):
    rng = np.random.default_rng(4)
    g, f = np.r_[rng.integers(0, 5, 60), rng.integers(5, 9, 60)], np.r_[rng.integers(0, 4, 60), rng.integers(4, 8, 60)]
    x = rng.standard_normal(120)
    y = 2 * x + g - f + rng.standard_normal(120)
    rows = [*zip(g.tolist(), f.tolist(), x.tolist(), y.tolist(), strict=True), (99, 0, 5.0, 100.0)]
    fit = linear.areg(spark.createDataFrame(rows, "g int, f int, x double, y double"), Spec("y", ("x",)), ["g", "f"])
    d = np.column_stack([x, *[(g == c) for c in range(9)], *[(f == c) for c in range(8)]]).astype(float)
    rank = np.linalg.matrix_rank(d)
    beta = np.linalg.lstsq(d, y, rcond=None)[0]
    rss = ((y - d @ beta) ** 2).sum()
    assert fit.beta[0] == pytest.approx(beta[0], rel=1e-7) and fit.metrics["df_resid"] == 120 - rank
    assert fit.metrics["rss"] == pytest.approx(rss, rel=1e-7)


def test_full_leverage_and_repeated_periods_are_errors(spark):
    df = spark.createDataFrame([(0.0, 0.0, 1.0), (0.0, 1.0, 2.0), (0.0, 2.0, 2.5), (1.0, 3.0, 9.0)], "alone double, x double, y double")
    with pytest.raises(ValueError, match="leverage"):
        linear.ols(df, Spec("y", ("alone", "x"), "HC3"))
    with pytest.raises(ValueError, match="repeats"):
        linear.ols(df.withColumn("t", F.lit(1)), Spec("y", ("x",), "hac", time="t", lags=1))


def test_large_offsets_and_running_totals(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((500, 2)) * 0.5 + [1e9, -1e6]
    df = spark.createDataFrame([(list(map(float, r)),) for r in x], "v array<double>")
    from quarrystat.operators import multivariate, ranked

    _, _, cov = multivariate.vector_moments(df, "v", 2)
    assert cov == pytest.approx(np.cov(x.T), rel=1e-6)
    rows = spark.createDataFrame([(float(v), int(k)) for v, k in zip(rng.permutation(3_000), rng.integers(1, 5, 3_000), strict=True)], "v double, n long")
    for down in (False, True):
        got = ranked.running(rows, "v", "n", "upto", descending=down, slices=20).orderBy(F.col("v").desc() if down else "v").toPandas()
        assert (got.upto == got.n.cumsum()).all()


def test_null_keys_are_checked_where_they_match(spark):
    left, right = spark.createDataFrame([(None, 1)], "k long, x long"), spark.createDataFrame([(None, 1), (None, 2)], "k long, r long")
    with pytest.raises(ValueError):
        prepare.join(left, right, ["k"], nulls="equal")
    with pytest.raises(ValueError):
        prepare.reshape_wide(spark.createDataFrame([(1, None, 2)], "id long, variable string, value long"), ["id"], "variable", "value", ["a"])


def test_preparation(spark):
    base = spark.createDataFrame([(1, 2), (2, None), (2, 4), (None, 5)], "key long, x long")
    right = spark.createDataFrame([(1, 7), (2, 8), (3, 9), (None, 0)], "key long, r long")
    assert prepare.join(base, right, ["key"]).count() == 3
    assert prepare.join(base, right, ["key"], nulls="equal").count() == 4
    assert prepare.join(base, right, ["key"], "outer", nulls="equal").count() == 5
    with pytest.raises(ValueError):
        prepare.join(base, right, ["key"], validate="1:1")
    with pytest.raises(TypeError):
        prepare.join(base, right.withColumn("key", F.col("key").cast("string")), ["key"])
    long = prepare.reshape_long(spark.createDataFrame([(1, 2, 3), (2, None, 5)], "id long, a long, b long"), ["id"], ["a", "b"])
    wide = prepare.reshape_wide(long, ["id"], "variable", "value", ["a", "b"]).orderBy("id").collect()
    assert [tuple(r) for r in wide] == [(1, 2, 3), (2, None, 5)]
    with pytest.raises(ValueError):
        prepare.reshape_wide(long.union(long), ["id"], "variable", "value", ["a", "b"])
    with pytest.raises(TypeError):
        prepare.map_rows(base, {"z": F.lit(1)}, {"z": "string"})
    gaps = spark.createDataFrame([(1, 10.0), (2, 11.0), (4, 15.0)], "t long, v double")
    assert [r["L1_v"] for r in prepare.lag(gaps, "v", "t").orderBy("t").collect()] == [None, 10.0, None]
    a, b = prepare.receipt(base).first(), prepare.receipt(base.orderBy(F.col("x").desc())).first()
    assert a == b


def test_cox_matches_numpy(spark):
    rng = np.random.default_rng(6)
    n = 120
    x, t = rng.standard_normal(n), np.round(rng.exponential(2, n), 1)
    d = (rng.random(n) < 0.7).astype(float)
    fit = survival.cox(spark.createDataFrame([tuple(map(float, r)) for r in zip(t, d, x, strict=True)], "t double, d double, x double"), "t", "d", ("x",))
    b, score = fit.beta[0], 0.0
    for i in range(n):
        if d[i]:
            r = t >= t[i]
            w = np.exp(b * x[r])
            score += x[i] - (w * x[r]).sum() / w.sum()
    assert abs(score) < 1e-6


def test_var_and_random_effects(spark):
    rng = np.random.default_rng(1)
    a = np.array([[0.5, 0.1], [-0.2, 0.3]])
    y = np.zeros((260, 2))
    for t in range(1, 260):
        y[t] = a @ y[t - 1] + rng.standard_normal(2)
    df = spark.createDataFrame([(t, *map(float, r)) for t, r in enumerate(y)], "t long, p double, q double")
    names, b, residual, n = series.var(df, ["p", "q"], "t", 1)
    z = np.column_stack([y[:-1], np.ones(259)])
    assert b == pytest.approx(np.linalg.lstsq(z, y[1:], rcond=None)[0], rel=1e-7) and n == 259 and names[-1] == "_cons"
    assert series.irf(b, residual, 1, 3)[2] == pytest.approx(np.linalg.matrix_power(b[:2].T, 2) @ np.linalg.cholesky(residual))
    rows = [(i, t, float(rng.standard_normal()), 0.0) for i in range(30) for t in range(6)]
    u = rng.standard_normal(30)
    data = spark.createDataFrame([(i, t, x, 1 + 2 * x + float(u[i]) + 0.3 * float(rng.standard_normal())) for i, t, x, _ in rows], "id long, t long, x double, y double")
    spec = Spec("y", ("x",))
    assert panel.random_effects(data, spec, "id").beta[0] == pytest.approx(2, abs=0.15)
    assert panel.fixed_effects(data, spec, "id").beta[0] == pytest.approx(2, abs=0.15)


def test_cores_and_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (7, 8), (4, 4)], "src long, dst long")
    assert {r["node"]: r["core"] for r in network.core_numbers(edges).collect()} == {1: 2, 2: 2, 3: 2, 4: 1, 7: 1, 8: 1}
    assert {r["node"]: r["component"] for r in network.components(edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7}
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "src long, dst long")
    assert {r["component"] for r in network.components(chain).collect()} == {0}


def test_histogram_of_a_constant(spark):
    out = descriptive.histogram(spark.createDataFrame([(5.0,), (5.0,), (None,)], "v double"), "v", 4).orderBy("bin").collect()
    assert [r["n"] for r in out] == [0, 0, 2, 0] and out[0]["low"] == 4.5


def norm(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v if v is None or isinstance(v, str | int) else float(v)


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
def test_queries_match_sql(spark):
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    wrong = []
    for name, sql in registered.oracle_sql().items():
        got = registered.queries()[name](spark, DATA)
        columns = sorted(got.columns)
        want = con.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
        if Counter(tuple(map(norm, r)) for r in got.select(*columns).collect()) != Counter(tuple(map(norm, r)) for r in want):
            wrong.append(name)
    assert not wrong
