"""Local polynomials and discontinuities against dense weighted least squares."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrystat.operators import local as L


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(6)
    x = rng.uniform(-1, 1, 3000)
    y = 0.5 * x + x**2 + 0.8 * np.sin(3 * x) + 2.0 * (x >= 0) + 0.3 * rng.normal(size=3000)
    d = (rng.uniform(size=3000) < 0.2 + 0.6 * (x >= 0)).astype(float)
    return x, y, d


@pytest.fixture(scope="module")
def rows(spark, data):
    made = [(float(a), float(b), float(c)) for a, b, c in zip(*data, strict=True)]
    return spark.createDataFrame([*made, (None, 1.0, 0.0), (0.1, None, 0.0), (0.1, float("nan"), 1.0)], "x double, y double, d double").repartition(3)


KERNEL = {"uniform": lambda u: 0.5 * (u <= 1), "triangular": lambda u: np.maximum(1 - u, 0), "epanechnikov": lambda u: 0.75 * np.maximum(1 - u * u, 0), "tricube": lambda u: 70 / 81 * np.maximum(1 - u**3, 0) ** 3}


def dense(x, y, at, h, kernel, degree):
    w = KERNEL[kernel](np.abs(x - at) / h)
    design = np.vander(x - at, degree + 1, increasing=True)
    inverse = np.linalg.inv(design.T @ (w[:, None] * design))
    beta = inverse @ design.T @ (w * y)
    e = y - design @ beta
    return beta, inverse @ (design.T @ ((w * e)[:, None] ** 2 * design)) @ inverse


@pytest.mark.parametrize(("kernel", "degree"), [("uniform", 0), ("triangular", 1), ("epanechnikov", 2), ("tricube", 1)])
def test_local_polynomials(rows, data, kernel, degree):
    x, y, _ = data
    points = [-0.9, -0.33, 0.0, 0.5, 1.0]
    got = L.local_polynomial(rows, "y", "x", points=points, bandwidth=0.3, kernel=kernel, degree=degree).orderBy("x").collect()
    for p, r in zip(points, got, strict=True):
        beta, v = dense(x, y, p, 0.3, kernel, degree)
        assert r["estimate"] == pytest.approx(beta[0], abs=1e-9)
        assert r["std_error"] == pytest.approx(math.sqrt(v[0, 0]), rel=1e-7)
        if degree:
            assert r["slope"] == pytest.approx(beta[1], abs=1e-7)


def test_a_grid_and_empty_kernels(rows, spark):
    assert L.local_polynomial(rows, "y", "x", points=30).count() == 30
    far = L.local_polynomial(rows, "y", "x", points=[0.0, 9.0], bandwidth=0.2).orderBy("x").collect()
    assert far[0]["estimate"] is not None
    assert far[1]["estimate"] is None
    with pytest.raises(ValueError, match="no rows"):
        L.local_polynomial(rows.where("false"), "y", "x", points=3)


def dense_jump(x, y, h, b):
    """Conventional and bias-corrected jumps with both variances, row by row."""
    total = np.zeros(2)
    v = np.zeros(2)
    for side, sign in ((x >= 0, 1), (x < 0, -1)):
        xs, ys = x[side], y[side]
        kh, kb = np.maximum(1 - np.abs(xs) / h, 0), np.maximum(1 - np.abs(xs) / b, 0)
        rp, rq = np.vander(xs, 2, increasing=True), np.vander(xs, 3, increasing=True)
        hp = np.linalg.inv(rp.T @ (kh[:, None] * rp)) @ (rp * kh[:, None]).T
        hq = np.linalg.inv(rq.T @ (kb[:, None] * rq)) @ (rq * kb[:, None]).T
        adjusted = hp[0] - (hp[0] @ xs**2) * hq[2]
        total += sign * np.array([hp[0] @ ys, adjusted @ ys])
        v += np.array([(hp[0] ** 2) @ (ys - rp @ (hp @ ys)) ** 2, (adjusted**2) @ (ys - rq @ (hq @ ys)) ** 2])
    return total, np.sqrt(v)


def test_discontinuity(rows, data):
    x, y, _ = data
    got = {r["method"]: r for r in L.discontinuity(rows.where("y IS NOT NULL AND NOT isnan(y)"), "y", "x", bandwidth=0.4, bias_bandwidth=0.6).collect()}
    value, se = dense_jump(x, y, 0.4, 0.6)
    assert got["conventional"]["estimate"] == pytest.approx(value[0])
    assert got["conventional"]["std_error"] == pytest.approx(se[0])
    assert got["robust"]["estimate"] == pytest.approx(value[1])
    assert got["robust"]["std_error"] == pytest.approx(se[1])
    assert got["robust"]["ci_low"] < 2 < got["robust"]["ci_high"]


def test_chosen_bandwidths(rows):
    clean = rows.where("y IS NOT NULL AND NOT isnan(y)")
    h, b = L.rd_bandwidths(clean, "y", "x", 0.0)
    assert 0.1 < h < 0.9
    assert h < b <= 1.0
    robust = L.discontinuity(clean, "y", "x").where("method = 'robust'").first()
    assert robust["bandwidth"] == pytest.approx(h)
    assert abs(robust["estimate"] - 2) < 4 * robust["std_error"]
    scaled = clean.withColumns({"x": F.col("x") * 1000 + 5, "y": F.col("y") * 7})
    h2, b2 = L.rd_bandwidths(scaled, "y", "x", 5.0)
    assert (h2, b2) == pytest.approx((1000 * h, 1000 * b), rel=1e-6)


def test_fuzzy_discontinuity(rows, data):
    x, _, d = data
    clean = rows.where("y IS NOT NULL AND NOT isnan(y)").withColumn("y", F.col("y") - 2 * (F.col("x") >= 0).cast("double") + 3 * F.col("d"))
    fuzzy = L.discontinuity(clean, "y", "x", bandwidth=0.5, treated="d").where("method = 'conventional'").first()
    jump = {c: L.discontinuity(clean, c, "x", bandwidth=0.5).first()["estimate"] for c in ("y", "d")}
    assert fuzzy["estimate"] == pytest.approx(jump["y"] / jump["d"])
    assert abs(fuzzy["estimate"] - 3) < 4 * fuzzy["std_error"]


def test_bins_of_a_plot(rows, data):
    x, y, _ = data
    got = L.rd_plot(rows.where("y IS NOT NULL AND NOT isnan(y)"), "y", "x", bins=10).collect()
    assert sum(r["n"] for r in got) == len(x)
    one = next(r for r in got if r["side"] == -1 and r["bin"] == 9)
    low = x.min()
    assert one["mean"] == pytest.approx(y[x < low + (0 - low) / 10].mean())
    assert L.rd_plot(rows.where("false"), "y", "x").count() == 0
