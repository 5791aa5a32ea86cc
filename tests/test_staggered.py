"""Group-time effects and treatment effects against unit-by-unit formulas, resampling and known effects."""

import math

import numpy as np
import pytest

from quarrystat.operators import staggered


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(12)
    rows, wide = [], []
    for u in range(600):
        x = rng.normal()
        draw = rng.random() + 0.15 * x
        g = 3 if draw < 0.2 else 4 if draw < 0.45 else 7 if draw < 0.5 else None
        fixed = rng.normal()
        ys = []
        for t in range(1, 7):
            effect = (1.0 + 0.5 * (t - g)) if g is not None and t >= g else 0.0
            ys.append(fixed + 0.3 * t + 0.4 * x * t + effect + 0.5 * rng.normal())
        wide.append((g, x, ys))
        rows += [(u, t + 1, float(y), g, float(x), 1) for t, y in enumerate(ys)]
    rows += [(900, 1, 1.0, None, 0.0, 1), (901, 1, None, 3, 0.0, 1), (None, 1, 1.0, 3, 0.0, 1)]
    return spark.createDataFrame(rows, "unit long, t long, y double, g long, x double, n int").repartition(4), wide


def test_effects_without_covariates(spark, panel):
    rows, wide = panel
    fit = staggered.group_time(rows, "y", "unit", "t", "g", draws=400)
    assert fit.cohorts == [3, 4]
    assert fit.units == 600
    never = np.array([y for g, _, y in wide if g is None])
    assert all(g in (3, 4, 7, None) for g, _, _ in wide)
    got = {(r["cohort"], r["time"]): r for r in fit.frame(spark).collect()}
    for g in (3, 4):
        own = np.array([y for c, _, y in wide if c == g])
        for t in range(2, 7):
            b = g - 1 if t >= g else t - 1
            d1, d0 = own[:, t - 1] - own[:, b - 1], never[:, t - 1] - never[:, b - 1]
            r = got[g, t]
            assert r["estimate"] == pytest.approx(d1.mean() - d0.mean())
            assert r["std_error"] == pytest.approx(math.sqrt(d1.var() / len(d1) + d0.var() / len(d0)))
            assert r["band_low"] < r["ci_low"]
    simple = fit.aggregate(spark, "simple").first()
    cells = [(g, t) for g in (3, 4) for t in range(g, 7)]
    n = {g: sum(c == g for c, _, _ in wide) for g in (3, 4)}
    assert simple["estimate"] == pytest.approx(sum(n[g] * got[g, t]["estimate"] for g, t in cells) / sum(n[g] for g, _ in cells))
    event = {r["key"]: r for r in fit.aggregate(spark, "event").collect()}
    assert set(event) == {-2, -1, 0, 1, 2, 3, None}
    assert event[0]["estimate"] == pytest.approx((n[3] * got[3, 3]["estimate"] + n[4] * got[4, 4]["estimate"]) / (n[3] + n[4]))
    assert event[None]["estimate"] == pytest.approx(np.mean([event[k]["estimate"] for k in range(4)]))
    assert {r["key"] for r in fit.aggregate(spark, "calendar").collect()} == {3, 4, 5, 6, None}
    assert fit.aggregate(spark, "group").count() == 3


def test_standard_errors_of_aggregates_agree_with_draws(spark, panel):
    fit = staggered.group_time(panel[0], "y", "unit", "t", "g", draws=800)
    again = staggered.group_time(panel[0].repartition(7), "y", "unit", "t", "g", draws=800)
    assert np.allclose(fit.draws, again.draws)
    assert np.std(fit.draws[:, 0]) == pytest.approx(math.sqrt(fit.covariance[0, 0]), rel=0.1)


def test_covariates_make_it_doubly_robust(spark, panel):
    rows, wide = panel
    fit = staggered.group_time(rows, "y", "unit", "t", "g", ("x",))
    for r in fit.frame(spark).collect():
        truth = 1.0 + 0.5 * (r["time"] - r["cohort"]) if r["time"] >= r["cohort"] else 0.0
        assert abs(r["estimate"] - truth) < 4.5 * r["std_error"]
    # errors by leaving units out, from the formulas for one cell
    own = [(x, y[2] - y[1], 1.0) for g, x, y in wide if g == 3]
    none = [(x, y[2] - y[1], 0.0) for g, x, y in wide if g is None]
    data = np.array(own + none)

    def effect(m):
        x, dy, d = np.column_stack([np.ones(len(m)), m[:, 0]]), m[:, 1], m[:, 2]
        b = np.zeros(2)
        for _ in range(25):
            p = 1 / (1 + np.exp(-x @ b))
            b = b + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x, x.T @ (d - p))
        p = 1 / (1 + np.exp(-x @ b))
        slope = np.linalg.lstsq(x[d == 0], dy[d == 0], rcond=None)[0]
        e, w = dy - x @ slope, (1 - d) * p / (1 - p)
        return (d @ e) / d.sum() - (w @ e) / w.sum()

    at = fit.cells.index((3, 3))
    assert fit.att[at] == pytest.approx(effect(data), abs=1e-6)
    left = np.array([effect(np.delete(data, i, axis=0)) for i in range(len(data))])
    jackknife = (len(data) - 1) / len(data) * ((left - left.mean()) ** 2).sum()
    assert fit.covariance[at, at] == pytest.approx(jackknife, rel=0.08)


def test_controls_not_yet_treated(spark, panel):
    rows, wide = panel
    fit = staggered.group_time(rows, "y", "unit", "t", "g", controls="notyet")
    at = fit.cells.index((3, 3))
    d1 = np.array([y[2] - y[1] for g, _, y in wide if g == 3])
    d0 = np.array([y[2] - y[1] for g, _, y in wide if g is None or g > 3])
    assert fit.att[at] == pytest.approx(d1.mean() - d0.mean())
    with pytest.raises(ValueError, match="no controls"):
        staggered.group_time(rows.where("g IS NOT NULL"), "y", "unit", "t", "g")


def test_bacon_adds_up_to_two_way_fixed_effects(spark, panel):
    rows, wide = panel
    parts = staggered.bacon(rows, "y", "unit", "t", "g").collect()
    assert sum(r["weight"] for r in parts) == pytest.approx(1)
    y = np.array([v for _, _, v in wide])
    d = np.array([[float(g is not None and t >= g) for t in range(1, 7)] for g, _, _ in wide])
    inside = lambda m: m - m.mean(axis=0) - m.mean(axis=1, keepdims=True) + m.mean()
    coefficient = (inside(d) * inside(y)).sum() / (inside(d) ** 2).sum()
    assert sum(r["weight"] * r["estimate"] for r in parts) == pytest.approx(coefficient)
    assert {r["kind"] for r in parts} == {"treated with never treated", "earlier with later treated", "later with earlier treated"}


def test_treatment_effects(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=1500)
    d = (rng.random(1500) < 1 / (1 + np.exp(-0.5 - 0.8 * x))).astype(float)
    y = 1 + 2 * d + x + 0.5 * d * x + rng.normal(size=1500)
    rows = spark.createDataFrame([*[(float(a), float(b), float(c)) for a, b, c in zip(y, d, x, strict=True)], (None, 1.0, 0.0)], "y double, d double, x double").repartition(3)
    got = {r["method"]: r for r in staggered.treatment_effects(rows, "y", "d", ("x",)).collect()}

    def effects(m):
        y, d, x = m[:, 0], m[:, 1], np.column_stack([np.ones(len(m)), m[:, 2]])
        b = np.zeros(2)
        for _ in range(20):
            p = 1 / (1 + np.exp(-x @ b))
            b = b + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x, x.T @ (d - p))
        p = 1 / (1 + np.exp(-x @ b))
        f = [x @ np.linalg.lstsq(x[d == a], y[d == a], rcond=None)[0] for a in (0, 1)]
        w1, w0 = d / p, (1 - d) / (1 - p)
        return np.array([f[1].mean() - f[0].mean(), w1 @ y / w1.sum() - w0 @ y / w0.sum(), (f[1] + w1 * (y - f[1]) - f[0] - w0 * (y - f[0])).mean()])

    data = np.column_stack([y, d, x])
    whole = effects(data)
    draws = np.array([effects(data[rng.integers(0, 1500, 1500)]) for _ in range(300)])
    for i, m in enumerate(("ra", "ipw", "aipw")):
        assert got[m]["estimate"] == pytest.approx(whole[i], abs=1e-6)
        assert got[m]["std_error"] == pytest.approx(draws[:, i].std(), rel=0.2)
        assert abs(got[m]["estimate"] - 2) < 4 * got[m]["std_error"]
