"""Staggered adoption: group-time effects with doubly robust scores, their aggregates, and what two-way fixed effects average.

The panel is reduced to one row a unit: its cohort, covariates and outcomes by period as one array. Propensities of each cohort
are a logit, outcome regressions come from cross-products of the controls, and what a unit adds to each effect's error is its
influence, a vector over the effects. Tasks turn units into influences and return only their outer products and their sums
under multiplier draws, so all covariances and bands take one pass, whatever the number of units.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystat.functions import dist
from quarrystat.operators import mle
from quarrystat.sources.tables import small, written

EFFECT = "estimate double, std_error double, z double, p_value double, ci_low double, ci_high double"


@dataclass(frozen=True)
class GroupTime:
    """Effects by cohort and period, and the joint covariance of their errors and of the cohorts' shares."""

    cohorts: list[int]
    times: list[int]
    cells: list[tuple[int, int]]
    att: np.ndarray
    shares: np.ndarray  # of each cohort among the units
    covariance: np.ndarray  # of att and shares together
    units: int
    #: Errors of att and shares under multiplier draws.
    draws: np.ndarray

    def frame(self, spark, alpha: float = 0.05) -> DataFrame:
        """cohort, time, event_time, and the estimates; band_low and band_high hold for all cells at once."""
        se = np.sqrt(np.diag(self.covariance)[: len(self.cells)])
        reach = self.band(np.eye(len(self.cells), len(self.covariance)), se, alpha)
        rows = [(g, t, t - g, *line, float(a - reach * s), float(a + reach * s)) for (g, t), a, s, line in zip(self.cells, self.att, se, _lines(self.att, se, alpha), strict=True)]
        return small(spark, rows, f"cohort long, time long, event_time long, {EFFECT}, band_low double, band_high double")

    def band(self, weights: np.ndarray, se: np.ndarray, alpha: float) -> float:
        """The quantile of the largest of several studentised errors."""
        if not len(self.draws):
            return math.nan
        top = np.nanmax(np.abs(self.draws @ weights.T) / np.where(se > 0, se, np.nan), axis=1)
        return float(np.quantile(top, 1 - alpha))

    def aggregate(self, spark, kind: str, alpha: float = 0.05) -> DataFrame:
        """``simple``: over all cells after adoption, by the cohorts' sizes; ``event``: by periods since adoption; ``group``: by
        cohort; ``calendar``: by period. One row for each (key), and one of their mean (null key; for ``event`` of the periods
        after adoption). Errors count those of the shares."""
        cohort = {g: i for i, g in enumerate(self.cohorts)}
        after = [(g, t) for g, t in self.cells if t >= g]
        if kind == "simple":
            keyed = {None: after}
        elif kind == "event":
            keyed = {k: [(g, t) for g, t in self.cells if t - g == k] for k in sorted({t - g for g, t in self.cells})}
        elif kind == "group":
            keyed = {g: [c for c in after if c[0] == g] for g in self.cohorts}
        elif kind == "calendar":
            keyed = {t: [c for c in after if c[1] == t] for t in sorted({t for _, t in after})}
        else:
            raise ValueError("simple, event, group or calendar")
        keyed = {k: v for k, v in keyed.items() if v}
        place, n = {c: i for i, c in enumerate(self.cells)}, len(self.cells)
        value, weights = [], []
        for cells in keyed.values():
            p = np.array([self.shares[cohort[g]] for g, _ in cells])
            a = np.array([self.att[place[c]] for c in cells])
            mean = float(p @ a / p.sum())
            w = np.zeros(n + len(self.cohorts))
            for c, share, effect in zip(cells, p, a, strict=True):
                w[place[c]] += share / p.sum()
                w[n + cohort[c[0]]] += (effect - mean) / p.sum()
            value.append(mean)
            weights.append(w)
        keys = list(keyed)
        if kind != "simple":
            some = [i for i, k in enumerate(keys) if kind != "event" or k >= 0]
            share = np.array([self.shares[cohort[keys[i]]] for i in some]) if kind == "group" else np.ones(len(some))
            share = share / share.sum()
            w = share @ np.array([weights[i] for i in some])
            mean = float(share @ np.array([value[i] for i in some]))
            if kind == "group":
                total = sum(self.shares[cohort[keys[i]]] for i in some)
                for i in some:
                    w[n + cohort[keys[i]]] += (value[i] - mean) / total
            keys, value, weights = [*keys, None], [*value, mean], [*weights, w]
        w = np.array(weights)
        se = np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", w, self.covariance, w), 0))
        rows = [(k, *line) for k, line in zip(keys, _lines(np.array(value), se, alpha), strict=True)]
        return small(spark, rows, f"key long, {EFFECT}")


def _lines(value: np.ndarray, se: np.ndarray, alpha: float) -> list[tuple]:
    at = dist.critical(alpha, None)
    z = [float(v / s) if s > 0 else math.nan for v, s in zip(value, se, strict=True)]
    return [(float(v), float(s), x, dist.two_sided(x, None), float(v - at * s), float(v + at * s)) for v, s, x in zip(value, se, z, strict=True)]


def _units(df: DataFrame, unit: str, time: str, outcome: str, cohort: str, covariates: tuple[str, ...]) -> tuple[DataFrame, list[int]]:
    """One row for each unit with an outcome in every period: u (a hash), g (null: never), x (1 and covariates, as in its first
    period), y (by period)."""
    rows = df.select(F.col(unit).alias("unit"), F.col(time).cast("long").alias("t"), F.col(outcome).cast("double").alias("y"), F.col(cohort).cast("long").alias("g"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(covariates)])
    rows = rows.where(F.col("unit").isNotNull() & F.col("t").isNotNull() & F.col("y").isNotNull() & ~F.isnan("y"))
    times = [r[0] for r in rows.select("t").distinct().orderBy("t").limit(1001).collect()]
    if len(times) > 1000:
        raise ValueError("more than 1000 periods")
    first = F.min(F.struct("t", *[f"x{i}" for i in range(len(covariates))]))
    by = rows.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("t").alias("m"), F.max("g").alias("g"), first.alias("first"), F.array_sort(F.collect_list(F.struct("t", "y"))).alias("s"))
    if not by.where("n > m").isEmpty():
        raise ValueError("a unit has a period twice")
    x = F.array(F.lit(1.0), *[F.col(f"first.x{i}") for i in range(len(covariates))])
    whole = by.where(F.col("n") == len(times)).select(F.xxhash64("unit").alias("u"), "g", x.alias("x"), F.transform("s", lambda v: v.y).alias("y"))
    return whole.where(~F.exists("x", lambda v: v.isNull() | F.isnan(v))), times


def _reduced(rows: DataFrame, body: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of what ``body`` makes of batches of units: hash, cohort (NaN: never), covariates, outcomes."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                flat = lambda c, b=b: b[c].flatten().to_numpy().reshape(b.num_rows, -1)
                part = body(b["u"].to_numpy(), b["g"].to_numpy(zero_copy_only=False).astype(float), flat("x"), flat("y")).ravel()
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["i", "v"])

    got = rows.mapInArrow(sums, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(got.num_rows)
    out[got["i"].to_numpy()] = got["v"].to_numpy()
    return out


def _signs(u: np.ndarray, draws: int) -> np.ndarray:
    """Rademacher multipliers (draw, unit) from the units' hashes."""
    x = u.view(np.uint64)[None, :] + np.arange(1, draws + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.where(((x ^ (x >> np.uint64(31))) >> np.uint64(40)) & np.uint64(1), 1.0, -1.0)


def group_time(df: DataFrame, outcome: str, unit: str, time: str, cohort: str, covariates: tuple[str, ...] = (), *, controls: str = "never", draws: int = 0) -> GroupTime:
    """Effects of adoption on each cohort in each period, after Callaway and Sant'Anna, doubly robust in the covariates (their
    values in the unit's first period). ``cohort``: the period of adoption, null for never. The outcome is compared with the
    period before adoption, before it with the period before. ``controls``: units never treated, or with ``notyet`` also those
    not treated up to the period. Units without an outcome in every period, or without covariates, are left out, as are
    cohorts that adopt in the first period or after the last. ``draws``: multiplier draws for uniform bands."""
    found, times = _units(df, unit, time, outcome, cohort, covariates)
    units = written(found)
    if len(times) < 2:
        raise ValueError("effects need two periods")
    counts = {r["g"]: r["n"] for r in units.groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()}
    cohorts = sorted(g for g in counts if g is not None and times[0] < g <= times[-1])
    if len(cohorts) > 500:
        raise ValueError("more than 500 cohorts")
    if not cohorts or (controls == "never" and None not in counts):
        raise ValueError("no cohort that adopts within the periods, or no controls")
    place = {t: i for i, t in enumerate(times)}
    base = lambda g, t: place[max(s for s in times if s < g)] if t >= g else place[t] - 1
    cells = [(g, t) for g in cohorts for t in times[1:]]

    def control(g_row: np.ndarray, g: int, t: int) -> np.ndarray:
        return np.isnan(g_row) if controls == "never" else (np.isnan(g_row) | (g_row > max(t, g - 1))) & (g_row != g)

    if controls != "never":
        last = max(cohorts) if None not in counts else math.inf
        cells = [(g, t) for g, t in cells if t < last]
    k = 1 + len(covariates)
    n = sum(counts.values())
    propensity = {key: _propensity(units, key, k, controls) for key in dict.fromkeys((g, t if controls != "never" else 0) for g, t in cells)} if covariates else {}

    def change(y: np.ndarray, g: int, t: int) -> np.ndarray:
        return y[:, place[t]] - y[:, base(g, t)]

    # the controls' regressions of changes on covariates
    def crossed(u, g_row, x, y):
        out = []
        for g, t in cells:
            c = control(g_row, g, t)
            out.append(np.concatenate([(x[c].T @ x[c]).ravel(), x[c].T @ change(y[c], g, t)]))
        return np.array(out)

    got = _reduced(units, crossed).reshape(len(cells), k * k + k)
    grams = got[:, : k * k].reshape(-1, k, k)
    inverses = np.array([np.linalg.pinv(m, hermitian=True) for m in grams])
    slopes = np.einsum("cij,cj->ci", inverses, got[:, k * k :])

    def odds(x: np.ndarray, g: int, t: int) -> np.ndarray:
        if not covariates:
            return np.ones(len(x))
        return np.exp(np.clip(x @ propensity[g, t if controls != "never" else 0][0], -30, 30))

    # means that the scores need
    def means(u, g_row, x, y):
        out = []
        for i, (g, t) in enumerate(cells):
            d, c = g_row == g, control(g_row, g, t)
            e = change(y, g, t) - x @ slopes[i]
            w = np.where(c, odds(x, g, t), 0.0)
            out.append(np.concatenate([[d.sum(), d @ e, w.sum(), w @ e], d @ x, w @ x, (w * e) @ x]))
        return np.array(out)

    got = _reduced(units, means).reshape(len(cells), 4 + 3 * k)
    treated, weighted = got[:, 0], got[:, 2]
    eta1, eta0 = got[:, 1] / treated, got[:, 3] / weighted
    xd, xw, xwe = got[:, 4 : 4 + k], got[:, 4 + k : 4 + 2 * k], got[:, 4 + 2 * k :]
    att = eta1 - eta0
    shares = np.array([counts[g] for g in cohorts]) / n

    # each unit's influence on all effects, times 1 / n, and on the shares
    def influence(u, g_row, x, y):
        out = np.zeros((len(u), len(cells) + len(cohorts)))
        for i, (g, t) in enumerate(cells):
            d, c = (g_row == g).astype(float), control(g_row, g, t).astype(float)
            e = change(y, g, t) - x @ slopes[i]
            ps = odds(x, g, t)
            regression = (c * e)[:, None] * (x @ inverses[i])
            one = (d * (e - eta1[i]) - regression @ xd[i]) / treated[i]
            zero = c * ps * (e - eta0[i]) - regression @ xw[i]
            if covariates:
                _, v = propensity[g, t if controls != "never" else 0]
                p = ps / (1 + ps)
                zero = zero + (((d - p) * (d + c > 0))[:, None] * (x @ v)) @ (xwe[i] - eta0[i] * xw[i])
            out[:, i] = one - zero / weighted[i]
        for j, g in enumerate(cohorts):
            out[:, len(cells) + j] = ((g_row == g) - shares[j]) / n
        return out

    width = len(cells) + len(cohorts)

    def products(u, g_row, x, y):
        s = influence(u, g_row, x, y)
        return np.concatenate([(s.T @ s).ravel(), (_signs(u, draws) @ s).ravel() if draws else np.zeros(0)])

    got = _reduced(units, products)
    return GroupTime(cohorts, times, cells, att, shares, got[: width * width].reshape(width, width), n, got[width * width :].reshape(draws, width))


def _propensity(units: DataFrame, key: tuple[int, int], k: int, controls: str) -> tuple[np.ndarray, np.ndarray]:
    """A logit of belonging to a cohort among it and its controls: coefficients with the constant first, and covariance."""
    g, t = key
    never = F.col("g").isNull() if controls == "never" else F.col("g").isNull() | (F.col("g") > max(t, g - 1))
    rows = units.where((F.col("g") == g) | never).select((F.col("g") == g).alias("own"), *[F.col("x")[i].alias(f"c{i}") for i in range(1, k)])
    rows = rows.withColumn("own", F.coalesce("own", F.lit(False)).cast("double"))
    fit = mle.logit(rows, "own", tuple(f"c{i}" for i in range(1, k)))
    order = [k - 1, *range(k - 1)]
    return fit.beta[order], fit.covariance[np.ix_(order, order)]


# ---- what two-way fixed effects average

def bacon(df: DataFrame, outcome: str, unit: str, time: str, cohort: str) -> DataFrame:
    """The comparisons that the two-way fixed effects estimate of a treatment averages, after Goodman-Bacon: kind (treated with
    never treated, earlier with later treated, later with earlier treated), treated, control (cohorts; null: never), estimate
    and weight; weights sum to one, and estimates by weights to the coefficient. Spark sums units to means by cohort and
    period; units without all periods are left out, and those treated throughout are compared like controls."""
    found, times = _units(df, unit, time, outcome, cohort, ())
    cells = found.groupBy("g").agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col("y")[i]).alias(f"m{i}") for i in range(len(times))]).collect()
    late = times[-1]
    groups: dict[int | None, tuple[int, np.ndarray]] = {}
    for r in cells:
        g = r["g"] if r["g"] is not None and r["g"] <= late else None
        n, m = r["n"], np.array(r[2:], float)
        had = groups.get(g)
        groups[g] = (n, m) if had is None else (had[0] + n, (had[0] * had[1] + n * m) / (had[0] + n))
    total = sum(n for n, _ in groups.values())
    at = np.array(times)
    share = {g: groups[g][0] / total for g in groups}
    time_on = {g: 0.0 if g is None else float((at >= g).mean()) for g in groups}
    mean = lambda g, some: float(groups[g][1][some].mean())
    rows = []
    treated = [g for g in groups if g is not None and times[0] < g]
    fixed = [g for g in groups if g is None or g <= times[0]]
    for k in treated:
        post = at >= k
        for u in fixed:
            nk, nu, d = share[k], share[u], time_on[k]
            est = mean(k, post) - mean(k, ~post) - (mean(u, post) - mean(u, ~post))
            rows.append(("treated with never treated" if u is None else "treated with always treated", k, u, est, nk * nu * d * (1 - d)))
        for later in treated:
            if later <= k:
                continue
            nk, nl, dk, dl = share[k], share[later], time_on[k], time_on[later]
            before, middle, after = at < k, (at >= k) & (at < later), at >= later
            if before.any() and middle.any():
                early = mean(k, middle) - mean(k, before) - (mean(later, middle) - mean(later, before))
                rows.append(("earlier with later treated", k, later, early, nk * nl * (dk - dl) * (1 - dk)))
            if middle.any() and after.any():
                late_est = mean(later, after) - mean(later, middle) - (mean(k, after) - mean(k, middle))
                rows.append(("later with earlier treated", later, k, late_est, nk * nl * dl * (dk - dl)))
    whole = sum(r[4] for r in rows)
    if not rows or whole <= 0:
        raise ValueError("no comparison identifies the effect")
    return small(df.sparkSession, [(*r[:4], r[4] / whole) for r in rows], "kind string, treated long, control long, estimate double, weight double")


# ---- effects of a treatment with a fitted propensity

def treatment_effects(df: DataFrame, outcome: str, treated: str, covariates: tuple[str, ...], *, alpha: float = 0.05) -> DataFrame:
    """method, estimate, std_error, z, p_value, ci_low, ci_high of the average effect of a treatment: ra (regressions in both
    arms), ipw (normalised weights by a logit), aipw (doubly robust). Errors count the estimation of propensities and
    regressions. Rows with a null are left out; one arm alone, or an arm that the covariates separate, is an error."""
    rows = df.select(F.col(outcome).cast("double").alias("y"), F.col(treated).cast("double").alias("d"), *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(covariates)])
    k = 1 + len(covariates)
    names = tuple(f"c{i}" for i in range(k - 1))
    rows = rows.na.drop()
    logit = mle.logit(rows, "d", names)
    order = [k - 1, *range(k - 1)]
    gamma, v = logit.beta[order], logit.covariance[np.ix_(order, order)]
    units = rows.select(F.lit(0).cast("long").alias("u"), F.col("d").alias("g"), F.array(F.lit(1.0), *names).alias("x"), F.array("y").alias("y"))

    def crossed(u, d, x, y):
        return np.concatenate([np.concatenate([(x[d == a].T @ x[d == a]).ravel(), x[d == a].T @ y[d == a, 0]]) for a in (0, 1)])

    got = _reduced(units, crossed).reshape(2, k * k + k)
    inverse = [np.linalg.inv(g[: k * k].reshape(k, k)) for g in got]
    beta = [inverse[a] @ got[a, k * k :] for a in (0, 1)]

    def parts(d, x, y):
        p = 1 / (1 + np.exp(-(x @ gamma)))
        fitted = [x @ beta[a] for a in (0, 1)]
        return p, fitted, [(1 - d) / (1 - p), d / p], y[:, 0]

    def means(u, d, x, y):
        p, fitted, w, y = parts(d, x, y)
        slope = [w[0] * p, -w[1] * (1 - p)]  # of the weights in the logit's index
        out = [np.array([len(d)]), x.sum(axis=0)]
        for a in (0, 1):
            out += [np.array([w[a].sum(), w[a] @ y, (fitted[a] + w[a] * (y - fitted[a])).sum(), fitted[a].sum()]), slope[a] @ x, (slope[a] * y) @ x, (slope[a] * (y - fitted[a])) @ x, (1 - w[a]) @ x]
        return np.concatenate(out)

    got = _reduced(units, means)
    n, xbar, rest = got[0], got[1 : 1 + k], got[1 + k :].reshape(2, 4 + 4 * k)
    ipw = rest[:, 1] / rest[:, 0]
    aipw, ra = rest[:, 2] / n, rest[:, 3] / n
    s0, s1, s2, s3 = (rest[:, 4 + i * k : 4 + (i + 1) * k] for i in range(4))

    def influence(u, d, x, y):
        p, fitted, w, y = parts(d, x, y)
        score = ((d - p)[:, None] * x) @ v
        out = np.zeros((len(d), 3))
        for a, sign in ((0, -1), (1, 1)):
            arm = (d == a)[:, None] * (y - fitted[a])[:, None] * (x @ inverse[a])
            out[:, 0] += sign * ((fitted[a] - ra[a]) / n + arm @ xbar / n)
            out[:, 1] += sign * (w[a] * (y - ipw[a]) + score @ (s1[a] - ipw[a] * s0[a])) / rest[a, 0]
            out[:, 2] += sign * (fitted[a] + w[a] * (y - fitted[a]) - aipw[a] + score @ s2[a] + arm @ s3[a]) / n
        return out.T @ out

    cov = _reduced(units, influence).reshape(3, 3)
    value = np.array([ra[1] - ra[0], ipw[1] - ipw[0], aipw[1] - aipw[0]])
    return small(df.sparkSession, [(m, *line) for m, line in zip(("ra", "ipw", "aipw"), _lines(value, np.sqrt(np.diag(cov)), alpha), strict=True)], f"method string, {EFFECT}")
