"""Linear models from sufficient statistics: the data are reduced in Spark, K by K algebra is done on the driver."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystat.functions import dist
from quarrystat.plans.spec import INTERCEPT, Spec, design
from quarrystat.sources.tables import small, written

COEFFICIENTS = "term string, estimate double, std_error double, statistic double, p_value double, ci_low double, ci_high double"


@dataclass(frozen=True)
class Fit:
    """A fitted model. ``df`` are the degrees of freedom of t tests, None for normal ones."""

    names: list[str]
    beta: np.ndarray
    covariance: np.ndarray
    df: float | None
    metrics: dict[str, float] = field(default_factory=dict)
    alpha: float = 0.05

    def rows(self) -> list[tuple]:
        at = dist.critical(self.alpha, self.df)
        out = []
        for name, b, v in zip(self.names, self.beta, np.diag(self.covariance), strict=True):
            se = math.sqrt(max(v, 0.0))
            z = b / se if se > 0 else math.nan
            out.append((name, float(b), se, float(z), dist.two_sided(z, self.df), float(b - at * se), float(b + at * se)))
        return out

    def frame(self, spark: SparkSession) -> DataFrame:
        return small(spark, self.rows(), COEFFICIENTS)

    def predict(self, xs: list[Column]) -> Column:
        return sum((F.lit(float(b)) * x for b, x in zip(self.beta, xs, strict=True)), F.lit(0.0))

    def lincom(self, weights: dict[str, float]) -> tuple[float, float, float]:
        """Estimate, standard error and p-value of a linear combination of coefficients."""
        r = np.array([weights.get(n, 0.0) for n in self.names])
        est, se = float(r @ self.beta), math.sqrt(float(r @ self.covariance @ r))
        return est, se, dist.two_sided(est / se, self.df)

    def test(self, restrictions: list[dict[str, float]]) -> tuple[float, float]:
        """Wald test that each combination is zero: F (chi-square for normal tests) and its p-value."""
        r = np.array([[w.get(n, 0.0) for n in self.names] for w in restrictions])
        w = float((r @ self.beta) @ np.linalg.solve(r @ self.covariance @ r.T, r @ self.beta))
        q = len(restrictions)
        return (w, dist.chi2_sf(w, q)) if self.df is None else (w / q, dist.f_sf(w / q, q, self.df))


def gram(df: DataFrame, columns: list[Column], weight: Column | None = None) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means, and cross-products about the means, of doubles; two passes, each one aggregate. The second pass
    works about the first one's means, so large offsets cost no digits."""
    w = F.lit(1.0) if weight is None else weight
    k = len(columns)
    first = df.agg(F.count(F.lit(1)), F.sum(w), *[F.sum(w * c) for c in columns]).first()
    n, total = first[0], first[1]
    if not n:
        return 0, np.zeros(k), np.zeros((k, k))
    means = np.array(first[2:]) / total
    centred = [c - F.lit(float(m)) for c, m in zip(columns, means, strict=True)]
    second = df.agg(*[F.sum(w * centred[i] * centred[j]) for i in range(k) for j in range(i, k)]).first()
    products = np.zeros((k, k))
    products[np.triu_indices(k)] = second
    return n, means, products + np.triu(products, 1).T


def solve(products: np.ndarray, means: np.ndarray, total: float, intercept: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From centred products of (y, x...) to coefficients, the inverse of X'X, and which terms are kept. Terms that
    others explain, going in order, are left out. ``intercept``: its place among x, or None."""
    k = len(means) - 1
    raw = products + total * np.outer(means, means)
    sxx, sxy = (products if intercept is not None else raw)[1:, 1:], (products if intercept is not None else raw)[1:, 0]
    keep = [i for i in range(k) if i != intercept]
    chosen: list[int] = []
    for i in keep:
        block = np.ix_([*chosen, i], [*chosen, i])
        left = sxx[i, i] - (sxx[i, chosen] @ np.linalg.solve(sxx[np.ix_(chosen, chosen)], sxx[chosen, i]) if chosen else 0.0)
        if sxx[i, i] > 0 and left > 1e-10 * sxx[i, i] and np.all(np.isfinite(sxx[block])):
            chosen.append(i)
    scale = 1 / np.sqrt(np.diag(sxx)[chosen])
    inner = np.linalg.inv(sxx[np.ix_(chosen, chosen)] * np.outer(scale, scale)) * np.outer(scale, scale)
    beta, inverse = np.zeros(k), np.zeros((k, k))
    beta[chosen] = inner @ sxy[chosen]
    inverse[np.ix_(chosen, chosen)] = inner
    kept = np.zeros(k, bool)
    kept[chosen] = True
    if intercept is not None:
        m = means[1:]
        beta[intercept] = means[0] - m[chosen] @ beta[chosen]
        cross = -inverse @ np.where(kept, m, 0.0)
        inverse[intercept, :] = inverse[:, intercept] = cross
        inverse[intercept, intercept] = 1 / total + np.where(kept, m, 0.0) @ -cross
        kept[intercept] = True
    return beta, inverse, kept


def products_of(df: DataFrame, scores: list[Column]) -> np.ndarray:
    """The sum of outer products of the scores."""
    k = len(scores)
    row = df.agg(*[F.coalesce(F.sum(scores[i] * scores[j]), F.lit(0.0)) for i in range(k) for j in range(i, k)]).first()
    out = np.zeros((k, k))
    out[np.triu_indices(k)] = row
    return out + np.triu(out, 1).T


def clustered(df: DataFrame, scores: list[Column], keys: list[str]) -> tuple[np.ndarray, int]:
    """The meat of one or several cluster dimensions by inclusion and exclusion, each with its G / (G - 1), and the
    least number of clusters. Scores are summed within clusters before anything is multiplied."""
    meat, least = np.zeros((len(scores), len(scores))), None
    names = [f"s{i}" for i in range(len(scores))]
    for bits in range(1, 1 << len(keys)):
        some = [k for i, k in enumerate(keys) if bits >> i & 1]
        sums = df.groupBy(*some).agg(*[F.sum(s).alias(n) for s, n in zip(scores, names, strict=True)])
        k = len(names)
        row = sums.agg(F.count(F.lit(1)), *[F.sum(F.col(names[i]) * F.col(names[j])) for i in range(k) for j in range(i, k)]).first()
        own = np.zeros((k, k))
        own[np.triu_indices(k)] = row[1:]
        own = own + np.triu(own, 1).T
        groups = row[0]
        meat += (-1) ** (len(some) + 1) * own * groups / max(groups - 1, 1)
        if len(some) == 1:
            least = groups if least is None else min(least, groups)
    return meat, least


def positive(v: np.ndarray) -> np.ndarray:
    """The matrix with its negative eigenvalues set to zero."""
    values, vectors = np.linalg.eigh((v + v.T) / 2)
    return v if values.min() >= 0 else (vectors * np.maximum(values, 0)) @ vectors.T


def hac(df: DataFrame, scores: list[Column], time: str, lags: int) -> np.ndarray:
    """Bartlett-weighted autocovariances of the scores at exact distances in time, which holds one row a period."""
    names = [f"s{i}" for i in range(len(scores))]
    own = df.select(F.col(time).alias("t"), *[s.alias(n) for s, n in zip(scores, names, strict=True)])
    meat = products_of(own, [F.col(n) for n in names])
    if own.groupBy("t").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty() is False:
        raise ValueError(f"{time} repeats")
    if not lags:
        return meat
    later = own.withColumn("lag", F.explode(F.sequence(F.lit(1), F.lit(lags))))
    later = later.select((F.col("t") - F.col("lag")).alias("t"), "lag", *[F.col(n).alias(f"l{n}") for n in names])
    k = len(names)
    weight = 1 - F.col("lag") / F.lit(float(lags + 1))
    row = own.join(later, "t").agg(*[F.coalesce(F.sum(weight * F.col(names[i]) * F.col(f"l{names[j]}")), F.lit(0.0)) for i in range(k) for j in range(k)]).first()
    cross = np.array(row).reshape(k, k)
    return meat + cross + cross.T


def ols(df: DataFrame, spec: Spec, absorbed: int = 0) -> Fit:
    """Least squares. ``absorbed``: degrees of freedom used by effects already taken out of the columns."""
    rows, names = design(df, spec)
    k = len(names)
    xs = [F.col(f"x{i}") for i in range(k)]
    w = F.col("w")
    rows = rows.persist()
    try:
        n, means, products = gram(rows, [F.col("y"), *xs], w)
        if not n:
            raise ValueError("no complete rows")
        total = rows.agg(F.sum("w")).first()[0]
        if spec.weights and spec.weight_type != "fweight":  # analytic and sampling weights are scaled to the number of rows
            products, rows, total = products * n / total, rows.withColumn("w", F.col("w") * F.lit(n / total)), float(n)
        count = total if spec.weight_type == "fweight" and spec.weights else n
        place = names.index(INTERCEPT) if INTERCEPT in names else None
        beta, inverse, kept = solve(products, means, total, place)
        used = int(kept.sum()) + absorbed
        e = F.col("y") - sum((F.lit(float(b)) * x for b, x in zip(beta, xs, strict=True)), F.lit(0.0))
        rss = rows.agg(F.sum(w * e * e)).first()[0]
        tss = products[0, 0] if place is not None else products[0, 0] + total * means[0] ** 2
        df_t: float | None = count - used
        kind = "HC1" if spec.weight_type == "pweight" and spec.weights and spec.covariance == "nonrobust" else spec.covariance
        if spec.cluster and kind == "nonrobust":
            kind = "cluster"
        freq = spec.weights is not None and spec.weight_type == "fweight"
        scores = [w * e * x for x in xs]
        if kind == "nonrobust":
            v = inverse * rss / (count - used)
        elif kind.startswith("HC"):
            h = sum((F.lit(float(inverse[i, j])) * xs[i] * xs[j] for i in range(k) for j in range(k) if inverse[i, j]), F.lit(0.0)) * (F.lit(1.0) if freq else w)
            if kind in ("HC2", "HC3") and (rows.agg(F.max(h)).first()[0] or 0.0) > 1 - 1e-10:
                raise ValueError(f"a row has a leverage of 1, so {kind} doesn't exist")
            shrink = {"HC0": F.lit(1.0), "HC1": F.lit(1.0), "HC2": F.sqrt(1 - h), "HC3": 1 - h}[kind]
            base = [(F.sqrt(w) if freq else w) * e * x / shrink for x in xs]
            meat = products_of(rows, base)
            v = inverse @ meat @ inverse * (count / (count - used) if kind == "HC1" else 1.0)
        elif kind == "cluster":
            meat, groups = clustered(rows, scores, [f"k_{c}" for c in spec.cluster])
            v = positive(inverse @ meat @ inverse * (count - 1) / (count - used))
            df_t = groups - 1
        elif kind == "hac":
            v = inverse @ hac(rows, scores, f"k_{spec.time}", spec.lags) @ inverse * count / (count - used)
        else:
            raise ValueError(f"unknown covariance {kind}")
        ll = -count / 2 * (math.log(2 * math.pi) + 1 + math.log(rss / count)) if rss > 0 else math.inf
        r2 = 1 - rss / tss if tss > 0 else math.nan
        has = int(place is not None)
        metrics = {
            "n": float(count), "df_model": float(used - has), "df_resid": float(count - used), "rss": rss, "r2": r2,
            "r2_adjusted": 1 - (1 - r2) * (count - has) / (count - used), "rmse": math.sqrt(rss / count), "loglik": ll,
            "aic": -2 * ll + 2 * used, "bic": -2 * ll + math.log(count) * used,
        }
        return Fit(names, beta, v, df_t, metrics, spec.alpha)
    finally:
        rows.unpersist()


def within(df: DataFrame, columns: dict[str, Column], effects: list[str], *, sweeps: int = 200, tolerance: float = 1e-10) -> DataFrame:
    """``df`` with each named column less its means by the effects. Means are group sums, joined back, so a group that
    holds a third of all rows is one row in the shuffle. One effect takes one pass. With several, alternating
    projections run on the small tables of level effects: the part of each effect in the other's levels is a table of
    cells (level, level, rows), so sweeps never read the rows again; what doesn't settle is an error."""
    names = list(columns)
    rows = df.select("*", *[c.cast("double").alias(n) for n, c in columns.items()])
    if len(effects) == 1:
        return _less(rows, [_means(rows, effects[0], names)], effects, names)
    kept = written
    cells = kept(rows.groupBy(*effects).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(n).alias(f"_s{i}") for i, n in enumerate(names)]))
    state = [cells.select(e).distinct().select(e, *[F.lit(0.0).alias(n) for n in names]) for e in effects]
    size = rows.agg(*[F.max(F.abs(n)) for n in names]).first()
    largest = max((v or 0.0) for v in size)
    for sweep in range(sweeps):
        moved = 0.0
        for k, effect in enumerate(effects):
            part = cells
            for j, other in enumerate(effects):
                if j != k:
                    part = part.join(state[j].select(F.col(other).alias("_o"), *[F.col(n).alias(f"_a{j}_{i}") for i, n in enumerate(names)]), F.col(other) == F.col("_o")).drop("_o")
            left = lambda i, k=k: F.sum(F.col(f"_s{i}") - F.col("_n") * sum((F.col(f"_a{j}_{i}") for j in range(len(effects)) if j != k), F.lit(0.0))) / F.sum("_n")
            fresh = part.groupBy(effect).agg(*[left(i).alias(n) for i, n in enumerate(names)])
            before = state[k].select(F.col(effect).alias("_o"), *[F.col(n).alias(f"_b{i}") for i, n in enumerate(names)])
            fresh = kept(fresh.join(before, F.col(effect) == F.col("_o")).drop("_o"))
            moved = max(moved, fresh.agg(F.max(F.greatest(*[F.abs(F.col(n) - F.col(f"_b{i}")) for i, n in enumerate(names)], F.lit(0.0)))).first()[0] or 0.0)
            state[k] = fresh.select(effect, *names)
        if moved <= tolerance * max(largest, 1e-300):
            return _less(rows, state, effects, names)
    raise ValueError(f"the effects did not settle in {sweeps} sweeps")


def _means(rows: DataFrame, effect: str, names: list[str]) -> DataFrame:
    return rows.groupBy(effect).agg(*[F.avg(n).alias(n) for n in names])


def _less(rows: DataFrame, tables: list[DataFrame], effects: list[str], names: list[str]) -> DataFrame:
    for k, (table, effect) in enumerate(zip(tables, effects, strict=True)):
        own = table.select(F.col(effect).alias(f"_o{k}"), *[F.col(n).alias(f"_m{k}_{i}") for i, n in enumerate(names)])
        rows = rows.join(own, F.col(effect).eqNullSafe(F.col(f"_o{k}")), "left")
    for i, n in enumerate(names):
        rows = rows.withColumn(n, F.col(n) - sum((F.col(f"_m{k}_{i}") for k in range(len(effects))), F.lit(0.0)))
    return rows.drop(*[f"_o{k}" for k in range(len(effects))], *[f"_m{k}_{i}" for k in range(len(effects)) for i in range(len(names))])


def singletons_dropped(rows: DataFrame, effects: list[str]) -> DataFrame:
    """With several effects, without rows that are alone in a level, again and again until none is; they fit perfectly."""
    if len(effects) < 2:
        return rows
    while True:
        alone = [(e, rows.groupBy(F.col(e).alias("_o")).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")) for e in effects]
        alone = [(e, t) for e, t in alone if not t.isEmpty()]
        if not alone:
            return rows
        for e, t in alone:
            rows = rows.join(t, F.col(e) == F.col("_o"), "left_anti")
        rows = written(rows)


def levels_absorbed(rows: DataFrame, effects: list[str]) -> int:
    """Degrees of freedom of the effects: the levels of the first, and of each further one its levels less the connected
    groups (mobility groups) that it forms with the first; at least one is lost to each."""
    from quarrystat.operators.network import components

    counts = rows.agg(*[F.countDistinct(e) for e in effects]).first()
    total = counts[0]
    for k, e in enumerate(effects[1:], 1):
        text = lambda n, mark: F.concat(F.lit(mark), F.col(n).cast("string"))
        groups = components(rows.select(text(effects[0], "a").alias("src"), text(e, "b").alias("dst")).distinct()).select("component").distinct().count()
        total += counts[k] - max(groups, 1)
    return total


def areg(df: DataFrame, spec: Spec, effects: list[str]) -> Fit:
    """Least squares with absorbed effects: the coefficients of the predictors, with degrees of freedom for the effects."""
    names = [spec.outcome, *spec.predictors]
    used = [n for n in dict.fromkeys([*names, *effects, *spec.cluster])]
    rows = singletons_dropped(df.select(*used).na.drop(), effects)
    absorbed = levels_absorbed(rows, effects)
    flat = within(rows, {f"d_{n}": F.col(n) for n in names}, effects)
    clean = Spec(f"d_{spec.outcome}", tuple(f"d_{p}" for p in spec.predictors), spec.covariance, spec.cluster, intercept=False, alpha=spec.alpha)
    fit = ols(flat, clean, absorbed=absorbed)
    return Fit(list(spec.predictors), fit.beta, fit.covariance, fit.df, fit.metrics, fit.alpha)


def ivregress(df: DataFrame, spec: Spec, endogenous: tuple[str, ...], instruments: tuple[str, ...], *, small: bool = True) -> Fit:
    """Two-stage least squares from one set of cross-products. Exogenous predictors are ``spec.predictors``."""
    both = Spec(spec.outcome, (*endogenous, *spec.predictors, *instruments), spec.covariance, spec.cluster, intercept=True)
    rows, names = design(df, both)
    rows = rows.persist()
    try:
        k = len(names)
        n, means, products = gram(rows, [F.col("y"), *[F.col(f"x{i}") for i in range(k)]])
        raw = products + n * np.outer(means, means)
        x = [i + 1 for i, m in enumerate(names) if m not in instruments]
        z = [i + 1 for i, m in enumerate(names) if m not in endogenous]
        zz, zx, zy = raw[np.ix_(z, z)], raw[np.ix_(z, x)], raw[z, 0]
        project = np.linalg.solve(zz, zx)  # first stages
        bread = np.linalg.inv(project.T @ zx)
        beta = bread @ (project.T @ zy)
        e = F.col("y") - sum((F.lit(float(b)) * F.col(f"x{i - 1}") for b, i in zip(beta, x, strict=True)), F.lit(0.0))
        fitted = [sum((F.lit(float(p)) * F.col(f"x{i - 1}") for p, i in zip(project[:, j], z, strict=True)), F.lit(0.0)) for j in range(len(x))]
        used, df_t = len(x), None
        if spec.covariance == "nonrobust" and not spec.cluster:
            rss = rows.agg(F.sum(e * e)).first()[0]
            v = bread * rss / (n - used if small else n)
        elif spec.cluster:
            meat, groups = clustered(rows, [e * f for f in fitted], [f"k_{c}" for c in spec.cluster])
            v = bread @ meat @ bread * ((n - 1) / (n - used) if small else 1.0)
            df_t = groups - 1 if small else None
        else:
            v = bread @ products_of(rows, [e * f for f in fitted]) @ bread * (n / (n - used) if small else 1.0)
        return Fit([names[i - 1] for i in x], beta, v, (df_t or n - used) if small else None, {"n": float(n)}, spec.alpha)
    finally:
        rows.unpersist()
