"""Maximum likelihood by Newton's method: every iteration is one aggregate of score and information over the rows."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystat.functions import jets
from quarrystat.operators import mle
from quarrystat.operators.linear import Fit, clustered, positive, products_of
from quarrystat.plans.spec import INTERCEPT, Spec, design


def _eta(xs: list[Column], beta: np.ndarray) -> Column:
    return sum((F.lit(float(b)) * x for b, x in zip(beta, xs, strict=True)), F.lit(0.0))


#: For each family and its canonical or usual link: (log likelihood, d/d eta, minus the expected second derivative),
#: from y and eta.
def _logit(y: Column, eta: Column) -> tuple[Column, Column, Column]:
    p = 1 / (1 + F.exp(-eta))
    return y * eta - F.greatest(eta, F.lit(0.0)) - F.log1p(F.exp(-F.abs(eta))), y - p, p * (1 - p)


def _poisson(y: Column, eta: Column) -> tuple[Column, Column, Column]:
    mu = F.exp(eta)
    return y * eta - mu, y - mu, mu


def _gamma(y: Column, eta: Column) -> tuple[Column, Column, Column]:
    mu = F.exp(eta)
    return -y / mu - eta, y / mu - 1, F.lit(1.0)


def _gaussian(y: Column, eta: Column) -> tuple[Column, Column, Column]:
    return -(y - eta) ** 2 / 2, y - eta, F.lit(1.0)


def _cloglog(y: Column, eta: Column) -> tuple[Column, Column, Column]:
    m = F.exp(eta)
    p = -F.expm1(-m)
    return F.when(y > 0, F.log(p)).otherwise(-m), F.when(y > 0, m * F.exp(-m) / p).otherwise(-m), m * m * F.exp(-m) / p


FAMILIES = {"logit": _logit, "poisson": _poisson, "gamma": _gamma, "gaussian": _gaussian, "cloglog": _cloglog}


def _parts(rows: DataFrame, xs: list[Column], beta: np.ndarray, family: str) -> DataFrame:
    ll, s, h = FAMILIES[family](F.col("y"), F.col("_eta"))
    return rows.withColumn("_eta", _eta(xs, beta)).select("*", ll.alias("_ll"), s.alias("_s"), h.alias("_h"))


def fit(df: DataFrame, spec: Spec, family: str = "logit", *, steps: int = 50, tolerance: float = 1e-10) -> Fit:
    """A generalised linear model with normal inference: nonrobust, robust (HC1 or HC0) or clustered covariance.
    Each step is halved until the likelihood doesn't fall; stops when score and step are both small."""
    rows, names = design(df, spec)
    k = len(names)
    if family == "probit":
        return _probit(rows, names, spec)
    xs = [F.col(f"x{i}") for i in range(k)]
    rows = rows.persist()
    try:
        w = F.col("w")
        n, total, mean = rows.agg(F.count(F.lit(1)), F.sum("w"), F.sum(w * F.col("y")) / F.sum("w")).first()
        beta = np.zeros(k)
        if INTERCEPT in names:
            share = min(max(mean, 1e-6), 1 - 1e-6)
            start = {"logit": math.log(share / (1 - share)), "probit": 0.0, "gaussian": mean, "cloglog": math.log(-math.log1p(-share))}
            beta[names.index(INTERCEPT)] = start.get(family, math.log(max(mean, 1e-6)))
        upper = np.triu_indices(k)

        def measure(b: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
            parts = _parts(rows, xs, b, family)
            row = parts.agg(F.sum(w * F.col("_ll")), *[F.sum(w * F.col("_s") * x) for x in xs], *[F.sum(w * F.col("_h") * xs[i] * xs[j]) for i, j in zip(*upper, strict=True)]).first()
            h = np.zeros((k, k))
            h[upper] = row[1 + k :]
            return row[0], np.array(row[1 : 1 + k]), h + np.triu(h, 1).T

        ll, score, info = measure(beta)
        null = ll
        for _ in range(steps):
            scale = 1 / np.sqrt(np.maximum(np.diag(info), 1e-300))
            step = np.linalg.lstsq(info * np.outer(scale, scale), score * scale, rcond=1e-12)[0] * scale
            size = 1.0
            for _ in range(30):
                moved = measure(beta + size * step)
                if moved[0] >= ll - 1e-12 * abs(ll):
                    break
                size /= 2
            beta, (ll, score, info) = beta + size * step, moved
            if np.max(np.abs(score * scale)) / math.sqrt(total) <= 1e-8 and np.max(np.abs(step) / (1 + np.abs(beta))) <= math.sqrt(tolerance):
                break
        else:
            raise mle.NotConverged(f"not converged in {steps} steps; an outcome may be separated")
        inverse = np.linalg.inv(info)
        dispersion = 1.0
        if family in ("gaussian", "gamma"):
            parts = _parts(rows, xs, beta, family)
            dispersion = parts.agg(F.sum(w * F.col("_s") ** 2)).first()[0] / (total - k)
        v = inverse * dispersion
        parts = _parts(rows, xs, beta, family)
        scores = [w * F.col("_s") * x for x in xs]
        if spec.cluster:
            meat, _ = clustered(parts, scores, [f"k_{c}" for c in spec.cluster])
            v = positive(inverse @ meat @ inverse)
        elif spec.covariance.startswith("HC"):
            v = inverse @ products_of(parts, scores) @ inverse * (n / (n - 1) if spec.covariance == "HC1" else 1.0)
        return Fit(names, beta, v, None, {"n": float(n), "loglik": ll, "loglik_null": null, "pseudo_r2": 1 - ll / null if null else math.nan}, spec.alpha)
    finally:
        rows.unpersist()


def _probit(rows: DataFrame, names: list[str], spec: Spec) -> Fit:
    """By the engine for any likelihood: the normal distribution function isn't one of Spark's."""
    terms = tuple(f"x{i}" for i in range(len(names)))
    keys = [f"k_{c}" for c in spec.cluster]
    if len(keys) > 1:
        raise ValueError("probit clusters by one column")
    problem = mle.Problem(lambda y, e: jets.log_ndtr(e[0] * np.where(y["y"] > 0, 1.0, -1.0)), ("y",), (mle.Equation("y", terms, False),))
    fit = mle.maximise(rows, problem, weight="w", robust=spec.covariance.startswith("HC"), cluster=keys[0] if keys else None, alpha=spec.alpha)
    n, n1 = rows.agg(F.sum("w"), F.sum(F.col("w") * F.col("y"))).first()
    null = n1 * math.log(n1 / n) + (n - n1) * math.log(1 - n1 / n) if 0 < n1 < n else math.nan
    return Fit(names, fit.beta, fit.covariance, None, fit.metrics | {"loglik_null": null, "pseudo_r2": 1 - fit.metrics["loglik"] / null if null else math.nan}, spec.alpha)
