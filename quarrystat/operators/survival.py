"""Survival analysis from counts by distinct time: life tables, Kaplan-Meier, Nelson-Aalen, log-rank, Cox (Breslow)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystat.functions import dist
from quarrystat.operators.linear import Fit
from quarrystat.operators.mle import NotConverged
from quarrystat.operators.ranked import running
from quarrystat.plans.spec import Spec
from quarrystat.sources.tables import small


def risk_table(df: DataFrame, time: str, event: str, by: list[str] | None = None) -> DataFrame:
    """by, time, events, exits, at_risk. Rows are first counted by time, so the windows run over distinct times."""
    by = by or []
    rows = df.na.drop(subset=[time, event, *by])
    counts = rows.groupBy(*by, F.col(time).cast("double").alias("time")).agg(F.sum(F.col(event).cast("long")).alias("events"), F.count(F.lit(1)).alias("exits"))
    if not by:
        return running(counts, "time", "exits", "at_risk", descending=True)
    after = Window.partitionBy(*by).orderBy("time").rowsBetween(0, Window.unboundedFollowing)
    return counts.withColumn("at_risk", F.sum("exits").over(after))


def kaplan_meier(df: DataFrame, time: str, event: str, by: list[str] | None = None) -> DataFrame:
    """The survivor function with Greenwood's standard error, and the Nelson-Aalen cumulative hazard, at event times."""
    by = by or []
    upto = Window.partitionBy(*by).orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    rows = risk_table(df, time, event, by)
    left = F.col("at_risk") - F.col("events")
    rows = rows.withColumns({
        "_log": F.sum(F.when(left > 0, F.log(left / F.col("at_risk"))).otherwise(F.lit(0.0))).over(upto), "_gone": F.max((left == 0).cast("int")).over(upto),
        "_g": F.sum(F.when(left > 0, F.col("events") / (F.col("at_risk") * left)).otherwise(F.lit(0.0))).over(upto), "hazard": F.sum(F.col("events") / F.col("at_risk")).over(upto),
    }).where("events > 0")
    survival = F.when(F.col("_gone") == 1, F.lit(0.0)).otherwise(F.exp("_log"))
    return rows.select(*by, "time", "at_risk", "events", survival.alias("survival"), (survival * F.sqrt("_g")).alias("std_error"), "hazard")


def logrank(df: DataFrame, time: str, event: str, group: str) -> DataFrame:
    """The log-rank test of equal hazards: observed and expected events of the first group, chi-square, p-value."""
    rows = df.na.drop(subset=[time, event, group])
    levels = [r[0] for r in rows.select(group).distinct().orderBy(group).limit(1001).collect()]
    if len(levels) > 1000:
        raise ValueError("more than 1000 groups")
    by_time = rows.groupBy(F.col(time).cast("double").alias("time")).agg(
        *[F.count(F.when(F.col(group) == v, 1)).alias(f"n{i}") for i, v in enumerate(levels)], *[F.sum(F.when(F.col(group) == v, F.col(event).cast("long")).otherwise(0)).alias(f"d{i}") for i, v in enumerate(levels)]
    )
    k = len(levels)
    rows = running(by_time, "time", [f"n{i}" for i in range(k)], [f"r{i}" for i in range(k)], descending=True)
    r, d = sum((F.col(f"r{i}") for i in range(k)), F.lit(0)), sum((F.col(f"d{i}") for i in range(k)), F.lit(0))
    scale = F.when(r > 1, d * (r - d) / (r - 1)).otherwise(F.lit(0.0))
    share = [F.col(f"r{i}") / r for i in range(k)]
    cells = [F.sum(scale * (share[i] * ((i == j) * 1.0 - share[j]))) for i in range(k - 1) for j in range(k - 1)]
    x = rows.agg(*[F.sum(f"d{i}") for i in range(k)], *[F.sum(d * s) for s in share], *cells).first()
    o, e = np.array(x[:k], float), np.array(x[k : 2 * k], float)
    v = np.array(x[2 * k :], float).reshape(k - 1, k - 1)
    u = (o - e)[: k - 1]
    chi2 = float(u @ np.linalg.solve(v, u))
    return small(df.sparkSession, [(float(o[0]), float(e[0]), chi2, k - 1, dist.chi2_sf(chi2, k - 1))], "observed double, expected double, chi2 double, df int, p_value double")


def cox(df: DataFrame, time: str, event: str, predictors: tuple[str, ...], *, steps: int = 30) -> Fit:
    """Cox regression, Breslow's way with ties. Each step sums the risk set's moments by distinct time, and runs them
    up from the last time; no rows are sorted, and what is ordered are distinct times. What has no maximum is an error."""
    k = len(predictors)
    rows = df.select(F.col(time).cast("double").alias("t"), F.col(event).cast("double").alias("d"), *[F.col(p).cast("double").alias(f"x{i}") for i, p in enumerate(predictors)]).na.drop()
    means = rows.agg(*[F.avg(f"x{i}") for i in range(k)]).first()
    rows = rows.select("t", "d", *[(F.col(f"x{i}") - F.lit(m)).alias(f"x{i}") for i, m in enumerate(means)]).persist()
    xs = [F.col(f"x{i}") for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def measure(b: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        eta: Column = sum((F.lit(float(v)) * x for v, x in zip(b, xs, strict=True)), F.lit(0.0))
        at = rows.withColumns({"eta": eta, "r": F.exp(eta)}).groupBy("t").agg(
            F.sum("d").alias("d"), F.sum(F.col("d") * F.col("eta")).alias("de"), F.sum("r").alias("s0"),
            *[F.sum(F.col("d") * x).alias(f"dx{i}") for i, x in enumerate(xs)], *[F.sum(F.col("r") * x).alias(f"s{i + 1}") for i, x in enumerate(xs)],
            *[F.sum(F.col("r") * xs[i] * xs[j]).alias(f"q{i}_{j}") for i, j in pairs],
        )
        moments = ["s0", *[f"s{i + 1}" for i in range(k)], *[f"q{i}_{j}" for i, j in pairs]]
        run = running(at, "t", moments, [f"u_{c}" for c in moments], descending=True)
        run = run.select("d", "de", *[f"dx{i}" for i in range(k)], *[F.col(f"u_{c}").alias(c) for c in moments]).where("d > 0")
        m = [F.col(f"s{i + 1}") / F.col("s0") for i in range(k)]
        x = run.agg(
            F.sum(F.col("de") - F.col("d") * F.log("s0")), *[F.sum(F.col(f"dx{i}") - F.col("d") * m[i]) for i in range(k)],
            *[F.sum(F.col("d") * (F.col(f"q{i}_{j}") / F.col("s0") - m[i] * m[j])) for i, j in pairs],
        ).first()
        h = np.zeros((k, k))
        h[np.triu_indices(k)] = x[1 + k :]
        return x[0], np.array(x[1 : 1 + k]), h + np.triu(h, 1).T

    try:
        beta = np.zeros(k)
        ll, score, info = measure(beta)
        null, first = ll, info
        for _ in range(steps):
            try:
                step, size = np.linalg.solve(info, score), 1.0
            except np.linalg.LinAlgError as e:
                raise NotConverged("the likelihood is flat: terms explain each other, or events are separated") from e
            for _ in range(30):
                moved = measure(beta + size * step)
                if moved[0] >= ll - 1e-12 * abs(ll):
                    break
                size /= 2
            beta, (ll, score, info) = beta + size * step, moved
            if np.max(np.abs(size * step) / (1 + np.abs(beta))) < 1e-7:
                break
        else:
            raise NotConverged(f"not converged in {steps} steps; events may be separated")
        scale = 1 / np.sqrt(np.maximum(np.diag(info), 1e-300))
        if np.linalg.eigvalsh(info * np.outer(scale, scale)).min() < 1e-9 or np.diag(info).min() < 1e-8 * np.diag(first).min():
            raise NotConverged("the likelihood is flat: terms explain each other, or events are separated")
        return Fit(list(predictors), beta, np.linalg.inv(info), None, {"loglik": ll, "loglik_null": null, "lr_chi2": 2 * (ll - null)})
    finally:
        rows.unpersist()


def exponential(df: DataFrame, time: str, event: str, by: list[str]) -> DataFrame:
    """Incidence rates by group: events over time at risk, with the log rate's standard error."""
    sums = df.na.drop(subset=[time, event, *by]).groupBy(*by).agg(F.sum(F.col(event).cast("double")).alias("events"), F.sum(F.col(time).cast("double")).alias("exposure"))
    return sums.select(*by, "events", "exposure", (F.col("events") / F.col("exposure")).alias("rate"), (1 / F.sqrt("events")).alias("log_std_error"))


def wald(spec: Spec, fit: Fit) -> float:
    """Chi-square that all coefficients are zero."""
    return float(fit.beta @ np.linalg.solve(fit.covariance, fit.beta)) if len(fit.beta) else math.nan
