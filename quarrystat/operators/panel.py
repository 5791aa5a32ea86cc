"""Panel estimators, difference in differences, and treatment effects."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrystat.operators import prepare
from quarrystat.operators.linear import Fit, areg, ols
from quarrystat.plans.spec import Spec
from quarrystat.sources.tables import small


def fixed_effects(df: DataFrame, spec: Spec, panel: str) -> Fit:
    return areg(df, spec, [panel])


def between(df: DataFrame, spec: Spec, panel: str) -> Fit:
    """Least squares on panel means."""
    names = [spec.outcome, *spec.predictors]
    means = df.select(panel, *names).na.drop().groupBy(panel).agg(*[F.avg(n).alias(n) for n in names])
    return ols(means, spec)


def first_difference(df: DataFrame, spec: Spec, panel: str, time: str) -> Fit:
    """Least squares on differences at exact periods, without an intercept."""
    rows = df
    for n in (spec.outcome, *spec.predictors):
        rows = prepare.difference(rows, n, time, 1, [panel], f"D_{n}")
    fit = ols(rows, Spec(f"D_{spec.outcome}", tuple(f"D_{p}" for p in spec.predictors), spec.covariance, spec.cluster, intercept=False))
    return Fit(list(spec.predictors), fit.beta, fit.covariance, fit.df, fit.metrics, fit.alpha)


def random_effects(df: DataFrame, spec: Spec, panel: str) -> Fit:
    """Swamy-Arora: within and between variances give each panel's share of its mean to take out."""
    names = [spec.outcome, *spec.predictors]
    rows = df.select(panel, *[F.col(n).cast("double").alias(n) for n in names]).na.drop()
    inside, outside = areg(rows, spec, [panel]).metrics, between(rows, spec, panel).metrics
    s2_e = inside["rss"] / inside["df_resid"]
    counts = rows.groupBy(panel).agg(F.count(F.lit(1)).alias("t")).agg(F.count(F.lit(1)) / F.sum(1 / F.col("t"))).first()[0]
    s2_u = max(outside["rss"] / outside["df_resid"] - s2_e / counts, 0.0)
    by = Window.partitionBy(panel)
    theta = 1 - F.sqrt(F.lit(s2_e) / (F.count(F.lit(1)).over(by) * F.lit(s2_u) + F.lit(s2_e)))
    flat = rows.withColumn("_theta", theta).select(panel, (1 - F.col("_theta")).alias("_one"), *[(F.col(n) - F.col("_theta") * F.avg(n).over(by)).alias(n) for n in names])
    fit = ols(flat, Spec(spec.outcome, (*spec.predictors, "_one"), spec.covariance, spec.cluster, intercept=False))
    return Fit([*spec.predictors, "_cons"], fit.beta, fit.covariance, None, fit.metrics | {"sigma_u": math.sqrt(s2_u), "sigma_e": math.sqrt(s2_e)}, fit.alpha)


def hausman(fixed: Fit, random: Fit) -> tuple[float, int]:
    """The Hausman statistic over the common coefficients, and its degrees of freedom."""
    at = [random.names.index(n) for n in fixed.names]
    d, v = fixed.beta - random.beta[at], fixed.covariance - random.covariance[np.ix_(at, at)]
    return float(d @ np.linalg.pinv(v) @ d), len(at)


def fama_macbeth(df: DataFrame, outcome: str, predictor: str, time: str) -> DataFrame:
    """The mean over periods of each period's regression on one predictor, with the means' standard errors."""
    slopes = df.na.drop(subset=[outcome, predictor, time]).groupBy(time).agg(F.regr_slope(outcome, predictor).alias("slope"), F.regr_intercept(outcome, predictor).alias("cons"))
    each = slopes.where("slope IS NOT NULL").select(F.explode(F.array(F.struct(F.lit(predictor).alias("term"), F.col("slope").alias("b")), F.struct(F.lit("_cons").alias("term"), F.col("cons").alias("b")))).alias("r")).select("r.*")
    return each.groupBy("term").agg(F.avg("b").alias("estimate"), (F.stddev("b") / F.sqrt(F.count("b"))).alias("std_error"), F.count("b").alias("periods"))


def did(df: DataFrame, outcome: str, treated: str, after: str) -> DataFrame:
    """The two-by-two difference in differences: the four cell means, the effect and its standard error."""
    cells = df.na.drop(subset=[outcome, treated, after]).groupBy(F.col(treated).cast("int").alias("g"), F.col(after).cast("int").alias("p")).agg(F.avg(outcome).alias("m"), F.count(F.lit(1)).alias("n"), (F.var_pop(outcome) * F.count(F.lit(1))).alias("ss"))
    sign = F.when(F.col("g") == F.col("p"), 1).otherwise(-1)
    x = cells.agg(F.sum(sign * F.col("m")).alias("att"), F.sum("n").alias("n"), F.sum("ss").alias("rss"), F.sum(1 / F.col("n")).alias("inv"))
    return x.select("att", F.sqrt(F.col("rss") / (F.col("n") - 4) * F.col("inv")).alias("std_error"), "n")


def event_study(df: DataFrame, outcome: str, cohort: str, time: str, never: str | None = None) -> DataFrame:
    """Cohort-by-period effects against units never treated (null cohort): the change of the cohort's mean since the
    period before its treatment, less that of the never treated, and the cohort's size."""
    rows = df.where(F.col(time).isNotNull() & F.col(outcome).isNotNull())
    means = rows.groupBy(F.col(cohort).alias("g"), F.col(time).alias("t")).agg(F.avg(outcome).alias("m"), F.count(F.lit(1)).alias("n"))
    control = means.where("g IS NULL").select("t", F.col("m").alias("c"))
    treated = means.where("g IS NOT NULL").join(control, "t")
    base = treated.where(F.col("t") == F.col("g") - 1).select("g", F.col("m").alias("m0"), F.col("c").alias("c0"))
    return treated.join(base, "g").select("g", "t", (F.col("t") - F.col("g")).alias("event_time"), ((F.col("m") - F.col("m0")) - (F.col("c") - F.col("c0"))).alias("att"), "n")


def ipw(df: DataFrame, outcome: str, treated: str, propensity: str) -> DataFrame:
    """Average treatment effect with normalised inverse propensity weights: both potential means and the effect."""
    d, p, y = F.col(treated).cast("double"), F.col(propensity), F.col(outcome)
    w1, w0 = d / p, (1 - d) / (1 - p)
    x = df.agg((F.sum(w1 * y) / F.sum(w1)).alias("mean1"), (F.sum(w0 * y) / F.sum(w0)).alias("mean0"))
    return x.withColumn("ate", F.col("mean1") - F.col("mean0"))


def regression_adjustment(df: DataFrame, outcome: str, treated: str, covariate: str) -> DataFrame:
    """Average treatment effect from a regression on one covariate in each arm, averaged over all rows."""
    rows = df.na.drop(subset=[outcome, treated, covariate])
    arm = lambda k: (F.regr_slope(F.when(F.col(treated) == k, F.col(outcome)), F.col(covariate)), F.regr_intercept(F.when(F.col(treated) == k, F.col(outcome)), F.col(covariate)))
    (s1, c1), (s0, c0) = arm(1), arm(0)
    m = F.avg(covariate)
    return rows.agg((s1 * m + c1).alias("mean1"), (s0 * m + c0).alias("mean0")).withColumn("ate", F.col("mean1") - F.col("mean0"))


def match_nearest(df: DataFrame, outcome: str, treated: str, score: str) -> DataFrame:
    """Effect on the treated by the nearest control in one score, ties averaged. Controls are collapsed to distinct
    scores; the nearest on either side comes from the order of the scores, not from pairs. Slices of the score's
    range are ordered by themselves, and edges of slices are passed on."""
    rows = df.na.drop(subset=[outcome, treated, score]).groupBy(F.col(score).cast("double").alias("s")).agg(
        F.avg(F.when(F.col(treated) == 0, F.col(outcome))).alias("c"), F.sum(F.when(F.col(treated) == 0, 1).otherwise(0)).alias("nc"),
        F.sum(F.when(F.col(treated) == 1, F.col(outcome)).otherwise(0.0)).alias("y1"), F.sum(F.when(F.col(treated) == 1, 1).otherwise(0)).alias("n1"),
    )
    low, high = rows.agg(F.min("s"), F.max("s")).first()
    width = (high - low) / 256 or 1.0
    rows = rows.withColumn("b", F.floor((F.col("s") - low) / width))
    control = F.when(F.col("nc") > 0, F.struct("s", "c", "nc"))
    edge = rows.groupBy("b").agg(F.max(control).alias("top"), F.min(control).alias("bottom"))
    slices = edge.select(
        F.col("b").alias("_b"),
        F.last("top", True).over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)).alias("left0"),
        F.first("bottom", True).over(Window.orderBy("b").rowsBetween(1, Window.unboundedFollowing)).alias("right0"),
    )
    by = Window.partitionBy("b").orderBy("s")
    near = rows.join(slices, F.col("b") == F.col("_b")).select(
        "s", "y1", "n1",
        F.coalesce(F.last(control, True).over(by.rowsBetween(Window.unboundedPreceding, 0)), "left0").alias("l"),
        F.coalesce(F.first(control, True).over(by.rowsBetween(0, Window.unboundedFollowing)), "right0").alias("r"),
    ).where("n1 > 0")
    dl, dr = F.coalesce(F.col("s") - F.col("l.s"), F.lit(float("inf"))), F.coalesce(F.col("r.s") - F.col("s"), F.lit(float("inf")))
    both = (F.col("l.c") * F.col("l.nc") + F.col("r.c") * F.col("r.nc")) / (F.col("l.nc") + F.col("r.nc"))
    mean = F.when(dl < dr, F.col("l.c")).when(dr < dl, F.col("r.c")).otherwise(F.when(F.col("l.s") == F.col("r.s"), F.col("l.c")).otherwise(both))
    return near.agg(((F.sum("y1") - F.sum(F.col("n1") * mean)) / F.sum("n1")).alias("att"), F.sum("n1").alias("treated"))


def meta(spark, effects: list[tuple[float, float]]) -> DataFrame:
    """Fixed and random effects (DerSimonian-Laird) from effects and standard errors: estimates, errors, Q, I2, tau2."""
    y, w = np.array([e for e, _ in effects]), np.array([1 / s**2 for _, s in effects])
    fixed = float(w @ y / w.sum())
    q = float(w @ (y - fixed) ** 2)
    tau2 = max(0.0, (q - (len(y) - 1)) / (w.sum() - (w @ w) / w.sum()))
    r = 1 / (1 / w + tau2)
    return small(spark, [(fixed, w.sum() ** -0.5, float(r @ y / r.sum()), r.sum() ** -0.5, q, max(0.0, (q - len(y) + 1) / q) if q else 0.0, tau2)], "fixed double, fixed_se double, random double, random_se double, q double, i2 double, tau2 double")
