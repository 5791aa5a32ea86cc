"""Time series: one row for each integer period; lags are joins on exact periods, so gaps are missing lags."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrystat.operators import prepare, recurrence
from quarrystat.operators.linear import Fit, gram, ols
from quarrystat.plans.spec import Spec
from quarrystat.sources.tables import small


def lagged(df: DataFrame, value: str, time: str, lags: int, panel: list[str] | None = None) -> DataFrame:
    """L1 to L<lags> of a value."""
    by = Window.partitionBy(*(panel or [])).orderBy(time)
    return df.withColumns({f"L{k}_{value}": F.max(value).over(by.rangeBetween(-k, -k)) for k in range(1, lags + 1)})


def corrgram(df: DataFrame, value: str, time: str, lags: int) -> DataFrame:
    """lag, ac (autocorrelation), q (Ljung-Box), from products with the same series at exact distances."""
    rows = df.select(F.col(time).cast("long").alias("t"), F.col(value).cast("double").alias("v")).na.drop()
    n, mean = rows.agg(F.count(F.lit(1)), F.avg("v")).first()
    rows = rows.withColumn("d", F.col("v") - F.lit(mean))
    c0 = rows.agg(F.sum(F.col("d") * F.col("d"))).first()[0]
    later = rows.select(F.col("d").alias("e"), F.explode(F.sequence(F.lit(1), F.lit(lags))).alias("lag"), "t").select("e", "lag", (F.col("t") + F.col("lag")).alias("t"))
    ac = rows.join(later, "t").groupBy("lag").agg((F.sum(F.col("d") * F.col("e")) / F.lit(c0)).alias("ac"))
    upto = Window.orderBy("lag").rowsBetween(Window.unboundedPreceding, 0)
    return ac.select("lag", "ac", (F.lit(n * (n + 2.0)) * F.sum(F.col("ac") ** 2 / (F.lit(n) - F.col("lag"))).over(upto)).alias("q"))


def dickey_fuller(df: DataFrame, value: str, time: str, lags: int = 0, trend: bool = False) -> Fit:
    """The augmented Dickey-Fuller regression of the difference on the level's lag; its statistic is that of ``level``."""
    rows = df.select(F.col(time).cast("long").alias("t"), F.col(value).cast("double").alias("v"))
    rows = prepare.lag(rows, "v", "t", 1, name="level")
    rows = rows.withColumn("dv", F.col("v") - F.col("level"))
    for k in range(1, lags + 1):
        rows = prepare.lag(rows, "dv", "t", k, name=f"LD{k}")
    return ols(rows, Spec("dv", ("level", *[f"LD{k}" for k in range(1, lags + 1)], *(("t",) if trend else ()))))


def kpss(df: DataFrame, value: str, time: str, lags: int) -> DataFrame:
    """The KPSS statistic of level stationarity with Bartlett weights."""
    rows = df.select(F.col(time).cast("long").alias("t"), F.col(value).cast("double").alias("v")).na.drop()
    n, mean = rows.agg(F.count(F.lit(1)), F.avg("v")).first()
    rows = rows.withColumn("e", F.col("v") - F.lit(mean))
    rows = rows.withColumn("s", F.sum("e").over(Window.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)))
    top, g0 = rows.agg(F.sum(F.col("s") ** 2), F.sum(F.col("e") ** 2)).first()
    later = rows.select(F.col("e").alias("f"), F.explode(F.sequence(F.lit(1), F.lit(max(lags, 1)))).alias("k"), "t").select("f", "k", (F.col("t") + F.col("k")).alias("t"))
    g = rows.join(later, "t").where(F.col("k") <= lags).agg(F.sum((1 - F.col("k") / (lags + 1.0)) * F.col("e") * F.col("f"))).first()[0] or 0.0
    return small(df.sparkSession, [(top / (n * (g0 + 2 * g)), n)], "kpss double, n long")


def var(df: DataFrame, values: list[str], time: str, lags: int) -> tuple[list[str], np.ndarray, np.ndarray, int]:
    """A vector autoregression from one set of cross-products: names of the regressors, coefficients (regressor by
    equation), residual covariance (divided by the rows), rows."""
    rows = df.select(F.col(time).cast("long").alias("t"), *[F.col(v).cast("double").alias(v) for v in values])
    for v in values:
        rows = lagged(rows, v, "t", lags)
    names = [f"L{k}_{v}" for k in range(1, lags + 1) for v in values]
    rows = rows.na.drop()
    n, means, products = gram(rows, [F.col(c) for c in [*values, *names]])
    k = len(values)
    slopes = np.linalg.solve(products[k:, k:], products[k:, :k])
    cons = means[:k] - means[k:] @ slopes
    residual = (products[:k, :k] - products[:k, k:] @ slopes) / n
    return [*names, "_cons"], np.vstack([slopes, cons]), residual, n


def irf(coefficients: np.ndarray, residual: np.ndarray, lags: int, steps: int, orthogonal: bool = True) -> np.ndarray:
    """Impulse responses (step by responding by shocked variable)."""
    k = residual.shape[0]
    a = [coefficients[i * k : (i + 1) * k].T for i in range(lags)]
    psi = [np.eye(k)]
    for s in range(1, steps + 1):
        psi.append(sum((a[j] @ psi[s - 1 - j] for j in range(min(lags, s))), np.zeros((k, k))))
    out = np.stack(psi)
    return out @ np.linalg.cholesky(residual) if orthogonal else out


def granger(df: DataFrame, effect: str, cause: str, time: str, lags: int) -> DataFrame:
    """F test that the lags of one series don't help to predict another beyond its own lags."""
    rows = lagged(lagged(df.select(time, F.col(effect).cast("double").alias(effect), F.col(cause).cast("double").alias(cause)), effect, time, lags), cause, time, lags).na.drop()
    own, other = tuple(f"L{k}_{effect}" for k in range(1, lags + 1)), tuple(f"L{k}_{cause}" for k in range(1, lags + 1))
    full, short = ols(rows, Spec(effect, (*own, *other))).metrics, ols(rows, Spec(effect, own)).metrics
    f = (short["rss"] - full["rss"]) / lags / (full["rss"] / full["df_resid"])
    return small(df.sparkSession, [(f, lags, int(full["df_resid"]))], "f double, df1 int, df2 int")


def smooth(df: DataFrame, value: str, time: str, alpha: float, panel: list[str]) -> DataFrame:
    """panel, time and smooth: simple exponential smoothing of each panel from its first value, the forecast for a row from all
    earlier ones; rows in order, whatever their distance. See ``recurrence``."""
    rows = recurrence.smooth(df, value, time, alpha, tuple(panel))
    return rows.select(*panel, F.col("t").alias(time), F.col("forecast").alias("smooth"))


def white_noise(df: DataFrame, value: str, time: str, lags: int) -> DataFrame:
    """The portmanteau test: Ljung-Box q at the last lag."""
    return corrgram(df, value, time, lags).where(F.col("lag") == lags).select("q")


def half_life(fit: Fit) -> float:
    """Periods until half of a deviation is gone, from a Dickey-Fuller regression."""
    b = 1 + float(fit.beta[fit.names.index("level")])
    return math.log(0.5) / math.log(b) if 0 < b < 1 else math.inf
