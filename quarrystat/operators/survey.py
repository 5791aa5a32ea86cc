"""Survey statistics under designs of several stages, with replicate weights and calibration.

Every statistic is a sum of scores (its linearisation), so its variance comes from weighted scores summed by sampling unit:
units of the last stage first, then those of the stage above, with the moments of each stage's strata, in one plan. Replicates are combinations of the units' sums: tasks multiply them by the replicates' factors, which
come from a rule, and return one sum for each replicate.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrystat.functions import dist
from quarrystat.functions.jets import Jet
from quarrystat.operators import mle
from quarrystat.operators.linear import Fit
from quarrystat.sources.tables import release, written


@dataclass(frozen=True)
class Stage:
    """Sampling units within those of the stage before. ``population``: how many units the stratum (of this stage, within the
    unit before) has; without it units count as drawn with replacement, and later stages add nothing."""

    unit: str
    stratum: str | None = None
    population: str | None = None


@dataclass(frozen=True)
class Design:
    """``lonely``: what a stratum with one unit does: ``raise``, ``certainty`` (adds nothing), or ``grand`` (differs from the
    mean of all units)."""

    weight: str
    stages: tuple[Stage, ...]
    lonely: str = "raise"


def _keyed(df: DataFrame, design: Design, extra: list[Column]) -> DataFrame:
    keys = []
    for i, s in enumerate(design.stages):
        keys += [(F.col(s.stratum) if s.stratum else F.lit(0)).alias(f"h{i}"), F.col(s.unit).alias(f"u{i}"), (F.col(s.population).cast("double") if s.population else F.lit(None).cast("double")).alias(f"n{i}")]
    rows = df.select(F.col(design.weight).cast("double").alias("w"), *keys, *extra)
    for i in range(len(design.stages)):
        rows = rows.where(F.col(f"u{i}").isNotNull() & F.col(f"h{i}").isNotNull())
    return rows.where(F.col("w") > 0)


def _prefix(i: int, unit: bool) -> list[str]:
    return [c for j in range(i + 1) for c in ((f"h{j}", f"u{j}") if j < i or unit else (f"h{j}",))]


#: Rows of a unit of the last stage but one, on average, up to which each of these units is handled where its rows meet.
ROWS_OF_A_UNIT = 10_000


def variance(scores: DataFrame, design: Design, k: int) -> tuple[np.ndarray, float]:
    """The variance matrix of the sums of z0..z(k-1), weighted scores beside the design's keys; and the degrees of freedom:
    units of the first stage less its strata.

    A stratum's part is the spread of its units' sums, and its sampled fraction times the parts of the strata within them. So
    units and strata are summed stage by stage from the last one up, and no unit meets its stratum's mean again."""
    pairs, stages = [(i, j) for i in range(k) for j in range(i, k)], len(design.stages)
    z, parts = [f"z{i}" for i in range(k)], [f"v{i}_{j}" for i, j in pairs]
    below, carried = scores, []
    if stages > 1:
        # lines of one unit of the stage above meet once, for three groupings; few large units would make few large tasks
        above = _prefix(stages - 2, True)
        rows, units = scores.select(*above).agg(F.count(F.lit(1)), F.approx_count_distinct(F.xxhash64(*above))).first()
        if rows <= ROWS_OF_A_UNIT * units:
            below = scores.repartition(*above)
    strata = None
    for s in reversed(range(stages)):
        populations = [F.max(f"n{j}").alias(f"n{j}") for j in range(s + 1)]
        units = below.groupBy(*_prefix(s, True)).agg(*populations, *[F.sum(c).alias(c) for c in [*z, *carried]])
        # moments about the stratum's mean, so large totals cost no digits
        moments = [(F.covar_pop(f"z{i}", f"z{j}") * F.count(F.lit(1))).alias(f"m{i}_{j}") for i, j in pairs]
        found = units.groupBy(*_prefix(s, False)).agg(F.count(F.lit(1)).alias("m"), *populations, *moments, *[F.sum(c).alias(c) for c in [*z, *carried]])
        f = F.when(F.col(f"n{s}").isNull(), 0.0).otherwise(F.least(F.col("m") / F.col(f"n{s}"), F.lit(1.0)))
        spread = F.when(F.col("m") > 1, F.col("m") / (F.col("m") - 1)).otherwise(0.0) * (1 - f)
        own = [(spread * F.col(f"m{i}_{j}") + (f * F.col(f"v{i}_{j}") if carried else F.lit(0.0))).alias(f"v{i}_{j}") for i, j in pairs]
        lonely = ((F.col("m") == 1) & (F.col(f"n{s}").isNull() | (F.col(f"n{s}") > 1))).cast("long").alias(f"lonely{s}")
        strata = found.select(*_prefix(s, False), "m", f.alias("f"), *[f"n{j}" for j in range(s)], *z, *own, *[c for c in carried if c not in parts], lonely)
        carried = [*parts, *[f"lonely{j}" for j in reversed(range(s, stages))]]
        below = strata
    strata = written(strata)
    number, units, *sums = strata.agg(F.count(F.lit(1)), F.sum("m"), *[F.sum(c) for c in [*z, *parts]], *[F.sum(f"lonely{s}") for s in range(stages)]).first()
    if not number:
        raise ValueError("no rows")
    if design.lonely == "raise":
        for s, bad in enumerate(sums[k + len(parts) :]):
            if bad:
                raise ValueError(f"a stratum of stage {s + 1} has one unit")
    own = list(sums[k : k + len(parts)])
    if design.lonely == "grand":
        d = [F.col(c) - F.lit(float(t) / units) for c, t in zip(z, sums, strict=False)]
        more = strata.where("m = 1").agg(*[F.coalesce(F.sum((1 - F.col("f")) * d[i] * d[j]), F.lit(0.0)) for i, j in pairs]).first()
        own = [a + b for a, b in zip(own, more, strict=True)]
    total = np.zeros((k, k))
    for (i, j), v in zip(pairs, own, strict=True):
        total[i, j] = total[j, i] = v
    release(strata)
    return total, float(units - number)


def _fit(names: list[str], value: np.ndarray, v: np.ndarray, free: float, metrics: dict) -> Fit:
    return Fit(names, np.asarray(value, float), v, free if free > 0 else None, metrics)


def _complete(columns: list[str]) -> Column:
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return ok


def totals(df: DataFrame, values: list[str], design: Design) -> Fit:
    """Totals of columns. Rows with a null in a value, a unit or a stratum, or without weight, are left out."""
    rows = written(_keyed(df.where(_complete(values)), design, [F.col(v).cast("double").alias(f"y{i}") for i, v in enumerate(values)]))
    sums = rows.agg(F.count(F.lit(1)), *[F.sum(F.col("w") * F.col(f"y{i}")) for i in range(len(values))]).first()
    v, free = variance(rows.withColumns({f"z{i}": F.col("w") * F.col(f"y{i}") for i in range(len(values))}), design, len(values))
    return _fit(list(values), np.array(sums[1:]), v, free, {"n": float(sums[0])})


def ratios(df: DataFrame, pairs: list[tuple[str, str]], design: Design) -> Fit:
    """Ratios of totals, named numerator/denominator."""
    columns = list(dict.fromkeys(c for p in pairs for c in p))
    rows = written(_keyed(df.where(_complete(columns)), design, [F.col(v).cast("double").alias(f"y{i}") for i, v in enumerate(columns)]))
    n, *sums = rows.agg(F.count(F.lit(1)), *[F.sum(F.col("w") * F.col(f"y{i}")) for i in range(len(columns))]).first()
    at = {c: i for i, c in enumerate(columns)}
    value = [sums[at[a]] / sums[at[b]] for a, b in pairs]
    z = {f"z{i}": F.col("w") * (F.col(f"y{at[a]}") - F.lit(float(r)) * F.col(f"y{at[b]}")) / F.lit(float(sums[at[b]])) for i, ((a, b), r) in enumerate(zip(pairs, value, strict=True))}
    v, free = variance(rows.withColumns(z), design, len(pairs))
    return _fit([f"{a}/{b}" for a, b in pairs], np.array(value), v, free, {"n": float(n)})


def means(df: DataFrame, values: list[str], design: Design) -> Fit:
    """Means of columns over the rows that have all of them."""
    fit = ratios(df.withColumn("_one", F.lit(1.0)), [(v, "_one") for v in values], design)
    return Fit(list(values), fit.beta, fit.covariance, fit.df, fit.metrics)


def proportions(df: DataFrame, value: str, design: Design) -> Fit:
    """The shares of a column's levels (100 at most)."""
    levels = [r[0] for r in df.select(value).where(F.col(value).isNotNull()).distinct().orderBy(value).limit(101).collect()]
    if len(levels) > 100:
        raise ValueError("a share has 100 levels at most")
    rows = df.where(F.col(value).isNotNull()).withColumns({f"_level{i}": (F.col(value) == F.lit(v)).cast("double") for i, v in enumerate(levels)})
    fit = means(rows, [f"_level{i}" for i in range(len(levels))], design)
    return Fit([str(v) for v in levels], fit.beta, fit.covariance, fit.df, fit.metrics)


# ---- regressions

#: Log likelihoods of a row in its index.
FAMILIES: dict[str, Callable[[np.ndarray, Jet], Jet]] = {
    "linear": lambda y, e: (y - e) * (y - e) * -0.5,
    "logit": lambda y, e: e * y - mle.J.softplus(e),
    "probit": lambda y, e: mle.J.log_ndtr(e * mle._binary(y)),
    "poisson": lambda y, e: e * y - mle.J.exp(e),
}


def _scores(rows: DataFrame, keep: list[str], family: str, beta: np.ndarray, bread: np.ndarray) -> DataFrame:
    """The columns of ``keep`` with z0...: the influence of each row's weighted score on the coefficients."""
    loglik, k = FAMILIES[family], len(beta)

    def slope(y: pa.Array, index: pa.Array) -> pa.Array:
        return pa.array(loglik(y.to_numpy(zero_copy_only=False), Jet.variables([index.to_numpy(zero_copy_only=False)])[0]).g[0])

    x = [*[F.col(f"x{i}") for i in range(k - 1)], F.lit(1.0)]
    combined = lambda w: sum((F.lit(float(v)) * c for v, c in zip(w[1:], x[1:], strict=True)), F.lit(float(w[0])) * x[0])
    # only the outcome and the index go to the function, and plans that ask for keys alone don't call it
    scored = rows.select(*keep, *[c for c in ("w", *[f"x{i}" for i in range(k - 1)]) if c not in keep], (F.col("w") * F.arrow_udf(slope, "double")("y", combined(beta))).alias("_s"))
    return scored.select(*keep, *[(F.col("_s") * combined(bread[:, i])).alias(f"z{i}") for i in range(k)])


def regression(df: DataFrame, outcome: str, terms: tuple[str, ...], design: Design, family: str = "linear") -> Fit:
    """Weighted pseudo-likelihood (linear, logit, probit or poisson) with the design's variance of its scores. The constant
    comes last."""
    rows = written(_keyed(df.where(_complete([outcome, *terms])), design, [F.col(outcome).cast("double").alias("y"), *[F.col(t).cast("double").alias(f"x{i}") for i, t in enumerate(terms)]]))
    names, loglik = tuple(f"x{i}" for i in range(len(terms))), FAMILIES[family]
    fit = mle.maximise(rows, mle.Problem(lambda y, e: loglik(y["y"], e[0]), ("y",), (mle.Equation("y", names),)), weight="w")
    keys = [c for i in range(len(design.stages)) for c in (f"h{i}", f"u{i}", f"n{i}")]
    v, free = variance(_scores(rows, keys, family, fit.beta, fit.covariance), design, len(terms) + 1)
    return _fit([*terms, "_cons"], fit.beta, v, free, {"n": fit.metrics["n"]})


def lincom(fit: Fit, weights: dict[str, float]) -> tuple[float, float, float]:
    """Estimate, standard error and p-value of a combination, with the design's degrees of freedom."""
    return fit.lincom(weights)


# ---- replicate weights

def _first_stage(df: DataFrame, design: Design, values: dict[str, Column]) -> DataFrame:
    """Weighted sums of ``values`` by unit of the first stage: stratum, unit, number of units in the stratum, s (array)."""
    rows = _keyed(df, Design(design.weight, design.stages[:1], design.lonely), [c.cast("double").alias(f"v{i}") for i, c in enumerate(values.values())])
    ok = F.lit(True)
    for i in range(len(values)):
        ok = ok & F.col(f"v{i}").isNotNull() & ~F.isnan(f"v{i}")
    units = rows.where(ok).groupBy("h0", "u0").agg(F.array(*[F.sum(F.col("w") * F.col(f"v{i}")) for i in range(len(values))]).alias("s"))
    counts = units.groupBy(F.col("h0").alias("_h")).agg(F.count(F.lit(1)).alias("m"))
    return written(units.join(counts, F.col("h0") == F.col("_h")).drop("_h"))


def _summed(units: DataFrame, body: Callable[[pa.RecordBatch, np.ndarray], np.ndarray]) -> np.ndarray:
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                part = body(b, b["s"].flatten().to_numpy().reshape(b.num_rows, -1)).ravel()
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["i", "x"])

    got = units.mapInArrow(sums, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).toArrow()
    out = np.zeros(got.num_rows)
    out[got["i"].to_numpy()] = got["x"].to_numpy()
    return out


#: What a statistic needs of the rows, and how it comes from the sums.
@dataclass(frozen=True)
class Statistic:
    names: list[str]
    values: dict[str, Column]
    #: (replicates, sums) to (replicates, estimates).
    estimate: Callable[[np.ndarray], np.ndarray]


def mean_statistic(values: list[str]) -> Statistic:
    return Statistic(values, {"one": F.lit(1.0)} | {v: F.col(v) for v in values}, lambda s: s[:, 1:] / s[:, :1])


def total_statistic(values: list[str]) -> Statistic:
    return Statistic(values, {v: F.col(v) for v in values}, lambda s: s)


def ratio_statistic(numerator: str, denominator: str) -> Statistic:
    return Statistic([f"{numerator}/{denominator}"], {"a": F.col(numerator), "b": F.col(denominator)}, lambda s: s[:, :1] / s[:, 1:])


def regression_statistic(outcome: str, terms: tuple[str, ...]) -> Statistic:
    """Weighted least squares, from cross-products."""
    k = len(terms) + 1
    x = [*[F.col(t).cast("double") for t in terms], F.lit(1.0)]
    values = {f"{i}_{j}": x[i] * x[j] for i in range(k) for j in range(k)} | {f"y{i}": c * F.col(outcome).cast("double") for i, c in enumerate(x)}
    return Statistic([*terms, "_cons"], values, lambda s: (np.linalg.pinv(s[:, : k * k].reshape(-1, k, k), hermitian=True) @ s[:, k * k :, None])[..., 0])


def replicate_weights(df: DataFrame, design: Design, *, fay: float = 0.0) -> tuple[DataFrame, int]:
    """``df`` with ``replicates``, an array of the rows' weights in each balanced half sample, and their number: the factors
    of ``balanced``."""
    units, number, _ = _halves(df, design, {"one": F.lit(1.0)})
    signs = F.transform(F.sequence(F.lit(1), F.lit(number)), lambda r: F.when(F.bit_count(r.bitwiseAND(F.col("_place"))) % 2 == 0, 1.0).otherwise(-1.0))
    keys = units.select(F.col("h0").alias("_h"), F.col("u0").alias("_u"), F.col("place").alias("_place"), F.col("side").alias("_side"))
    stage = design.stages[0]
    joined = df.join(keys, (F.col(stage.stratum) == F.col("_h")) & (F.col(stage.unit) == F.col("_u")))
    weights = F.transform(signs, lambda s: F.col(design.weight) * (1 + s * F.col("_side") * (1 - fay)))
    return joined.withColumn("replicates", weights).drop("_h", "_u", "_place", "_side"), number


def _halves(df: DataFrame, design: Design, values: dict[str, Column]) -> tuple[DataFrame, int, int]:
    """Units with the place of their stratum (from 1) and side (1 or -1); replicates; strata."""
    units = _first_stage(df, design, values)
    if not units.where("m <> 2").isEmpty():
        raise ValueError("balanced halves need two units in each stratum")
    strata = units.select("h0").distinct().orderBy("h0").limit(100_001).collect()
    if len(strata) > 100_000:
        raise ValueError("more than 100,000 strata")
    if not strata:
        raise ValueError("no rows")
    spark = df.sparkSession
    kind = units.schema["h0"].dataType
    places = spark.createDataFrame([(r[0], i + 1) for i, r in enumerate(strata)], T.StructType([T.StructField("_h", kind), T.StructField("place", T.LongType())]))
    low = units.groupBy(F.col("h0").alias("_l")).agg(F.min("u0").alias("low"))
    placed = units.join(places, F.col("h0") == F.col("_h")).join(low, F.col("h0") == F.col("_l")).withColumn("side", F.when(F.col("u0") == F.col("low"), 1).otherwise(-1))
    return written(placed.select("h0", "u0", "s", "place", "side")), 1 << len(strata).bit_length(), len(strata)


def balanced(df: DataFrame, statistic: Statistic, design: Design, *, fay: float = 0.0) -> Fit:
    """Balanced repeated replication over strata of two units, with ``fay`` (0 to below 1) Fay's method: in replicate r the
    first unit of stratum h counts 1 + H[r, h] (1 - fay) times, the other the rest of two times. H is Sylvester's Hadamard
    matrix, whose sign is the parity of the common bits of r and h. The variance is about the full sample's estimate."""
    units, number, strata = _halves(df, design, statistic.values)

    def body(b: pa.RecordBatch, s: np.ndarray) -> np.ndarray:
        place, side = b["place"].to_numpy(), b["side"].to_numpy()
        sign = 1.0 - 2.0 * (np.bitwise_count(np.arange(number)[:, None] & place[None, :]) % 2)
        return np.concatenate([s.sum(axis=0)[None], (1 + sign * side * (1 - fay)) @ s])

    got = _summed(units, body).reshape(number + 1, -1)
    value = statistic.estimate(got)
    d = value[1:] - value[0]
    return _fit(statistic.names, value[0], d.T @ d / (number * (1 - fay) ** 2), float(strata), {"replicates": float(number)})


def jackknifed(df: DataFrame, statistic: Statistic, design: Design) -> Fit:
    """Leaving one unit of the first stage out at a time, the others of its stratum counting m / (m - 1) times; strata of one
    unit add nothing. Units are handled where they lie, from their stratum's sum and the whole."""
    units = _first_stage(df, design, statistic.values)
    k = len(statistic.values)
    strata = units.groupBy(F.col("h0").alias("_h")).agg(F.array(*[F.sum(F.col("s")[i]) for i in range(k)]).alias("t"))
    n, h, *whole = units.agg(F.count(F.lit(1)), F.count_distinct("h0"), *[F.sum(F.col("s")[i]) for i in range(k)]).first()
    if not n:
        raise ValueError("no rows")
    total = np.array(whole)
    value, estimate = statistic.estimate(total[None])[0], statistic.estimate

    def body(b: pa.RecordBatch, s: np.ndarray) -> np.ndarray:
        t, m = b["t"].flatten().to_numpy().reshape(b.num_rows, -1), b["m"].to_numpy()[:, None]
        several = m[:, 0] > 1
        left = (total + (t - s) / np.maximum(m - 1, 1) - s)[several]
        d = (estimate(left) - value) * np.sqrt((m[several] - 1) / m[several])
        return d.T @ d

    v = _summed(units.join(strata, F.col("h0") == F.col("_h")), body).reshape(len(value), -1)
    return _fit(statistic.names, value, v, float(n - h), {"replicates": float(n)})


def bootstrapped(df: DataFrame, statistic: Statistic, design: Design, *, draws: int = 200, seed: int = 0) -> Fit:
    """Resampled units of the first stage after Rao and Wu, with Poisson counts of mean 1 from the units' hashes in place of
    multinomial ones: a unit counts 1 + sqrt(m / (m - 1)) (c - mean c of its stratum) times."""
    units = _first_stage(df, design, statistic.values).withColumn("h", F.xxhash64(F.lit(seed), "h0", "u0"))
    from quarrystat.operators.moments import _poisson_ones

    k = len(statistic.values)

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = _poisson_ones(b["h"].to_numpy().view(np.uint64), draws)
            yield pa.RecordBatch.from_arrays([b["h0"], b["m"], b["s"], pa.array(list(c), pa.list_(pa.float64()))], ["h0", "m", "s", "c"])

    schema = T.StructType([units.schema["h0"], units.schema["m"], units.schema["s"], T.StructField("c", T.ArrayType(T.DoubleType()))])
    counted = written(units.select("h0", "m", "s", "h").mapInArrow(drawn, schema))
    means_ = counted.select(F.col("h0").alias("_h"), F.posexplode("c")).groupBy("_h", "pos").agg(F.avg("col").alias("a")).groupBy("_h").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "a"))), lambda x: x.a).alias("a"))

    def body(b: pa.RecordBatch, s: np.ndarray) -> np.ndarray:
        c, a, m = (b[n].flatten().to_numpy().reshape(b.num_rows, -1) if n != "m" else b[n].to_numpy()[:, None] for n in ("c", "a", "m"))
        factor = 1 + np.sqrt(np.where(m > 1, m / np.maximum(m - 1, 1), 0.0)) * (c - a)
        return np.concatenate([s.sum(axis=0)[None], factor.T @ s])

    got = _summed(counted.join(means_, F.col("h0") == F.col("_h")), body).reshape(draws + 1, k)
    value = statistic.estimate(got)
    n, h = units.agg(F.count(F.lit(1)), F.count_distinct("h0")).first()
    return _fit(statistic.names, value[0], np.atleast_2d(np.cov(value[1:].T)), float(n - h), {"replicates": float(draws)})


# ---- calibration

def calibrate(df: DataFrame, weight: str, totals_: dict[str, float], *, method: str = "linear", steps: int = 50, tolerance: float = 1e-10) -> DataFrame:
    """``df`` with ``calibrated``: weights whose totals of the auxiliary columns are those stated, near the old weights in the
    linear (chi-square) or ``raking`` (entropy) distance. A pass a step, of the auxiliary columns' cross-products. Totals that
    no weights of this form reach are an error. Rows with a null among the auxiliaries keep a null."""
    names = list(totals_)
    goal = np.array([totals_[n] for n in names], float)
    rows = df.where(_complete([weight, *names])).select(F.col(weight).cast("double").alias("w"), F.array(*[F.col(n).cast("double") for n in names]).alias("s"))
    k, at = len(names), np.zeros(len(names))

    def measured(lam: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def body(b: pa.RecordBatch, x: np.ndarray) -> np.ndarray:
            u, w = x @ lam, b["w"].to_numpy()
            g, slope = (1 + u, np.ones(len(u))) if method == "linear" else (np.exp(np.minimum(u, 500)),) * 2
            return np.concatenate([(w * g) @ x, (x.T @ (x * (w * slope)[:, None])).ravel()])

        got = _summed(rows, body)
        return got[:k], got[k:].reshape(k, k)

    if method not in ("linear", "raking"):
        raise ValueError("linear or raking")
    for _ in range(steps):
        have, slope = measured(at)
        gap = goal - have
        if np.abs(gap).max() <= tolerance * max(1.0, np.abs(goal).max()):
            break
        if not np.isfinite(slope).all() or np.linalg.matrix_rank(slope) < k:
            raise mle.NotConverged("the auxiliary columns explain each other, or no weights reach the totals")
        at = at + np.linalg.solve(slope, gap)
    else:
        raise mle.NotConverged("no weights reach the totals")
    index = sum((F.lit(float(v)) * F.col(n).cast("double") for v, n in zip(at, names, strict=True)), F.lit(0.0))
    return df.withColumn("calibrated", F.col(weight) * (1 + index if method == "linear" else F.exp(index)))


def calibrated_total(df: DataFrame, value: str, auxiliaries: dict[str, float], design: Design, *, method: str = "linear") -> Fit:
    """A total with calibrated weights, and the design's variance of its regression residuals on the auxiliary columns."""
    # the steps, the sums and the scores all read the rows, which may come from joins: written once, with what they need
    keys = [c for st in design.stages for c in (st.unit, st.stratum, st.population) if c]
    held = written(df.select(*[F.col(c) for c in dict.fromkeys([design.weight, value, *auxiliaries, *keys])]))
    rows = calibrate(held, design.weight, auxiliaries, method=method).where(_complete([value, *auxiliaries]))
    names, k = list(auxiliaries), len(auxiliaries)
    x = [F.col(n).cast("double") for n in names]
    found = rows.agg(F.sum(F.col("calibrated") * F.col(value)), *[F.sum(F.col(design.weight) * a * b) for a in x for b in x], *[F.sum(F.col(design.weight) * a * F.col(value)) for a in x]).first()
    slopes = np.linalg.solve(np.array(found[1 : 1 + k * k]).reshape(k, k), np.array(found[1 + k * k :]))
    residual = F.col(value) - sum((F.lit(float(b)) * c for b, c in zip(slopes, x, strict=True)), F.lit(0.0))
    scored = _keyed(rows, design, [(F.col("calibrated") * residual).alias("z0")])
    v, free = variance(scored, design, 1)
    release(held)
    return _fit([value], np.array([found[0]]), v, free, {})
