"""Missing values of normal columns: expectation-maximisation by pattern, a test that they miss at random, and imputation.

All that a step needs of the rows are the counts, sums and cross-products of the observed columns by pattern of missingness. One
pass gathers them, and the steps run on them: their cost doesn't depend on the rows. Imputations take parameters from
bootstrap samples of the rows (all in one pass, weights from the rows' hashes), and draws from streams of the same hashes, so
reruns agree however rows lie.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrystat.functions import dist
from quarrystat.operators.linear import Fit
from quarrystat.operators.mle import NotConverged
from quarrystat.operators.moments import _poisson_ones
from quarrystat.sources.tables import small

#: Patterns that the driver goes through.
PATTERNS = 4096


@dataclass(frozen=True)
class Normal:
    columns: list[str]
    mean: np.ndarray
    covariance: np.ndarray
    loglik: float
    n: float

    def frame(self, spark) -> DataFrame:
        """a, b, value: means (b is null) and covariances."""
        rows = [(c, None, float(m)) for c, m in zip(self.columns, self.mean, strict=True)]
        rows += [(a, b, float(self.covariance[i, j])) for i, a in enumerate(self.columns) for j, b in enumerate(self.columns) if i <= j]
        return small(spark, rows, "a string, b string, value double")


def _read(df: DataFrame, columns: list[str], centre: np.ndarray, keys: list[str] | None = None, seed: int = 0) -> DataFrame:
    """v: the columns less their centre (NaN where missing), mask: which are seen, h: a hash. Rows with none are left out."""
    if not 1 <= len(columns) <= 40:
        raise ValueError("one to forty columns")
    x = [F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) - F.lit(float(m)) for c, m in zip(columns, centre, strict=True)]
    rows = df.select(F.array(*x).alias("v"), F.xxhash64(F.lit(seed), *(keys or columns)).alias("h"))
    mask = F.aggregate(F.transform("v", lambda c, i: F.when(F.isnan(c), F.lit(0).cast("long")).otherwise(F.pow(F.lit(2.0), i).cast("long"))), F.lit(0).cast("long"), lambda a, b: a + b)
    return rows.withColumn("mask", mask).where("mask > 0")


def _sums(rows: DataFrame, p: int, draws: int = 0) -> dict[int, np.ndarray]:
    """By pattern, and for each bootstrap sample after the whole: count, sums, cross-products, with zeros for what is missing."""
    width = 1 + p + p * p

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            x = np.nan_to_num(b["v"].flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, p))
            parts = np.column_stack([np.ones(len(x)), x, (x[:, :, None] * x[:, None, :]).reshape(len(x), -1)])
            w = np.column_stack([np.ones(len(x)), *([_poisson_ones(b["h"].to_numpy().view(np.uint64), draws)] if draws else [])])
            mask = b["mask"].to_numpy()
            for m in np.unique(mask).tolist():
                own = mask == m
                held[m] = held.get(m, 0.0) + w[own].T @ parts[own]
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([v.ravel() for v in held.values()], pa.list_(pa.float64()))], ["mask", "s"])

    parts = rows.mapInArrow(reduce, "mask long, s array<double>").select("mask", F.posexplode("s").alias("i", "x")).groupBy("mask", "i").agg(F.sum("x").alias("x"))
    if parts.select("mask").distinct().limit(PATTERNS + 1).count() > PATTERNS:
        raise ValueError(f"more than {PATTERNS} patterns of missingness")
    got = parts.toArrow()
    out: dict[int, np.ndarray] = {}
    for m, i, x in zip(got["mask"].to_pylist(), got["i"].to_numpy(), got["x"].to_numpy(), strict=True):
        out.setdefault(m, np.zeros((draws + 1) * width))[i] = x
    return {m: v.reshape(draws + 1, width) for m, v in out.items()}


def _seen(mask: int, p: int) -> np.ndarray:
    return np.array([bool(mask >> i & 1) for i in range(p)])


def _step(sums: dict[int, np.ndarray], mean: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """The parameters after a step, the log likelihood before it, and the rows. ``sums``: of one sample."""
    p = len(mean)
    first, second, n, ll = np.zeros(p), np.zeros((p, p)), 0.0, 0.0
    for mask, s in sums.items():
        count, total, cross = s[0], s[1 : 1 + p], s[1 + p :].reshape(p, p)
        if not count:
            continue
        o = _seen(mask, p)
        m = ~o
        d = total[o] - count * mean[o]
        scatter = cross[np.ix_(o, o)] - np.outer(total[o], mean[o]) - np.outer(mean[o], total[o]) + count * np.outer(mean[o], mean[o])
        inverse = np.linalg.inv(cov[np.ix_(o, o)])
        ll -= 0.5 * (count * (o.sum() * math.log(2 * math.pi) + np.linalg.slogdet(cov[np.ix_(o, o)])[1]) + np.sum(inverse * scatter))
        slope = np.zeros((p, o.sum()))
        slope[o] = np.eye(o.sum())
        slope[m] = cov[np.ix_(m, o)] @ inverse
        first += slope @ d
        second += slope @ scatter @ slope.T
        second[np.ix_(m, m)] += count * (cov[np.ix_(m, m)] - slope[m] @ cov[np.ix_(o, m)])
        n += count
    shift = first / n
    return mean + shift, second / n - np.outer(shift, shift), ll, n


def _maximum(sums: dict[int, np.ndarray], p: int, steps: int, tolerance: float) -> tuple[np.ndarray, np.ndarray, float, float]:
    whole = sum(sums.values())
    counts = np.array([sum(s[0] for m, s in sums.items() if m >> i & 1) for i in range(p)])
    if (counts < 2).any():
        raise ValueError("a column has fewer than two values")
    mean = whole[1 : 1 + p] / counts
    squares = np.diag(whole[1 + p :].reshape(p, p)) / counts - mean**2
    if (squares <= 0).any():
        raise ValueError("a column doesn't vary")
    cov, before = np.diag(squares), -math.inf
    for _ in range(steps):
        moved, spread, ll, n = _step(sums, mean, cov)
        scale = np.sqrt(np.diag(cov))
        change = max(np.abs((moved - mean) / scale).max(), np.abs((spread - cov) / np.outer(scale, scale)).max())
        mean, cov = moved, (spread + spread.T) / 2
        if np.linalg.eigvalsh(cov / np.outer(scale, scale)).min() < 1e-10:
            raise NotConverged("the columns explain each other")
        if change < tolerance and ll >= before - 1e-9 * abs(ll):
            return mean, cov, ll, n
        before = ll
    raise NotConverged(f"not converged in {steps} steps")


def _centre(df: DataFrame, columns: list[str]) -> np.ndarray:
    found = df.agg(*[F.avg(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))) for c in columns]).first()
    if any(v is None for v in found):
        raise ValueError("a column has no values")
    return np.array(found, float)


def normal_em(df: DataFrame, columns: list[str], *, steps: int = 5000, tolerance: float = 1e-9) -> Normal:
    """Mean and covariance of jointly normal columns with values missing at random, by maximum likelihood. A null or NaN is
    missing; rows without any value are left out. Columns without two different values are an error."""
    centre = _centre(df, columns)
    sums = {m: s[0] for m, s in _sums(_read(df, columns, centre), len(columns)).items()}
    mean, cov, ll, n = _maximum(sums, len(columns), steps, tolerance)
    # a column that every row has keeps its average: what the sums about it hold is rounding
    whole = [all(m >> i & 1 for m in sums) for i in range(len(columns))]
    return Normal(list(columns), np.where(whole, 0.0, mean) + centre, cov, ll, n)


def missing_at_random(df: DataFrame, columns: list[str]) -> DataFrame:
    """Little's test that values miss completely at random: chi2, df, p_value, patterns."""
    centre, p = _centre(df, columns), len(columns)
    sums = {m: s[0] for m, s in _sums(_read(df, columns, centre), p).items()}
    mean, cov, _, n = _maximum(sums, p, 5000, 1e-9)
    cov = cov * n / (n - 1)
    chi2 = free = 0.0
    for mask, s in sums.items():
        o = _seen(mask, p)
        d = s[1 : 1 + p][o] / s[0] - mean[o]
        chi2 += s[0] * float(d @ np.linalg.solve(cov[np.ix_(o, o)], d))
        free += o.sum()
    free -= p
    return small(df.sparkSession, [(chi2, int(free), dist.chi2_sf(chi2, free) if free > 0 else math.nan, len(sums))], "chi2 double, df int, p_value double, patterns int")


def impute(df: DataFrame, columns: list[str], keys: list[str], *, imputations: int = 10, seed: int = 0) -> DataFrame:
    """Every row of ``df`` once for each imputation (column ``imputation``, from 1), with the missing values of jointly normal
    columns drawn given the seen ones. Each imputation takes its parameters from a bootstrap sample of the rows (weights and
    draws from hashes of ``keys``, which have to tell rows apart). The columns become doubles."""
    centre, p = _centre(df, columns), len(columns)
    sums = _sums(_read(df, columns, centre, keys, seed), p, imputations)
    fits = [_maximum({m: s[i + 1] for m, s in sums.items()}, p, 5000, 1e-7)[:2] for i in range(imputations)]
    names = [c for c in df.columns if c not in columns]
    values = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in columns])
    rows = df.select(F.struct(F.lit(0).alias("nothing"), *[F.col(f"`{c}`") for c in names]).alias("row"), values.alias("v"), F.xxhash64(F.lit(seed), *keys).alias("h"))

    def normals(h: np.ndarray, count: int) -> np.ndarray:
        """Standard normal numbers (n, count) from hashes, by Box and Muller."""
        x = h[:, None] + np.arange(1, 2 * count + 1, dtype=np.uint64)[None, :] * np.uint64(0xD6E8FEB86659FD93)
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
        u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53 + 2.0**-54
        return np.sqrt(-2 * np.log(u[:, :count])) * np.cos(2 * math.pi * u[:, count:])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = b["v"].flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, p) - centre
            seen = ~np.isnan(x)
            codes = seen @ (1 << np.arange(p))
            z = normals(b["h"].to_numpy().view(np.uint64), imputations * p).reshape(-1, imputations, p)
            for i, (mean, cov) in enumerate(fits):
                out = x.copy()
                for mask in np.unique(codes):
                    o = _seen(int(mask), p)
                    m, own = ~o, np.flatnonzero(codes == mask)
                    if not m.any():
                        continue
                    slope = cov[np.ix_(m, o)] @ np.linalg.pinv(cov[np.ix_(o, o)], hermitian=True)
                    left = cov[np.ix_(m, m)] - slope @ cov[np.ix_(o, m)]
                    root = np.linalg.cholesky(left + 1e-12 * np.diag(np.diag(cov)[m]))
                    out[np.ix_(own, m)] = mean[m] + (x[np.ix_(own, o)] - mean[o]) @ slope.T + z[own, i][:, m] @ root.T
                yield pa.RecordBatch.from_arrays([b["row"], pa.array(np.full(len(x), i + 1, np.int32)), *[pa.array(out[:, j] + centre[j]) for j in range(p)]], ["row", "imputation", *[f"c{j}" for j in range(p)]])

    schema = T.StructType([rows.schema["row"], T.StructField("imputation", T.IntegerType()), *[T.StructField(f"c{j}", T.DoubleType()) for j in range(p)]])
    made = rows.mapInArrow(fill, schema)
    return made.select(*[F.col(f"row.`{c}`") for c in names], "imputation", *[F.col(f"c{j}").alias(c) for j, c in enumerate(columns)])


def pooled(fits: list[Fit], complete_df: float | None = None) -> Fit:
    """One result from those of several imputations by Rubin's rules; degrees of freedom after Barnard and Rubin where the
    complete data's are known. Metrics: the largest share of information lost, and relative efficiency."""
    m = len(fits)
    if m < 2:
        raise ValueError("pooling takes two imputations")
    betas = np.array([f.beta for f in fits])
    within, between = np.mean([f.covariance for f in fits], axis=0), np.atleast_2d(np.cov(betas.T))
    total = within + (1 + 1 / m) * between
    with np.errstate(all="ignore"):
        share = (1 + 1 / m) * np.diag(between) / np.diag(total)
    share = np.nan_to_num(share)
    top = float(share.max())
    free = (m - 1) / top**2 if top > 0 else math.inf
    if complete_df is not None:
        own = (complete_df + 1) / (complete_df + 3) * complete_df * (1 - top)
        free = 1 / (1 / free + 1 / own) if math.isfinite(free) else own
    return Fit(fits[0].names, betas.mean(axis=0), total, free if math.isfinite(free) and free < 1e8 else None, {"imputations": float(m), "missing_information": top, "efficiency": 1 / (1 + top / m)})
