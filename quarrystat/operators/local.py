"""Local polynomials: kernel regression, and regression discontinuities with robust bias-corrected intervals.

The range of x is cut at the evaluation points and at the ends of their kernels. One pass sums powers of x (about each
slice's middle, in halves of its width) and of y by slice; between cuts a kernel is a polynomial, so the weighted moments
about any point follow exactly from the slices under its kernel. Neither rows nor pairs of rows and points are spread out,
and what tasks return is a table of slices and powers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystat.functions import dist
from quarrystat.sources.tables import small

#: Kernels on [-1, 1]: coefficients of powers of |u|.
KERNELS = {"uniform": [0.5], "triangular": [1.0, -1.0], "epanechnikov": [0.75, 0.0, -0.75], "tricube": [70 / 81, 0, 0, -210 / 81, 0, 0, 210 / 81, 0, 0, -70 / 81]}


class Moments(NamedTuple):
    """For slices between cuts: sums of ((x - middle) / half) ** a * y ** b, as (slice, a, b)."""

    middle: np.ndarray
    half: np.ndarray
    sums: np.ndarray


def slice_moments(df: DataFrame, x: str, y: str, cuts: np.ndarray, powers: int, y_powers: int = 2) -> Moments:
    """A slice holds its lower cut, the last one its upper too. Rows outside of the cuts, and those with a null or NaN, are
    left out."""
    low, high = float(cuts[0]), float(cuts[-1])
    middle, half = (cuts[1:] + cuts[:-1]) / 2, (cuts[1:] - cuts[:-1]) / 2
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where(F.col("x").between(low, high) & F.col("y").isNotNull() & ~F.isnan("y"))
    width = (powers + 1) * (y_powers + 1)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(middle), powers + 1, y_powers + 1))
        for b in batches:
            xs, ys = b["x"].to_numpy(), b["y"].to_numpy()
            at = np.minimum(np.searchsorted(cuts, xs, side="right") - 1, len(middle) - 1)
            u = (xs - middle[at]) / half[at]
            for j in range(y_powers + 1):
                power = ys**j
                for i in range(powers + 1):
                    total[:, i, j] += np.bincount(at, power, len(middle))
                    power = power * u
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["i", "x"])

    got = rows.mapInArrow(sums, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).toArrow()
    out = np.zeros(len(middle) * width)
    out[got["i"].to_numpy()] = got["x"].to_numpy()
    return Moments(middle, half, out.reshape(len(middle), powers + 1, y_powers + 1))


def about(m: Moments, point: float, h: float, weights: np.ndarray, side: int, powers: int) -> np.ndarray:
    """Sums of w(|u|) u^a y^b with u = (x - point) / h over slices on one side of the point (1: above), where ``weights`` are
    coefficients of powers of |u|; as (a, b)."""
    inside = (m.middle > point) & (m.middle < point + h) if side > 0 else (m.middle < point) & (m.middle > point - h)
    out = np.zeros((powers + 1, m.sums.shape[2]))
    top = m.sums.shape[1]
    for s in np.flatnonzero(inside):
        # u = shift + scale t, where t is the slice's own coordinate
        step = np.array([(m.middle[s] - point) / h, m.half[s] / h])
        line = [np.array([1.0])]
        for _ in range(top - 1):
            line.append(np.convolve(line[-1], step))
        raw = np.zeros((top, m.sums.shape[2]))  # powers of u
        for a in range(top):
            raw[a] = line[a] @ m.sums[s, : a + 1]
        for d, w in enumerate(weights):
            if w:
                out += w * side**d * raw[d : d + powers + 1]
    return out


class LocalFit(NamedTuple):
    """Coefficients in powers of (x - point), their covariance by squared residuals, and the rows' weight."""

    beta: np.ndarray
    covariance: np.ndarray
    weight: float


def _squared(w: list[float]) -> np.ndarray:
    return np.convolve(w, w)


def needed_powers(kernel: str, degree: int) -> int:
    return 2 * (len(KERNELS[kernel]) - 1) + 4 * degree


def fit_at(m: Moments, point: float, h: float, kernel: str, degree: int, sides: tuple[int, ...] = (1, -1)) -> LocalFit:
    """The weighted least squares fit at a point, from the moments on the given sides."""
    w = np.array(KERNELS[kernel])
    first = sum(about(m, point, h, w, s, 2 * degree) for s in sides)
    p = degree + 1
    gram = np.array([[first[i + j, 0] for j in range(p)] for i in range(p)])
    if first[0, 0] <= 0 or np.linalg.matrix_rank(gram) < p:
        return LocalFit(np.full(p, np.nan), np.full((p, p), np.nan), float(first[0, 0]))
    inverse = np.linalg.inv(gram)
    beta = inverse @ first[:p, 1]
    second = sum(about(m, point, h, _squared(w), s, 4 * degree) for s in sides)
    squares = np.convolve(beta, beta)
    meat = np.empty((p, p))
    for i in range(p):
        for j in range(p):
            a = i + j
            meat[i, j] = second[a, 2] - 2 * beta @ second[a : a + p, 1] + squares @ second[a : a + 2 * degree + 1, 0]
    scale = h ** -np.arange(p)
    return LocalFit(beta * scale, inverse @ meat @ inverse * np.outer(scale, scale), float(first[0, 0]))


def rule_of_thumb(df: DataFrame, x: str, y: str) -> float:
    """1.06 times the smaller of deviation and scaled quartile range, times n to the -1/5."""
    n, s, q = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(F.count(F.lit(1)), F.stddev(x), F.percentile_approx(x, [0.25, 0.75], 10_000)).first()
    if not n or not s:
        raise ValueError("no rows, or no variance")
    return 1.06 * min(s, (q[1] - q[0]) / 1.349 or s) * n**-0.2


def local_polynomial(df: DataFrame, y: str, x: str, *, points: list[float] | int = 50, bandwidth: float | None = None, kernel: str = "epanechnikov", degree: int = 1, alpha: float = 0.05) -> DataFrame:
    """x, estimate, slope, std_error, ci_low, ci_high, weight at evaluation points (a number of them: evenly over the range):
    kernel regression with ``degree`` 0, local linear with 1, and so on. The bandwidth is by a rule of thumb unless it is
    stated. Where the rows under a kernel don't identify the polynomial the estimate is null. Residuals are those of the
    point's own fit."""
    h = bandwidth or rule_of_thumb(df, x, y)
    if isinstance(points, int):
        low, high = df.where(F.col(y).isNotNull()).agg(F.min(F.col(x).cast("double")), F.max(F.col(x).cast("double"))).first()
        points = list(np.linspace(low, high, points))
    at = np.asarray(sorted(points), float)
    cuts = np.unique(np.concatenate([at, at - h, at + h]))
    cuts = cuts[np.append(True, np.diff(cuts) > 1e-12 * h)]
    m = slice_moments(df, x, y, cuts, needed_powers(kernel, degree))
    z = dist.critical(alpha, None)
    rows = []
    for p in at:
        f = fit_at(m, p, h, kernel, degree)
        b, se = (float(f.beta[0]), math.sqrt(max(f.covariance[0, 0], 0.0))) if np.isfinite(f.beta[0]) else (None, None)
        rows.append((float(p), b, float(f.beta[1]) if b is not None and degree else None, se, *((b - z * se, b + z * se) if b is not None else (None, None)), f.weight))
    return small(df.sparkSession, rows, "x double, estimate double, slope double, std_error double, ci_low double, ci_high double, weight double")


# ---- regression discontinuity

def _one_side(df: DataFrame, y: str, x: str, cutoff: float, h: float, side: int, powers: int) -> Moments:
    """Moments on one side within a bandwidth; the cutoff itself is on the upper side."""
    rows = df.where(F.col(x) >= cutoff) if side > 0 else df.where(F.col(x) < cutoff)
    return slice_moments(rows, x, y, np.array([cutoff, cutoff + h] if side > 0 else [cutoff - h, cutoff]), powers)


class _Step(NamedTuple):
    """Variance, bias and regularisation of an estimate of a derivative, as the plug-in rule for a bandwidth needs them."""

    v: float
    b: float
    r: float


def _plug_in(df: DataFrame, y: str, x: str, cutoff: float, side: int, degree: int, derivative: int, h_variance: float, bias_degree: int, h_bias: float, kernel: str) -> _Step:
    m = _one_side(df, y, x, cutoff, h_variance, side, needed_powers(kernel, degree) + 1)
    fit = fit_at(m, cutoff, h_variance, kernel, degree, (side,))
    first = about(m, cutoff, h_variance, np.array(KERNELS[kernel]), side, 2 * degree + 1)
    p = degree + 1
    gram = np.array([[first[i + j, 0] for j in range(p)] for i in range(p)])
    constant = np.linalg.solve(gram, first[p : 2 * p, 0])[derivative] * h_variance ** (p - derivative)
    wide = fit_at(_one_side(df, y, x, cutoff, h_bias, side, needed_powers(kernel, bias_degree)), cutoff, h_bias, kernel, bias_degree, (side,))
    # per unit of bandwidth, so that the rule can solve for it
    scale = h_variance ** (derivative - p)
    per = constant * scale
    return _Step((2 * derivative + 1) * fit.covariance[derivative, derivative] * h_variance ** (2 * derivative + 1), math.sqrt(2 * (p - derivative)) * per * wide.beta[p], 2 * (p - derivative) * 3 * per**2 * wide.covariance[p, p])


def rd_bandwidths(df: DataFrame, y: str, x: str, cutoff: float, *, degree: int = 1, derivative: int = 0, kernel: str = "triangular") -> tuple[float, float]:
    """The bandwidths for estimate and bias with the least mean squared error of the jump, by plug-in steps after Calonico,
    Cattaneo and Titiunik, with variances by squared residuals: a pilot, a bandwidth for a high derivative, then the two."""
    rows = df.where(F.col(y).isNotNull() & F.col(x).isNotNull())
    n, s, q, low, high = rows.agg(F.count(F.lit(1)), F.stddev(x), F.percentile_approx(x, [0.25, 0.75], 10_000), F.min(x), F.max(x)).first()
    if not n or not s or not low < cutoff < high:
        raise ValueError("no rows on one side of the cutoff")
    pilot = {"uniform": 1.843, "triangular": 2.576, "epanechnikov": 2.34}[kernel] * min(s, (q[1] - q[0]) / 1.349 or s) * n**-0.2
    pilot = min(pilot, max(high - cutoff, cutoff - low))
    top = degree + 1
    both = lambda *a: [_plug_in(rows, y, x, cutoff, side, *a, kernel) for side in (1, -1)]

    def solved(steps: list[_Step], order: int, regular: float, signs: int) -> float:
        up, down = steps
        return ((up.v + down.v) / ((up.b + signs * down.b) ** 2 + regular * (up.r + down.r))) ** (1 / (2 * order + 3))

    far = [_plug_in(rows, y, x, cutoff, side, top + 1, top + 1, pilot, top + 2, (high - cutoff) if side > 0 else (cutoff - low), kernel) for side in (1, -1)]
    wide = solved(far, top + 1, 0.0, -1)
    bias = solved(both(top, degree + 1, pilot, top + 1, wide), top, 1.0, -1)
    main = solved(both(degree, derivative, pilot, top, bias), degree, 1.0, -1)
    limit = max(high - cutoff, cutoff - low)
    return min(main, limit), min(bias, limit)


def discontinuity(df: DataFrame, y: str, x: str, cutoff: float = 0.0, *, bandwidth: float | None = None, bias_bandwidth: float | None = None, degree: int = 1, kernel: str = "triangular", treated: str | None = None, alpha: float = 0.05) -> DataFrame:
    """method, estimate, std_error, z, p_value, ci_low, ci_high, bandwidth, bias_bandwidth of the jump of ``y`` where ``x``
    passes the cutoff: conventional, bias-corrected, and robust (bias-corrected with the variance of both). With ``treated``
    the jump of y over that of the treatment (a fuzzy design), with its delta-method variance. Rows with a null are left
    out; a row at the cutoff is above. Bandwidths, where not stated, are chosen for the least mean squared error."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & (F.col(treated).isNotNull() if treated else F.lit(True)))
    if bandwidth is None:
        bandwidth, chosen = rd_bandwidths(rows, y, x, cutoff, degree=degree, kernel=kernel)
        bias_bandwidth = bias_bandwidth or chosen
    h, b = bandwidth, bias_bandwidth or bandwidth
    parts = [_corrected(rows, y, treated, x, cutoff, h, b, side, degree, kernel) for side in (1, -1)]
    plain, corrected = parts[0][0] - parts[1][0], parts[0][1] - parts[1][1]
    v_plain, v_robust = parts[0][2] + parts[1][2], parts[0][3] + parts[1][3]
    out = []
    z = dist.critical(alpha, None)
    for name, value, v in (("conventional", plain, v_plain), ("bias-corrected", corrected, v_plain), ("robust", corrected, v_robust)):
        if treated:
            est = value[0] / value[1]
            weights = np.array([1 / value[1], -value[0] / value[1] ** 2])
            se = math.sqrt(weights @ v @ weights)
        else:
            est, se = value[0], math.sqrt(v[0, 0])
        out.append((name, float(est), se, est / se, dist.two_sided(est / se, None), est - z * se, est + z * se, float(h), float(b)))
    return small(df.sparkSession, out, "method string, estimate double, std_error double, z double, p_value double, ci_low double, ci_high double, bandwidth double, bias_bandwidth double")


def _corrected(rows: DataFrame, y: str, treated: str | None, x: str, cutoff: float, h: float, b: float, side: int, degree: int, kernel: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Limits at the cutoff of one side for y and the treatment: plain, bias-corrected, and both covariances. Two passes: the
    fits, then the outer products of the rows' influence with residuals of the wider fit."""
    outcomes = [y, *([treated] if treated else [])]
    own = rows.where(F.col(x) >= cutoff) if side > 0 else rows.where(F.col(x) < cutoff)
    reach = max(h, b)
    near = own.where(F.abs(F.col(x) - cutoff) <= reach).select(F.col(x).cast("double").alias("x"), *[F.col(o).cast("double").alias(f"y{i}") for i, o in enumerate(outcomes)])
    w, p = np.array(KERNELS[kernel]), degree + 1
    up = lambda v, k: np.vander(v, k + 1, increasing=True)

    def weigh(u: np.ndarray) -> np.ndarray:
        return np.where(np.abs(u) <= 1, np.polynomial.polynomial.polyval(np.abs(u), w), 0.0)

    def reduce(body) -> np.ndarray:
        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                if batch.num_rows:
                    part = body(batch["x"].to_numpy() - cutoff, np.column_stack([batch[f"y{i}"].to_numpy() for i in range(len(outcomes))])).ravel()
                    total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["i", "x"])

        got = near.mapInArrow(sums, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).toArrow()
        if not got.num_rows:
            raise ValueError("no rows within the bandwidth on one side of the cutoff")
        out = np.zeros(got.num_rows)
        out[got["i"].to_numpy()] = got["x"].to_numpy()
        return out

    def crossed(d: np.ndarray, ys: np.ndarray) -> np.ndarray:
        kh, kb, rp, rq = weigh(d / h), weigh(d / b), up(d / h, degree), up(d / b, p)
        return np.concatenate([(rp.T @ (kh[:, None] * np.column_stack([rp, (d / h) ** p, ys]))).ravel(), (rq.T @ (kb[:, None] * np.column_stack([rq, ys]))).ravel()])

    got = reduce(crossed)
    cut = p * (p + 1 + len(outcomes))
    first, second = got[:cut].reshape(p, -1), got[cut:].reshape(p + 1, -1)
    gp, gq = np.linalg.inv(first[:, :p]), np.linalg.inv(second[:, : p + 1])
    bp, bq = gp @ first[:, p + 1 :], gq @ second[:, p + 1 :]
    bias = (gp @ first[:, p])[0] * (h / b) ** p  # what a unit of the wider fit's next coefficient adds at the cutoff
    plain, corrected = bp[0], bp[0] - bias * bq[p]

    def spread(d: np.ndarray, ys: np.ndarray) -> np.ndarray:
        lp = (up(d / h, degree) @ gp[0]) * weigh(d / h)
        lq = (up(d / b, p) @ gq[p]) * weigh(d / b)
        narrow, wide = ys - up(d / h, degree) @ bp, ys - up(d / b, p) @ bq
        robust = (lp - bias * lq)[:, None] * wide
        return np.stack([(lp[:, None] * narrow).T @ (lp[:, None] * narrow), robust.T @ robust])

    v = reduce(spread).reshape(2, len(outcomes), len(outcomes))
    return plain, corrected, v[0], v[1]


def rd_plot(df: DataFrame, y: str, x: str, cutoff: float = 0.0, *, bins: int = 20) -> DataFrame:
    """side (-1 or 1), bin (from the cutoff), middle, n, mean, std_error: means of y in ``bins`` even bins on each side."""
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    low, high = rows.agg(F.min("x"), F.max("x")).first()
    if low is None:
        return small(df.sparkSession, [], "side int, bin int, middle double, n long, mean double, std_error double")
    above = F.col("x") >= cutoff
    width = F.when(above, F.lit((high - cutoff) / bins)).otherwise(F.lit((cutoff - low) / bins))
    place = F.least(F.floor(F.abs(F.col("x") - cutoff) / width), F.lit(bins - 1)).cast("int")
    sided = rows.select(F.when(above, 1).otherwise(-1).alias("side"), place.alias("bin"), width.alias("width"), "y")
    means = sided.groupBy("side", "bin").agg(F.max("width").alias("width"), F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"), (F.stddev("y") / F.sqrt(F.count("y"))).alias("std_error"))
    return means.select("side", "bin", (F.lit(cutoff) + F.col("side") * (F.col("bin") + 0.5) * F.col("width")).alias("middle"), "n", "mean", "std_error")
