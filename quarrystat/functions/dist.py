"""Tails and quantiles of the normal, t, chi-square and F distributions, for the few numbers a result needs."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np


#: Nodes on (-1, 1) for Gauss-Legendre panels.
_AT, _WEIGHT = np.polynomial.legendre.leggauss(40)


def beta_tail(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function I_x(a, b): the density of ``u = log(t / (1 - t))`` is smooth with one
    mode at log(a / b), so panels around it (as wide as its deviation) are integrated by Gauss-Legendre."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    log_beta = math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b) if max(a, b) < 1e4 else _log_beta(a, b)
    mode, width = math.log(a / b), math.sqrt(1 / a + 1 / b)
    at = math.log(x) - math.log1p(-x)

    def mass(low: float, high: float) -> float:
        """Between two values of u, by panels of about a deviation."""
        panels = max(1, math.ceil((high - low) / min(width, 2.0)))
        edges = np.linspace(low, high, panels + 1)
        u = (edges[:-1, None] + edges[1:, None]) / 2 + (edges[1:, None] - edges[:-1, None]) / 2 * _AT
        log_t = -np.logaddexp(0, -u)
        return float((np.exp(a * log_t + b * (log_t - u) - log_beta) @ _WEIGHT * (edges[1:] - edges[:-1]) / 2).sum())

    # beyond these the density is below 1e-300 of a deviation's mass: e^(a u) to the left, e^(-b u) to the right
    reach = 40 * width + 80
    if at <= mode:
        return min(1.0, mass(at - min(reach, 45 / a + 10 * width), at))
    return max(0.0, 1 - mass(at, at + min(reach, 45 / b + 10 * width)))


def _log_beta(a: float, b: float) -> float:
    """log B(a, b) where an argument is large: differences of Stirling's series, not of large numbers."""
    big, small_ = max(a, b), min(a, b)
    tail = lambda v: 1 / (12 * v) - 1 / (360 * v**3) + 1 / (1260 * v**5)
    if small_ < 1e4:
        gap = (big - 0.5) * -math.log1p(small_ / big) - small_ * math.log(big + small_) + small_
        return math.lgamma(small_) + gap + tail(big) - tail(big + small_)
    return 0.5 * math.log(2 * math.pi) + (small_ - 0.5) * math.log(small_ / (small_ + big)) + big * -math.log1p(small_ / big) - 0.5 * math.log(big) + tail(big) + tail(small_) - tail(big + small_)


def gamma_upper(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function Q(a, x)."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-17 * abs(total):
            n += 1
            term *= x / n
            total += term
        return 1 - front * total
    b, c = x + 1 - a, 1e300
    d = f = 1 / b
    for i in range(1, 10_000):
        b += 2
        d, c = 1 / (b - i * (i - a) * d), b - i * (i - a) / c
        f *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * f


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def t_sf(t: float, df: float) -> float:
    half = 0.5 * beta_tail(df / 2, 0.5, df / (df + t * t))
    return half if t >= 0 else 1 - half


def chi2_sf(x: float, df: float) -> float:
    return gamma_upper(df / 2, x / 2)


def f_sf(f: float, df1: float, df2: float) -> float:
    return beta_tail(df2 / 2, df1 / 2, df2 / (df2 + df1 * f)) if f > 0 else 1.0


def two_sided(statistic: float, df: float | None) -> float:
    """Twice the upper tail: of t with df degrees of freedom, of the normal if df is None."""
    if math.isnan(statistic):
        return math.nan
    return 2 * (normal_sf(abs(statistic)) if df is None else t_sf(abs(statistic), df))


def quantile(upper_tail: Callable[[float], float], p: float, low: float, high: float) -> float:
    """x with upper_tail(x) = 1 - p, between low and high, by bisection."""
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if upper_tail(mid) > 1 - p else (low, mid)
        if high - low <= 1e-15 * max(1.0, abs(mid)):
            break
    return (low + high) / 2


def critical(alpha: float, df: float | None) -> float:
    """The two-sided critical value."""
    return quantile(normal_sf if df is None else lambda x: t_sf(x, df), 1 - alpha / 2, 0, 1e3 if df is None or df > 2 else 1e6)
