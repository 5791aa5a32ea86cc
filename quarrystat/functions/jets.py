"""Numbers with first and second derivatives over arrays of rows, and the special functions that likelihoods need.

A ``Jet`` holds values (n), gradients (K by n) and Hessians (K by K by n) in K variables, here a model's linear
indices. A log likelihood written once in jets gives score and curvature exactly.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np

HALF_LOG_2PI = 0.5 * math.log(2 * math.pi)


class Jet:
    __array_ufunc__ = None  # arrays leave arithmetic to the jet

    def __init__(self, v: np.ndarray, g: np.ndarray, h: np.ndarray):
        self.v, self.g, self.h = v, g, h

    @staticmethod
    def variables(values: Sequence[np.ndarray]) -> list[Jet]:
        k, n = len(values), len(values[0])
        unit = np.eye(k)
        return [Jet(np.asarray(v, float), np.repeat(unit[:, i : i + 1], n, axis=1), np.zeros((k, k, n))) for i, v in enumerate(values)]

    def chain(self, f: np.ndarray, f1: np.ndarray, f2: np.ndarray) -> Jet:
        """A function of this number, from its value and derivatives."""
        return Jet(f, f1 * self.g, f1 * self.h + f2 * self.g[:, None] * self.g[None, :])

    def __add__(self, other) -> Jet:
        return Jet(self.v + other.v, self.g + other.g, self.h + other.h) if isinstance(other, Jet) else Jet(self.v + other, self.g, self.h)

    def __mul__(self, other) -> Jet:
        if not isinstance(other, Jet):
            return Jet(self.v * other, self.g * other, self.h * other)
        cross = self.g[:, None] * other.g[None, :]
        return Jet(self.v * other.v, self.g * other.v + self.v * other.g, self.h * other.v + self.v * other.h + cross + cross.transpose(1, 0, 2))

    __radd__, __rmul__ = __add__, __mul__

    def __neg__(self) -> Jet:
        return self * -1.0

    def __sub__(self, other) -> Jet:
        return self + (-other)

    def __rsub__(self, other) -> Jet:
        return -self + other

    def __pow__(self, p: float) -> Jet:
        return self.chain(self.v**p, p * self.v ** (p - 1), p * (p - 1) * self.v ** (p - 2))

    def __truediv__(self, other) -> Jet:
        return self * (other**-1.0 if isinstance(other, Jet) else 1.0 / other)

    def __rtruediv__(self, other) -> Jet:
        return self**-1.0 * other


def where(mask: np.ndarray, a: Jet, b: Jet) -> Jet:
    return Jet(np.where(mask, a.v, b.v), np.where(mask, a.g, b.g), np.where(mask, a.h, b.h))


def exp(x: Jet) -> Jet:
    e = np.exp(np.minimum(x.v, 700.0))
    return x.chain(e, e, e)


def log(x: Jet) -> Jet:
    v = np.maximum(x.v, 1e-300)
    return x.chain(np.log(v), 1 / v, -1 / v**2)


def sigmoid(v: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(v / 2))


def softplus(x: Jet) -> Jet:
    """log(1 + exp(x))."""
    p = sigmoid(x.v)
    return x.chain(np.logaddexp(0.0, x.v), p, p * (1 - p))


def log1mexp(x: Jet) -> Jet:
    """log(1 - exp(-x)) for x > 0."""
    v = np.maximum(x.v, 1e-300)
    r = 1 / np.expm1(np.minimum(v, 700.0))
    return x.chain(np.where(v > 0.7, np.log1p(-np.exp(-v)), np.log(-np.expm1(-v))), r, -r * (1 + r))


def tanh(x: Jet) -> Jet:
    t = np.tanh(x.v)
    return x.chain(t, 1 - t * t, -2 * t * (1 - t * t))


def mills(a: np.ndarray) -> np.ndarray:
    """(1 - Phi(a)) / phi(a) for a >= 0: a power series for small a, a continued fraction from 3 on."""
    near = np.minimum(a, 3.0)
    term = total = near.copy()
    for k in range(1, 60):
        term = term * near * near / (2 * k + 1)
        total = total + term
    inside = 0.5 * np.exp(near * near / 2 + HALF_LOG_2PI) - total
    far = np.maximum(a, 3.0)
    fraction = far.copy()
    for k in range(60, 0, -1):
        fraction = far + k / fraction
    return np.where(a < 3.0, inside, 1 / fraction)


def log_normal_cdf(v: np.ndarray) -> np.ndarray:
    tail = -v * v / 2 - HALF_LOG_2PI + np.log(mills(np.abs(v)))
    return np.where(v < 0, tail, np.log1p(-np.exp(tail)))


def log_ndtr(x: Jet) -> Jet:
    """The log of the normal distribution function."""
    f = log_normal_cdf(x.v)
    r = np.exp(-x.v * x.v / 2 - HALF_LOG_2PI - f)
    return x.chain(f, r, -r * (x.v + r))


def ndtr(x: Jet) -> Jet:
    d = np.exp(-x.v * x.v / 2 - HALF_LOG_2PI)
    return x.chain(np.exp(log_normal_cdf(x.v)), d, -x.v * d)


def log_density(x: Jet) -> Jet:
    """The log of the normal density."""
    return x * x * -0.5 - HALF_LOG_2PI


def gammas(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log gamma and its first two derivatives for v > 0: asymptotic series beyond 10, reached by the recurrence."""
    x, low, d1, d2 = v.astype(float).copy(), np.zeros_like(v, float), np.zeros_like(v, float), np.zeros_like(v, float)
    while (small := x < 10).any():
        step = np.where(small, x, 1.0)
        low -= np.where(small, np.log(step), 0.0)
        d1 -= np.where(small, 1 / step, 0.0)
        d2 += np.where(small, 1 / step**2, 0.0)
        x = np.where(small, x + 1, x)
    r = 1 / x
    r2 = r * r
    low += (x - 0.5) * np.log(x) - x + HALF_LOG_2PI + r * (1 / 12 - r2 * (1 / 360 - r2 * (1 / 1260 - r2 * (1 / 1680 - r2 / 1188))))
    d1 += np.log(x) - r / 2 - r2 * (1 / 12 - r2 * (1 / 120 - r2 * (1 / 252 - r2 * (1 / 240 - r2 / 132))))
    d2 += r + r2 / 2 + r2 * r * (1 / 6 - r2 * (1 / 30 - r2 * (1 / 42 - r2 * (1 / 30 - r2 * 5 / 66))))
    return low, d1, d2


def lgamma(x: Jet) -> Jet:
    return x.chain(*gammas(np.maximum(x.v, 1e-300)))


def log_binormal(a: Jet, b: Jet, rho: Jet, nodes: int = 24) -> Jet:
    """The log of the bivariate normal distribution function: the product of the margins and an integral over the angle
    whose sine is the correlation."""
    at, weight = np.polynomial.legendre.leggauss(nodes)
    r = np.clip(rho.v, -0.999999, 0.999999)
    c = np.sqrt(1 - r * r)
    angle = rho.chain(np.arcsin(r), 1 / c, r / c**3)
    total = ndtr(a) * ndtr(b)
    squares, product = a * a + b * b, a * b
    for t, w in zip((at + 1) / 2, weight / 2, strict=True):
        s = angle * t
        sine = s.chain(np.sin(s.v), np.cos(s.v), -np.sin(s.v))
        total = total + exp((squares - product * sine * 2.0) / (sine * sine * -2.0 + 2.0) * -1.0) * angle * (w / (2 * math.pi))
    return log(total)
