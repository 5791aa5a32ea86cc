"""Ordered recurrences over arrays of rows: affine steps and Kalman steps, composed and replayed.

Rows are dealt to blocks of about the root of their number. A loop goes through the places of a block, for all blocks and
all parameter points at once; then blocks are joined in order. So a step of a recurrence costs no Python call of its own,
and the same composition joins slices that different tasks hold.

Shapes: n rows, m parameter points, k states.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np


class Affine(NamedTuple):
    """``s = a[kind] s + b`` for each row. ``a``: (kinds, m, k, k); ``kind``: (n,); ``b``: (n, m, k)."""

    a: np.ndarray
    kind: np.ndarray
    b: np.ndarray


def _blocked(n: int) -> tuple[int, int]:
    length = max(1, int(np.ceil(np.sqrt(n))))
    return -(-n // length), length


def _dealt(x: np.ndarray, blocks: int, length: int, fill) -> np.ndarray:
    """Rows as (place, block, ...), filled up at the end."""
    pad = np.full((blocks * length - len(x), *x.shape[1:]), fill, x.dtype)
    return np.swapaxes(np.concatenate([x, pad]).reshape(blocks, length, *x.shape[1:]), 0, 1)


def _affine_dealt(steps: Affine) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    k = steps.b.shape[-1]
    same = np.broadcast_to(np.eye(k), (1, *steps.a.shape[1:]))
    blocks, length = _blocked(len(steps.kind))
    return np.concatenate([steps.a, same]), _dealt(steps.kind, blocks, length, len(steps.a)), _dealt(steps.b, blocks, length, 0.0)


def _by(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of matrices; those of one by one are plain ones, which cost no call each."""
    return a * b if a.shape[-1] == 1 else a @ b


def _on(a: np.ndarray, v: np.ndarray) -> np.ndarray:
    return a[..., 0] * v if a.shape[-1] == 1 else (a @ v[..., None])[..., 0]


def composed(steps: Affine) -> tuple[np.ndarray, np.ndarray]:
    """All steps as one: its matrix (m, k, k) and its constant (m, k)."""
    a, kinds, b = _affine_dealt(steps)
    t, c = _block_steps(a, kinds, b)
    total, constant = t[0], c[0]
    for i in range(1, len(t)):
        total, constant = _by(t[i], total), _on(t[i], constant) + c[i]
    return total, constant


def _block_steps(a: np.ndarray, kinds: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    t = np.broadcast_to(np.eye(a.shape[-1]), (kinds.shape[1], *a.shape[1:]))
    c = np.zeros(b.shape[1:])
    for kind, add in zip(kinds, b, strict=True):
        step = a[kind]
        t, c = _by(step, t), _on(step, c) + add
    return t, c


def states(steps: Affine, start: np.ndarray) -> np.ndarray:
    """The state after each row (n, m, k), from the one before the first row (m, k)."""
    a, kinds, b = _affine_dealt(steps)
    t, c = _block_steps(a, kinds, b)
    s = np.empty((len(t), *start.shape))
    s[0] = start
    for i in range(1, len(t)):
        s[i] = _on(t[i - 1], s[i - 1]) + c[i - 1]
    out = np.empty(b.shape)
    for i, (kind, add) in enumerate(zip(kinds, b, strict=True)):
        s = _on(a[kind], s) + add
        out[i] = s
    return np.swapaxes(out, 0, 1).reshape(-1, *start.shape)[: len(steps.kind)]


class Model(NamedTuple):
    """A state-space model at m parameter points: ``s = f s + noise q``, ``y = d + h s + noise r``; before a series' first
    row the state has mean ``a0`` and variance ``p0``, as a prediction for that row."""

    f: np.ndarray  # (m, k, k)
    q: np.ndarray  # (m, k, k)
    h: np.ndarray  # (m, k)
    r: np.ndarray  # (m,)
    d: np.ndarray  # (m,)
    a0: np.ndarray  # (m, k)
    p0: np.ndarray  # (m, k, k)


class Element(NamedTuple):
    """What some rows make of the state before them: its distribution after them is ``a (I + P J)^-1 (mean + P eta) + b``
    with variance ``a (I + P J)^-1 P a' + c``, where P is the variance before."""

    a: np.ndarray
    b: np.ndarray
    c: np.ndarray
    eta: np.ndarray
    j: np.ndarray


def _vector(m: np.ndarray, v: np.ndarray) -> np.ndarray:
    return (m @ v[..., None])[..., 0]


def _t(m: np.ndarray) -> np.ndarray:
    return np.swapaxes(m, -1, -2)


def joined(first: Element, second: Element) -> Element:
    """The element of rows and those that follow them."""
    eye = np.eye(first.a.shape[-1])
    between = np.linalg.inv(eye + first.c @ second.j)
    ahead = second.a @ between
    back = _t(first.a) @ _t(between)
    return Element(
        ahead @ first.a,
        _vector(ahead, first.b + _vector(first.c, second.eta)) + second.b,
        ahead @ first.c @ _t(second.a) + second.c,
        _vector(back, second.eta - _vector(second.j, first.b)) + first.eta,
        back @ second.j @ first.a + first.j,
    )


def applied(element: Element, mean: np.ndarray, variance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ahead = element.a @ np.linalg.inv(np.eye(mean.shape[-1]) + variance @ element.j)
    after = ahead @ variance @ _t(element.a) + element.c
    return _vector(ahead, mean + _vector(variance, element.eta)) + element.b, (after + _t(after)) / 2


def _elements(model: Model, y: np.ndarray, first: np.ndarray, padded: np.ndarray) -> Element:
    """The elements of rows (blocks, m, ...) with values ``y`` (blocks, m): a first row forgets what was before it, a null
    value (NaN) only predicts, and a padded row does nothing."""
    f, h = model.f, model.h
    k = f.shape[-1]
    eye, none = np.eye(k), np.zeros((k, k))
    spread = _vector(model.q, h)
    s = (spread * h).sum(-1) + model.r
    gain = spread / s[:, None]
    left = eye - gain[:, :, None] * h[:, None, :]
    hf = _vector(_t(f), h)
    spread0 = _vector(model.p0, h)
    s0 = (spread0 * h).sum(-1) + model.r
    gain0 = spread0 / s0[:, None]
    p0 = model.p0 - gain0[:, :, None] * spread0[:, None, :]
    seen = ~np.isnan(y[:, 0])
    v = np.where(seen[:, None], y, 0.0) - model.d
    kind = np.where(padded, 4, np.where(first, np.where(seen, 2, 3), np.where(seen, 0, 1)))
    pick = lambda *x: np.stack([np.broadcast_to(z, model.f.shape) for z in x])[kind]
    a = pick(left @ f, f, none, none, eye)
    c = pick(left @ model.q, model.q, p0, model.p0, none)
    j = pick(hf[:, :, None] * hf[:, None, :] / s[:, None, None], none, none, none, none)
    start0 = model.a0 + gain0 * (v - (h * model.a0).sum(-1))[..., None]
    b = np.select([(kind == x)[:, None, None] for x in (0, 2, 3)], [gain * v[..., None], start0, np.broadcast_to(model.a0, start0.shape)], 0.0)
    eta = np.where((kind == 0)[:, None, None], hf * (v / s)[..., None], 0.0)
    return Element(a, b, c, eta, j)


def _at(e: Element, i: int) -> Element:
    return Element(*[x[i] for x in e])


def _block_elements(model: Model, y: np.ndarray, first: np.ndarray, padded: np.ndarray) -> Element:
    total = None
    for v, f, p in zip(y, first, padded, strict=True):
        e = _elements(model, v, f, p)
        total = e if total is None else joined(total, e)
    return total


def _series_dealt(y: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    y = y if y.ndim > 1 else y[:, None]
    blocks, length = _blocked(len(y))
    return _dealt(y, blocks, length, np.nan), _dealt(first, blocks, length, False), _dealt(np.zeros(len(y), bool), blocks, length, True)


def summary(model: Model, y: np.ndarray, first: np.ndarray) -> Element:
    """All rows as one element (m, ...). ``y``: (n,), or (n, m)."""
    blocks = _block_elements(model, *_series_dealt(y, first))
    total = _at(blocks, 0)
    for i in range(1, len(blocks.a)):
        total = joined(total, _at(blocks, i))
    return total


class Filtered(NamedTuple):
    """For each row the prediction's error and variance (n, m), NaN errors where nothing was seen, and the state after it."""

    error: np.ndarray
    variance: np.ndarray
    mean: np.ndarray  # (n, m, k)
    spread: np.ndarray  # (n, m, k, k)


def filtered(model: Model, y: np.ndarray, first: np.ndarray, mean: np.ndarray, variance: np.ndarray) -> Filtered:
    """The Kalman filter from the state after the row before the first one."""
    ys, firsts, pads = _series_dealt(y, first)
    blocks = _block_elements(model, ys, firsts, pads)
    m, p = [mean], [variance]
    for i in range(len(blocks.a) - 1):
        after = applied(_at(blocks, i), m[-1], p[-1])
        m.append(after[0])
        p.append(after[1])
    a, c = np.stack(m), np.stack(p)
    out: list[tuple] = []
    for v, f, pad in zip(ys, firsts, pads, strict=True):
        mark, skip = f[:, None], pad[:, None]
        a1 = np.where(mark[..., None], model.a0, _vector(model.f, a))
        c1 = np.where(mark[..., None, None], model.p0, model.f @ c @ _t(model.f) + model.q)
        spread = _vector(c1, model.h)
        s = (spread * model.h).sum(-1) + model.r
        error = v - model.d - (a1 * model.h).sum(-1)
        seen = ~np.isnan(error)
        gain = np.where(seen[..., None], spread / s[..., None], 0.0)
        a1 = a1 + gain * np.where(seen, error, 0.0)[..., None]
        c1 = c1 - gain[..., :, None] * spread[..., None, :]
        a, c = np.where(skip[..., None], a, a1), np.where(skip[..., None, None], c, (c1 + _t(c1)) / 2)
        out.append((error, s, a, c))
    back = lambda i: np.swapaxes(np.stack([x[i] for x in out]), 0, 1).reshape(-1, *out[0][i].shape[1:])[: len(y)]
    return Filtered(back(0), back(1), back(2), back(3))


def differences(f: Callable[[np.ndarray], np.ndarray], at: np.ndarray, scale: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Value, gradient and Hessian of ``f`` by central differences; ``f`` gets all points (m, parameters) at once."""
    k = len(at)
    h = 1e-4 * scale
    unit = np.diag(h)
    pairs = [(i, j) for i in range(k) for j in range(i)]
    points = [at, *[at + s * unit[i] for i in range(k) for s in (1, -1)], *[at + a * unit[i] + b * unit[j] for i, j in pairs for a, b in ((1, 1), (1, -1), (-1, 1), (-1, -1))]]
    v = f(np.array(points))
    up, down = v[1 : 2 * k + 1 : 2], v[2 : 2 * k + 2 : 2]
    hessian = np.diag((up - 2 * v[0] + down) / h**2)
    for n, (i, j) in enumerate(pairs):
        a, b, c, d = v[2 * k + 1 + 4 * n : 2 * k + 5 + 4 * n]
        hessian[i, j] = hessian[j, i] = (a - b - c + d) / (4 * h[i] * h[j])
    return float(v[0]), (up - down) / (2 * h), hessian
