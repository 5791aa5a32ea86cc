"""Ordered recurrences over series of any length: smoothing, ARMA, GARCH and state-space models.

A table is cut into slices of rows in the order of panel and time. Where a model has to go from row to row, every slice is
first reduced to what it does to the state before it (an affine step, or an element of the Kalman filter); the driver joins
these, one small matrix a slice; then each slice is replayed from its own incoming state. So no series is one task, no row
is cut off, and a pass costs two jobs whatever the number of rows. Likelihoods are evaluated at all the points that
derivatives need in one such pass.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrystat.functions import scan
from quarrystat.functions.scan import Affine, Element, Model
from quarrystat.operators.linear import Fit
from quarrystat.operators.mle import NotConverged
from quarrystat.sources.tables import small, written

#: Rows of a slice.
PER_SLICE = 50_000

#: Columns of a slice as arrays of doubles, and which rows are the first of their series.
Rows = dict[str, np.ndarray]


class Layout(NamedTuple):
    """What tasks know of the slices: columns of the panel, names of the values, and for each slice the key that the slice
    before it ends with."""

    keys: list[str]
    values: tuple[str, ...]
    before: dict[int, tuple | None]


@dataclass(frozen=True)
class Series:
    """Rows in slices: slice, p0... (the panel), t, and the values as doubles v0...."""

    rows: DataFrame
    panel: tuple[str, ...]
    layout: Layout


def ordered(df: DataFrame, time: str, values: list[str] | tuple[str, ...], panel: tuple[str, ...] = (), per_slice: int = PER_SLICE) -> Series:
    """The series of a table, one for each key of ``panel``. Rows with a null time or key are left out; a null or NaN value
    is a gap of its series. A time that repeats within a series is an error."""
    keys = [f"p{i}" for i in range(len(panel))]
    rows = df.select(*[F.col(p).alias(k) for p, k in zip(panel, keys, strict=True)], F.col(time).alias("t"), *[F.col(v).cast("double").alias(f"v{i}") for i, v in enumerate(values)]).na.drop(subset=[*keys, "t"])
    slices = max(1, -(-rows.count() // per_slice))
    cut = written(rows.repartitionByRange(slices, *keys, "t").withColumn("slice", F.spark_partition_id()))
    ends = cut.groupBy("slice").agg(F.max(F.struct(F.lit(0).alias("zero"), *keys)).alias("last")).orderBy("slice").collect()
    before: dict[int, tuple | None] = {}
    last = None
    for r in ends:
        before[r["slice"]] = last
        last = tuple(r["last"])[1:]
    return Series(cut, tuple(panel), Layout(keys, tuple(values), before))


def _follows(keys: list[str], table: pa.Table) -> np.ndarray:
    """Which rows of a table in order, but the first, go on with the series of the row before."""
    same = np.ones(len(table) - 1, bool)
    for k in keys:
        same &= pc.equal(table[k].slice(0, len(table) - 1), table[k].slice(1)).to_numpy(zero_copy_only=False)
    if (same & pc.equal(table["t"].slice(0, len(table) - 1), table["t"].slice(1)).to_numpy(zero_copy_only=False)).any():
        raise ValueError("a time repeats within a series")
    return same


def _opened(layout: Layout, table: pa.Table) -> tuple[pa.Table, int, Rows, np.ndarray]:
    """A slice in order, its number, its values, and which rows begin a series."""
    keys = layout.keys
    table = table.sort_by([(k, "ascending") for k in [*keys, "t"]])
    number, same = table["slice"][0].as_py(), _follows(keys, table)
    begins = layout.before[number] != tuple(table[k][0].as_py() for k in keys)
    values = {v: table[f"v{i}"].to_numpy(zero_copy_only=False).astype(float) for i, v in enumerate(layout.values)}
    return table, number, values, np.append(begins, ~same)


@dataclass(frozen=True)
class Stepper:
    """How a model at m points goes through rows. ``reduce`` makes arrays of a slice, ``follow`` a state and those to the
    state after the slice, from ``start``."""

    reduce: Callable[[Rows, np.ndarray], tuple[np.ndarray, ...]]
    follow: Callable[[tuple, tuple[np.ndarray, ...]], tuple]
    start: tuple[np.ndarray, ...]


def incoming(series: Series | Packed, stepper: Stepper, whole: bool = False) -> tuple[dict[int, tuple], tuple]:
    """The state before each slice, and after the last one (only if ``whole``, or if there are several slices)."""
    numbers = series.earlier if isinstance(series, Packed) else series.layout.before
    if len(numbers) <= 1 and not whole:
        return dict.fromkeys(numbers, stepper.start), stepper.start

    def reduce(number: int, values: Rows, first: np.ndarray) -> pa.Table:
        parts = stepper.reduce(values, first)
        return pa.table({"slice": pa.array([number], pa.int32()), "shapes": pa.array([[list(p.shape) for p in parts]], pa.list_(pa.list_(pa.int64()))), "x": pa.array([np.concatenate([p.ravel() for p in parts])], pa.list_(pa.float64()))})

    found = _per_slice(series, reduce, "slice int, shapes array<array<long>>, x array<double>").orderBy("slice").toArrow()
    states, state = {}, stepper.start
    for number, shapes, x in zip(found["slice"].to_pylist(), found["shapes"].to_pylist(), found["x"], strict=True):
        states[number] = state
        cuts = np.cumsum([math.prod(s) for s in shapes])[:-1]
        state = stepper.follow(state, tuple(part.reshape(s) for part, s in zip(np.split(x.values.to_numpy(), cuts), shapes, strict=True)))
    return states, state


# ---- slices that many passes read

@dataclass(frozen=True)
class Packed:
    """Slices in order, one row each: slice, same (which rows but the first go on with the series before them), v (values).
    What sums over them pass after pass neither moves nor sorts rows. ``earlier``: for each slice the values of up to ``lags``
    rows before it, the nearest last, or None where its first row begins a series."""

    rows: DataFrame
    value: str
    lags: int
    earlier: dict[int, tuple[float, ...] | None]


def packed(df: DataFrame, value: str, time: str, panel: tuple[str, ...] = (), lags: int = 1, per_slice: int = PER_SLICE) -> Packed:
    """The series of a table as ``ordered``, packed. Rows with a null value are left out as well."""
    keys = [f"p{i}" for i in range(len(panel))]
    rows = df.select(*[F.col(p).alias(k) for p, k in zip(panel, keys, strict=True)], F.col(time).alias("t"), F.col(value).cast("double").alias("v")).na.drop()
    slices = max(1, -(-rows.count() // per_slice))
    cut = rows.repartitionByRange(slices, *keys, "t").withColumn("slice", F.spark_partition_id()).sortWithinPartitions(*keys, "t")
    ends = [T.StructField(f"{side}_{k}", rows.schema[k].dataType) for side in ("first", "last") for k in keys]
    schema = T.StructType([T.StructField("slice", T.IntegerType()), *ends, T.StructField("same", T.ArrayType(T.BooleanType())), T.StructField("near", T.ArrayType(T.DoubleType())), T.StructField("v", T.ArrayType(T.DoubleType()))])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            table = pa.Table.from_batches(held)
            same, v = _follows(keys, table), table["v"].to_numpy()
            own = v[np.append(0, np.flatnonzero(~same) + 1)[-1] :][-lags:]
            found = [table[k].slice(i, 1).combine_chunks() for i in (0, len(v) - 1) for k in keys]
            yield pa.RecordBatch.from_arrays([table["slice"].slice(0, 1).combine_chunks(), *found, pa.array([same], pa.list_(pa.bool_())), *[pa.array([x], pa.list_(pa.float64())) for x in (own, v)]], schema.names)

    made = written(cut.mapInArrow(pack, schema))
    earlier: dict[int, tuple[float, ...] | None] = {}
    last, near = None, ()
    for r in made.select("slice", *[f.name for f in ends], F.forall("same", lambda x: x).alias("single"), "near").orderBy("slice").collect():
        goes_on = last == tuple(r[f"first_{k}"] for k in keys)
        earlier[r["slice"]] = near if goes_on else None
        near = (*(near if goes_on and r["single"] else ()), *r["near"])[-lags:]
        last = tuple(r[f"last_{k}"] for k in keys)
    return Packed(made.select("slice", "same", "v"), value, lags, earlier)


def lagged(name: str, lag: int) -> str:
    """The column of ``lag`` rows earlier in the series of a packed slice; NaN where the series hasn't begun by then."""
    return f"{name}-{lag}"


def _unpacked(value: str, lags: int, before: dict[int, tuple[float, ...] | None], b: pa.RecordBatch) -> Iterator[tuple[int, Rows, np.ndarray]]:
    """The slices of a batch: number, values with their lags, and which rows begin a series."""
    for i, number in enumerate(b["slice"].to_pylist()):
        v = b["v"][i].values.to_numpy(zero_copy_only=False)
        earlier = before[number]
        first = np.append(earlier is None, ~b["same"][i].values.to_numpy(zero_copy_only=False).astype(bool))
        places, near = np.arange(len(v)), np.array(earlier or ())
        age = places - np.maximum.accumulate(np.where(first, places, -len(near)))
        whole = np.concatenate([np.full(lags - len(near), np.nan), near, v])
        rows = {value: v}
        for lag in range(1, lags + 1):
            rows[lagged(value, lag)] = np.where(age >= lag, whole[lags - lag : lags - lag + len(v)], np.nan)
        yield number, rows, first


def _per_slice(series: Series | Packed, body: Callable[[int, Rows, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """The rows that ``body`` makes of each slice."""
    if isinstance(series, Packed):
        known = (series.value, series.lags, series.earlier)

        def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for slice_ in _unpacked(*known, b):
                    yield from body(*slice_).to_batches()

        return series.rows.mapInArrow(parts, schema)
    layout = series.layout
    return series.rows.groupBy("slice").applyInArrow(lambda table: body(*_opened(layout, table)[1:]), schema)


def summed(series: Series | Packed, stepper: Stepper | None, body: Callable[[Rows, np.ndarray, tuple | None], np.ndarray]) -> np.ndarray:
    """The sum over all slices of an array that ``body`` makes of a slice and its incoming state (None without a stepper)."""
    states = incoming(series, stepper)[0] if stepper else {}

    def part(number: int, values: Rows, first: np.ndarray) -> pa.Table:
        x = body(values, first, states.get(number)).ravel()
        return pa.table({"i": np.arange(len(x)), "x": x})

    got = _per_slice(series, part, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).toArrow()
    out = np.zeros(got.num_rows)
    out[got["i"].to_numpy()] = got["x"].to_numpy()
    return out


def mapped(series: Series, stepper: Stepper, body: Callable[[Rows, np.ndarray, tuple], dict[str, np.ndarray]], names: list[str]) -> DataFrame:
    """A row for each row: the panel, t, and what ``body`` makes of a slice; NaN comes out as null."""
    states, layout = incoming(series, stepper)[0], series.layout
    keys = layout.keys

    def part(table: pa.Table) -> pa.Table:
        table, number, values, first = _opened(layout, table)
        made = body(values, first, states[number])
        return pa.table({**{k: table[k] for k in [*keys, "t"]}, **{n: pa.array(made[n], pa.float64(), from_pandas=True) for n in names}})

    kept = [f for f in series.rows.schema.fields if f.name in {*keys, "t"}]
    schema = T.StructType([*sorted(kept, key=lambda f: [*keys, "t"].index(f.name)), *[T.StructField(n, T.DoubleType()) for n in names]])
    out = series.rows.groupBy("slice").applyInArrow(part, schema)
    return out.withColumnsRenamed(dict(zip(keys, series.panel, strict=True)))


# ---- affine models

@dataclass(frozen=True)
class AffineModel:
    """``s = a s + input`` at m points; before a series' first row the state is ``start``. ``inputs`` makes (n, m, k) of rows,
    ``first_inputs`` likewise for first rows where they don't follow from ``start``. Rows with ``gap`` go on by ``idle``."""

    a: np.ndarray
    start: np.ndarray
    inputs: Callable[[Rows], np.ndarray]
    first_inputs: Callable[[Rows], np.ndarray] | None = None
    gap: Callable[[Rows], np.ndarray] | None = None
    idle: np.ndarray | None = None

    def steps(self, rows: Rows, first: np.ndarray) -> Affine:
        b = self.inputs(rows)
        kind = first.astype(int)
        matrices = [self.a, np.zeros_like(self.a)]
        begun = self.first_inputs(rows) if self.first_inputs else b + (self.a @ self.start[..., None])[..., 0]
        b = np.where(first[:, None, None], begun, b)
        if self.gap:
            missing = self.gap(rows)
            kind = np.where(missing & ~first, 2, kind)
            b = np.where((missing & ~first)[:, None, None], 0.0, b)
            matrices.append(self.idle)
        return Affine(np.stack(matrices), kind, b)

    @property
    def stepper(self) -> Stepper:
        return Stepper(lambda rows, first: scan.composed(self.steps(rows, first)), lambda s, x: ((x[0] @ s[0][..., None])[..., 0] + x[1],), (self.start,))

    def run(self, rows: Rows, first: np.ndarray, state: tuple) -> tuple[np.ndarray, np.ndarray]:
        """The states before and after each row (n, m, k)."""
        after = scan.states(self.steps(rows, first), state[0])
        earlier = np.concatenate([state[0][None], after[:-1]])
        return np.where(first[:, None, None], self.start, earlier), after


def smoother(alpha: float, beta: float | None = None, gamma: float | None = None, period: int = 0, damping: float = 1.0, value: str = "y") -> AffineModel:
    """Exponential smoothing as error correction: level, with ``beta`` a trend, with ``gamma`` a season of ``period`` rows.
    A series starts at its first value, with no trend and no season. Gaps only carry the state on."""
    k = 2 + period
    f = np.zeros((k, k))
    f[0, 0] = 1.0
    f[0, 1] = f[1, 1] = damping if beta is not None else 0.0
    w = np.zeros(k)
    w[0], w[1] = 1.0, f[0, 1]
    g = np.zeros(k)
    g[0], g[1] = alpha, beta or 0.0
    if period:
        w[-1] = 1.0
        f[2, -1], g[2] = 1.0, gamma or 0.0
        f[3:, 2:-1] = np.eye(period - 1)
    a = f - np.outer(g, w)
    unit = np.eye(k)[0]
    clean = lambda rows: np.nan_to_num(rows[value])[:, None, None]
    return AffineModel(a[None], np.zeros((1, k)), lambda rows: clean(rows) * g, lambda rows: clean(rows) * unit, lambda rows: np.isnan(rows[value]), f[None])


def _smoothed(model: AffineModel, period: int, rows: Rows, first: np.ndarray, state: tuple) -> dict[str, np.ndarray]:
    before, after = (x[:, 0] for x in model.run(rows, first, state))
    ahead = model.idle[0][0]
    made = {"forecast": np.where(first, np.nan, before @ ahead + (before[:, -1] if period else 0.0)), "level": after[:, 0], "trend": after[:, 1]}
    return made | ({"season": after[:, 2]} if period else {})


def smooth(df: DataFrame, value: str, time: str, alpha: float, panel: tuple[str, ...] = (), *, beta: float | None = None, gamma: float | None = None, period: int = 0, damping: float = 1.0, per_slice: int = PER_SLICE) -> DataFrame:
    """Exponential smoothing (simple; with ``beta`` Holt's; with ``gamma`` and ``period`` Holt's and Winters' additive one) of
    each series in the order of its rows: panel, t, forecast (from earlier rows; null for the first), level, trend, season.
    ``beta`` and ``gamma`` are the shares of an error that go into trend and season."""
    if gamma is not None and period < 2:
        raise ValueError("a season has two rows at least")
    series = ordered(df, time, [value], panel, per_slice)
    model = smoother(alpha, beta, gamma, period, damping, value)
    names = ["forecast", "level", "trend", *(["season"] if period else [])]
    return mapped(series, model.stepper, lambda rows, first, state: _smoothed(model, period, rows, first, state), names)


def moving_average(df: DataFrame, value: str, time: str, before: int, after: int, panel: tuple[str, ...] = ()) -> DataFrame:
    """The mean over the rows from ``before`` earlier to ``after`` later ones of a series, over slices with their margins."""
    series = ordered(df, time, [value], panel)
    keys = series.layout.keys
    by, here = Window.partitionBy("_s", *keys).orderBy("t"), F.col("_s") == F.col("slice")
    last = max(series.layout.before, default=0)
    edge = Window.partitionBy("slice").orderBy(*keys, "t")
    back = Window.partitionBy("slice").orderBy(*[F.desc(k) for k in [*keys, "t"]])
    placed = series.rows.withColumns({"_head": F.row_number().over(edge), "_tail": F.row_number().over(back)})
    # a slice's first rows also follow the slice before, its last ones also precede the next
    targets = F.array_compact(F.array(F.col("slice"), F.when((F.col("_head") <= after) & (F.col("slice") > 0), F.col("slice") - 1), F.when((F.col("_tail") <= before) & (F.col("slice") < last), F.col("slice") + 1)))
    spread = placed.withColumn("_s", F.explode(targets))
    out = spread.withColumn("average", F.avg("v0").over(by.rowsBetween(-before, after))).where(here)
    return out.select(*[F.col(k).alias(p) for k, p in zip(keys, series.panel, strict=True)], "t", "average")


def exponential_fit(df: DataFrame, value: str, time: str, panel: tuple[str, ...] = (), *, trend: bool = False, period: int = 0, per_slice: int = PER_SLICE) -> Fit:
    """The smoothing weights with the least sum of squared one-step errors, on the log-odds scale, by Newton's method; the
    metrics hold the weights themselves, sse and rmse."""
    series = ordered(df, time, [value], panel, per_slice)
    names = ["alpha", *(["beta"] if trend else []), *(["gamma"] if period else [])]
    logistic = lambda x: 1 / (1 + np.exp(-x))

    def objective(points: np.ndarray) -> np.ndarray:
        made = []
        for p in points:
            w = dict(zip(names, logistic(p), strict=True))
            made.append(smoother(w["alpha"], w["alpha"] * w["beta"] if trend else None, w.get("gamma", 0.0) if period else None, period, 1.0, value))
        joint = AffineModel(np.concatenate([m.a for m in made]), np.concatenate([m.start for m in made]), lambda rows: np.concatenate([m.inputs(rows) for m in made], axis=1), lambda rows: np.concatenate([m.first_inputs(rows) for m in made], axis=1), made[0].gap, np.concatenate([m.idle for m in made]))

        def errors(rows: Rows, first: np.ndarray, state: tuple) -> np.ndarray:
            before, _ = joint.run(rows, first, state)
            ahead = before @ made[0].idle[0][0] + (before[..., -1] if period else 0.0)
            e = np.where(first[:, None], np.nan, rows[value][:, None] - ahead)
            return np.append(np.nansum(e * e, axis=0), np.sum(~np.isnan(e[:, 0])))

        total = summed(series, joint.stepper, errors)
        return -total[-1] / 2 * (np.log(2 * math.pi * total[:-1] / total[-1]) + 1)

    beta, v, ll = newton(objective, np.array([0.0] + [-2.0] * (len(names) - 1)))
    n = float(series.rows.where(F.col("v0").isNotNull() & ~F.isnan("v0")).count())
    return Fit(names, beta, v, None, {"n": n, "loglik": ll} | {f"weight_{k}": float(logistic(b)) for k, b in zip(names, beta, strict=True)})


# ---- maximisation

def newton(objective: Callable[[np.ndarray], np.ndarray], start: np.ndarray, *, scale: np.ndarray | None = None, steps: int = 50, tolerance: float = 1e-7) -> tuple[np.ndarray, np.ndarray, float]:
    """The maximum of an objective that takes many points at once: place, inverse of the negative Hessian, value. Points at
    which a model isn't defined have the value -inf. No convergence is an error."""
    at, scale = np.asarray(start, float), np.ones(len(start)) if scale is None else scale
    halves = 0.5 ** np.arange(0, 12)
    for _ in range(steps):
        value, gradient, hessian = scan.differences(objective, at, scale)
        if not math.isfinite(value):
            raise NotConverged("the likelihood is not finite at the start")
        if not (np.isfinite(gradient).all() and np.isfinite(hessian).all()):
            raise NotConverged("the likelihood is at the edge of where the model is defined")
        values, vectors = np.linalg.eigh(-hessian * np.outer(scale, scale))
        step = scale * (vectors @ ((vectors.T @ (gradient * scale)) / np.maximum(np.abs(values), 1e-8 * max(1.0, np.abs(values).max()))))
        gain = float(step @ gradient)
        if gain < tolerance * max(1.0, abs(value)) * 1e-2 and values.min() > 0:
            return at, np.linalg.inv(-hessian), value
        moved = objective(at + halves[:, None] * step)
        better = np.where(np.isfinite(moved), moved, -np.inf)
        if better.max() <= value:
            if gain < 1e-4 * max(1.0, abs(value)) * 1e-2 and values.min() > 0:  # below what differences resolve
                return at, np.linalg.inv(-hessian), value
            raise NotConverged("no step raises the likelihood")
        at = at + halves[int(np.argmax(better))] * step
    raise NotConverged(f"not converged in {steps} steps")


def _gaussian(e: np.ndarray, variance: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(e), 0.0, -0.5 * (math.log(2 * math.pi) + np.log(variance) + e * e / variance))


# ---- GARCH

def garch_model(points: np.ndarray, arch: int, garch: int, asymmetric: bool, variance: float, value: str) -> AffineModel:
    """State: the next row's variance and earlier ones, then squared deviations (each row's, also as counted below the mean)."""
    m, k = len(points), max(garch, 1) + 2 * arch
    mean, omega = points[:, 0], np.exp(points[:, 1])
    alphas, rest = points[:, 2 : 2 + arch], points[:, 2 + arch :]
    skew, betas = (rest[:, :arch], rest[:, arch:]) if asymmetric else (np.zeros((m, arch)), rest)
    g = max(garch, 1)
    a = np.zeros((m, k, k))
    a[:, 0, :garch] = betas
    a[:, 1:g, : g - 1] = np.eye(g - 1)
    for block, weights in ((g, alphas), (g + arch, skew)):
        a[:, 0, block : block + arch - 1] = weights[:, 1:]
        a[:, block + 1 : block + arch, block : block + arch - 1] = np.eye(arch - 1)
    start = np.full((m, k), variance)
    start[:, g + arch :] = variance / 2

    def inputs(rows: Rows) -> np.ndarray:
        e = np.nan_to_num(rows[value][:, None] - mean)
        b = np.zeros((len(e), m, k))
        b[..., g], b[..., g + arch] = e * e, np.where(e < 0, e * e, 0.0)
        b[..., 0] = omega + alphas[:, 0] * b[..., g] + skew[:, 0] * b[..., g + arch]
        return b

    return AffineModel(a, start, inputs)


def _driven(points: np.ndarray, arch: int, skew: np.ndarray, variance: float, value: str, shift: int, rows: Rows) -> np.ndarray:
    """What squared deviations add to the next variance (n, m), or with ``shift`` 1 to the row's own: the part that needs no
    state, only the values of earlier rows; before a series these count as the sample's variance."""
    means, which = np.unique(points[:, 0], return_inverse=True)
    omega, alphas = np.exp(points[:, 1]), points[:, 2 : 2 + arch]
    n = len(rows[value])
    out = np.repeat(omega[:, None], n, axis=1)
    term = np.empty(n)
    for i in range(arch):
        y = rows[lagged(value, i + shift) if i + shift else value]
        begun = ~np.isnan(y)
        for u, mean in enumerate(means):
            e = y - mean
            squares = np.where(begun, e * e, variance)
            below = np.where(begun, np.where(e < 0, squares, 0.0), variance / 2) if skew.any() else None
            for p in np.flatnonzero(which == u):
                out[p] += np.multiply(squares, alphas[p, i], out=term)
                if skew[p].any():
                    out[p] += np.multiply(below, skew[p, i], out=term)
    return out.T


def garch(df: DataFrame, value: str, time: str, panel: tuple[str, ...] = (), *, arch: int = 1, garch: int = 1, asymmetric: bool = False, robust: bool = False, per_slice: int = PER_SLICE) -> Fit:
    """GARCH(garch, arch) with a constant mean, or with ``asymmetric`` the threshold form of Glosten, Jagannathan and Runkle
    (an extra weight on squares below the mean); with ``garch=0`` ARCH. Maximum likelihood with normal errors; the variance
    before a series is the sample's. Names: mean, lnomega, arch1..., tarch1..., garch1.... ``robust``: with the scores'
    outer products, taken in one more pass. Rows with a null value are left out."""
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    series = packed(rows, value, time, panel, max(arch, 1), per_slice)
    n, middle, variance = series.rows.select(F.explode("v").alias("v")).agg(F.count("v"), F.avg("v"), F.var_pop("v")).first()
    if not n or not variance:
        raise ValueError("no rows, or no variance")
    names = ["mean", "lnomega", *[f"arch{i + 1}" for i in range(arch)], *([f"tarch{i + 1}" for i in range(arch)] if asymmetric else []), *[f"garch{i + 1}" for i in range(garch)]]

    def rowwise(points: np.ndarray) -> tuple[Stepper | None, Callable]:
        rest = points[:, 2 + arch :]
        skew, betas = (rest[:, :arch], rest[:, arch:]) if asymmetric else (np.zeros((len(points), arch)), rest)
        model = None
        if garch:  # only the variances go from row to row
            a = np.zeros((len(points), garch, garch))
            a[:, 0], a[:, 1:, :-1] = betas, np.eye(garch - 1)
            unit = np.eye(garch)[0]
            model = AffineModel(a, np.full((len(points), garch), variance), lambda rows: _driven(points, arch, skew, variance, value, 0, rows)[..., None] * unit)

        def loglik(rows: Rows, first: np.ndarray, state: tuple | None) -> np.ndarray:
            h = np.ascontiguousarray(model.run(rows, first, state)[0][..., 0].T) if model else _driven(points, arch, skew, variance, value, 1, rows).T
            with np.errstate(all="ignore"):
                for v, mean in zip(h, points[:, 0], strict=True):  # a point at a time stays in the processor's cache
                    if not model:
                        v[first] = variance
                    v[:] = np.where(v > 0, _gaussian(rows[value] - mean, v), -np.inf)
            return h.T

        return model.stepper if model else None, loglik

    def objective(points: np.ndarray) -> np.ndarray:
        stepper, loglik = rowwise(points)
        alive = (points[:, 2:] > -0.5).all(axis=1) & (np.abs(points[:, 2:]).sum(axis=1) < 3)
        total = summed(series, stepper, lambda rows, first, state: np.nan_to_num(loglik(rows, first, state).sum(axis=0), nan=-np.inf, neginf=-np.inf))
        return np.where(alive, total, -np.inf)

    each = 0.1 / arch
    start = np.array([middle, math.log(variance * (0.1 if garch else 0.9)), *[each] * arch, *([0.01] * arch if asymmetric else []), *[0.8 / max(garch, 1)] * garch])
    scale = np.array([math.sqrt(variance), *[1.0] * (len(names) - 1)])
    beta, v, ll = newton(objective, start, scale=scale)
    if robust:
        h = 1e-4 * scale
        points = np.concatenate([beta + np.diag(h), beta - np.diag(h)])
        stepper, loglik = rowwise(points)

        def outer(rows: Rows, first: np.ndarray, state: tuple) -> np.ndarray:
            x = loglik(rows, first, state)
            s = (x[:, : len(h)] - x[:, len(h) :]) / (2 * h)
            return s.T @ s

        v = v @ summed(series, stepper, outer).reshape(len(h), len(h)) @ v
    k = len(names)
    return Fit(names, beta, v, None, {"n": float(n), "loglik": ll, "aic": 2 * k - 2 * ll, "bic": math.log(n) * k - 2 * ll, "start_variance": variance})


def garch_variance(df: DataFrame, value: str, time: str, parameters: dict[str, float], start_variance: float, panel: tuple[str, ...] = (), *, per_slice: int = PER_SLICE) -> DataFrame:
    """panel, t, variance (of the row, from earlier ones), next (of the row after it), at given parameters of ``garch``."""
    count = lambda head: sum(1 for n in parameters if n.startswith(head))
    arch, lags, asymmetric = count("arch"), count("garch"), count("tarch") > 0
    names = ["mean", "lnomega", *[f"arch{i + 1}" for i in range(arch)], *([f"tarch{i + 1}" for i in range(arch)] if asymmetric else []), *[f"garch{i + 1}" for i in range(lags)]]
    series = ordered(df.where(F.col(value).isNotNull()), time, [value], panel, per_slice)
    model = garch_model(np.array([[parameters[n] for n in names]]), arch, lags, asymmetric, start_variance, value)

    def body(rows: Rows, first: np.ndarray, state: tuple) -> dict[str, np.ndarray]:
        before, after = model.run(rows, first, state)
        return {"variance": before[:, 0, 0], "next": after[:, 0, 0]}

    return mapped(series, model.stepper, body, ["variance", "next"])


def garch_forecast(fit: Fit, last: float, squared: float, steps: int) -> np.ndarray:
    """Variances of the rows after the last one of a GARCH(1, 1), from its variance and squared deviation."""
    p = dict(zip(fit.names, fit.beta, strict=True))
    skew = p.get("tarch1", 0.0)
    out = [math.exp(p["lnomega"]) + (p["arch1"] + skew / 2) * squared + p.get("garch1", 0.0) * last]
    for _ in range(steps - 1):
        out.append(math.exp(p["lnomega"]) + (p["arch1"] + skew / 2 + p.get("garch1", 0.0)) * out[-1])
    return np.array(out)


# ---- state-space models

def _kalman(model: Model, y: Callable[[Rows], np.ndarray]) -> Stepper:
    m, k = model.h.shape
    return Stepper(
        lambda rows, first: tuple(scan.summary(model, y(rows), first)),
        lambda s, parts: scan.applied(Element(*parts), *s),
        (np.zeros((m, k)), np.broadcast_to(np.eye(k), (m, k, k)).copy()),
    )


def _likelihood(series: Series, model: Model, y: Callable[[Rows], np.ndarray], alive: np.ndarray) -> np.ndarray:
    def body(rows: Rows, first: np.ndarray, state: tuple) -> np.ndarray:
        f = scan.filtered(model, y(rows), first, *state)
        with np.errstate(all="ignore"):
            return np.nan_to_num(_gaussian(f.error, f.variance).sum(axis=0), nan=-np.inf)

    return np.where(alive, summed(series, _kalman(model, y), body), -np.inf)


@dataclass(frozen=True)
class Arima:
    """Orders of an ARIMA model, seasonal ones for ``season`` rows a season."""

    p: int = 0
    d: int = 0
    q: int = 0
    sp: int = 0
    sd: int = 0
    sq: int = 0
    season: int = 0

    @property
    def states(self) -> int:
        return max(self.p + self.season * self.sp, self.q + self.season * self.sq + 1)

    def names(self, constant: bool, predictors: tuple[str, ...]) -> list[str]:
        some = lambda head, n: [f"{head}{i + 1}" for i in range(n)]
        return [*(["_cons"] if constant else []), *predictors, *some("ar", self.p), *some("ma", self.q), *some("sar", self.sp), *some("sma", self.sq), "lnsigma"]

    def polynomial(self, own: np.ndarray, seasonal: np.ndarray, sign: float) -> np.ndarray:
        """Coefficients from lag 1 of (1 - own)(1 - seasonal), or with plus signs."""
        far = np.zeros(self.season * len(seasonal) + 1)
        far[0] = 1.0
        far[self.season :: self.season or 1] = sign * seasonal if len(seasonal) else far[self.season :: self.season or 1]
        return sign * np.convolve(np.append(1.0, sign * own), far)[1:]


def _arma_matrices(order: Arima, ar: np.ndarray, ma: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Companion matrix, noise loading, stationary variance at unit noise, and whether the model is stationary."""
    k = order.states
    f = np.zeros((k, k))
    f[: len(ar), 0] = ar
    f[:-1, 1:] += np.eye(k - 1)
    g = np.zeros(k)
    g[0], g[1 : 1 + len(ma)] = 1.0, ma
    if np.abs(np.linalg.eigvals(f)).max(initial=0.0) >= 0.9999:
        return f, g, np.eye(k), False
    p = np.outer(g, g)
    step = f.copy()
    for _ in range(60):  # the sum of f^i g g' f'^i, doubled each time
        more = step @ p @ step.T
        p = p + more
        if np.abs(more).max() < 1e-14 * np.abs(p).max():
            break
        step = step @ step
    return f, g, p, True


def _arima_model(order: Arima, points: np.ndarray, constant: bool, predictors: int) -> tuple[Model, np.ndarray, np.ndarray]:
    at = constant + predictors
    mats, alive = [], []
    for x in points:
        parts = np.split(x[at:], np.cumsum([order.p, order.q, order.sp, order.sq]))
        f, g, p0, ok = _arma_matrices(order, order.polynomial(parts[0], parts[2], -1.0) if order.p or order.sp else np.zeros(0), order.polynomial(parts[1], parts[3], 1.0) if order.q or order.sq else np.zeros(0))
        mats.append((f, g, p0, math.exp(2 * min(x[-1], 300.0))))
        alive.append(ok)
    k, m = order.states, len(points)
    s2 = np.array([x[3] for x in mats])[:, None, None]
    model = Model(np.stack([x[0] for x in mats]), np.stack([np.outer(x[1], x[1]) for x in mats]) * s2, np.broadcast_to(np.eye(k)[0], (m, k)), np.zeros(m), points[:, 0] if constant else np.zeros(m), np.zeros((m, k)), np.stack([x[2] for x in mats]) * s2)
    return model, points[:, constant:at], np.array(alive)


def differenced(df: DataFrame, value: str, time: str, panel: tuple[str, ...], lag: int) -> DataFrame:
    """The value less that of exactly ``lag`` periods before; null where there is none. A join, so no series is one task."""
    earlier = df.select(*panel, (F.col(time) + lag).alias(time), F.col(value).alias("_earlier"))
    return df.join(earlier, [*panel, time], "left").withColumn(value, F.col(value) - F.col("_earlier")).drop("_earlier")


def _prepared(df: DataFrame, value: str, time: str, order: Arima, panel: tuple[str, ...], predictors: tuple[str, ...]) -> DataFrame:
    rows = df.select(*panel, F.col(time).cast("long").alias(time), *[F.col(c).cast("double").alias(c) for c in (value, *predictors)])
    for lag in [1] * order.d + [order.season] * order.sd:
        for c in (value, *predictors):
            rows = differenced(rows, c, time, panel, lag)
    if predictors:
        rows = rows.withColumn(value, F.when(~F.array_contains(F.array(*[F.col(c).isNull() | F.isnan(c) for c in predictors]), True), F.col(value))).na.fill(0.0, list(predictors))
    # a series begins with its first difference; later gaps stay
    begins = rows.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*panel).agg(F.min(time).alias("_begins"))
    joined = rows.join(begins, list(panel)) if panel else rows.join(F.broadcast(begins))
    return joined.where(F.col(time) >= F.col("_begins")).drop("_begins")


@dataclass(frozen=True)
class ArimaFit:
    fit: Fit
    order: Arima
    constant: bool
    predictors: tuple[str, ...]
    value: str
    time: str
    panel: tuple[str, ...] = field(default=())


def arima(df: DataFrame, value: str, time: str, order: Arima, panel: tuple[str, ...] = (), predictors: tuple[str, ...] = (), *, constant: bool = True, per_slice: int = PER_SLICE) -> ArimaFit:
    """ARIMA with predictors and seasonal factors: the exact likelihood of the differenced series by the Kalman filter, with
    the stationary distribution before a series' first row. ``time`` counts periods; a null value is a gap, and so is a row
    without the rows that its difference needs. Series of a panel share all parameters."""
    series = ordered(_prepared(df, value, time, order, panel, predictors), time, [value, *predictors], panel, per_slice)
    n, middle, variance = series.rows.agg(F.count("v0"), F.avg("v0"), F.var_pop("v0")).first()
    if not n or not variance:
        raise ValueError("no rows, or no variance")
    names = order.names(constant, predictors)

    def objective(points: np.ndarray) -> np.ndarray:
        model, slopes, alive = _arima_model(order, points, constant, len(predictors))
        return _likelihood(series, model, lambda rows: _adjusted(rows, value, predictors, slopes), alive)

    start = np.zeros(len(names))
    start[:constant] = middle
    lags = constant + len(predictors)
    start[lags : len(names) - 1] = [0.1] * order.p + [0.05] * order.q + [0.1] * order.sp + [0.05] * order.sq
    start[-1] = 0.5 * math.log(variance)
    scale = np.ones(len(names))
    scale[:constant] = math.sqrt(variance)
    if predictors:
        spread = series.rows.agg(*[F.stddev_pop(f"v{i + 1}") for i in range(len(predictors))]).first()
        scale[constant:lags] = math.sqrt(variance) / np.maximum(np.array(spread, float), 1e-12)
    beta, v, ll = newton(objective, start, scale=scale)
    k = len(names)
    return ArimaFit(Fit(names, beta, v, None, {"n": float(n), "loglik": ll, "aic": 2 * k - 2 * ll, "bic": math.log(n) * k - 2 * ll}), order, constant, predictors, value, time, panel)


def _adjusted(rows: Rows, value: str, predictors: tuple[str, ...], slopes: np.ndarray) -> np.ndarray:
    y = np.repeat(rows[value][:, None], len(slopes), axis=1)
    return y - np.column_stack([rows[c] for c in predictors]) @ slopes.T if predictors else y


def state_space_filter(df: DataFrame, value: str, time: str, model: Model, panel: tuple[str, ...] = (), *, per_slice: int = PER_SLICE) -> DataFrame:
    """The Kalman filter of any time-invariant model (``scan.Model`` at one point) over series in the order of their rows:
    panel, t, error and variance of each row's prediction, and its loglik (null for a gap)."""
    return kalman_filter(ordered(df, time, [value], panel, per_slice), model, lambda rows: rows[value][:, None])


def arima_filter(df: DataFrame, value: str, time: str, order: Arima, parameters: dict[str, float], panel: tuple[str, ...] = (), predictors: tuple[str, ...] = (), *, per_slice: int = PER_SLICE) -> DataFrame:
    """panel, t, error and variance of each row's prediction, and its loglik, on the differenced series."""
    constant = "_cons" in parameters
    series = ordered(_prepared(df, value, time, order, panel, predictors), time, [value, *predictors], panel, per_slice)
    points = np.array([[parameters[n] for n in order.names(constant, predictors)]])
    model, slopes, alive = _arima_model(order, points, constant, len(predictors))
    if not alive[0]:
        raise ValueError("the model is not stationary")
    return kalman_filter(series, model, lambda rows: _adjusted(rows, value, predictors, slopes))


def kalman_filter(series: Series, model: Model, y: Callable[[Rows], np.ndarray]) -> DataFrame:
    """panel, t, error and variance of each row's prediction and its loglik, for a state-space model at one point."""

    def body(rows: Rows, first: np.ndarray, state: tuple) -> dict[str, np.ndarray]:
        f = scan.filtered(model, y(rows), first, *state)
        seen = np.where(np.isnan(f.error), np.nan, _gaussian(f.error, f.variance))
        return {"error": f.error[:, 0], "variance": f.variance[:, 0], "loglik": seen[:, 0]}

    return mapped(series, _kalman(model, y), body, ["error", "variance", "loglik"])


def arima_forecast(df: DataFrame, fitted: ArimaFit, steps: int, *, per_slice: int = PER_SLICE) -> DataFrame:
    """step, t, forecast, std_error of the value itself for the periods after the last one of a single series without
    predictors; differences are summed up again from its last values."""
    order, fit, value, time = fitted.order, fitted.fit, fitted.value, fitted.time
    if fitted.panel or fitted.predictors:
        raise ValueError("forecasts are made for a single series without predictors")
    series = ordered(_prepared(df, value, time, order, (), ()), time, [value], (), per_slice)
    model, _, _ = _arima_model(order, fit.beta[None], fitted.constant, 0)
    _, (mean, spread) = incoming(series, _kalman(model, lambda rows: rows[value][:, None]), whole=True)
    polynomial = np.array([1.0])
    for lag in [1] * order.d + [order.season] * order.sd:
        polynomial = np.convolve(polynomial, np.eye(lag + 1)[0] - np.eye(lag + 1)[lag])
    back = len(polynomial) - 1
    newest = series.rows.agg(F.max("t")).first()[0]
    tail = {int(r[0]): float(r[1]) for r in df.select(F.col(time).cast("long"), F.col(value).cast("double")).where((F.col(time) > newest - max(back, 1)) & F.col(value).isNotNull()).collect()}
    if any(newest - i not in tail for i in range(back)):
        raise ValueError("the last values have gaps, so differences can't be summed up")
    f, q, d = model.f[0], model.q[0], float(model.d[0])
    state, variance, ahead = mean[0], spread[0], []
    covariance = np.zeros((steps, steps))
    for i in range(steps):
        state, variance = f @ state, f @ variance @ f.T + q
        ahead.append(state[0] + d)
        row = variance[:, 0]  # of the states at this step and those to come with this step's value
        for j in range(i, steps):
            covariance[i, j] = covariance[j, i] = row[0]
            row = f @ row
    values = [tail[newest - i] for i in range(back - 1, -1, -1)]
    for x in ahead:
        values.append(x - sum(polynomial[j] * values[-j] for j in range(1, back + 1)))
    toeplitz = sum((polynomial[j] * np.eye(steps, k=-j) for j in range(min(back, steps - 1) + 1)), np.zeros((steps, steps)))
    undone = np.linalg.inv(toeplitz)
    total, errors = values[back:], np.sqrt(np.diag(undone @ covariance @ undone.T))
    spark = df.sparkSession
    return small(spark, [(i + 1, newest + i + 1, float(total[i]), float(errors[i])) for i in range(steps)], "step int, t long, forecast double, std_error double")


# ---- unobserved components

def _component_model(points: np.ndarray, trend: bool, season: int, variance: float, middle: float) -> Model:
    """Level, with ``trend`` a slope, with ``season`` dummies that sum to noise; parameters are log variances."""
    m, k = len(points), 1 + trend + max(season - 1, 0)
    f, h = np.zeros((k, k)), np.zeros(k)
    f[0, 0] = h[0] = 1.0
    if trend:
        f[0, 1] = f[1, 1] = 1.0
    at = 1 + trend
    if season:
        f[at, at:] = -1.0
        f[at + 1 :, at:-1] = np.eye(season - 2)
        h[at] = 1.0
    v = np.exp(np.clip(points, -200, 200))
    q = np.zeros((m, k, k))
    places = [0, *([1] if trend else []), *([at] if season else [])]
    for i, place in enumerate(places):
        q[:, place, place] = v[:, i + 1]
    a0 = np.zeros(k)
    a0[0] = middle
    return Model(np.broadcast_to(f, (m, k, k)), q, np.broadcast_to(h, (m, k)), v[:, 0], np.zeros(m), np.broadcast_to(a0, (m, k)), np.broadcast_to(np.eye(k) * 1e6 * variance, (m, k, k)))


COMPONENTS = ["irregular", "level", "slope", "seasonal"]


def components(df: DataFrame, value: str, time: str, panel: tuple[str, ...] = (), *, trend: bool = False, season: int = 0, per_slice: int = PER_SLICE) -> Fit:
    """An unobserved-components model: level and irregular part, with ``trend`` a slope, with ``season`` a dummy season; names
    lnvar_irregular, lnvar_level, .... Before a series the state's variance is a million times the sample's (nearly diffuse),
    and the likelihood counts that. Gaps are predicted over."""
    series = ordered(df, time, [value], panel, per_slice)
    n, middle, variance = series.rows.agg(F.count("v0"), F.avg("v0"), F.var_pop("v0")).first()
    if not n or not variance:
        raise ValueError("no rows, or no variance")
    names = [f"lnvar_{c}" for c, has in zip(COMPONENTS, (True, True, trend, bool(season)), strict=True) if has]
    y = lambda rows: rows[value][:, None]
    objective = lambda points: _likelihood(series, _component_model(points, trend, season, variance, middle), y, (np.abs(points) < 150).all(axis=1))
    start = math.log(variance) + np.array([-1.0, -2.0, *([-5.0] if trend else []), *([-4.0] if season else [])])
    beta, v, ll = newton(objective, start)
    return Fit(names, beta, v, None, {"n": float(n), "loglik": ll, "variance": variance, "middle": middle})


def components_filter(df: DataFrame, value: str, time: str, variances: dict[str, float], panel: tuple[str, ...] = (), *, variance: float, middle: float = 0.0, season: int = 0, per_slice: int = PER_SLICE) -> DataFrame:
    """panel, t, prediction, variance (of its error), level, and slope and season where the model has them, all from the rows up
    to t, at given variances (irregular, level, slope, seasonal). ``variance`` and ``middle``: as in ``components``."""
    trend = "slope" in variances
    series = ordered(df, time, [value], panel, per_slice)
    with np.errstate(divide="ignore"):
        point = np.log([[variances[c] for c in COMPONENTS if c in variances]])
    model = _component_model(point, trend, season, variance, middle)
    y = lambda rows: rows[value][:, None]
    names = ["prediction", "variance", "level", *(["slope"] if trend else []), *(["season"] if season else [])]

    def body(rows: Rows, first: np.ndarray, state: tuple) -> dict[str, np.ndarray]:
        f = scan.filtered(model, y(rows), first, *state)
        before = np.concatenate([state[0][None], f.mean[:-1]])
        ahead = np.where(first[:, None, None], model.a0, np.einsum("mij,nmj->nmi", model.f, before))
        made = {"prediction": (ahead * model.h).sum(-1)[:, 0], "variance": f.variance[:, 0], "level": f.mean[:, 0, 0]}
        return made | ({"slope": f.mean[:, 0, 1]} if trend else {}) | ({"season": f.mean[:, 0, 1 + trend]} if season else {})

    return mapped(series, _kalman(model, y), body, names)
