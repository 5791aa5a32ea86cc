"""Resampling of cluster scores: wild cluster tests and confidence sets for least squares, and score tests for likelihoods.

Everything that a draw needs of a cluster are sums over it: its scores at the restricted fit, and its cross-products. Clusters
are summed once; tasks multiply them by the draws' signs and return sums by draw. Restricted residuals are linear in the
value that is tested, so both statistics of a draw are ratios of polynomials in it, and a confidence set is found from one
pass, by solving on the driver. With few clusters all sign patterns are gone through, so the test is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystat.functions.jets import Jet
from quarrystat.operators import mle
from quarrystat.plans.spec import Spec, design
from quarrystat.sources.tables import written

#: Up to so many clusters all sign patterns are enumerated.
FEW = 12


def _signs(h: np.ndarray, place: np.ndarray, draws: int, few: bool) -> np.ndarray:
    """Signs (cluster, draw): by the cluster's hash, or the bits of the draw's number at the cluster's place."""
    if few:
        return np.where(np.arange(draws)[None, :] >> place[:, None] & 1, -1.0, 1.0)
    x = h.view(np.uint64)[:, None] + np.arange(1, draws + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.where((x ^ (x >> np.uint64(31))) >> np.uint64(40) & np.uint64(1), 1.0, -1.0)


def _reduced(clusters: DataFrame, body) -> np.ndarray:
    """Sums over clusters of what ``body`` makes of hashes, places and the clusters' sums."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                part = body(b["h"].to_numpy(), b["place"].to_numpy(), b["s"].flatten().to_numpy().reshape(b.num_rows, -1)).ravel()
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["i", "x"])

    got = clusters.mapInArrow(sums, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).toArrow()
    out = np.zeros(got.num_rows)
    out[got["i"].to_numpy()] = got["x"].to_numpy()
    return out


def _placed(sums: DataFrame, seed: int) -> tuple[DataFrame, int]:
    """Cluster sums with a hash, and a place where they are few; and their number."""
    made = written(sums.withColumn("h", F.xxhash64(F.lit(seed), "g")))
    number = made.count()
    if number < 2:
        raise ValueError("fewer than two clusters")
    if number > FEW:
        return made.withColumn("place", F.lit(0).cast("long")), number
    order = made.sparkSession.createDataFrame([(r["h"], i) for i, r in enumerate(made.select("h").orderBy("h").collect())], "_h long, place long")
    return written(made.join(order, F.col("h") == F.col("_h")).drop("_h")), number


@dataclass(frozen=True)
class WildTest:
    """The draws of a test of one coefficient as functions of its value b: numerators n0 + n1 b, squared denominators
    d0 + d1 b + d2 b^2; the first draw is the sample itself."""

    estimate: float
    numerators: np.ndarray  # (2, draws)
    denominators: np.ndarray  # (3, draws)
    clusters: int
    exact: bool

    def statistic(self, value: float) -> np.ndarray:
        n = self.numerators[0] + self.numerators[1] * value
        d = self.denominators[0] + self.denominators[1] * value + self.denominators[2] * value**2
        with np.errstate(all="ignore"):
            return np.where(d > 1e-300, n / np.sqrt(np.maximum(d, 1e-300)), 0.0)

    def p_value(self, value: float = 0.0) -> float:
        """The share of draws that are as far out as the sample. The sample counts as a draw; enumerated patterns include it."""
        t = np.abs(self.statistic(value))
        beyond = t[1:] >= t[0] * (1 - 1e-9)
        return float(beyond.mean()) if self.exact else float((1 + beyond.sum()) / len(t))

    def confidence_set(self, alpha: float = 0.05) -> tuple[float, float]:
        """The values around the estimate that aren't rejected; an end that isn't found is infinite."""
        ends = []
        t0 = self.denominators[0, 0] ** 0.5 if self.denominators[0, 0] > 0 else 1.0
        for sign in (-1, 1):
            inside, step = self.estimate, max(abs(t0), 1e-12 * max(1.0, abs(self.estimate)))
            outside = None
            for _ in range(80):
                at = inside + sign * step
                if self.p_value(at) <= alpha:
                    outside = at
                    break
                inside, step = at, step * 2
            if outside is None:
                ends.append(sign * float("inf"))
                continue
            for _ in range(100):
                middle = (inside + outside) / 2
                inside, outside = (middle, outside) if self.p_value(middle) > alpha else (inside, middle)
            ends.append((inside + outside) / 2)
        return ends[0], ends[1]


def wild_cluster(df: DataFrame, spec: Spec, term: str, cluster: str, *, draws: int = 999, seed: int = 0) -> WildTest:
    """The wild cluster test of a coefficient with its value imposed on the residuals (Rademacher signs), studentised by the
    clustered variance. Draws repeat, however rows lie. Up to twelve clusters all sign patterns are taken instead. Rows
    with a null in a used column are left out; a term that others explain is an error."""
    rows, names = design(df, spec, (cluster,))
    k = len(names)
    if term not in names:
        raise ValueError(f"no term {term}")
    xs, y = [F.col(f"x{i}") for i in range(k)], F.col("y")
    parts = [F.col("w") * a * b for a in xs for b in xs] + [F.col("w") * a * y for a in xs]
    sums = rows.groupBy(F.col(f"k_{cluster}").cast("string").alias("g")).agg(F.array(*[F.sum(p) for p in parts]).alias("s"))
    clusters, number = _placed(sums, seed)
    whole = _reduced(clusters, lambda h, place, s: s.sum(axis=0))
    gram, cross = whole[: k * k].reshape(k, k), whole[k * k :]
    if np.linalg.matrix_rank(gram) < k:
        raise ValueError("terms explain each other")
    inverse, at = np.linalg.inv(gram), names.index(term)
    beta = inverse @ cross
    few = number <= FEW
    draws = 1 << number if few else draws
    # the restricted fit is b0 + b1 value; its scores by cluster likewise
    rest = [i for i in range(k) if i != at]
    inner = np.linalg.inv(gram[np.ix_(rest, rest)]) if rest else np.zeros((0, 0))
    b0, b1 = np.zeros(k), np.zeros(k)
    b0[rest], b1[rest], b1[at] = inner @ cross[rest], -inner @ gram[rest, at], 1.0
    c = inverse[at]

    def scores(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        m = s[:, : k * k].reshape(-1, k, k)
        return s[:, k * k :] - m @ b0, -(m @ b1), m @ c

    def signed(h, place, s):
        v = np.column_stack([np.ones(len(h)), _signs(h, place, draws, few)])
        s0, s1, _ = scores(s)
        return np.stack([v.T @ s0, v.T @ s1])

    moved = _reduced(clusters, signed).reshape(2, draws + 1, k) @ inverse.T  # coefficients less the restricted ones

    def spread(h, place, s):
        v = np.column_stack([np.ones(len(h)), _signs(h, place, draws, few)])
        s0, s1, mc = scores(s)
        p, q = v * (s0 @ c)[:, None] - mc @ moved[0].T, v * (s1 @ c)[:, None] - mc @ moved[1].T
        return np.stack([(p * p).sum(axis=0), 2 * (p * q).sum(axis=0), (q * q).sum(axis=0)])

    return WildTest(float(beta[at]), moved[:, :, at], _reduced(clusters, spread).reshape(3, draws + 1), number, few)


def score_test(df: DataFrame, problem: mle.Problem, term: str, cluster: str, *, value: float = 0.0, draws: int = 999, seed: int = 0) -> tuple[float, float]:
    """The score test of a coefficient of a one-index likelihood with its value imposed, and its p-value from signs on the
    clusters' scores, cleared of the other coefficients' (after Kline and Santos)."""
    (equation,) = problem.equations
    if term not in equation.terms:
        raise ValueError(f"no term {term}")
    offset = f"_offset_{term}".replace(":", "_")
    rest = mle.Equation(equation.name, tuple(t for t in equation.terms if t != term), equation.constant)
    rows_in = df.withColumn(offset, mle.expression(term) * F.lit(float(value)))
    held = mle.Problem(lambda y, e: problem.loglik(y, [e[0] + y[offset]]), (*problem.outcomes, offset), (rest,), problem.start)
    fit = mle.maximise(rows_in.where(F.col(cluster).isNotNull() & F.col(offset).isNotNull()), held)
    full = mle.Problem(held.loglik, held.outcomes, (equation,))
    rows = mle._read(rows_in, full, None, cluster)
    names, k = equation.names, len(equation.names)
    at, beta = names.index(term), np.zeros(k)
    for name, b in zip(fit.names, fit.beta, strict=True):
        beta[names.index(name)] = b
    loglik, outcomes, terms = held.loglik, held.outcomes, equation.terms

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            x = np.column_stack([*[b[f"x0_{j}"].to_numpy() for j in range(len(terms))], *([np.ones(n)] if equation.constant else [])])
            l = loglik({o: b[f"y{i}"].to_numpy(zero_copy_only=False).astype(float) for i, o in enumerate(outcomes)}, Jet.variables([x @ beta]))
            s = np.column_stack([l.g[0][:, None] * x, (l.h[0, 0][:, None, None] * x[:, :, None] * x[:, None, :]).reshape(n, -1)])
            yield pa.RecordBatch.from_arrays([b["cluster"].cast(pa.string()), pa.array(list(s), pa.list_(pa.float64()))], ["g", "s"])

    width = k + k * k
    each = rows.mapInArrow(score, "g string, s array<double>").groupBy("g").agg(F.array(*[F.sum(F.col("s")[i]) for i in range(width)]).alias("s"))
    clusters, number = _placed(each, seed)
    hessian = _reduced(clusters, lambda h, place, s: s.sum(axis=0))[k:].reshape(k, k)
    others = [i for i in range(k) if i != at]
    clear = np.zeros(k)
    clear[at] = 1.0
    if others:
        clear[others] = -np.linalg.solve(hessian[np.ix_(others, others)], hessian[others, at])
    few = number <= FEW
    draws = 1 << number if few else draws

    def signed(h, place, s):
        v = np.column_stack([np.ones(len(h)), _signs(h, place, draws, few)])
        z = s[:, :k] @ clear
        return np.stack([v.T @ z, np.full(draws + 1, z @ z)])

    total, square = _reduced(clusters, signed).reshape(2, draws + 1)
    mean = total / number
    t = total / np.sqrt(np.maximum(square - number * mean**2, 1e-300))
    beyond = np.abs(t[1:]) >= abs(t[0]) * (1 - 1e-9)
    return float(t[0]), float(beyond.mean()) if few else float((1 + beyond.sum()) / (draws + 1))
