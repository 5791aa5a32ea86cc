"""Random intercepts in likelihoods, integrated out by adaptive Gauss-Hermite quadrature.

Any model of ``mle`` takes ``panel=...``: its first index then holds a normal effect of the row's panel. Every row adds its
log likelihood, score and curvature at each node of its panel; Spark sums these by panel, first within tasks, so rows of a
panel are never gathered, and what meets is one vector a panel and task. A panel's nodes are then weighed, which gives its
likelihood, score and information, and the place and width of its effect's distribution, by which its nodes lie in the next pass.

Equal rows of a panel are one with a count, and rows are kept in ranges of panels, so a task meets few panels and sends few
vectors; a panel of many rows spreads over several ranges.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystat.functions.jets import HALF_LOG_2PI, Jet
from quarrystat.operators import mle
from quarrystat.operators.linear import Fit
from quarrystat.sources.tables import release, written


#: Up to so many panels, the places of their nodes go to all tasks; those of more are joined by a shuffle.
BROADCAST = 1_000_000


@dataclass(frozen=True)
class RandomFit(Fit):
    """``effects``: panel, effect and deviation (posterior mean and standard deviation, times sigma_u)."""

    effects: DataFrame | None = None


def _grouped(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal codes together, and where each begins in it."""
    order = np.argsort(codes, kind="stable")
    return order, np.flatnonzero(np.append(True, np.diff(codes[order]) != 0))


def _node_sums(problem: mle.Problem, beta: np.ndarray, z: np.ndarray):
    """Batches of rows (with a and s of their panel) to a vector for each panel and node: log likelihood, score, upper
    triangle of the curvature."""
    equations = problem.equations
    where = np.repeat(np.arange(len(equations)), [len(e.names) for e in equations])
    k = len(beta)
    sigma = math.exp(beta[-1])
    rows_, cols_ = np.triu_indices(k)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            c = {n: b[n].to_numpy(zero_copy_only=False).astype(float) for n in b.schema.names if n != "cluster"}
            n, m = b.num_rows, len(z)
            xs = [np.column_stack([np.zeros((n, 0)), *[c[f"x{i}_{j}"] for j in range(len(e.terms))], *([np.ones(n)] if e.constant else [])]) for i, e in enumerate(equations)]
            u = c["a"][:, None] + math.sqrt(2) * c["s"][:, None] * z
            etas = [np.repeat(x @ beta[:-1][where == i], m) for i, x in enumerate(xs)]
            etas[0] = etas[0] + sigma * u.ravel()
            with np.errstate(all="ignore"):
                l = problem.loglik({o: np.repeat(c[f"y{i}"], m) for i, o in enumerate(problem.outcomes)}, Jet.variables(etas))
            g, h = l.g.reshape(-1, n, m), l.h.reshape(len(xs), len(xs), n, m)
            at = [*where, 0]
            design = [*[np.repeat(x[:, [j]], m, axis=1) for x in xs for j in range(x.shape[1])], sigma * u]
            parts = [l.v.reshape(n, m), *[g[at[i]] * design[i] for i in range(k)]]
            parts += [h[at[i], at[j]] * design[i] * design[j] + (g[0] * design[-1] if i == j == k - 1 else 0.0) for i, j in zip(rows_, cols_, strict=True)]
            cluster = b["cluster"].dictionary_encode()
            order, begins = _grouped(cluster.indices.to_numpy())
            times = c["n"][:, None]
            total = np.stack([np.add.reduceat((part * times)[order], begins) for part in parts], axis=2).reshape(len(begins), -1)
            first = pa.array(order[begins])
            yield pa.RecordBatch.from_arrays([b["cluster"].take(first), b["a"].take(first), b["s"].take(first), pa.array(list(total), pa.list_(pa.float64()))], ["cluster", "a", "s", "x"])

    return sums


def _summit(u: np.ndarray, t: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the highest of each row's values has its summit, and the deviation of a normal law with its curvature there, by a
    parabola through it and its neighbours. Where that has no summit the highest place stays, with twice the deviation."""
    i = np.clip(t.argmax(axis=1), 1, t.shape[1] - 2)
    at = np.arange(len(t))
    x = [u[at, i + d] - u[at, i] for d in (-1, 1)]
    y = [t[at, i + d] - t[at, i] for d in (-1, 1)]
    det = x[0] * x[1] * (x[0] - x[1])
    with np.errstate(all="ignore"):
        bend = (x[1] * y[0] - x[0] * y[1]) / det
        slope = (x[0] ** 2 * y[1] - x[1] ** 2 * y[0]) / det
        good = np.isfinite(bend) & np.isfinite(slope) & (bend < 0)
        move = np.where(good, -slope / (2 * np.where(good, bend, -1.0)), 0.0)
        width = np.where(good, np.sqrt(-0.5 / np.where(good, bend, -1.0)), 2 * s)
    reach = 3 * np.ptp(u, axis=1)
    return u[at, i] + np.clip(move, -reach, reach), np.clip(width, 1e-6, 4 * s)


def _weighed(k: int, z: np.ndarray, w: np.ndarray, sigma: float):
    """Sorted node sums to a row for each panel: a and s for its next nodes (times sigma, so they hold at another sigma too), and log likelihood, score, information, and the
    mean and deviation of its effect."""
    rows_, cols_ = np.triu_indices(k)

    def finish(a: np.ndarray, s: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = x.reshape(len(a), len(z), -1)
        u = a[:, None] + math.sqrt(2) * s[:, None] * z
        log_posterior = x[..., 0] - u * u / 2 - HALF_LOG_2PI
        t = log_posterior + np.log(w) + z * z + np.log(math.sqrt(2) * s)[:, None]
        top = t.max(axis=1, keepdims=True)
        ll = np.log(np.exp(t - top).sum(axis=1)) + top[:, 0]
        p = np.exp(t - ll[:, None])
        score = np.einsum("gm,gmk->gk", p, x[..., 1 : 1 + k])
        outer = x[..., 1:][..., rows_] * x[..., 1:][..., cols_]
        information = score[:, rows_] * score[:, cols_] - np.einsum("gm,gmk->gk", p, x[..., 1 + k :] + outer)
        mean = (p * u).sum(axis=1)
        spread = np.sqrt(np.maximum((p * u * u).sum(axis=1) - mean**2, 0.0))
        # moments place nodes best once several of them count; before that the summit leads there
        settled = (p * p).sum(axis=1) < 0.4
        place, width = _summit(u, log_posterior, s)
        return sigma * np.where(settled, mean, place), sigma * np.where(settled, spread, width), np.column_stack([ll, score, information, mean, spread])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def made(t: pa.Table) -> pa.RecordBatch:
            codes = pa.compute.run_end_encode(t["cluster"].combine_chunks())
            begins = np.append(0, codes.run_ends.to_numpy()[:-1]) if len(t) else np.zeros(0, int)
            x = np.add.reduceat(np.array(t["x"].combine_chunks().flatten()).reshape(len(t), -1), begins)
            first = pa.array(begins)
            mean, spread, out = finish(t["a"].take(first).to_numpy(), t["s"].take(first).to_numpy(), x)
            return pa.RecordBatch.from_arrays([t["cluster"].take(first).combine_chunks(), pa.array(mean), pa.array(spread), pa.array(list(out), pa.list_(pa.float64()))], ["cluster", "a", "s", "t"])

        for b in batches:
            if not b.num_rows:
                continue
            held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            last = held["cluster"][len(held) - 1]  # may go on in the next batch
            cut = pa.compute.sum(pa.compute.not_equal(held["cluster"], last)).as_py()
            if cut:
                yield made(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None:
            yield made(held)

    return weigh


def _measured(rows: DataFrame, problem: mle.Problem, beta: np.ndarray, nodes: int, places: DataFrame | None) -> tuple[float, np.ndarray, np.ndarray, DataFrame]:
    """Log likelihood, score, information, and the panels with the places of their next nodes; without ``places`` the nodes
    are those of the effects' own distribution."""
    z, w = np.polynomial.hermite.hermgauss(nodes)
    k, sigma = len(beta), math.exp(beta[-1])
    if places is None:
        placed = rows.withColumns({"a": F.lit(0.0), "s": F.lit(1.0)})
    else:
        own = places.select("cluster", (F.col("a") / sigma).alias("a"), (F.col("s") / sigma).alias("s"))
        placed = rows.join(F.broadcast(own) if places.count() <= BROADCAST else own, "cluster")
    parts = placed.mapInArrow(_node_sums(problem, beta, z), "cluster string, a double, s double, x array<double>")
    panels = written(parts.repartition("cluster").sortWithinPartitions("cluster").mapInArrow(_weighed(k, z, w, sigma), "cluster string, a double, s double, t array<double>"))
    got = mle._reduce_lists(panels, "t")
    information = np.zeros((k, k))
    information[np.triu_indices(k)] = got[1 + k : -2]
    return got[0], got[1 : 1 + k], information + np.triu(information, 1).T, panels


def _panel_rows(df: DataFrame, problem: mle.Problem, panel: str) -> DataFrame:
    """What the model reads of the different rows of each panel, and n, how often each stands there, in ranges of panels."""
    rows = mle._read(df, problem, None, panel).drop("w").withColumn("cluster", F.col("cluster").cast("string"))
    names = ["cluster", *[c for c in rows.columns if c != "cluster"]]
    counted = written(rows.groupBy(*names).agg(F.count(F.lit(1)).cast("double").alias("n")))
    ranged = written(counted.repartitionByRange(*names).sortWithinPartitions("cluster"))
    release(counted)
    return ranged


def evaluated(df: DataFrame, problem: mle.Problem, panel: str, beta: list[float], *, nodes: int = 12, passes: int = 4) -> DataFrame:
    """panel, loglik, effect, deviation at given coefficients, the last of which is lnsigma_u."""
    rows, at, places = _panel_rows(df, problem, panel), np.array(beta, float), None
    for _ in range(passes):
        *_, places = _measured(rows, problem, at, nodes, places)
    sigma = F.lit(math.exp(at[-1]))
    return _effects(places, panel, sigma)


def _effects(places: DataFrame, panel: str, sigma: Column) -> DataFrame:
    return places.select(F.col("cluster").alias(panel), F.col("t")[0].alias("loglik"), (F.element_at("t", -2) * sigma).alias("effect"), (F.element_at("t", -1) * sigma).alias("deviation"))


def maximise(df: DataFrame, problem: mle.Problem, panel: str, *, nodes: int = 12, alpha: float = 0.05, steps: int = 60, tolerance: float = 1e-9, start_sigma: float | None = None) -> RandomFit:
    """The maximum with a normal effect of ``panel`` in the first index; names as in ``mle.maximise``, and lnsigma_u. The
    covariance is the inverse of the observed information. Rows with a null panel or a null in what is read are left out;
    an empty table is an error, and so are panels that don't differ (the deviation goes to zero). Metrics: n, groups,
    loglik, loglik_pooled, sigma_u."""
    rows_in = df.where(F.col(panel).isNotNull())
    pooled = mle.maximise(rows_in, problem)
    rows = _panel_rows(rows_in, problem, panel)
    labels = [*pooled.names, "lnsigma_u"]
    k = len(labels)
    spread = dict(zip(pooled.names, pooled.beta, strict=True)).get("lnsigma:_cons")
    begin = math.log(start_sigma) if start_sigma else spread - 0.7 if spread is not None else math.log(0.7)
    beta = np.append(pooled.beta, begin)
    measure = lambda b, places: _measured(rows, problem, b, nodes, places)
    ll, score, info, places = measure(beta, None)
    for _ in range(3):  # nodes find their places
        before, used = ll, places
        ll, score, info, places = measure(beta, used)
        release(used)
        if abs(ll - before) < 1e-7 * abs(ll):
            break
    if not math.isfinite(ll):
        raise mle.NotConverged("the likelihood is not finite at the start")
    for _ in range(steps):
        scale = 1 / np.sqrt(np.maximum(np.abs(np.diag(info)), 1e-300))
        values, vectors = np.linalg.eigh(info * np.outer(scale, scale))
        step = scale * (vectors @ ((vectors.T @ (score * scale)) / np.maximum(np.abs(values), 1e-6)))
        gain = float(step @ score)
        if gain <= tolerance * max(1.0, abs(ll)) * 1e-2 and values.min() > 0:
            break
        size, better = min(1.0, 0.7 / max(abs(step[-1]), 1e-300)), lambda m: math.isfinite(m[0]) and m[0] >= ll - 1e-7 * abs(ll)  # noqa: B023
        for _ in range(20):
            moved = measure(beta + size * step, places)
            if not better(moved):
                first = moved[3]
                moved = measure(beta + size * step, first)  # once more, with nodes that have moved along
                release(first)
            if better(moved):
                break
            release(moved[3])
            size /= 2
        else:
            raise mle.NotConverged("no step raises the likelihood")
        beta, used = beta + size * step, places
        ll, score, info, places = moved
        release(used)
        if beta[-1] < -8:
            raise mle.NotConverged("the panels don't differ: the deviation of their effects goes to zero")
    else:
        raise mle.NotConverged(f"not converged in {steps} steps")
    sigma = math.exp(beta[-1])
    effects = _effects(places, panel, F.lit(sigma)).drop("loglik")
    metrics = {"n": pooled.metrics["n"], "groups": float(places.count()), "loglik": ll, "loglik_pooled": pooled.metrics["loglik"], "sigma_u": sigma, "aic": 2 * k - 2 * ll}
    return RandomFit(labels, beta, np.linalg.inv(info), None, metrics, alpha, effects)


def share_of_variance(fit: Fit, own: float = math.pi**2 / 3) -> float:
    """The share of the effects in the variance of the latent outcome: ``own`` is a row's, pi^2 / 3 for logit, 1 for probit."""
    s2 = fit.metrics["sigma_u"] ** 2
    return s2 / (s2 + own)


def no_effects_test(fit: Fit) -> tuple[float, float]:
    """The likelihood-ratio statistic of sigma_u = 0 and its p-value, half a chi-square tail as the null is at the edge."""
    from quarrystat.functions import dist

    lr = max(0.0, 2 * (fit.metrics["loglik"] - fit.metrics["loglik_pooled"]))
    return lr, 0.5 * dist.chi2_sf(lr, 1)
