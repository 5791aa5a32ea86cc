"""Models that need cross-products alone: one pass for the sums, K by K algebra on the driver."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystat.functions import dist
from quarrystat.operators.linear import Fit, gram, ols, products_of
from quarrystat.plans.spec import INTERCEPT, Spec, design
from quarrystat.sources.tables import small


def crossed(df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means and cross-products about the means of plain columns, over complete rows."""
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).na.drop()
    return gram(rows, [F.col(f"`{c}`") for c in columns])


def constrained(df: DataFrame, spec: Spec, constraints: list[tuple[dict[str, float], float]]) -> Fit:
    """Least squares under linear constraints, each a combination of coefficients and its value."""
    rows, names = design(df, spec)
    k = len(names)
    n, means, products = gram(rows, [F.col("y"), *[F.col(f"x{i}") for i in range(k)]])
    raw = products + n * np.outer(means, means)
    r = np.array([[c.get(m, 0.0) for m in names] for c, _ in constraints])
    value = np.array([v for _, v in constraints])
    inverse = np.linalg.inv(raw[1:, 1:])
    free = inverse @ raw[1:, 0]
    pull = inverse @ r.T @ np.linalg.inv(r @ inverse @ r.T)
    beta = free - pull @ (r @ free - value)
    rss = raw[0, 0] - 2 * beta @ raw[1:, 0] + beta @ raw[1:, 1:] @ beta
    df_t = n - k + len(constraints)
    return Fit(names, beta, (inverse - pull @ r @ inverse) * rss / df_t, df_t, {"n": float(n), "rss": float(rss)}, spec.alpha)


def ridge(df: DataFrame, outcome: str, predictors: list[str], penalty: float) -> dict[str, float]:
    """Ridge coefficients on standardised predictors, given back in the predictors' units, with the constant free."""
    n, means, products = crossed(df, [outcome, *predictors])
    scale = np.sqrt(np.diag(products)[1:] / n)
    z = products[1:, 1:] / n / np.outer(scale, scale)
    beta = np.linalg.solve(z + penalty * np.eye(len(scale)), products[1:, 0] / n / scale) / scale
    return dict(zip(predictors, beta, strict=True)) | {INTERCEPT: means[0] - beta @ means[1:]}


def elastic_net(df: DataFrame, outcome: str, predictors: list[str], penalty: float, *, mix: float = 1.0, steps: int = 10_000) -> dict[str, float]:
    """Minimises ``rss / 2n + penalty (mix |b| + (1 - mix) b^2 / 2)`` on standardised predictors, by coordinates; ``mix``
    1 is the lasso."""
    n, means, products = crossed(df, [outcome, *predictors])
    scale = np.sqrt(np.diag(products)[1:] / n)
    z, c = products[1:, 1:] / n / np.outer(scale, scale), products[1:, 0] / n / scale
    b = np.zeros(len(c))
    for _ in range(steps):
        largest = 0.0
        for j in range(len(c)):
            pull = c[j] - z[j] @ b + z[j, j] * b[j]
            new = math.copysign(max(abs(pull) - penalty * mix, 0.0), pull) / (z[j, j] + penalty * (1 - mix))
            largest, b[j] = max(largest, abs(new - b[j])), new
        if largest < 1e-12 * max(1.0, np.abs(c).max()):
            break
    else:
        raise ValueError(f"not converged in {steps} rounds")
    return dict(zip(predictors, b / scale, strict=True)) | {INTERCEPT: means[0] - (b / scale) @ means[1:]}


def partial_correlations(df: DataFrame, a: str, others: list[str]) -> DataFrame:
    """The correlation of one column with each other one, the rest held fixed: b, corr, t, p_value."""
    n, _, products = crossed(df, [a, *others])
    inverse = np.linalg.inv(products)
    out = []
    for j, name in enumerate(others, 1):
        r, free = -inverse[0, j] / math.sqrt(inverse[0, 0] * inverse[j, j]), n - len(others) - 1
        t = r * math.sqrt(free / (1 - r * r))
        out.append((name, float(r), float(t), dist.two_sided(float(t), free)))
    return small(df.sparkSession, out, "b string, corr double, t double, p_value double")


def inflation(df: DataFrame, predictors: list[str]) -> DataFrame:
    """Variance inflation factors: term, vif, tolerance."""
    _, _, products = crossed(df, predictors)
    vif = np.diag(np.linalg.inv(products)) * np.diag(products)
    return small(df.sparkSession, [(p, v, 1 / v) for p, v in zip(predictors, vif, strict=True)], "term string, vif double, tolerance double")


def stepwise(df: DataFrame, outcome: str, candidates: list[str], *, enter: float = 0.05, leave: float = 0.1) -> list[str]:
    """Forward selection with backward checks, by p-values; all from one table of cross-products."""
    n, _, s = crossed(df, [outcome, *candidates])
    chosen: list[int] = []

    def p_values(some: list[int]) -> np.ndarray:
        inverse = np.linalg.inv(s[np.ix_(some, some)])
        b = inverse @ s[some, 0]
        free = n - len(some) - 1
        se = np.sqrt(np.diag(inverse) * (s[0, 0] - b @ s[some, 0]) / free)
        return np.array([dist.two_sided(float(t), free) for t in b / se])

    for _ in range(4 * len(candidates)):
        rest = [j for j in range(1, len(candidates) + 1) if j not in chosen]
        tried = {j: p_values([*chosen, j])[-1] for j in rest}
        if not tried or min(tried.values()) >= enter:
            break
        chosen.append(min(tried, key=tried.get))
        while len(chosen) > 1 and (p := p_values(chosen)).max() > leave:
            del chosen[int(p.argmax())]
    return [candidates[j - 1] for j in chosen]


def seemingly_unrelated(df: DataFrame, equations: list[tuple[str, tuple[str, ...]]]) -> Fit:
    """Feasible generalised least squares over equations (outcome, predictors) with correlated errors: all from one
    table of cross-products. Terms are named outcome:term."""
    used = list(dict.fromkeys(c for y, xs in equations for c in (y, *xs)))
    n, means, products = crossed(df, used)
    raw = np.zeros((len(used) + 1, len(used) + 1))  # the last place is the constant
    raw[:-1, :-1] = products + n * np.outer(means, means)
    raw[-1, :-1] = raw[:-1, -1] = n * means
    raw[-1, -1] = n
    at = [[*[used.index(x) for x in xs], len(used)] for _, xs in equations]
    out = [used.index(y) for y, _ in equations]
    single = [np.linalg.solve(raw[np.ix_(a, a)], raw[a, y]) for a, y in zip(at, out, strict=True)]
    m = len(equations)
    sigma = np.array([[(raw[out[i], out[j]] - single[i] @ raw[at[i], out[j]] - single[j] @ raw[at[j], out[i]] + single[i] @ raw[np.ix_(at[i], at[j])] @ single[j]) / n for j in range(m)] for i in range(m)])
    w = np.linalg.inv(sigma)
    bread = np.linalg.inv(np.block([[w[i, j] * raw[np.ix_(at[i], at[j])] for j in range(m)] for i in range(m)]))
    beta = bread @ np.concatenate([sum(w[i, j] * raw[at[i], out[j]] for j in range(m)) for i in range(m)])
    return Fit([f"{y}:{t}" for y, xs in equations for t in (*xs, INTERCEPT)], beta, bread, None, {"n": float(n)})


def k_class(df: DataFrame, outcome: str, endogenous: tuple[str, ...], exogenous: tuple[str, ...], instruments: tuple[str, ...], method: str = "liml") -> Fit:
    """Instrumental variables from cross-products: 2sls, liml or gmm (two steps, heteroskedastic weights), with the
    first stage's F of the excluded instruments and, if over-identified, Sargan's (or Hansen's) statistic in the metrics."""
    names = [outcome, *endogenous, *exogenous, *instruments]
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in names]).na.drop().withColumn(INTERCEPT, F.lit(1.0)).persist()
    try:
        columns = [*names, INTERCEPT]
        n, means, products = gram(rows, [F.col(c) for c in columns])
        raw = products + n * np.outer(means, means)
        at = {c: i for i, c in enumerate(columns)}
        x, z, w = ([at[c] for c in some] for some in ((*endogenous, *exogenous, INTERCEPT), (*exogenous, *instruments, INTERCEPT), (*exogenous, INTERCEPT)))
        y = at[outcome]

        def left(some: list[int], by: list[int]) -> np.ndarray:
            """Cross-products of residuals on the columns ``by``."""
            return raw[np.ix_(some, some)] - raw[np.ix_(some, by)] @ np.linalg.solve(raw[np.ix_(by, by)], raw[np.ix_(by, some)])

        both = [y, *[at[c] for c in endogenous]]
        kappa = 1.0
        if method == "liml":
            kappa = float(np.linalg.eigvals(np.linalg.solve(left(both, z), left(both, w))).real.min())
        zz = np.linalg.inv(raw[np.ix_(z, z)])
        inside = lambda some: raw[np.ix_(x, z)] @ zz @ raw[np.ix_(z, some)]
        a = (1 - kappa) * raw[np.ix_(x, x)] + kappa * inside(x)
        beta = np.linalg.solve(a, ((1 - kappa) * raw[np.ix_(x, [y])] + kappa * inside([y]))[:, 0])
        residual = lambda b: F.col(outcome) - sum((F.lit(float(v)) * F.col(columns[i]) for v, i in zip(b, x, strict=True)), F.lit(0.0))
        over = len(z) - len(x)
        if method == "gmm":
            weight = np.linalg.inv(products_of(rows, [residual(beta) * F.col(columns[i]) for i in z]) / n)
            g = raw[np.ix_(z, x)]
            v = np.linalg.inv(g.T @ weight @ g) * n
            beta = v / n @ g.T @ weight @ raw[z, y]
            moment = (raw[z, y] - g @ beta) / n
            test = float(n * moment @ weight @ moment)
        else:
            rss = float(raw[y, y] - 2 * beta @ raw[x, y] + beta @ raw[np.ix_(x, x)] @ beta)
            v = np.linalg.inv(a) * rss / n
            ze = raw[z, y] - raw[np.ix_(z, x)] @ beta
            test = float(n * ze @ zz @ ze / rss)
        first = {}
        for c in endogenous:
            short, full = left([at[c]], w)[0, 0], left([at[c]], z)[0, 0]
            first[f"first_stage_f_{c}"] = (short - full) / len(instruments) / (full / (n - len(z)))
        p = {"overid_p": dist.chi2_sf(test, over)} if over else {}
        return Fit([columns[i] for i in x], beta, v, None, {"n": float(n), "kappa": kappa, "overid": test if over else math.nan} | first | p)
    finally:
        rows.unpersist()


def anova(df: DataFrame, outcome: str, factors: list[str], interactions: bool = False) -> DataFrame:
    """Sequential analysis of variance: source, ss, df, f, p_value; factors are coded as categories."""
    rows = df.na.drop(subset=[outcome, *factors])
    terms = [*factors, *([":".join(factors)] if interactions else [])]
    rows = rows.select(F.col(outcome).cast("double").alias(outcome), *factors, *([F.concat_ws("|", *[F.col(f).cast("string") for f in factors]).alias(terms[-1].replace(":", "_x_"))] if interactions else []))
    fits = [ols(rows, Spec(outcome, (), categorical=tuple(t.replace(":", "_x_") for t in terms[:k]))).metrics for k in range(len(terms) + 1)]
    last = fits[-1]
    error = last["rss"] / last["df_resid"]
    out = []
    for k, t in enumerate(terms, 1):
        ss, free = fits[k - 1]["rss"] - fits[k]["rss"], fits[k]["df_model"] - fits[k - 1]["df_model"]
        f = ss / free / error if free else math.nan
        out.append((t, ss, free, f, dist.f_sf(f, free, last["df_resid"]) if free else math.nan))
    return small(df.sparkSession, [*out, ("residual", last["rss"], last["df_resid"], math.nan, math.nan)], "source string, ss double, df double, f double, p_value double")


def _resampled(rows: DataFrame, k: int, weigh: Callable[[np.ndarray], np.ndarray], draws: int) -> np.ndarray:
    """Draws of coefficients: the cross-products of (y, x...) under each draw's weights, added up in Spark."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((draws, (k + 1) * (k + 1)))
        for b in batches:
            c = np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(k + 1)])
            w = weigh(b.column(k + 1).to_numpy(zero_copy_only=False))
            total += w.T @ (c[:, :, None] * c[:, None, :]).reshape(len(c), -1)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(draws), total.shape[1])), pa.array(np.tile(np.arange(total.shape[1]), draws)), pa.array(total.ravel())], ["draw", "i", "x"])

    cells = rows.mapInArrow(sums, "draw long, i long, x double").groupBy("draw", "i").agg(F.sum("x").alias("x")).toArrow()
    table = np.zeros((draws, (k + 1) * (k + 1)))
    table[cells.column("draw").to_numpy(), cells.column("i").to_numpy()] = cells.column("x").to_numpy()
    out = table.reshape(draws, k + 1, k + 1)
    return np.array([np.linalg.lstsq(m[1:, 1:], m[1:, 0], rcond=None)[0] for m in out])


def bootstrap(df: DataFrame, spec: Spec, *, draws: int = 200, seed: int = 0, key: str | None = None) -> Fit:
    """Least squares with bootstrap covariance: a row's (or with ``key`` a cluster's) weight in each draw is a Poisson
    number from a hash of it, so all draws take one pass and reruns agree, however the rows lie. Equal rows are first summed
    to one, whose weight is the sum of as many Poisson numbers: one with their count as its mean."""
    rows, names = design(df, spec, (key,) if key else ())
    k = len(names)
    if not key:
        return _bootstrap_of_rows(df, spec, rows, names, draws, seed)
    unit = F.xxhash64(F.lit(seed), F.col(f"k_{key}"))
    betas = _resampled(rows.select("y", *[f"x{i}" for i in range(k)], unit.alias("h")), k, lambda h: _poisson_ones(h.astype(np.uint64), draws), draws)
    fit = ols(df, spec)
    return Fit(names, fit.beta, np.atleast_2d(np.cov(betas.T)), None, fit.metrics | {"draws": float(draws)}, spec.alpha)


def _poisson_ones(h: np.ndarray, draws: int) -> np.ndarray:
    """Poisson numbers of mean 1 for each hash and draw."""
    table = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)])
    x = h[:, None] + np.arange(1, draws + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.searchsorted(table, ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53).astype(float)


def _bootstrap_of_rows(df: DataFrame, spec: Spec, rows: DataFrame, names: list[str], draws: int, seed: int) -> Fit:
    k = len(names)
    columns = ["y", *[f"x{i}" for i in range(k)]]
    counted = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).withColumn("h", F.xxhash64(F.lit(seed), *columns))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((draws, (k + 1) ** 2))
        for b in batches:
            c = np.column_stack([b[n].to_numpy(zero_copy_only=False) for n in columns])
            outer = (c[:, :, None] * c[:, None, :]).reshape(len(c), -1)
            n, h = b["n"].to_numpy(), b["h"].to_numpy().view(np.uint64)
            w = _poisson_ones(h, draws)
            for i in np.flatnonzero(n > 1).tolist():  # a generator of the row's own seed, so neighbours don't matter
                w[i] = np.random.Generator(np.random.Philox(key=int(h[i]))).poisson(n[i], draws)
            total += w.T @ outer
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(draws), total.shape[1])), pa.array(np.tile(np.arange(total.shape[1]), draws)), pa.array(total.ravel())], ["draw", "i", "x"])

    cells = counted.mapInArrow(sums, "draw long, i long, x double").groupBy("draw", "i").agg(F.sum("x").alias("x")).toArrow()
    table = np.zeros((draws, (k + 1) ** 2))
    table[cells["draw"].to_numpy(), cells["i"].to_numpy()] = cells["x"].to_numpy()
    betas = np.array([np.linalg.lstsq(m[1:, 1:], m[1:, 0], rcond=None)[0] for m in table.reshape(draws, k + 1, k + 1)])
    fit = ols(df, spec)
    return Fit(names, fit.beta, np.atleast_2d(np.cov(betas.T)), None, fit.metrics | {"draws": float(draws)}, spec.alpha)


def jackknife(df: DataFrame, spec: Spec, key: str) -> Fit:
    """Least squares with the covariance of leaving one cluster out. Clusters are summed to cross-products; the tasks
    that hold these take them from the whole and solve, and only sums of deviations come back."""
    rows, names = design(df, spec, (key,))
    k = len(names)
    columns = [F.col("y"), *[F.col(f"x{i}") for i in range(k)]]
    pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    cells = rows.groupBy(f"k_{key}").agg(*[F.sum(columns[i] * columns[j]).alias(f"p{i}_{j}") for i, j in pairs]).persist()
    try:
        total = np.zeros((k + 1, k + 1))
        whole = cells.agg(F.count(F.lit(1)), *[F.sum(f"p{i}_{j}") for i, j in pairs]).first()
        for (i, j), v in zip(pairs, whole[1:], strict=True):
            total[i, j] = total[j, i] = v
        groups, fit = whole[0], ols(df, spec)
        beta = fit.beta

        def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((k, k))
            for b in batches:
                own = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns])
                left = np.repeat(total[None], len(own), axis=0)
                rows_, cols_ = np.array(pairs).T
                left[:, rows_, cols_] -= own
                left[:, cols_, rows_] = left[:, rows_, cols_]
                d = (np.linalg.pinv(left[:, 1:, 1:], hermitian=True) @ left[:, 1:, :1])[..., 0] - beta
                sums += d.T @ d
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), pa.array(sums.ravel())], ["i", "x"])

        got = cells.select(*[f"p{i}_{j}" for i, j in pairs]).mapInArrow(outer, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
        v = np.zeros(k * k)
        for r in got:
            v[r["i"]] = r["x"]
        return Fit(names, beta, v.reshape(k, k) * (groups - 1) / groups, groups - 1, fit.metrics | {"clusters": float(groups)}, spec.alpha)
    finally:
        cells.unpersist()
