"""Maximum likelihood for models with one or several linear indices.

A model is a log likelihood of a row in jets of its indices (``functions.jets``), so score and curvature need no
formulas of their own. Every Newton step is one Spark job: tasks reduce their Arrow batches to one vector of sums, and
Spark adds these up. Rows that agree in everything the model reads are first summed to one with a count, where that
makes far fewer of them. What doesn't converge, and what would run off to infinity, is an error.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystat.functions import jets as J
from quarrystat.functions.jets import Jet
from quarrystat.operators.linear import Fit, positive
from quarrystat.plans.spec import INTERCEPT, expression, finite

#: A row's log likelihood from the outcomes (arrays by name) and the indices, in the order of the equations.
Likelihood = Callable[[dict[str, np.ndarray], list[Jet]], Jet]


@dataclass(frozen=True)
class Equation:
    """A linear index: its name, its terms as formulas, and whether it has a constant."""

    name: str
    terms: tuple[str, ...] = ()
    constant: bool = True

    @property
    def names(self) -> list[str]:
        return [*self.terms, *([INTERCEPT] if self.constant else [])]


@dataclass(frozen=True)
class Problem:
    loglik: Likelihood
    outcomes: tuple[str, ...]
    equations: tuple[Equation, ...]
    start: dict[str, float] = field(default_factory=dict)
    #: Outcomes that may be null, as the open end of an interval; they come as NaN.
    open: tuple[str, ...] = ()


#: Sums of equal rows that a task reads.
PATTERNS_OF_A_TASK = 50_000


class NotConverged(ValueError):
    """The iterations ended without a maximum, as when an outcome is separated perfectly."""


def _read(df: DataFrame, problem: Problem, weight: str | None, cluster: str | None) -> DataFrame:
    columns: list[Column] = [expression(o).alias(f"y{i}") for i, o in enumerate(problem.outcomes)]
    ok = F.lit(True)
    for i, o in enumerate(problem.outcomes):
        ok = ok & (F.lit(True) if o in problem.open else finite(F.col(f"y{i}")))
    for k, e in enumerate(problem.equations):
        for j, t in enumerate(e.terms):
            product = F.lit(1.0)
            for factor in t.split(":"):
                product = product * expression(factor)
            columns.append(product.cast("double").alias(f"x{k}_{j}"))
            ok = ok & finite(F.col(f"x{k}_{j}"))
    columns.append((F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"))
    keep = [F.col(cluster).alias("cluster")] if cluster else []
    return df.select(*columns, *keep).where(ok & (F.col("w") > 0) & (F.col("cluster").isNotNull() if cluster else F.lit(True)))


def _reduce(rows: DataFrame, body: Callable[[dict[str, np.ndarray]], np.ndarray]) -> np.ndarray:
    """The sum over all rows of a vector that ``body`` makes of a batch."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                part = body({n: c.to_numpy(zero_copy_only=False).astype(float) for n, c in zip(b.schema.names, b.columns, strict=True)})
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["i", "x"])

    got = rows.mapInArrow(sums, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).toArrow()
    out = np.zeros(got.num_rows)
    out[got.column("i").to_numpy()] = got.column("x").to_numpy()
    return out


def _reduce_lists(rows: DataFrame, name: str) -> np.ndarray:
    """The sum of lists of one length over all rows."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                part = b[name].flatten().to_numpy().reshape(b.num_rows, -1).sum(axis=0)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["i", "x"])

    got = rows.select(name).mapInArrow(sums, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).toArrow()
    out = np.zeros(got.num_rows)
    out[got.column("i").to_numpy()] = got.column("x").to_numpy()
    return out


def maximise(
    df: DataFrame, problem: Problem, *, weight: str | None = None, robust: bool = False, cluster: str | None = None, alpha: float = 0.05, steps: int = 60, tolerance: float = 1e-9, ancillary: dict | None = None,
    panel: str | None = None, nodes: int = 12,
) -> Fit:
    """The maximum, with covariance from the observed information, or robust, or clustered. Rows with a null or NaN in
    what is read are left out; an empty table is an error. Coefficients are named equation:term, or by the term alone
    where there is one equation. With ``panel`` the first index holds a normal effect of each panel, integrated over
    ``nodes`` (see ``random_effects``)."""
    if panel:
        from quarrystat.operators import random_effects

        if weight or robust or cluster:
            raise ValueError("a model with random effects takes no weights and no robust covariance")
        return random_effects.maximise(df, problem, panel, nodes=nodes, alpha=alpha, steps=steps, tolerance=tolerance)
    equations = problem.equations
    p = [len(e.names) for e in equations]
    offset = np.cumsum([0, *p])
    k = int(offset[-1])
    loglik, outcomes = problem.loglik, problem.outcomes
    rows = _read(df, problem, weight, cluster).withColumn("n", F.lit(1.0))
    names = [c for c in rows.columns if c not in ("n", "cluster")]
    n, total, patterns = rows.agg(F.count(F.lit(1)), F.sum("w"), F.approx_count_distinct(F.xxhash64(*names))).first()
    if not n:
        raise ValueError("no complete rows")
    if not cluster and patterns < n / 4:
        # a task for so many of them, not one for each partition of the shuffle in every step
        rows = rows.groupBy(*names).agg(F.sum("n").alias("n")).coalesce(-(-patterns // PATTERNS_OF_A_TASK))
    rows = rows.persist()

    def parts(b: np.ndarray, c: dict[str, np.ndarray]) -> tuple[Jet, list[np.ndarray]]:
        m = len(c["w"])
        xs = [np.column_stack([np.zeros((m, 0)), *[c[f"x{i}_{j}"] for j in range(len(e.terms))], *([np.ones(m)] if e.constant else [])]) for i, e in enumerate(equations)]
        with np.errstate(all="ignore"):
            return loglik({o: c[f"y{i}"] for i, o in enumerate(outcomes)}, Jet.variables([x @ b[offset[i] : offset[i + 1]] for i, x in enumerate(xs)])), xs

    def measure(b: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def body(c: dict[str, np.ndarray]) -> np.ndarray:
            l, xs = parts(b, c)
            w = c["w"] * c["n"]
            g = np.concatenate([x.T @ (w * l.g[i]) for i, x in enumerate(xs)])
            h = np.block([[xs[i].T @ (xs[j] * (w * l.h[i, j])[:, None]) for j in range(len(xs))] for i in range(len(xs))])
            return np.concatenate([[w @ l.v], g, h.ravel()])

        out = _reduce(rows, body)
        return out[0], out[1 : 1 + k], -out[1 + k :].reshape(k, k)

    labels = [f"{e.name}:{t}" if len(equations) > 1 else t for e in equations for t in e.names]
    beta = np.array([problem.start.get(label, problem.start.get(label.split(":")[0], 0.0) if label.endswith(INTERCEPT) else 0.0) for label in labels])
    try:
        ll, score, info = measure(beta)
        if not math.isfinite(ll):
            raise NotConverged("the likelihood is not finite at the start")
        first = ll
        for _ in range(steps):
            scale = 1 / np.sqrt(np.maximum(np.abs(np.diag(info)), 1e-12 * max(1.0, np.abs(np.diag(info)).max())))
            flat = info * np.outer(scale, scale)
            values, vectors = np.linalg.eigh((flat + flat.T) / 2)
            step = scale * (vectors @ ((vectors.T @ (score * scale)) / np.maximum(np.abs(values), 1e-9)))
            gain = float(step @ score)
            # where an outcome is separated the likelihood stands still while coefficients walk on
            if gain <= tolerance * max(1.0, abs(ll)) * 1e-3 and values.min() > 0 and np.abs(step / (1 + np.abs(beta))).max() < 1e-4:
                break
            size = min(1.0, 20 / max(np.abs(step / np.maximum(1.0, np.abs(beta))).max(), 1e-300))
            for _ in range(40):
                moved = measure(beta + size * step)
                if math.isfinite(moved[0]) and moved[0] >= ll - 1e-12 * abs(ll):
                    break
                size /= 2
            else:
                raise NotConverged("no step raises the likelihood")
            beta, (ll, score, info) = beta + size * step, moved
        else:
            raise NotConverged(f"not converged in {steps} steps; an outcome may be separated")
        if np.linalg.eigvalsh(info * np.outer(scale, scale)).min() < 1e-9:
            raise NotConverged("the likelihood is flat: terms explain each other, or an outcome is separated")
        v = np.linalg.inv(info)
        if robust or cluster:
            where = offset

            def scores(c: dict[str, np.ndarray]) -> np.ndarray:
                l, xs = parts(beta, c)
                return np.column_stack([c["w"][:, None] * l.g[i][:, None] * x for i, x in enumerate(xs)]).reshape(len(c["w"]), where[-1])

            if cluster:
                meat, groups = _clustered(rows, scores, k)
                v = positive(v @ meat @ v) * groups / (groups - 1)
            else:
                meat = _reduce(rows, lambda c: (s := scores(c)).T.dot(s * c["n"][:, None]).ravel()).reshape(k, k)
                v = v @ meat @ v * n / (n - 1)
        return Fit(labels, beta, v, None, {"n": float(n), "loglik": ll, "loglik_start": first, "aic": 2 * k - 2 * ll, "bic": math.log(n) * k - 2 * ll} | (ancillary or {}), alpha)
    finally:
        rows.unpersist()


def _clustered(rows: DataFrame, scores: Callable, k: int) -> tuple[np.ndarray, int]:
    """The outer products of scores that are summed within clusters first, and the number of clusters."""

    def by_cluster(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = scores({n: c.to_numpy(zero_copy_only=False).astype(float) for n, c in zip(b.schema.names, b.columns, strict=True) if n != "cluster"})
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("cluster")).cast(pa.string()), *[pa.array(s[:, i]) for i in range(k)]], ["cluster", *[f"s{i}" for i in range(k)]])

    sums = rows.mapInArrow(by_cluster, "cluster string, " + ", ".join(f"s{i} double" for i in range(k))).groupBy("cluster").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(k)])
    row = sums.agg(F.count(F.lit(1)), *[F.sum(F.col(f"s{i}") * F.col(f"s{j}")) for i in range(k) for j in range(i, k)]).first()
    meat = np.zeros((k, k))
    meat[np.triu_indices(k)] = row[1:]
    return meat + np.triu(meat, 1).T, row[0]


# ---- models: each takes a table, an outcome and terms, and options of ``maximise``

def _one(name: str, loglik: Callable[[np.ndarray, Jet], Jet]):
    """A model of one index."""

    def fit(df: DataFrame, outcome: str, terms: tuple[str, ...] = (), *, constant: bool = True, start: float = 0.0, **options) -> Fit:
        problem = Problem(lambda y, e: loglik(y[outcome], e[0]), (outcome,), (Equation(outcome, tuple(terms), constant),), {INTERCEPT: start})
        return maximise(df, problem, **options)

    fit.__name__, fit.__doc__ = name, f"{name}: maximum likelihood with one linear index."
    return fit


def _count(y: np.ndarray, eta: Jet) -> Jet:
    return eta * y - J.exp(eta) - J.gammas(y + 1)[0]


def _negative_binomial(y: np.ndarray, eta: Jet, ln_alpha: Jet) -> Jet:
    m, over = J.exp(-ln_alpha), J.softplus(eta + ln_alpha)
    return J.lgamma(m + y) - J.lgamma(m) - J.gammas(y + 1)[0] - m * over + (eta + ln_alpha - over) * y


def _binary(y: np.ndarray) -> np.ndarray:
    return np.where(y > 0, 1.0, -1.0)


logit = _one("logit", lambda y, e: e * y - J.softplus(e))
fraction_logit = _one("fraction_logit", lambda y, e: e * y - J.softplus(e))
probit = _one("probit", lambda y, e: J.log_ndtr(e * _binary(y)))
fraction_probit = _one("fraction_probit", lambda y, e: J.log_ndtr(e) * y + J.log_ndtr(-e) * (1 - y))
cloglog = _one("cloglog", lambda y, e: J.where(y > 0, J.log1mexp(J.exp(e)), -J.exp(e)))
poisson = _one("poisson", _count)
truncated_poisson = _one("truncated_poisson", lambda y, e: _count(y, e) - J.log1mexp(J.exp(e)))
gamma_log = _one("gamma_log", lambda y, e: -(J.exp(-e) * y) - e)
inverse_gaussian_log = _one("inverse_gaussian_log", lambda y, e: J.exp(e * -2.0) * (-0.5 * y) + J.exp(-e))
gaussian_log = _one("gaussian_log", lambda y, e: (y - J.exp(e)) * (y - J.exp(e)) * -0.5)
geometric = _one("geometric", lambda y, e: e * y - J.softplus(e) * (y + 1))


def exposed_poisson(df: DataFrame, outcome: str, exposure: str, terms: tuple[str, ...] = (), **options) -> Fit:
    """Poisson counts over an exposure."""
    return maximise(df, Problem(lambda y, e: _count(y[outcome], e[0] + np.log(y[exposure])), (outcome, exposure), (Equation(outcome, tuple(terms)),)), **options)


def _two(loglik: Callable, second: str, start: float = 0.0):
    """A model of two indices; the second is a constant unless it has terms."""

    def fit(df: DataFrame, outcome: str, terms: tuple[str, ...] = (), more: tuple[str, ...] = (), *, first: float = 0.0, begin: float = start, **options) -> Fit:
        problem = Problem(lambda y, e: loglik(y[outcome], e[0], e[1]), (outcome,), (Equation(outcome, tuple(terms)), Equation(second, tuple(more))), {outcome: first, second: begin})
        return maximise(df, problem, **options)

    return fit


negative_binomial = _two(_negative_binomial, "lnalpha")
truncated_negative_binomial = _two(lambda y, e, a: _negative_binomial(y, e, a) - J.log1mexp(J.exp(-a) * J.softplus(e + a)), "lnalpha")
zero_inflated_poisson = _two(lambda y, e, z: J.where(y > 0, _count(y, e), J.softplus(-z - J.exp(e)) + z) - J.softplus(z), "inflate")
hurdle_poisson = _two(lambda y, e, z: J.where(y > 0, _count(y, e) - J.log1mexp(J.exp(e)) + z, z * 0.0) - J.softplus(z), "positive")
beta_regression = _two(
    lambda y, e, f: (lambda phi, mu: J.lgamma(phi) - J.lgamma(mu * phi) - J.lgamma((1.0 - mu) * phi) + (mu * phi - 1.0) * np.log(y) + ((1.0 - mu) * phi - 1.0) * np.log1p(-y))(J.exp(f), J.exp(-J.softplus(-e))), "lnphi", 1.0
)
gaussian = _two(lambda y, e, s: J.log_density((y - e) * J.exp(-s)) - s, "lnsigma")


def zero_inflated_negative_binomial(df: DataFrame, outcome: str, terms: tuple[str, ...] = (), inflate: tuple[str, ...] = (), **options) -> Fit:
    def loglik(y, e):
        none = -(J.exp(-e[2]) * J.softplus(e[0] + e[2]))
        return J.where(y[outcome] > 0, _negative_binomial(y[outcome], e[0], e[2]), J.softplus(none - e[1]) + e[1]) - J.softplus(e[1])

    return maximise(df, Problem(loglik, (outcome,), (Equation(outcome, tuple(terms)), Equation("inflate", tuple(inflate)), Equation("lnalpha")), {"inflate": -1.0}), **options)


def het_probit(df: DataFrame, outcome: str, terms: tuple[str, ...], spread: tuple[str, ...], **options) -> Fit:
    """Probit whose scale depends on terms."""
    return maximise(df, Problem(lambda y, e: J.log_ndtr(e[0] * J.exp(-e[1]) * _binary(y[outcome])), (outcome,), (Equation(outcome, tuple(terms)), Equation("lnsigma", tuple(spread), False))), **options)


def _ordered(df: DataFrame, outcome: str, terms: tuple[str, ...], between: Callable[[Jet, Jet], Jet], low: Callable[[Jet], Jet], scale: float, options: dict) -> Fit:
    counts = df.where(F.col(outcome).isNotNull()).groupBy(outcome).agg(F.count(F.lit(1)).alias("n")).orderBy(outcome).limit(51).collect()
    if not 2 <= len(counts) <= 50:
        raise ValueError("an ordered outcome has 2 to 50 levels")
    levels = np.array([float(r[0]) for r in counts])
    share = np.cumsum([r["n"] for r in counts])[:-1] / sum(r["n"] for r in counts)
    cuts = [f"cut{i + 1}" for i in range(len(levels) - 1)]

    def loglik(y, e):
        at = np.searchsorted(levels, y[outcome])
        xb, c = e[0], e[1:]
        out = J.where(at == 0, low(c[0] - xb), low(xb - c[-1]))
        for i in range(1, len(c)):
            out = J.where(at == i, between(c[i] - xb, c[i - 1] - xb), out)
        return out

    start = {f"{c}:{INTERCEPT}": scale * math.log(s / (1 - s)) for c, s in zip(cuts, share, strict=True)}
    return maximise(df, Problem(loglik, (outcome,), (Equation(outcome, tuple(terms), False), *[Equation(c) for c in cuts]), start), **options)


def ordered_logit(df: DataFrame, outcome: str, terms: tuple[str, ...], **options) -> Fit:
    return _ordered(df, outcome, terms, lambda b, a: b + J.log1mexp(b - a) - J.softplus(a) - J.softplus(b), lambda x: -J.softplus(-x), 1.0, options)


def ordered_probit(df: DataFrame, outcome: str, terms: tuple[str, ...], **options) -> Fit:
    def between(b: Jet, a: Jet) -> Jet:  # on the side where both tails are small
        flip = np.where(a.v > 0, -1.0, 1.0)
        return J.log((J.ndtr(b * flip) - J.ndtr(a * flip)) * flip)

    return _ordered(df, outcome, terms, between, J.log_ndtr, 0.6, options)


def multinomial_logit(df: DataFrame, outcome: str, terms: tuple[str, ...], *, base: float | None = None, **options) -> Fit:
    """One index for each level of a numeric outcome but the base (the smallest)."""
    levels = [float(r[0]) for r in df.select(outcome).where(F.col(outcome).isNotNull()).distinct().orderBy(outcome).limit(51).collect()]
    if not 2 <= len(levels) <= 50:
        raise ValueError("a multinomial outcome has 2 to 50 levels")
    base = levels[0] if base is None else base
    others = [v for v in levels if v != base]

    def loglik(y, e):
        most = np.maximum(0.0, np.max([x.v for x in e], axis=0))
        total = sum((J.exp(x - most) for x in e[1:]), J.exp(e[0] - most)) + np.exp(-most)
        own = sum((x * (y[outcome] == v) for x, v in zip(e[1:], others[1:], strict=True)), e[0] * (y[outcome] == others[0]))
        return own - J.log(total) - most

    return maximise(df, Problem(loglik, (outcome,), tuple(Equation(f"{v:g}", tuple(terms)) for v in others)), **options)


def tobit(df: DataFrame, outcome: str, terms: tuple[str, ...], *, low: float | None = None, high: float | None = None, **options) -> Fit:
    """A normal outcome, censored at ``low`` and ``high``."""

    def loglik(y, e):
        v = y[outcome]
        out = J.log_density((v - e[0]) * J.exp(-e[1])) - e[1]
        if low is not None:
            out = J.where(v <= low, J.log_ndtr((low - e[0]) * J.exp(-e[1])), out)
        return out if high is None else J.where(v >= high, J.log_ndtr((e[0] - high) * J.exp(-e[1])), out)

    return maximise(df, Problem(loglik, (outcome,), (Equation(outcome, tuple(terms)), Equation("lnsigma")), _moments(df, outcome)), **options)


def _moments(df: DataFrame, outcome: str) -> dict[str, float]:
    m, s = df.agg(F.avg(outcome), F.stddev(outcome)).first()
    return {outcome: m or 0.0, "lnsigma": math.log(s) if s else 0.0}


def truncated_regression(df: DataFrame, outcome: str, terms: tuple[str, ...], *, low: float | None = None, high: float | None = None, **options) -> Fit:
    """A normal outcome seen only between ``low`` and ``high``; rows outside are left out."""
    rows = df.where((F.col(outcome) > (low if low is not None else -math.inf)) & (F.col(outcome) < (high if high is not None else math.inf)))

    def loglik(y, e):
        r = J.exp(-e[1])
        out = J.log_density((y[outcome] - e[0]) * r) - e[1]
        if low is not None and high is not None:
            return out - J.log(J.ndtr((high - e[0]) * r) - J.ndtr((low - e[0]) * r))
        return out - (J.log_ndtr((e[0] - low) * r) if low is not None else J.log_ndtr((high - e[0]) * r))

    return maximise(rows, Problem(loglik, (outcome,), (Equation(outcome, tuple(terms)), Equation("lnsigma")), _moments(rows, outcome)), **options)


def interval_regression(df: DataFrame, low: str, high: str, terms: tuple[str, ...], **options) -> Fit:
    """A normal outcome known to lie between two columns; null is an open end, equal ends are a value."""

    def loglik(y, e):
        a, b, r = y[low], y[high], J.exp(-e[1])
        out = J.log_density((np.where(np.isfinite(a), a, 0.0) - e[0]) * r) - e[1]
        za, zb = (np.where(np.isnan(a), 0.0, a) - e[0]) * r, (np.where(np.isnan(b), 0.0, b) - e[0]) * r
        flip = np.where(za.v > 0, -1.0, 1.0)
        out = J.where(np.isfinite(a) & np.isfinite(b) & (b > a), J.log((J.ndtr(zb * flip) - J.ndtr(za * flip)) * flip), out)
        return J.where(np.isnan(a), J.log_ndtr(zb), J.where(np.isnan(b), J.log_ndtr(-za), out))

    rows = df.where(F.col(low).isNotNull() | F.col(high).isNotNull())
    known = _moments(rows.withColumn("_mid", F.coalesce((F.col(low) + F.col(high)) / 2, low, high)), "_mid")
    return maximise(rows, Problem(loglik, (low, high), (Equation("model", tuple(terms)), Equation("lnsigma")), {"model": known["_mid"], "lnsigma": known["lnsigma"]}, open=(low, high)), **options)


def selection(df: DataFrame, outcome: str, terms: tuple[str, ...], selected: str, select_terms: tuple[str, ...], **options) -> Fit:
    """A normal outcome seen where a probit says so, with correlated errors. The outcome may be null where not selected."""

    def loglik(y, e):
        s, z = y[selected] > 0, (np.where(y[selected] > 0, y[outcome], 0.0) - e[0]) * J.exp(-e[3])
        rho = J.tanh(e[2])
        return J.where(s, J.log_density(z) - e[3] + J.log_ndtr((e[1] + rho * z) * (1.0 - rho * rho + 1e-12) ** -0.5), J.log_ndtr(-e[1]))

    rows = df.withColumn("_seen", F.when(F.col(selected) > 0, F.col(outcome)).otherwise(0.0))
    known = _moments(df.where(F.col(selected) > 0), outcome)
    problem = Problem(lambda y, e: loglik({outcome: y["_seen"], selected: y[selected]}, e), ("_seen", selected), (Equation(outcome, tuple(terms)), Equation("select", tuple(select_terms)), Equation("athrho"), Equation("lnsigma")), known)
    return maximise(rows, problem, **options)


def bivariate_probit(df: DataFrame, first: str, terms: tuple[str, ...], second: str, more: tuple[str, ...], **options) -> Fit:
    def loglik(y, e):
        a, b = _binary(y[first]), _binary(y[second])
        return J.log_binormal(e[0] * a, e[1] * b, J.tanh(e[2]) * (a * b))

    return maximise(df, Problem(loglik, (first, second), (Equation(first, tuple(terms)), Equation(second, tuple(more)), Equation("athrho"))), **options)


def selection_probit(df: DataFrame, outcome: str, terms: tuple[str, ...], selected: str, select_terms: tuple[str, ...], **options) -> Fit:
    """A probit seen where another one says so."""

    def loglik(y, e):
        q = _binary(y["_seen"])
        return J.where(y[selected] > 0, J.log_binormal(e[0] * q, e[1], J.tanh(e[2]) * q), J.log_ndtr(-e[1]))

    rows = df.withColumn("_seen", F.when(F.col(selected) > 0, F.col(outcome).cast("double")).otherwise(0.0))
    return maximise(rows, Problem(loglik, ("_seen", selected), (Equation(outcome, tuple(terms)), Equation("select", tuple(select_terms)), Equation("athrho"))), **options)


def cragg_hurdle(df: DataFrame, outcome: str, terms: tuple[str, ...], select_terms: tuple[str, ...], *, low: float = 0.0, **options) -> Fit:
    """A probit for being above ``low``, and a normal outcome truncated there."""

    def loglik(y, e):
        v, r = y[outcome], J.exp(-e[2])
        return J.where(v > low, J.log_ndtr(e[1]) + J.log_density((v - e[0]) * r) - e[2] - J.log_ndtr((e[0] - low) * r), J.log_ndtr(-e[1]))

    return maximise(df, Problem(loglik, (outcome,), (Equation(outcome, tuple(terms)), Equation("select", tuple(select_terms)), Equation("lnsigma")), _moments(df.where(F.col(outcome) > low), outcome)), **options)


def frontier(df: DataFrame, outcome: str, terms: tuple[str, ...], *, cost: bool = False, **options) -> Fit:
    """A stochastic frontier with half-normal inefficiency."""
    sign = -1.0 if cost else 1.0

    def loglik(y, e):
        u, v = J.exp(e[2] * 2.0), J.exp(e[1] * 2.0)
        s = (u + v) ** 0.5
        r = (y[outcome] - e[0]) / s
        return J.log_density(r) - J.log(s) + math.log(2) + J.log_ndtr(r * J.exp(e[2] - e[1]) * -sign)

    known = _moments(df, outcome)
    half = known["lnsigma"] - 0.3
    return maximise(df, Problem(loglik, (outcome,), (Equation(outcome, tuple(terms)), Equation("lnsig_v"), Equation("lnsig_u")), {outcome: known[outcome] + sign * math.exp(half), "lnsig_v": half, "lnsig_u": half}), **options)


#: Log survivor and log hazard functions of time from an index and a shape index.
def _survival(kind: str) -> Callable[[np.ndarray, Jet, Jet], tuple[Jet, Jet]]:
    def exponential(t, e, a):
        return -(J.exp(e) * t), e + a * 0.0

    def weibull(t, e, a):
        grown = J.exp(J.exp(a) * np.log(t) + e)
        return -grown, e + a + (J.exp(a) - 1.0) * np.log(t)

    def gompertz(t, e, a):
        small = np.abs(a.v * t) < 1e-6
        rate = a * t
        body = J.where(small, rate * (t / 2) + t, (J.exp(rate) - 1.0) / J.where(small, rate * 0.0 + 1.0, a))
        return -(J.exp(e) * body), e + rate

    def lognormal(t, e, a):
        z = (np.log(t) - e) * J.exp(-a)
        tail = J.log_ndtr(-z)
        return tail, J.log_density(z) - a - np.log(t) - tail

    def loglogistic(t, e, a):
        z = (np.log(t) - e) * J.exp(-a)
        return -J.softplus(z), z - a - np.log(t) - J.softplus(z)

    return {"exponential": exponential, "weibull": weibull, "gompertz": gompertz, "lognormal": lognormal, "loglogistic": loglogistic}[kind]


def _shapes(kind: str, terms: tuple[str, ...]) -> tuple[Equation, ...]:
    return (Equation("_t", tuple(terms)), *(() if kind == "exponential" else (Equation("shape"),)))


def survival_regression(df: DataFrame, time: str, event: str, terms: tuple[str, ...], kind: str = "weibull", **options) -> Fit:
    """Parametric survival: exponential, weibull and gompertz by proportional hazards, lognormal and loglogistic by
    accelerated time. The shape is the log of p, gamma itself, the log of sigma or of gamma."""
    law = _survival(kind)

    def loglik(y, e):
        survive, hazard = law(y[time], e[0], e[1] if len(e) > 1 else e[0] * 0.0)
        return survive + hazard * (y[event] > 0)

    d, t, m = df.where(F.col(time) > 0).agg(F.sum(F.col(event).cast("double")), F.sum(F.col(time).cast("double")), F.avg(F.log(F.col(time).cast("double")))).first()
    start = m if kind.startswith("log") else math.log(max(d, 0.5) / t)
    return maximise(df.where(F.col(time) > 0), Problem(loglik, (time, event), _shapes(kind, terms), {"_t": start, INTERCEPT: start}), **options)


def interval_survival(df: DataFrame, low: str, high: str, terms: tuple[str, ...], kind: str = "weibull", **options) -> Fit:
    """Survival known to end between two times; a null or zero lower time is left, a null upper time right censoring,
    equal times are an event."""
    law = _survival(kind)

    def loglik(y, e):
        shape = e[1] if len(e) > 1 else e[0] * 0.0
        a, b = np.where(y[low] > 0, y[low], 1.0), np.where(np.isfinite(y[high]), y[high], 1.0)
        sa, ha = law(a, e[0], shape)
        sb, _ = law(b, e[0], shape)
        from_start, open_end, exact = ~(y[low] > 0), ~np.isfinite(y[high]), y[low] == y[high]
        between = J.where(from_start, J.log1mexp(-sb), sa + J.log1mexp(sa - sb))
        return J.where(exact, sa + ha, J.where(open_end, sa, between))

    rows = df.where((F.col(low) > 0) | F.col(high).isNotNull())
    mid = F.coalesce((F.coalesce(F.col(low), F.lit(0.0)) + F.col(high)) / 2, F.col(low)).cast("double")
    t, m = rows.agg(F.avg(mid), F.avg(F.log(mid))).first()
    start = m if kind.startswith("log") else -math.log(t)
    return maximise(rows, Problem(loglik, (low, high), _shapes(kind, terms), {"_t": start, INTERCEPT: start}, open=(low, high)), **options)


def quantile_regression(df: DataFrame, outcome: str, terms: tuple[str, ...], *, q: float = 0.5, narrow: tuple[float, ...] = (0.3, 0.03, 0.003, 0.0003), **options) -> Fit:
    """Quantile regression by smoothing the check loss ever less: the loss is ``q u + h log(1 + exp(-u / h))``, convex
    in the coefficients, with h as a share of the outcome's deviation. Covariance is the sandwich at the last h."""
    known = _moments(df, outcome)
    start, fit = {INTERCEPT: known[outcome]}, None
    for share in narrow:
        h = share * math.exp(known["lnsigma"])

        def loglik(y, e, h=h):
            u = (y[outcome] - e[0]) * (1 / h)
            return (u * q + J.softplus(-u)) * -1.0

        fit = maximise(df, Problem(loglik, (outcome,), (Equation(outcome, tuple(terms)),), start), robust=True, **options)
        start = dict(zip(fit.names, fit.beta, strict=True))
    return fit


def conditional_logit(df: DataFrame, outcome: str, terms: tuple[str, ...], group: str, *, steps: int = 50) -> Fit:
    """Choice of one row in each group. Groups are summed to moments, so no group is gathered; groups without exactly
    one chosen row are left out."""
    k = len(terms)
    rows = df.select(F.col(group).alias("g"), F.col(outcome).cast("double").alias("y"), *[expression(t).alias(f"x{i}") for i, t in enumerate(terms)]).na.drop()
    chosen = rows.groupBy("g").agg(F.sum("y").alias("s"), F.count(F.lit(1)).alias("m")).where("s = 1 AND m > 1").select(F.col("g").alias("_g"))
    rows = rows.join(chosen, F.col("g") == F.col("_g")).drop("_g").persist()
    xs = [F.col(f"x{i}") for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def measure(b):
        eta = sum((F.lit(float(v)) * x for v, x in zip(b, xs, strict=True)), F.lit(0.0))
        r = F.exp(eta)
        sums = rows.groupBy("g").agg(F.sum(F.col("y") * eta).alias("own"), F.sum(r).alias("s"), *[F.sum(F.col("y") * x).alias(f"o{i}") for i, x in enumerate(xs)], *[F.sum(r * x).alias(f"m{i}") for i, x in enumerate(xs)], *[F.sum(r * xs[i] * xs[j]).alias(f"q{i}_{j}") for i, j in pairs])
        mean = [F.col(f"m{i}") / F.col("s") for i in range(k)]
        x = sums.agg(F.sum(F.col("own") - F.log("s")), *[F.sum(F.col(f"o{i}") - mean[i]) for i in range(k)], *[F.sum(F.col(f"q{i}_{j}") / F.col("s") - mean[i] * mean[j]) for i, j in pairs], F.count(F.lit(1))).first()
        h = np.zeros((k, k))
        h[np.triu_indices(k)] = x[1 + k : -1]
        return x[0], np.array(x[1 : 1 + k]), h + np.triu(h, 1).T, x[-1]

    try:
        beta = np.zeros(k)
        ll, score, info, groups = measure(beta)
        for _ in range(steps):
            step, size = np.linalg.solve(info, score), 1.0
            if float(step @ score) < 1e-10 * max(1.0, abs(ll)):
                return Fit(list(terms), beta, np.linalg.inv(info), None, {"n": float(groups), "loglik": ll})
            while (moved := measure(beta + size * step))[0] < ll - 1e-12 * abs(ll) and size > 1e-9:
                size /= 2
            beta, (ll, score, info, groups) = beta + size * step, moved
        raise NotConverged(f"not converged in {steps} steps")
    finally:
        rows.unpersist()


#: How a fitted index becomes a mean, with its first two derivatives.
def _means(kind: str, eta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if kind == "logit":
        p = J.sigmoid(eta)
        return p, p * (1 - p), p * (1 - p) * (1 - 2 * p)
    if kind == "probit":
        d = np.exp(-eta * eta / 2 - J.HALF_LOG_2PI)
        return np.exp(J.log_normal_cdf(eta)), d, -eta * d
    if kind == "log":
        return np.exp(eta), np.exp(eta), np.exp(eta)
    return eta, np.ones_like(eta), np.zeros_like(eta)


def margins(df: DataFrame, fit: Fit, terms: tuple[str, ...], kind: str) -> Fit:
    """Average marginal effects of plain terms, with standard errors by the delta method. kind: logit, probit, log or linear."""
    names = [*terms, INTERCEPT]
    beta = np.array([fit.beta[fit.names.index(n)] for n in names])
    v = fit.covariance[np.ix_([fit.names.index(n) for n in names], [fit.names.index(n) for n in names])]
    k = len(terms)
    rows = df.select(*[expression(t).alias(f"x{i}") for i, t in enumerate(terms)]).na.drop()

    def body(c):
        x = np.column_stack([*[c[f"x{i}"] for i in range(k)], np.ones(len(c["x0"]))])
        _, d1, d2 = _means(kind, x @ beta)
        return np.concatenate([[len(x), d1.sum()], x.T @ d2])

    out = _reduce(rows, body)
    slope, curve = out[1] / out[0], out[2:] / out[0]
    effect = slope * beta[:k]
    jacobian = np.outer(beta[:k], curve) + slope * np.eye(k, k + 1)
    return Fit(list(terms), effect, jacobian @ v @ jacobian.T, None, {"n": out[0]}, fit.alpha)


def predict(df: DataFrame, fit: Fit, terms: tuple[str, ...], kind: str = "linear", name: str = "predicted") -> DataFrame:
    """``df`` with the fitted index, probability (logit) or mean (log) as a column; null where a term is."""
    beta = dict(zip(fit.names, fit.beta, strict=True))
    eta = sum((F.lit(float(beta[t])) * expression(t) for t in terms), F.lit(float(beta.get(INTERCEPT, 0.0))))
    return df.withColumn(name, {"linear": eta, "log": F.exp(eta), "logit": 1 / (1 + F.exp(-eta))}[kind])


def nlcom(fit: Fit, function: Callable[[dict[str, float]], float]) -> tuple[float, float]:
    """A function of the coefficients and its standard error, by central differences."""
    value = lambda b: function(dict(zip(fit.names, b, strict=True)))
    slope = np.zeros(len(fit.beta))
    for i, b in enumerate(fit.beta):
        h = 1e-5 * max(1.0, abs(b))
        unit = np.eye(len(fit.beta))[i] * h
        slope[i] = (value(fit.beta + unit) - value(fit.beta - unit)) / (2 * h)
    return value(fit.beta), math.sqrt(float(slope @ fit.covariance @ slope))
