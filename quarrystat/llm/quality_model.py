"""A quality classifier: a sparse ensemble of conjunctive rules over text statistics.

Small boosted trees are grown on the statistics of a bounded sample of labelled documents; every path from a root to a
node is a rule, a conjunction of bounds on statistics. Logistic regression with a lasso penalty weighs the rules, most
to nothing. What is left is compiled into one Spark column expression, so scoring runs no Python.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystat.llm.common import let, text_or_empty, words_of
from quarrystat.llm.quality_rules import repeated

#: What trees see of a text. Labels, ids, languages and sources are not among them.
STATISTICS = [
    "words", "word_length", "distinct_share", "repeat_share", "stutter_share", "short_share", "longest_word", "upper_share", "digit_share",
    "symbol_share", "shout_share", "stop_share", "comma_share", "bar_share", "dup_line_share", "line_words", "end_share",
]

#: A rule: for some statistics, bounds low < x <= high.
Rule = tuple[tuple[str, float, float], ...]


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def column(self, stats: Column) -> Column:
        """The probability of label 1, from a struct of statistics."""

        def holds(rule: Rule) -> Column:
            met = F.lit(True)
            for name, low, high in rule:
                met = met & (stats[name] > low) if low > -math.inf else met
                met = met & (stats[name] <= high) if high < math.inf else met
            return met

        votes = [F.when(holds(rule), F.lit(weight)).otherwise(F.lit(0.0)) for rule, weight in self.rules]
        total = F.aggregate(F.array(F.lit(self.intercept), *votes), F.lit(0.0), lambda a, x: a + x)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def statistics(text: Column) -> Column:
    """The statistics of a text, all finite doubles (shares of nothing are 0)."""
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0)).cast("double")
    chars = lambda kinds: F.length(text) - F.length(F.regexp_replace(text, f"[{kinds}]+", ""))

    def of(words: Column) -> Column:
        n, length = F.size(words), F.length(text)
        lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        # lengths of words, as numbers: cheaper to go over again than the words
        lengths = F.transform(words, lambda w: F.length(w))
        of_lengths = let(
            lengths,
            lambda x: F.struct(F.coalesce(F.array_max(x), F.lit(0)).alias("most"), F.size(F.filter(x, lambda v: v <= 2)).alias("short"), F.aggregate(x, F.lit(0), lambda a, v: a + v).alias("all")),
        )
        of_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("distinct"), F.size(F.filter(x, lambda v: v.rlike(r"[.!?][\x20\x09-\x0D]*$"))).alias("ended")))
        return let(
            F.struct(of_lengths.alias("w"), of_lines.alias("l")),
            lambda s: F.struct(
                n.cast("double").alias("words"),
                share(s["w"]["all"], n).alias("word_length"),
                share(F.size(F.array_distinct(words)), n).alias("distinct_share"),
                share(repeated(words), n).alias("repeat_share"),
                share(F.size(F.filter(words, lambda w, i: F.get(words, i + 1).eqNullSafe(w))), n).alias("stutter_share"),
                share(s["w"]["short"], n).alias("short_share"),
                s["w"]["most"].cast("double").alias("longest_word"),
                share(chars("A-Z"), length).alias("upper_share"),
                share(chars("0-9"), length).alias("digit_share"),
                share(chars(r"#*$%&<>@^~=_\\\\/"), length).alias("symbol_share"),
                share(chars("!?"), length).alias("shout_share"),
                share(chars("."), n).alias("stop_share"),
                share(chars(",;:"), n).alias("comma_share"),
                share(chars(r"|\[\]{}"), n).alias("bar_share"),
                share(s["l"]["n"] - s["l"]["distinct"], s["l"]["n"]).alias("dup_line_share"),
                share(n, s["l"]["n"]).alias("line_words"),
                share(s["l"]["ended"], s["l"]["n"]).alias("end_share"),
            ),
        )

    return let(words_of(text), of)


def grow(binned: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, rows: np.ndarray, depth: int, bins: int, path: tuple = ()) -> list[tuple[tuple, float]]:
    """Grows a tree; returns (path, value) for every node below the root. A path lists (statistic, bin, goes_left)."""
    found = [(path, float(gradient[rows].sum() / (hessian[rows].sum() + 1.0)))] if path else []
    if not depth or len(rows) < 20:
        return found
    g, h = gradient[rows], hessian[rows]
    best, where = 1e-6, None
    whole = g.sum() ** 2 / (h.sum() + 1.0)
    for k in range(binned.shape[1]):
        codes = binned[rows, k]
        left_g, left_h = np.cumsum(np.bincount(codes, g, bins))[:-1], np.cumsum(np.bincount(codes, h, bins))[:-1]
        gain = left_g**2 / (left_h + 1.0) + (g.sum() - left_g) ** 2 / (h.sum() - left_h + 1.0) - whole
        if (top := int(gain.argmax())) >= 0 and gain[top] > best:
            best, where = gain[top], (k, top)
    if where is None:
        return found
    goes = binned[rows, where[0]] <= where[1]
    for left in (True, False):
        if len(own := rows[goes == left]) >= 10:
            found += grow(binned, gradient, hessian, own, depth - 1, bins, (*path, (*where, left)))
    return found


def lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 300) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient for the mean log loss plus penalty times the weights' absolute sum."""
    n, m = x.shape
    step = 4.0 / max(np.linalg.norm(x.T @ x / n, 2) + 1.0, 1e-9)
    w, b, v, c, t = np.zeros(m), 0.0, np.zeros(m), 0.0, 1.0
    for _ in range(steps):
        r = 1 / (1 + np.exp(-np.clip(x @ v + c, -30, 30))) - y
        moved = v - step * (x.T @ r) / n
        new_w, new_b = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0), c - step * r.mean()
        new_t = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, c = new_w + (t - 1) / new_t * (new_w - w), new_b + (t - 1) / new_t * (new_b - b)
        w, b, t = new_w, new_b, new_t
    return b, w


def fit_rules(x: np.ndarray, y: np.ndarray, *, trees: int = 40, depth: int = 3, bins: int = 48, penalty: float = 5e-4, seed: int = 7) -> RuleModel:
    """Grows the trees and weighs their paths. With no rows the score is 1/2 everywhere; with one class, near it."""
    if not len(x):
        return RuleModel(0.0, ())
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins)[1:-1])) for k in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, k]) for k, e in enumerate(edges)], axis=1)
    rng = np.random.default_rng(seed)
    base = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    score, paths = np.full(len(y), base), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        nodes = grow(binned, y - p, p * (1 - p), np.flatnonzero(rng.random(len(y)) < 0.5), depth, bins)
        inner = {path[:-1] for path, _ in nodes}
        for path, value in nodes:
            bounds: dict[int, tuple[float, float]] = {}
            for k, at, left in path:
                low, high = bounds.get(k, (-math.inf, math.inf))
                edge = float(edges[k][at]) if at < len(edges[k]) else math.inf
                bounds[k] = (low, min(high, edge)) if left else (max(low, edge), high)
            rule = tuple(sorted((STATISTICS[k], *v) for k, v in bounds.items()))
            hit = np.ones(len(y), bool)
            for name, low, high in rule:
                hit &= (x[:, STATISTICS.index(name)] > low) & (x[:, STATISTICS.index(name)] <= high)
            if path not in inner:
                score += 0.3 * value * hit
            if 0 < hit.sum() < len(y):
                paths.setdefault(np.packbits(hit).tobytes(), (rule, hit))
    if not paths:
        return RuleModel(base, ())
    rules = [r for r, _ in paths.values()]
    intercept, weights = lasso_logistic(np.stack([h for _, h in paths.values()], axis=1).astype(np.float32), y.astype(np.float32), penalty)
    return RuleModel(float(intercept), tuple((r, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-6))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, fits: Column, most: int, *, text_col: str = "text") -> DataFrame:
    """At most ``most`` labelled documents (doc_id, text, y), the first by a hash of the id; ``fits`` says which label
    rows may be learnt from. Null ids and labels are left out; a document labelled twice takes the higher label."""
    known = labels.where(fits & F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("double").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # `most` rows at most, a documented bound, so each task can hold them
    found = docs.select(F.col("doc_id").alias("doc_id"), text_or_empty(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")
    return found


def fit(docs: DataFrame, labels: DataFrame, *, fits: Column, label: str = "quality", most: int = 12_000, text_col: str = "text") -> RuleModel:
    """Learns from ``most`` labelled rows at most; only their statistics come to the driver."""
    sample = labelled_sample(docs, labels, label, fits, most, text_col=text_col).select("doc_id", "y", statistics(F.col("text")).alias("s"))
    rows = sample.select("doc_id", "y", *[F.col("s")[n].alias(n) for n in STATISTICS]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).drop("doc_id").toPandas()
    return fit_rules(rows[STATISTICS].to_numpy(np.float64), rows["y"].to_numpy(np.float64))


def score(docs: DataFrame, model: RuleModel, *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with score (double, 0 to 1). Null texts score like empty ones, empty ones by their
    statistics, all 0. Repeated rows each keep their row; an empty table gives none. A column named score is replaced."""
    kept = [f"`{c}`" for c in docs.columns if c.lower() != "score"]
    # one expression that names the statistics once: a filter on the score, pushed below, computes them once too
    return docs.select(*kept, let(statistics(text_or_empty(text_col)), model.column).alias("score"))
