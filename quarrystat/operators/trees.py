"""Decision trees and causal forests grown level by level from histograms.

Predictors are cut at quantiles, or between all their values where these are few. For each level one pass sends every row
down the trees grown so far and adds it to its node's histogram of each predictor; tasks return sums by tree, node, predictor
and bin, whatever the number of rows, and the driver picks the splits from them. All trees of a forest share the passes.

Trees see no more of a row than its bins. So where combinations of bins are few, rows are first summed by them (and by what
trees take them for) in one pass, and the levels read these sums.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystat.sources.tables import release, small, written


@dataclass
class Tree:
    """Nodes by number (the root is 0; children follow their parent): predictor (-1 in a leaf), edge (left is at most that),
    left child (the right one is next), and the statistics of its rows."""

    predictors: list[str]
    feature: list[int] = field(default_factory=lambda: [-1])
    edge: list[float] = field(default_factory=lambda: [math.inf])
    left: list[int] = field(default_factory=lambda: [-1])
    stats: list[np.ndarray] = field(default_factory=lambda: [np.zeros(0)])
    levels: list = field(default_factory=list)

    def place(self, x: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
        """The leaf of each row (n, predictors); a null (NaN) goes right."""
        feature, edge, left = np.array(self.feature), np.array(self.edge), np.array(self.left)
        at = np.zeros(len(x), np.int64) if start is None else start
        while (inner := feature[at] >= 0).any():
            rows = np.flatnonzero(inner)
            node = at[rows]
            at[rows] = left[node] + ~(x[rows, feature[node]] <= edge[node])
        return at

    def leaves(self) -> list[int]:
        return [i for i, f in enumerate(self.feature) if f < 0]

    def expression(self, value: Callable[[int], Column], node: int = 0) -> Column:
        """A column that is ``value`` of a row's leaf."""
        if self.feature[node] < 0:
            return value(node)
        goes_left = F.coalesce(F.col(f"`{self.predictors[self.feature[node]]}`").cast("double") <= self.edge[node], F.lit(False))
        return F.when(goes_left, self.expression(value, self.left[node])).otherwise(self.expression(value, self.left[node] + 1))


def edges_of(df: DataFrame, predictors: list[str], bins: int) -> list[np.ndarray]:
    """Where each predictor may be cut: between its values if there are ``bins`` at most, else at quantiles
    (of so many rows approximate, so then partitions may move an edge a little)."""
    columns = [F.col(p).cast("double").alias(f"x{i}") for i, p in enumerate(predictors)]
    rows = df.select(*columns)
    counts = rows.agg(*[F.approx_count_distinct(f"x{i}", 0.02).alias(f"x{i}") for i in range(len(predictors))]).first()
    out = []
    few = [i for i, c in enumerate(counts) if c <= bins * 1.1]
    values: dict[int, np.ndarray] = {}
    for i in few:
        found = [r[0] for r in rows.select(f"x{i}").where(F.col(f"x{i}").isNotNull() & ~F.isnan(f"x{i}")).distinct().limit(bins * 2).collect()]
        if len(found) < bins * 2:
            values[i] = np.sort(np.array(found))
    many = [i for i in range(len(predictors)) if i not in values]
    quantiles = rows.agg(*[F.percentile_approx(f"x{i}", [k / bins for k in range(1, bins)], 10_000).alias(f"x{i}") for i in many]).first() if many else ()
    for i in range(len(predictors)):
        if i in values:
            out.append((values[i][1:] + values[i][:-1]) / 2)
        else:
            out.append(np.unique(np.array(quantiles[many.index(i)] or [], float)))
    return out


def _histograms(rows: DataFrame, width: int, statistics: Callable[[np.ndarray], np.ndarray], trees: list[Tree], active: list[dict[int, int]], edges: list[np.ndarray], take: Callable[[np.ndarray, int], np.ndarray] | None) -> np.ndarray:
    """Sums by place of an active node (all trees' in a row), predictor, bin and statistic. Rows: x (array), v (array), h."""
    count = sum(map(len, active))
    bins = max((len(e) for e in edges), default=0) + 2  # the last one for nulls
    p = len(edges)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((count, p, bins, width))
        for b in batches:
            if not b.num_rows:
                continue
            x = b["x"].flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            v = statistics(b["v"].flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1))
            h = b["h"].to_numpy().view(np.uint64)
            binned = np.column_stack([np.where(np.isnan(x[:, k]), bins - 1, np.searchsorted(e, x[:, k], side="left")) for k, e in enumerate(edges)])
            first = 0
            for t, (tree, nodes) in enumerate(zip(trees, active, strict=True)):
                mine = np.ones(len(x), bool) if take is None else take(h, t)
                number = np.full(len(tree.feature), -1)
                for node, place in nodes.items():
                    number[node] = place
                here = total[first : first + len(nodes)]
                at = number[tree.place(x[mine])]
                inside = at >= 0
                own, ob, ov = at[inside], binned[mine][inside], v[mine][inside]
                for k in range(p):
                    cell = own * bins + ob[:, k]
                    for s in range(width):
                        here[:, k, :, s] += np.bincount(cell, ov[:, s], len(nodes) * bins).reshape(-1, bins)
                first += len(nodes)
        filled = np.flatnonzero(total.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(filled), pa.array(total.ravel()[filled])], ["i", "s"])

    got = rows.mapInArrow(sums, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).toArrow()
    out = np.zeros(count * p * bins * width)
    out[got["i"].to_numpy()] = got["s"].to_numpy()
    return out.reshape(count, p, bins, width)


#: Sums (by combination of bins, group and statistic) up to which rows are summed first.
MOST_SUMS = 3_000_000

#: Rows that a task adds at once.
AT_ONCE = 100_000


def _codes(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """The number of each row's combination of bins; a null (NaN) has the last bin of its predictor."""
    code = np.zeros(len(x), np.int64)
    for k, e in enumerate(edges):
        code = code * (len(e) + 2) + np.where(np.isnan(x[:, k]), len(e) + 1, np.searchsorted(e, x[:, k], side="left"))
    return code


def _combined(rows: DataFrame, edges: list[np.ndarray], width: int, statistics: Callable[[np.ndarray], np.ndarray], groups: int = 1, dealt: Callable[[np.ndarray], Iterator[tuple[int, np.ndarray]]] | None = None) -> DataFrame | None:
    """Rows (x, v, h) summed by combination of bins and group: x holds a value of each bin, v the sums of the statistics, h the
    group. ``dealt`` makes of the rows' h pairs: a group, and which rows belong to it, or the one after it (0, 1; others to
    none). None where there may be too many sums."""
    sizes = [len(e) + 2 for e in edges]
    cells = math.prod(sizes)
    if cells * groups * width > MOST_SUMS:
        return None

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, groups, cells))

        def add(held: list[pa.RecordBatch]) -> None:
            x, v = (np.concatenate([b[c].flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for b in held]) for c in ("x", "v"))
            h = np.concatenate([b["h"].to_numpy() for b in held]).view(np.uint64)
            code, values = _codes(x, edges), np.ascontiguousarray(statistics(v).T)
            for group, role in dealt(h) if dealt else [(0, np.zeros(len(h), np.int64))]:
                mine = np.flatnonzero(role < 2)
                own, roles = code[mine] + cells * role[mine], min(2, groups - group)
                for s in range(width):
                    total[s, group : group + roles] += np.bincount(own, values[s, mine], roles * cells).reshape(roles, cells)

        held, n = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            if n >= AT_ONCE:
                add(held)
                held, n = [], 0
        if held:
            add(held)
        flat = total.reshape(width, -1)
        filled = np.flatnonzero((flat != 0).any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(filled), *[pa.array(flat[s, filled]) for s in range(width)]], ["i", *[f"s{s}" for s in range(width)]])

    names = [f"s{s}" for s in range(width)]
    got = rows.mapInArrow(sums, "i long, " + ", ".join(f"{n} double" for n in names)).groupBy("i").agg(*[F.sum(n).alias(n) for n in names])
    x, left = [], F.col("i") % cells
    for e, size in zip(reversed(edges), reversed(sizes), strict=True):
        # up to its edge a bin's values go left; beyond all edges, and for nulls, they go right
        x.insert(0, F.element_at(F.array(*[F.lit(float(v)) for v in [*e, math.inf, math.nan]]), (left % size + 1).cast("int")))
        left = F.floor(left / size)
    return got.select(F.array(*x).alias("x"), F.array(*names).alias("v"), F.floor(F.col("i") / cells).alias("h"))


def grow(rows: DataFrame, predictors: list[str], edges: list[np.ndarray], width: int, statistics: Callable, score: Callable[[np.ndarray], np.ndarray], size: Callable[[np.ndarray], np.ndarray], *, depth: int, least: float, gain: float, trees: int = 1, take: Callable | None = None, tried: Callable[[int, int], np.ndarray] | None = None) -> list[Tree]:
    """Trees whose splits raise the sum of ``score`` over nodes most. Ties go to the first predictor, then the lowest edge.
    ``tried``: which predictors a tree tries at a node."""
    grown = [Tree(predictors) for _ in range(trees)]
    active = [{0: 0} for _ in range(trees)]
    for level in range(depth + 1):
        if not any(active):
            break
        sums = _histograms(rows, width, statistics, grown, active, edges, take)
        offset = 0
        following = []
        for t, (tree, nodes) in enumerate(zip(grown, active, strict=True)):
            fresh: dict[int, int] = {}
            for node, place in nodes.items():
                own = sums[offset + place]
                whole = own[0].sum(axis=0)
                tree.stats[node] = whole
                if level == depth or size(whole) < 2 * least:
                    continue
                left = np.cumsum(own[:, :-1], axis=1)[:, :-1]  # up to each edge
                right = whole - left
                with np.errstate(all="ignore"):
                    improved = score(left) + score(right) - score(whole)
                usable = (size(left) >= least) & (size(right) >= least) & np.isfinite(improved)
                for k, e in enumerate(edges):
                    usable[k, len(e) :] = False
                if tried is not None:
                    usable[~np.isin(np.arange(len(edges)), tried(t, node))] = False
                improved = np.where(usable, improved, -np.inf)
                best = int(np.argmax(improved))
                k, at = divmod(best, improved.shape[1])
                if not improved[k, at] > gain:
                    continue
                tree.feature[node], tree.edge[node], tree.left[node] = k, float(edges[k][at]), len(tree.feature)
                for _ in range(2):
                    fresh[len(tree.feature)] = len(fresh)
                    tree.feature.append(-1)
                    tree.edge.append(math.inf)
                    tree.left.append(-1)
                    tree.stats.append(np.zeros(width))
            offset += len(nodes)
            following.append(fresh)
        active = following
    return grown


def _rows(df: DataFrame, predictors: list[str], values: list[Column]) -> DataFrame:
    x = F.array(*[F.coalesce(F.col(f"`{p}`").cast("double"), F.lit(float("nan"))) for p in predictors])
    found = df.select(x.alias("x"), F.array(*values).alias("v"))
    return found.where(~F.exists("v", lambda c: c.isNull() | F.isnan(c))).withColumn("h", F.xxhash64("x", "v"))


def cart(df: DataFrame, outcome: str, predictors: list[str], *, kind: str = "regression", depth: int = 5, least: int = 1, bins: int = 64, gain: float = 1e-9, edges: list[np.ndarray] | None = None) -> Tree:
    """A regression tree (least squares) or a classification tree (Gini; an outcome of 100 levels at most). ``least``: rows of a
    leaf; ``gain``: what a split has to add to the score, as a share of the root's. Rows with a null outcome are left out;
    null predictors go right. An empty table gives a single leaf. Statistics of a node: count, sum and sum of squares, or
    counts by level (``tree.levels``). ``edges``: where predictors may be cut, if that is known (``edges_of``)."""
    if kind == "regression":
        rows = _rows(df, predictors, [F.col(outcome).cast("double")])
        width, levels = 3, []
        statistics = lambda v: np.column_stack([np.ones(len(v)), v[:, 0], v[:, 0] ** 2])
        score = lambda s: np.where(s[..., 0] > 0, s[..., 1] ** 2 / np.maximum(s[..., 0], 1), 0.0)
        size = lambda s: s[..., 0]
        spread = rows.agg(F.var_pop(F.col("v")[0]) * F.count("v")).first()[0] or 0.0
    else:
        levels = [r[0] for r in df.select(outcome).where(F.col(outcome).isNotNull()).distinct().orderBy(outcome).limit(101).collect()]
        if len(levels) > 100:
            raise ValueError("a class has 100 levels at most")
        number = F.array_position(F.array(*[F.lit(v) for v in levels]), F.col(outcome)) - 1 if levels else F.lit(None)
        rows = _rows(df, predictors, [number.cast("double")])
        width = max(len(levels), 1)
        statistics = lambda v: (v[:, :1] == np.arange(width)).astype(float)
        size = lambda s: s.sum(axis=-1)
        score = lambda s: np.where(s.sum(axis=-1) > 0, (s**2).sum(axis=-1) / np.maximum(s.sum(axis=-1), 1), 0.0)
        spread = float(rows.count())
    edges = edges_of(df, predictors, bins) if edges is None else edges
    combined = _combined(rows, edges, width, statistics)
    rows = written(rows if combined is None else combined)
    tree = grow(rows, predictors, edges, width, statistics if combined is None else lambda v: v, score, size, depth=depth, least=least, gain=gain * max(spread, 1e-300))[0]
    release(rows)
    tree.levels = levels
    return tree


def node_value(tree: Tree, node: int):
    """The mean of a node's rows, or its most frequent level (the first of equals); None without rows."""
    s = tree.stats[node]
    if not tree.levels:
        return float(s[1] / s[0]) if len(s) and s[0] else None
    return tree.levels[int(np.argmax(s))] if s.sum() else None


def cart_predict(df: DataFrame, tree: Tree, name: str = "prediction") -> DataFrame:
    """``df`` with the value and number of each row's leaf, as one column expression each."""
    return df.withColumns({name: tree.expression(lambda n: F.lit(node_value(tree, n))), f"{name}_leaf": tree.expression(lambda n: F.lit(n))})


def describe(spark, tree: Tree) -> DataFrame:
    """node, parent, predictor, edge, n, value, impurity (residual sum of squares, or Gini times n)."""
    parent = {c: i for i, left in enumerate(tree.left) if left >= 0 for c in (left, left + 1)}
    rows = []
    for i, f in enumerate(tree.feature):
        s = tree.stats[i]
        n = float(s.sum()) if tree.levels else float(s[0]) if len(s) else 0.0
        impurity = (n - float((s**2).sum()) / n if tree.levels else float(s[2] - s[1] ** 2 / n)) if n else 0.0
        value = node_value(tree, i)
        rows.append((i, parent.get(i), tree.predictors[f] if f >= 0 else None, tree.edge[i] if f >= 0 else None, int(n), None if value is None else str(value) if tree.levels else f"{value:.12g}", max(impurity, 0.0)))
    return small(spark, rows, "node int, parent int, predictor string, edge double, n long, value string, impurity double")


def pruned(tree: Tree, penalty: float) -> Tree:
    """The tree without the splits that save less than ``penalty`` for each leaf they add (cost complexity)."""
    loss = [(s.sum() - (s**2).sum() / s.sum() if s.sum() else 0.0) if tree.levels else (s[2] - s[1] ** 2 / s[0] if len(s) and s[0] else 0.0) for s in tree.stats]

    def best(node: int) -> tuple[float, int]:
        """Loss and leaves below a node once it is pruned."""
        if feature[node] < 0:
            return loss[node], 1
        (a, m), (b, n) = best(tree.left[node]), best(tree.left[node] + 1)
        if loss[node] <= a + b + penalty * (m + n - 1):
            feature[node] = -1
            return loss[node], 1
        return a + b, m + n

    feature = list(tree.feature)
    best(0)
    kept = Tree(tree.predictors, levels=tree.levels)
    queue = [(0, 0)]
    kept.stats[0] = tree.stats[0]
    for old, new in queue:
        if feature[old] >= 0:
            kept.feature[new], kept.edge[new], kept.left[new] = feature[old], tree.edge[old], len(kept.feature)
            for child in (tree.left[old], tree.left[old] + 1):
                queue.append((child, len(kept.feature)))
                kept.feature.append(-1)
                kept.edge.append(math.inf)
                kept.left.append(-1)
                kept.stats.append(tree.stats[child])
    return kept


def prediction_split(df: DataFrame, share: float, seed: int = 0, keys: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows for learning and for testing, by a hash of their keys (all columns unless stated), so reruns agree and equal rows
    stay together."""
    h = F.pmod(F.xxhash64(F.lit(seed), *[F.col(f"`{k}`") for k in (keys or df.columns)]), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return df.where(h < share), df.where(h >= share)


# ---- causal forests

@dataclass(frozen=True)
class CausalForest:
    trees: list[Tree]
    #: For each tree and leaf: sums of treatment by outcome and of treatment squared, of rows that chose no split.
    sums: list[np.ndarray]
    predictors: list[str]


def _bits(h: np.ndarray, t: int) -> np.ndarray:
    x = h + np.uint64((t + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB) >> np.uint64(60)


def causal_forest(df: DataFrame, outcome: str, treatment: str, predictors: list[str], *, trees: int = 50, depth: int = 5, least: float = 20, bins: int = 32, seed: int = 0, keys: list[str] | None = None) -> CausalForest:
    """Honest causal trees on residuals: outcome and treatment less their regression trees' predictions; splits set effects
    apart most (n1 n2 / n times the squared difference). By a hash of the row (or of ``keys``) each tree takes half of the
    rows: half of these choose its splits, the others its effects. Equal rows are taken together unless ``keys`` tell them
    apart. Rows with a null outcome or treatment are left out; null predictors go right."""
    usable = df.where(F.col(outcome).isNotNull() & F.col(treatment).isNotNull())
    edges = edges_of(usable, predictors, bins)
    whole, first_stage = usable, []
    for c in (outcome, treatment):
        first_stage.append(cart(whole, c, predictors, depth=6, least=50, bins=bins, edges=edges))
        usable = cart_predict(usable, first_stage[-1], f"_{c}_hat")
    y, w = F.col(outcome).cast("double") - F.col(f"_{outcome}_hat"), F.col(treatment).cast("double") - F.col(f"_{treatment}_hat")
    rows = _rows(usable, predictors, [w * y, w * w])
    statistics = lambda v: np.column_stack([np.ones(len(v)), v])
    if keys:
        # tasks take the residuals: nested conditions of two trees are too long a method for the JVM to compile
        x = F.array(*[F.coalesce(F.col(f"`{p}`").cast("double"), F.lit(float("nan"))) for p in predictors])
        rows = whole.select(x.alias("x"), F.concat(F.array(F.col(outcome).cast("double"), F.col(treatment).cast("double")), x).alias("v"), F.xxhash64(F.lit(seed), *keys).alias("h"))
        hats = [np.array([math.nan if (value := node_value(t, n)) is None else value for n in range(len(t.feature))]) for t in first_stage]

        def statistics(v: np.ndarray) -> np.ndarray:
            y, w = (v[:, i] - hat[tree.place(v[:, 2:])] for i, (tree, hat) in enumerate(zip(first_stage, hats, strict=True)))
            return np.column_stack([np.ones(len(v)), w * y, w * w])

    # groups 2 t and 2 t + 1: the rows that choose the splits of tree t, and those that estimate its effects
    combined = _combined(rows, edges, 3, statistics, 2 * trees, lambda h: ((2 * t, (_bits(h, t) % np.uint64(4)).astype(np.int64)) for t in range(trees)))
    rows = written(rows if combined is None else combined)
    effect = lambda s: np.where(s[..., 2] > 1e-12, s[..., 1] / np.maximum(s[..., 2], 1e-12), 0.0)
    score = lambda s: s[..., 0] * effect(s) ** 2
    choose = lambda h, t: _bits(h, t) % np.uint64(4) == 0
    estimate = lambda h, t: _bits(h, t) % np.uint64(4) == 1
    if combined is not None:
        statistics = lambda v: v
        choose, estimate = (lambda h, t: h == np.uint64(2 * t)), (lambda h, t: h == np.uint64(2 * t + 1))
    several = max(1, math.ceil(len(predictors) * 2 / 3))

    def tried(t: int, node: int) -> np.ndarray:
        return np.random.default_rng([seed, t, node]).permutation(len(predictors))[:several]

    grown = grow(rows, predictors, edges, 3, statistics, score, lambda s: s[..., 0], depth=depth, least=least, gain=0.0, trees=trees, take=choose, tried=tried)
    leaves = [{n: i for i, n in enumerate(t.leaves())} for t in grown]
    sums = _histograms(rows, 3, statistics, grown, leaves, edges[:1], estimate)[:, 0].sum(axis=1)
    out, first = [], 0
    for tree, own in zip(grown, leaves, strict=True):
        table = np.zeros((len(tree.feature), 3))
        for node, i in own.items():
            table[node] = sums[first + i]
        out.append(table)
        first += len(own)
    release(rows)
    return CausalForest(grown, out, predictors)


def causal_predict(df: DataFrame, forest: CausalForest, name: str = "effect") -> DataFrame:
    """``df`` with each row's effect, from the leaves that it shares with the estimating rows; null where there are none."""
    trees, sums = forest.trees, forest.sums
    # rows between the same cuts share their leaves, so trees are asked once for each such combination in a batch
    cuts = [np.unique([e for t in trees for f, e in zip(t.feature, t.edge, strict=True) if f == k]) for k in range(len(forest.predictors))]
    coded = math.prod(len(c) + 2 for c in cuts) < 1 << 62

    def predict(*columns: pa.Array) -> pa.Array:
        x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in columns])
        back = slice(None)
        if coded:
            _, some, back = np.unique(_codes(x, cuts), return_index=True, return_inverse=True)
            x = x[some]
        total = np.zeros((len(x), 3))
        for tree, table in zip(trees, sums, strict=True):
            own = table[tree.place(x)]
            total += own / np.maximum(own[:, :1], 1)  # a tree's leaf counts once, by the means of its rows
        with np.errstate(all="ignore"):
            effect = np.where(total[:, 2] > 0, total[:, 1] / total[:, 2], np.nan)
        return pa.array(effect[back], pa.float64(), from_pandas=True)

    # a column's function: only the predictors go to it, and a plan reads no columns that nothing needs
    return df.withColumn(name, F.arrow_udf(predict, "double")(*[F.col(f"`{p}`").cast("double") for p in forest.predictors]))
