"""Categories as numbers: correspondence analysis of two columns, and multiple correspondence analysis of several.

Both need the counts of pairs of categories only, which Spark takes in one pass; the decomposition is of a matrix of categories.
Rows get their scores as column expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystat.sources.tables import small

#: Categories of all columns together.
MOST = 2000


@dataclass(frozen=True)
class Correspondence:
    """For each category (column, level): mass and principal coordinates; and the principal inertias."""

    columns: list[str]
    levels: list[tuple[str, object]]
    mass: np.ndarray
    coordinates: np.ndarray
    inertia: np.ndarray
    total: float
    n: float

    def frame(self, spark, axes: int = 2) -> DataFrame:
        """column, level, mass, axis (from 1), coordinate, contribution (to the axis's inertia). The sign of an axis is such that
        its first category of the largest coordinate is positive."""
        rows = []
        for a in range(min(axes, len(self.inertia))):
            for (c, v), m, x in zip(self.levels, self.mass, self.coordinates[:, a], strict=True):
                rows.append((c, str(v), float(m), a + 1, float(x), float(m * x * x / self.inertia[a]) if self.inertia[a] > 0 else 0.0))
        return small(spark, rows, "column string, level string, mass double, axis int, coordinate double, contribution double")

    def inertias(self, spark) -> DataFrame:
        """axis, inertia, share, cumulative."""
        share = self.inertia / self.total if self.total > 0 else np.zeros_like(self.inertia)
        return small(spark, [(i + 1, float(v), float(s), float(c)) for i, (v, s, c) in enumerate(zip(self.inertia, share, np.cumsum(share), strict=True))], "axis int, inertia double, share double, cumulative double")


def _signed(x: np.ndarray) -> np.ndarray:
    """Columns turned so that the largest entry (the first of equals) is positive."""
    if not x.size:
        return x
    top = np.argmax(np.abs(x) > np.abs(x).max(axis=0) * (1 - 1e-9), axis=0)
    return x * np.where(x[top, np.arange(x.shape[1])] < 0, -1.0, 1.0)


def _counts(df: DataFrame, columns: list[str], weight: str | None) -> tuple[dict[str, list], np.ndarray, float]:
    """The levels of each column, and the counts of all pairs of categories (the Burt table), of rows that have all columns."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.where(~F.array_contains(F.array(*[F.col(c).isNull() for c in columns]), True) & (w > 0)).groupBy(*columns).agg(F.sum(w).alias("_w"))
    cells = rows.select(F.col("_w"), F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")) for i, a in enumerate(columns) for j, b in enumerate(columns) if i <= j])).alias("p"))
    found = cells.groupBy("p.i", "p.j", "p.a", "p.b").agg(F.sum("_w").alias("n")).limit(MOST * MOST).collect()
    levels = {c: sorted({r["a"] for r in found if r["i"] == r["j"] == i}) for i, c in enumerate(columns)}
    size = sum(map(len, levels.values()))
    if size > MOST:
        raise ValueError(f"more than {MOST} categories")
    if not size:
        raise ValueError("no complete rows")
    first = dict(zip(columns, np.cumsum([0, *[len(levels[c]) for c in columns]]), strict=False))
    place = {(i, v): first[c] + k for i, c in enumerate(columns) for k, v in enumerate(levels[c])}
    burt = np.zeros((size, size))
    for r in found:
        x, y = place[r["i"], r["a"]], place[r["j"], r["b"]]
        burt[x, y] = burt[y, x] = r["n"]
    own = len(levels[columns[0]])
    return levels, burt, float(np.diag(burt)[:own].sum())


def correspondence(df: DataFrame, row: str, column: str, *, weight: str | None = None) -> Correspondence:
    """Correspondence analysis of the table of two columns: principal coordinates of the categories of both, inertias (their
    sum is chi-square over n). Rows with a null in either are left out; 2,000 categories at most."""
    levels, burt, n = _counts(df, [row, column], weight)
    a = len(levels[row])
    p = burt[:a, a:] / n
    r, c = p.sum(axis=1), p.sum(axis=0)
    u, s, vt = np.linalg.svd((p - np.outer(r, c)) / np.sqrt(np.outer(r, c)), full_matrices=False)
    keep = s > 1e-12
    u, s, vt = u[:, keep], s[keep], vt[keep]
    both = _signed(np.vstack([u / np.sqrt(r)[:, None] * s, vt.T / np.sqrt(c)[:, None] * s]))
    return Correspondence([row, column], [(k, v) for k in (row, column) for v in levels[k]], np.concatenate([r, c]), both, s**2, float((s**2).sum()), n)


def multiple(df: DataFrame, columns: list[str], *, weight: str | None = None) -> Correspondence:
    """Multiple correspondence analysis: the axes of the rows' indicator matrix, from the Burt table of all pairs. Inertias sum to
    the number of categories over that of columns, less one."""
    levels, burt, n = _counts(df, columns, weight)
    q = len(columns)
    mass = np.diag(burt) / (n * q)
    b = burt / (n * q * q)
    values, vectors = np.linalg.eigh((b - np.outer(mass, mass)) / np.sqrt(np.outer(mass, mass)))
    order = [i for i in np.argsort(-values) if values[i] > 1e-12]
    inertia = values[order]  # of the indicator matrix; those of the Burt table itself are their squares
    coordinates = _signed(vectors[:, order] / np.sqrt(mass)[:, None] * np.sqrt(inertia))
    return Correspondence(list(columns), [(c, v) for c in columns for v in levels[c]], mass, coordinates, inertia, float(inertia.sum()), n)


def project(df: DataFrame, fit: Correspondence, axes: int = 2) -> DataFrame:
    """``df`` with axis1, axis2, ...: for each row the mean of its categories' coordinates over the root of the axis's inertia,
    null where a category is null or unknown."""
    def score(a: int) -> Column:
        total = F.lit(0.0)
        for c in fit.columns:
            pairs = [x for (k, v), y in zip(fit.levels, fit.coordinates[:, a], strict=True) if k == c for x in (F.lit(v), F.lit(float(y)))]
            total = total + F.element_at(F.create_map(*pairs), F.col(c).cast("string"))
        return total / (len(fit.columns) * float(np.sqrt(fit.inertia[a])))

    return df.withColumns({f"axis{a + 1}": score(a) for a in range(min(axes, len(fit.inertia)))})
