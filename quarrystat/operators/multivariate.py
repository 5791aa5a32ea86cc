"""Survey totals, principal components and k-means: reductions in Spark, small algebra on the driver."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystat.operators.ranked import running
from quarrystat.sources.tables import small


def survey_mean(df: DataFrame, value: str, weight: str, stratum: str | None = None, psu: str | None = None, fpc: str | None = None) -> DataFrame:
    """mean, std_error (Taylor), total, total_se, psus, strata. Scores are summed by unit, then centred within strata."""
    s = F.col(stratum) if stratum else F.lit(0)
    rows = df.where(F.col(value).isNotNull() & F.col(weight).isNotNull()).select(s.alias("h"), (F.col(psu) if psu else F.monotonically_increasing_id()).alias("u"), F.col(value).cast("double").alias("y"), F.col(weight).cast("double").alias("w"), (F.col(fpc).cast("double") if fpc else F.lit(None).cast("double")).alias("N"))
    units = rows.groupBy("h", "u").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("wy"), F.max("N").alias("N"))
    total_w, total = units.agg(F.sum("w"), F.sum("wy")).first()
    mean = total / total_w
    scored = units.select("h", "N", ((F.col("wy") - F.lit(mean) * F.col("w")) / F.lit(total_w)).alias("z"), F.col("wy").alias("t"))
    by = scored.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.max("N").alias("N"), F.var_samp("z").alias("vz"), F.var_samp("t").alias("vt"))
    f = F.when(F.col("N").isNotNull(), 1 - F.col("m") / F.col("N")).otherwise(1.0)
    part = lambda v: F.sum(F.when(F.col("m") > 1, f * F.col("m") * F.col(v)).otherwise(0.0))
    vz, vt, psus, strata = by.agg(part("vz"), part("vt"), F.sum("m"), F.count(F.lit(1))).first()
    return small(df.sparkSession, [(mean, math.sqrt(vz), total, math.sqrt(vt), psus, strata)], "mean double, std_error double, total double, total_se double, psus long, strata long")


def survey_ratio(df: DataFrame, top: str, bottom: str, weight: str, stratum: str, psu: str) -> DataFrame:
    """The ratio of two weighted totals with its linearised standard error."""
    w = F.col(weight).cast("double")
    units = df.na.drop(subset=[top, bottom, weight]).groupBy(F.col(stratum).alias("h"), F.col(psu).alias("u")).agg(F.sum(w * F.col(top)).alias("a"), F.sum(w * F.col(bottom)).alias("b"))
    a, b = units.agg(F.sum("a"), F.sum("b")).first()
    z = units.select("h", ((F.col("a") - F.lit(a / b) * F.col("b")) / F.lit(b)).alias("z")).groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.var_samp("z").alias("v"))
    v = z.agg(F.sum(F.when(F.col("m") > 1, F.col("m") * F.col("v")).otherwise(0.0))).first()[0]
    return small(df.sparkSession, [(a / b, math.sqrt(v))], "ratio double, std_error double")


def vector_moments(df: DataFrame, vector: str, dims: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, mean and covariance of an array column, in two passes, the second about the mean. Tasks reduce their batches to one matrix each, and Spark adds the
    cells up; the driver sees dims * dims numbers."""
    rows = df.where(F.col(vector).isNotNull() & (F.size(vector) == dims)).select(F.col(vector).cast("array<double>").alias("v"))

    def sums(centre: np.ndarray | None) -> np.ndarray:
        def reduce(batches):
            import pyarrow as pa

            total = None
            for b in batches:
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                part = np.concatenate([[len(x)], x.sum(0)]) if centre is None else ((x - centre).T @ (x - centre)).ravel()
                total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["i", "x"])

        got = {r["i"]: r["x"] for r in rows.mapInArrow(reduce, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()}
        return np.array([got.get(i, 0.0) for i in range(1 + dims if centre is None else dims * dims)])

    first = sums(None)
    n, mean = int(first[0]), first[1:] / max(first[0], 1)
    return n, mean, sums(mean).reshape(dims, dims) / max(n - 1, 1)


def pca(df: DataFrame, vector: str, dims: int, keep: int = 5) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """component, eigenvalue, share; and the mean and loadings."""
    _, mean, cov = vector_moments(df, vector, dims)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:keep]
    table = small(df.sparkSession, [(i + 1, values[j], values[j] / values.sum()) for i, j in enumerate(order)], "component int, eigenvalue double, share double")
    return table, mean, vectors[:, order]


def kmeans(df: DataFrame, vector: str, dims: int, k: int, *, rounds: int | None = None, most: int = 1000, seed: int = 0) -> tuple[DataFrame, np.ndarray]:
    """Lloyd's iterations from k rows chosen by hash: cluster, size, and within sum of squares; and the centres. Tasks
    send k sums, never rows. Rounds go on until no centre moves; what still moves after ``most`` is an error. ``rounds``: so
    many at most."""
    rows = df.where(F.col(vector).isNotNull() & (F.size(vector) == dims)).select(F.col(vector).cast("array<double>").alias("v"))
    centres = np.array([r["v"] for r in rows.orderBy(F.xxhash64(F.lit(seed), F.col("v").cast("string"))).limit(k).collect()])
    out = None
    for _ in range(rounds if rounds is not None else most):
        current = centres.copy()

        def assign(batches, current=current):
            import pyarrow as pa

            sums, n, ss = np.zeros_like(current), np.zeros(len(current)), np.zeros(len(current))
            for b in batches:
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, current.shape[1])
                d = (x * x).sum(1)[:, None] - 2 * x @ current.T + (current * current).sum(1)[None, :]
                own = d.argmin(1)
                np.add.at(sums, own, x)
                n += np.bincount(own, minlength=len(current))
                ss += np.bincount(own, np.maximum(d[np.arange(len(x)), own], 0), len(current))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(current))), pa.array(n), pa.array(ss), pa.array(sums.tolist(), pa.list_(pa.float64()))], ["cluster", "n", "ss", "sums"])

        parts = rows.mapInArrow(assign, "cluster long, n double, ss double, sums array<double>")
        cells = parts.select("cluster", "n", "ss", F.posexplode("sums")).groupBy("cluster", "pos").agg(F.sum("col").alias("s"), F.sum("n").alias("n"), F.sum("ss").alias("ss")).collect()
        out = np.zeros((len(centres), 2))
        moved = centres.copy()
        for r in cells:
            if r["n"]:
                moved[r["cluster"], r["pos"]] = r["s"] / r["n"]
                out[r["cluster"]] = r["n"], r["ss"]
        shift, centres = np.abs(moved - centres).max(), moved
        if shift < 1e-9:
            break
    else:
        if rounds is None:
            raise ValueError(f"the centres still move after {most} rounds")
    return small(df.sparkSession, [(i, int(n), ss) for i, (n, ss) in enumerate(out)], "cluster int, size long, within double"), centres


def group_means(df: DataFrame, vector: str, label: str) -> DataFrame:
    """label, position, mean and variance of an array column by label."""
    cells = df.where(F.col(label).isNotNull()).select(label, F.posexplode(vector))
    return cells.groupBy(label, F.col("pos").alias("position")).agg(F.avg("col").alias("mean"), F.var_samp("col").alias("variance"))


def cronbach(df: DataFrame, items: list[str]) -> DataFrame:
    """Cronbach's alpha of items over complete rows."""
    rows = df.select(*[F.col(i).cast("double").alias(i) for i in items]).na.drop()
    total: Column = sum((F.col(i) for i in items), F.lit(0.0))
    k = len(items)
    return rows.agg((F.lit(k / (k - 1)) * (1 - sum((F.var_samp(i) for i in items), F.lit(0.0)) / F.var_samp(total))).alias("alpha"), F.count(F.lit(1)).alias("n"))


def lorenz(df: DataFrame, value: str) -> DataFrame:
    """The Gini coefficient, from counts of distinct values in order."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    rows = running(counts, "v", "n", "upto").withColumn("w", F.col("n") * (F.col("upto") - F.col("n") + (F.col("n") + 1) / 2.0))
    return rows.agg((2 * F.sum(F.col("w") * F.col("v")) / (F.sum("n") * F.sum(F.col("n") * F.col("v"))) - (F.sum("n") + 1) / F.sum("n")).alias("gini"))
