"""Descriptive statistics, tests of means and variances, tables, and rank statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrystat.functions import dist
from quarrystat.operators.ranked import running
from quarrystat.sources.tables import small


def describe(df: DataFrame, columns: list[str], by: list[str] | None = None, *, percentiles: tuple[float, ...] = (25, 50, 75)) -> DataFrame:
    """variable, n, mean, sd, min, max, skewness and kurtosis (population, normal: 3), and percentiles where P = n p / 100
    picks a value, or the mean of two if P is whole. Null groups are dropped."""
    by = by or []
    rows = df.na.drop(subset=by) if by else df
    long = rows.select(*by, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(by, columns, "variable", "value").where(F.col("value").isNotNull() & ~F.isnan("value"))
    keys = [*by, "variable"]
    stats = long.groupBy(*keys).agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev("value").alias("sd"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.skewness("value").alias("skewness"), (F.kurtosis("value") + 3).alias("kurtosis"),
    )
    # values are counted first; a percentile is the value at which the running count passes n p / 100
    distinct = long.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("_c"))
    by_value = Window.partitionBy(*keys).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = distinct.withColumns({"_upto": F.sum("_c").over(by_value)}).join(stats.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("n").alias("_n")), [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])

    def percentile(p: float) -> Column:
        at = F.col("_n") * p / 100
        whole = at == F.floor(at)
        first, second = F.greatest(F.when(whole, at).otherwise(F.floor(at) + 1), F.lit(1.0)), F.least(F.floor(at) + 1, F.col("_n"))
        covers = lambda i: (F.col("_upto") >= i) & (F.col("_upto") - F.col("_c") < i)
        pick = lambda i: F.max(F.when(covers(i), F.col("value")))
        return ((pick(first) + pick(second)) / 2).alias(f"p{p:g}")

    cuts = ranked.groupBy(*keys).agg(*[percentile(p) for p in percentiles])
    return stats.join(cuts, keys)


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """a, b, n, row and column shares, the expected count and the cell's part of chi-square, for cells that occur."""
    cells = df.na.drop(subset=[a, b]).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    row, col, all_ = F.sum("n").over(Window.partitionBy(a)), F.sum("n").over(Window.partitionBy(b)), F.sum("n").over(Window.partitionBy())
    out = cells.withColumns({"_r": row, "_c": col, "_t": all_})
    expected = F.col("_r") * F.col("_c") / F.col("_t")
    return out.select(a, b, "n", (F.col("n") / F.col("_r")).alias("row_share"), (F.col("n") / F.col("_c")).alias("col_share"), expected.alias("expected"), ((F.col("n") - expected) ** 2 / expected).alias("chi2_part"))


def chi2_test(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson chi-square, likelihood ratio, degrees of freedom, Cramer's V and p-value of independence."""
    cells = df.na.drop(subset=[a, b]).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    cells = cells.withColumns({"r": F.sum("n").over(Window.partitionBy(a)), "c": F.sum("n").over(Window.partitionBy(b))})
    # the sum over all cells, also empty ones: t (sum n^2 / (r c) - 1)
    x = cells.agg(F.sum("n"), F.sum(F.col("n") * F.col("n") / F.col("r") / F.col("c")), F.countDistinct(a), F.countDistinct(b), F.sum(F.col("n") * F.log(F.col("n") / (F.col("r") * F.col("c"))))).first()
    t, s, r, c, g = x
    chi2, df_, lr = t * (s - 1), (r - 1) * (c - 1), 2 * (g + t * math.log(t))
    row = (float(chi2), float(lr), int(df_), math.sqrt(chi2 / (t * max(min(r, c) - 1, 1))), dist.chi2_sf(chi2, df_) if df_ else 1.0, int(t))
    return small(df.sparkSession, [row], "chi2 double, lr double, df int, cramers_v double, p_value double, n long")


def correlate(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pairwise Pearson correlations over complete pairs: a, b, n, corr, t statistic."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    both = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull()
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count(F.when(both(a, b), 1)).alias("n"), F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias("corr")) for a, b in pairs]
    out = df.agg(F.array(*cells).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    return out.withColumn("t", F.col("corr") * F.sqrt((F.col("n") - 2) / (1 - F.col("corr") ** 2)))


def ttest(df: DataFrame, value: str, group: str, levels: tuple, *, unequal: bool = False) -> DataFrame:
    """Two-sample t test: difference of means, its standard error, t, degrees of freedom (Welch's if unequal), p-value."""
    rows = {r[0]: r for r in df.where(F.col(group).isin(*levels)).groupBy(group).agg(F.count(value), F.avg(value), F.var_samp(value)).collect()}
    (_, n1, m1, v1), (_, n2, m2, v2) = (rows[x] for x in levels)
    if unequal:
        a, b = v1 / n1, v2 / n2
        se, nu = math.sqrt(a + b), (a + b) ** 2 / (a * a / (n1 - 1) + b * b / (n2 - 1))
    else:
        nu = n1 + n2 - 2
        se = math.sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / nu * (1 / n1 + 1 / n2))
    t = (m1 - m2) / se
    return small(df.sparkSession, [(m1 - m2, se, t, float(nu), dist.two_sided(t, nu))], "diff double, std_error double, t double, df double, p_value double")


def sdtest(df: DataFrame, value: str, group: str, levels: tuple) -> DataFrame:
    """Variance ratio test: F, both degrees of freedom, two-sided p-value."""
    rows = {r[0]: r for r in df.where(F.col(group).isin(*levels)).groupBy(group).agg(F.count(value), F.var_samp(value)).collect()}
    (_, n1, v1), (_, n2, v2) = (rows[x] for x in levels)
    up = dist.f_sf(v1 / v2, n1 - 1, n2 - 1)
    return small(df.sparkSession, [(v1 / v2, n1 - 1, n2 - 1, min(1.0, 2 * min(up, 1 - up)))], "f double, df1 long, df2 long, p_value double")


def oneway(df: DataFrame, value: str, group: str) -> DataFrame:
    """One-way analysis of variance with Bartlett's test: sums of squares, F, p-value, Bartlett's chi-square."""
    groups = df.na.drop(subset=[value, group]).groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"))
    grand = groups.agg(F.sum(F.col("n") * F.col("m")) / F.sum("n")).first()[0]
    k, n, between, inner, logs, rec = groups.agg(
        F.count(F.lit(1)), F.sum("n"), F.sum(F.col("n") * (F.col("m") - F.lit(grand)) ** 2), F.sum((F.col("n") - 1) * F.coalesce("v", F.lit(0.0))),
        F.sum((F.col("n") - 1) * F.log("v")), F.sum(1 / (F.col("n") - 1)),
    ).first()
    f = between / (k - 1) / (inner / (n - k))
    bartlett = ((n - k) * math.log(inner / (n - k)) - logs) / (1 + (rec - 1 / (n - k)) / (3 * (k - 1)))
    row = (between, inner, int(k - 1), int(n - k), f, dist.f_sf(f, k - 1, n - k), bartlett, dist.chi2_sf(bartlett, k - 1))
    return small(df.sparkSession, [row], "ss_between double, ss_within double, df_between int, df_within int, f double, p_value double, bartlett double, bartlett_p double")


def midranks(df: DataFrame, value: str, by: list[str] | None = None, name: str = "rank") -> DataFrame:
    """``df`` with the average rank among ties. Ranks come from counts of distinct values, so a frequent value is one
    row in the window; ``by`` splits the ranking."""
    by = by or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    if by:
        upto = F.sum("_n").over(Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
        ranks = counts.withColumn(name, upto - (F.col("_n") - 1) / 2).drop("_n")
    else:
        ranks = running(counts, value, "_n", "_upto").withColumn(name, F.col("_upto") - (F.col("_n") - 1) / 2).drop("_n", "_upto")
    return df.join(ranks, [*by, value], "left")


def ranksum(df: DataFrame, value: str, group: str, levels: tuple) -> DataFrame:
    """Wilcoxon rank-sum test: rank sums, U, z with the correction for ties, p-value."""
    rows = midranks(df.where(F.col(group).isin(*levels)).where(F.col(value).isNotNull()).select(value, group), value)
    sums = {r[0]: (r[1], r[2]) for r in rows.groupBy(group).agg(F.count(F.lit(1)), F.sum("rank")).collect()}
    ties = rows.groupBy(value).agg(F.count(F.lit(1)).alias("t")).agg(F.sum(F.col("t").cast("double") ** 3 - F.col("t"))).first()[0]
    (n1, r1), (n2, r2) = (sums[x] for x in levels)
    n = n1 + n2
    var = n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1)))
    z = (r1 - n1 * (n + 1) / 2) / math.sqrt(var)
    return small(df.sparkSession, [(float(r1), float(r2), r1 - n1 * (n1 + 1) / 2, z, dist.two_sided(z, None))], "rank_sum1 double, rank_sum2 double, u double, z double, p_value double")


def kruskal(df: DataFrame, value: str, group: str) -> DataFrame:
    """Kruskal-Wallis test, with and without the correction for ties."""
    rows = midranks(df.na.drop(subset=[value, group]).select(value, group), value)
    k, n, s = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum("rank").alias("r")).agg(F.count(F.lit(1)), F.sum("n"), F.sum(F.col("r") ** 2 / F.col("n"))).first()
    ties = rows.groupBy(value).agg(F.count(F.lit(1)).alias("t")).agg(F.sum(F.col("t").cast("double") ** 3 - F.col("t"))).first()[0]
    h = 12 / (n * (n + 1)) * s - 3 * (n + 1)
    tied = h / (1 - ties / (float(n) ** 3 - n))
    return small(df.sparkSession, [(h, tied, int(k - 1), dist.chi2_sf(tied, k - 1))], "h double, h_tied double, df int, p_value double")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Spearman's rank correlation over complete pairs, with its t statistic."""
    rows = df.select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).na.drop()
    ranked = midranks(midranks(rows, "a", name="ra"), "b", name="rb")
    out = ranked.agg(F.count(F.lit(1)).alias("n"), F.corr("ra", "rb").alias("rho"))
    return out.withColumn("t", F.col("rho") * F.sqrt((F.col("n") - 2) / (1 - F.col("rho") ** 2)))


def signtest(df: DataFrame, value: str, median: float) -> DataFrame:
    """Counts above, below and at a median, and the normal approximation of the sign test."""
    up, down, at = df.agg(F.count(F.when(F.col(value) > median, 1)), F.count(F.when(F.col(value) < median, 1)), F.count(F.when(F.col(value) == median, 1))).first()
    z = (up - down) / math.sqrt(max(up + down, 1))
    return small(df.sparkSession, [(up, down, at, z, dist.two_sided(z, None))], "above long, below long, equal long, z double, p_value double")


def signrank(df: DataFrame, value: str, median: float = 0.0) -> DataFrame:
    """Wilcoxon signed-rank test of a median: sums of ranks, z with zeros and ties adjusted, p-value."""
    d = df.where(F.col(value).isNotNull()).select((F.col(value).cast("double") - F.lit(median)).alias("d")).withColumn("a", F.abs("d"))
    ranked = midranks(d, "a")
    n, plus, minus, zeros = ranked.agg(F.count(F.lit(1)), F.sum(F.when(F.col("d") > 0, F.col("rank")).otherwise(0.0)), F.sum(F.when(F.col("d") < 0, F.col("rank")).otherwise(0.0)), F.count(F.when(F.col("d") == 0, 1))).first()
    ties = d.where("a > 0").groupBy("a").agg(F.count(F.lit(1)).alias("t")).agg(F.coalesce(F.sum(F.col("t").cast("double") ** 3 - F.col("t")), F.lit(0.0))).first()[0]
    var = (n * (n + 1) * (2 * n + 1) - zeros * (zeros + 1) * (2 * zeros + 1)) / 24 - ties / 48
    z = (plus - (n * (n + 1) - zeros * (zeros + 1)) / 4) / math.sqrt(var)
    return small(df.sparkSession, [(plus, minus, z, dist.two_sided(z, None))], "sum_plus double, sum_minus double, z double, p_value double")


def histogram(df: DataFrame, value: str, bins: int = 40) -> DataFrame:
    """Equal-width counts: bin, low, high, n; the last edge belongs to the last bin. A constant column is widened by
    1 % or 1/2, whichever is more."""
    rows = df.select(F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    low, high = rows.agg(F.min("v"), F.max("v")).first()
    if low is None:
        return rows.select(F.lit(0).alias("bin"), F.col("v").alias("low"), F.col("v").alias("high"), F.lit(0).cast("long").alias("n"))
    if low == high:
        pad = max(abs(low) * 0.01, 0.5)
        low, high = low - pad, high + pad
    width = (high - low) / bins
    place = F.least(F.floor((F.col("v") - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = rows.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    edge = lambda i: F.lit(low) + i * F.lit(width)
    return every.join(counts, "bin", "left").select("bin", edge(F.col("bin")).alias("low"), edge(F.col("bin") + 1).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def categorical(df: DataFrame, x: str, y: str, measure: str = "sum", most: int = 1000) -> DataFrame:
    """Sum, mean or count by category, null for groups without values; more than ``most`` groups are refused."""
    made = {"sum": F.sum, "mean": F.avg, "count": F.count}[measure]
    out = df.groupBy(x).agg(made(y).alias(measure))
    if out.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} groups")
    return out


def roc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve from midranks, with the numbers of both classes."""
    rows = midranks(df.na.drop(subset=[score, label]).select(score, label), score)
    n1, n0, r = rows.agg(F.sum(F.col(label).cast("long")), F.sum((1 - F.col(label)).cast("long")), F.sum(F.col("rank") * F.col(label))).first()
    return small(df.sparkSession, [(n1, n0, (r - n1 * (n1 + 1) / 2) / (n1 * n0))], "positives long, negatives long, auc double")


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa for two ratings of the same items: agreement, expected agreement, kappa."""
    cells = df.na.drop(subset=[a, b]).groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    n, same = cells.agg(F.sum("n"), F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("n"))), F.lit(0))).first()
    rows = cells.groupBy("a").agg(F.sum("n").alias("ra")).join(cells.groupBy(F.col("b").alias("a")).agg(F.sum("n").alias("rb")), "a")
    expected = (rows.agg(F.sum(F.col("ra") * F.col("rb"))).first()[0] or 0) / n**2
    return small(df.sparkSession, [(n, same / n, expected, (same / n - expected) / (1 - expected))], "n long, agreement double, expected double, kappa double")


def mcnemar(df: DataFrame, a: str, b: str) -> DataFrame:
    """McNemar's test for paired 0/1 outcomes: both discordant counts, chi-square, p-value."""
    x, y = df.agg(F.count(F.when((F.col(a) == 1) & (F.col(b) == 0), 1)), F.count(F.when((F.col(a) == 0) & (F.col(b) == 1), 1))).first()
    chi2 = (x - y) ** 2 / max(x + y, 1)
    return small(df.sparkSession, [(x, y, float(chi2), dist.chi2_sf(chi2, 1))], "n10 long, n01 long, chi2 double, p_value double")


def scatter(df: DataFrame, x: str, y: str, order: list[str], most: int = 2000) -> DataFrame:
    """At most ``most`` finite pairs at even ranks of the stated order, the first and last among them."""
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), *[F.col(o).alias(f"o_{i}") for i, o in enumerate(order)]).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    n = rows.count()
    if n <= most:
        return rows.select("x", "y")
    # rows are counted by the first key's slices; only a slice's rows are ordered together
    rows = rows.withColumn("s", _slice_of(rows))
    sums = rows.groupBy(F.col("s").alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    starts = sums.select("_s", F.coalesce(F.sum("_n").over(Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    inner = Window.partitionBy("s").orderBy(*[f"o_{i}" for i in range(len(order))])
    ranked = rows.join(F.broadcast(starts), F.col("s") == F.col("_s")).withColumn("i", F.col("_start") + F.row_number().over(inner) - 1)
    step = F.lit((n - 1) / (most - 1))
    even = F.floor(F.ceil(F.col("i") / step) * step + 1e-9) == F.col("i")
    return ranked.where(even).select("x", "y")


def _slice_of(rows: DataFrame) -> Column:
    """Slices of the first key where it is a number or a time, else one."""
    kind = dict(rows.dtypes)["o_0"]
    if kind in ("string", "boolean", "binary"):
        return F.lit(0)
    value = F.col("o_0") if kind not in ("timestamp", "timestamp_ntz", "date") else F.unix_seconds(F.col("o_0").cast("timestamp"))
    numbered = rows.withColumn("_v", value.cast("double"))
    cuts = sorted(set(numbered.agg(F.percentile_approx("_v", [i / 256 for i in range(1, 256)], 2_000)).first()[0] or []))
    return F.coalesce(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < value.cast("double"))), F.lit(-1)) if cuts else F.lit(0)


def one_row(spark: SparkSession, values: dict[str, float]) -> DataFrame:
    return small(spark, [tuple(values.values())], ", ".join(f"{k} {'long' if isinstance(v, int) else 'double'}" for k, v in values.items()))
