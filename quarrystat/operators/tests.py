"""Further tests and measures of agreement: reductions in Spark, a closed form for what is left."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrystat.functions import dist
from quarrystat.operators.descriptive import midranks
from quarrystat.operators.ranked import running
from quarrystat.sources.tables import small


def binomial(df: DataFrame, value: str, p: float) -> DataFrame:
    """The exact two-sided test of a share of ones: outcomes no likelier than the one seen count, whatever their number."""
    n, k = df.where(F.col(value).isNotNull()).agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col(value).cast("long")), F.lit(0))).first()
    chance = binomial_chance(n, k, p)
    return small(df.sparkSession, [(n, k, k / n if n else math.nan, chance)], "n long, k long, share double, p_value double")


def binomial_chance(n: int, k: int, p: float) -> float:
    """The odds of a count no likelier than ``k`` of ``n``: both tails by the incomplete beta function. Beyond the mode odds
    fall, so the other tail's edge is found by halving."""
    if not n or not 0 < p < 1:
        return 1.0 if not n or k == n * p else 0.0
    log = lambda j: math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p)
    upper = lambda j: 1.0 if j <= 0 else 0.0 if j > n else dist.beta_tail(j, n - j + 1, p)  # noqa: E731  # j or more
    lower = lambda j: 0.0 if j < 0 else 1.0 if j >= n else dist.beta_tail(n - j, j + 1, 1 - p)  # noqa: E731  # j or fewer
    mode, seen = min(int((n + 1) * p), n), log(k) + 1e-9
    if k == mode:
        return 1.0
    if k < mode:
        low, high = mode, n + 1  # the first place above the mode that is no likelier
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if log(mid) <= seen else (mid + 1, high)
        return min(1.0, lower(k) + upper(low))
    low, high = -1, mode
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if log(mid) <= seen else (low, mid - 1)
    return min(1.0, lower(low) + upper(k))


def proportions(df: DataFrame, value: str, group: str, levels: tuple) -> DataFrame:
    """Two shares of ones: their difference, z with the pooled share, p-value."""
    got = {r[0]: (r[1], r[2]) for r in df.where(F.col(group).isin(*levels) & F.col(value).isNotNull()).groupBy(group).agg(F.count(F.lit(1)), F.sum(F.col(value).cast("double"))).collect()}
    (n1, k1), (n2, k2) = (got[v] for v in levels)
    pooled = (k1 + k2) / (n1 + n2)
    z = (k1 / n1 - k2 / n2) / math.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n2))
    return small(df.sparkSession, [(k1 / n1, k2 / n2, k1 / n1 - k2 / n2, z, dist.two_sided(z, None))], "share1 double, share2 double, diff double, z double, p_value double")


def goodness(df: DataFrame, value: str, shares: dict) -> DataFrame:
    """Pearson's chi-square of counts against stated shares."""
    got = {r[0]: r[1] for r in df.where(F.col(value).isin(*shares)).groupBy(value).agg(F.count(F.lit(1))).collect()}
    n, whole = sum(got.values()), sum(shares.values())
    chi2 = sum((got.get(v, 0) - n * s / whole) ** 2 / (n * s / whole) for v, s in shares.items())
    return small(df.sparkSession, [(chi2, len(shares) - 1, dist.chi2_sf(chi2, len(shares) - 1))], "chi2 double, df int, p_value double")


def one_sample(df: DataFrame, value: str, mean: float = 0.0) -> DataFrame:
    """The t test of a mean; of differences, the paired test."""
    n, m, s = df.agg(F.count(value), F.avg(value), F.stddev(value)).first()
    t = (m - mean) / (s / math.sqrt(n))
    return small(df.sparkSession, [(n, m, s / math.sqrt(n), t, dist.two_sided(t, n - 1))], "n long, mean double, std_error double, t double, p_value double")


def welch_anova(df: DataFrame, value: str, group: str) -> DataFrame:
    """Equality of means without equal variances."""
    g = df.na.drop(subset=[value, group]).groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v")).withColumn("w", F.col("n") / F.col("v"))
    k, w, wm, wmm = g.agg(F.count(F.lit(1)), F.sum("w"), F.sum(F.col("w") * F.col("m")), F.sum(F.col("w") * F.col("m") ** 2)).first()
    lam = g.agg(F.sum((1 - F.col("w") / F.lit(w)) ** 2 / (F.col("n") - 1))).first()[0] * 3 / (k * k - 1)
    f = (wmm - wm * wm / w) / (k - 1) / (1 + 2 * (k - 2) / 3 * lam)
    return small(df.sparkSession, [(f, float(k - 1), 1 / lam, dist.f_sf(f, k - 1, 1 / lam))], "f double, df1 double, df2 double, p_value double")


def levene(df: DataFrame, value: str, group: str) -> DataFrame:
    """Equality of spreads: the analysis of variance of distances from the group means."""
    from quarrystat.operators.descriptive import oneway

    means = df.na.drop(subset=[value, group]).groupBy(F.col(group).alias("_g")).agg(F.avg(value).alias("_m"))
    rows = df.na.drop(subset=[value, group]).join(means, F.col(group) == F.col("_g")).select(group, F.abs(F.col(value) - F.col("_m")).alias("d"))
    return oneway(rows, "d", group).select("f", "df_between", "df_within", "p_value")


def friedman(df: DataFrame, value: str, block: str, treatment: str) -> DataFrame:
    """Ranks within blocks, tied values averaged: chi-square that treatments don't differ. Blocks must be complete."""
    rows = df.na.drop(subset=[value, block, treatment])
    inner = Window.partitionBy(block)
    ranked = rows.withColumn("r", F.rank().over(inner.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(block, value)) - 1) / 2)
    b, k, cells, squares = ranked.agg(F.countDistinct(block), F.countDistinct(treatment), F.count(F.lit(1)), F.sum(F.col("r") ** 2)).first()
    if cells != b * k:
        raise ValueError("a block lacks a treatment or has one twice")
    sums = ranked.groupBy(treatment).agg(F.sum("r").alias("s")).agg(F.sum((F.col("s") - F.lit(b * (k + 1) / 2)) ** 2)).first()[0]
    chi2 = (k - 1) * sums / (squares - b * k * (k + 1) ** 2 / 4)
    return small(df.sparkSession, [(float(chi2), int(k - 1), dist.chi2_sf(chi2, k - 1))], "chi2 double, df int, p_value double")


def cochran_q(df: DataFrame, value: str, block: str, treatment: str) -> DataFrame:
    """Equality of shares of ones over treatments within blocks."""
    rows = df.na.drop(subset=[value, block, treatment]).select(block, treatment, F.col(value).cast("double").alias("v"))
    k, total, cols = rows.groupBy(treatment).agg(F.sum("v").alias("s")).agg(F.count(F.lit(1)), F.sum("s"), F.sum(F.col("s") ** 2)).first()
    rows_sq = rows.groupBy(block).agg(F.sum("v").alias("s")).agg(F.sum(F.col("s") ** 2)).first()[0]
    q = (k - 1) * (k * cols - total**2) / (k * total - rows_sq)
    return small(df.sparkSession, [(q, int(k - 1), dist.chi2_sf(q, k - 1))], "q double, df int, p_value double")


def kolmogorov(df: DataFrame, value: str, group: str, levels: tuple) -> DataFrame:
    """The two-sample Kolmogorov-Smirnov test, from running counts of distinct values."""
    rows = df.where(F.col(group).isin(*levels) & F.col(value).isNotNull())
    counts = rows.groupBy(F.col(value).cast("double").alias("v")).agg(*[F.count(F.when(F.col(group) == g, 1)).alias(f"n{i}") for i, g in enumerate(levels)])
    n1, n2 = counts.agg(F.sum("n0"), F.sum("n1")).first()
    gap = F.col("u0") / n1 - F.col("u1") / n2
    up, down = running(counts, "v", ["n0", "n1"], ["u0", "u1"]).agg(F.max(gap), F.min(gap)).first()
    d = max(up, -down)
    x = d * math.sqrt(n1 * n2 / (n1 + n2))
    p = min(1.0, max(0.0, 2 * sum((-1) ** (j - 1) * math.exp(-2 * j * j * x * x) for j in range(1, 101)))) if x > 0.2 else 1.0
    return small(df.sparkSession, [(max(up, 0.0), max(-down, 0.0), d, p)], "above double, below double, d double, p_value double")


def median_test(df: DataFrame, value: str, group: str) -> DataFrame:
    """Counts above and not above the overall median by group: chi-square of independence."""
    from quarrystat.operators.descriptive import chi2_test, describe

    middle = describe(df.na.drop(subset=[value, group]), [value], percentiles=(50,)).first()["p50"]
    return chi2_test(df.na.drop(subset=[value, group]).withColumn("_above", F.col(value) > F.lit(middle)), "_above", group).select("chi2", "df", "p_value")


def skewness_kurtosis(df: DataFrame, value: str) -> DataFrame:
    """Moments of shape and the Jarque-Bera test of normality."""
    n, s, k = df.agg(F.count(value), F.skewness(value), F.kurtosis(value)).first()
    jb = n / 6 * (s * s + k * k / 4)
    return small(df.sparkSession, [(n, s, k + 3, jb, dist.chi2_sf(jb, 2))], "n long, skewness double, kurtosis double, jarque_bera double, p_value double")


def kendall(df: DataFrame, a: str, b: str) -> DataFrame:
    """Kendall's tau-a and tau-b for columns with few distinct values: pairs are counted over the cells of the table."""
    cells = df.na.drop(subset=[a, b]).groupBy(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    size = cells.count()
    if size > 20_000:
        raise ValueError("more than 20,000 cells")
    other = F.broadcast(cells.toDF("c", "d", "m"))  # the size is checked above
    s = cells.join(other, F.col("c") > F.col("a")).agg(F.sum(F.col("n") * F.col("m") * F.signum(F.col("d") - F.col("b")))).first()[0] or 0.0
    pairs = lambda by: cells.groupBy(by).agg(F.sum("n").alias("t")).agg(F.sum(F.col("t") * (F.col("t") - 1) / 2)).first()[0]
    n = cells.agg(F.sum("n")).first()[0]
    all_ = n * (n - 1) / 2
    free = (all_ - pairs("a")) * (all_ - pairs("b"))  # 0 where a column has one value
    return small(df.sparkSession, [(int(n), float(s), s / all_, s / math.sqrt(free) if free else math.nan)], "n long, score double, tau_a double, tau_b double")


def runs(df: DataFrame, value: str, order: str, cut: float) -> DataFrame:
    """Runs above and not above a cut in the stated order, which is one series: runs, z, p-value."""
    up = (F.col(value) > cut).cast("int")
    rows = df.na.drop(subset=[value, order]).select(up.alias("u"), F.col(order).alias("t"))
    turned = rows.withColumn("new", (F.coalesce(F.lag("u").over(Window.orderBy("t")), F.lit(-1)) != F.col("u")).cast("int"))
    r, n1, n = turned.agg(F.sum("new"), F.sum("u"), F.count(F.lit(1))).first()
    n0 = n - n1
    mean = 2 * n1 * n0 / n + 1
    z = (r - mean) / math.sqrt((mean - 1) * (mean - 2) / (n - 1))
    return small(df.sparkSession, [(r, n1, n0, z, dist.two_sided(z, None))], "runs long, above long, below long, z double, p_value double")


def trend(df: DataFrame, value: str, group: str) -> DataFrame:
    """Cuzick's test for trend: rank sums weighted by the group's number."""
    rows = midranks(df.na.drop(subset=[value, group]).select(value, F.col(group).cast("double").alias("g")), value)
    n, t, l1, l2 = rows.agg(F.count(F.lit(1)), F.sum(F.col("rank") * F.col("g")), F.sum("g"), F.sum(F.col("g") ** 2)).first()
    ties = rows.groupBy(value).agg(F.count(F.lit(1)).alias("t")).agg(F.sum(F.col("t").cast("double") ** 3 - F.col("t"))).first()[0]
    var = (n + 1) / 12 * (n * l2 - l1 * l1) * (1 - ties / (float(n) ** 3 - n))
    z = (t - (n + 1) * l1 / 2) / math.sqrt(var)
    return small(df.sparkSession, [(t, z, dist.two_sided(z, None))], "score double, z double, p_value double")


def fisher_exact(df: DataFrame, a: str, b: str) -> DataFrame:
    """The exact test of a two by two table of 0 and 1, two-sided: tables no likelier than the one seen count."""
    x = {(r[0], r[1]): r[2] for r in df.na.drop(subset=[a, b]).groupBy(F.col(a).cast("int"), F.col(b).cast("int")).agg(F.count(F.lit(1))).collect()}
    p, q, r, s = (x.get(k, 0) for k in ((1, 1), (1, 0), (0, 1), (0, 0)))
    row, col, n = p + q, p + r, p + q + r + s
    choose = lambda m, k: math.lgamma(m + 1) - math.lgamma(k + 1) - math.lgamma(m - k + 1)
    log = lambda j: choose(row, j) + choose(n - row, col - j) - choose(n, col)
    seen = log(p) + 1e-7
    chance = sum(math.exp(v) for j in range(max(0, col - (n - row)), min(row, col) + 1) if (v := log(j)) <= seen)
    return small(df.sparkSession, [(p * s / (q * r) if q and r else math.inf, min(1.0, chance))], "odds_ratio double, p_value double")


def intraclass(df: DataFrame, value: str, group: str) -> DataFrame:
    """The one-way intraclass correlation, from between and within mean squares."""
    g = df.na.drop(subset=[value, group]).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    k, n, nn, grand, inner = g.agg(F.count(F.lit(1)), F.sum("n"), F.sum(F.col("n") ** 2), F.sum(F.col("n") * F.col("m")) / F.sum("n"), F.sum(F.col("n") * F.col("v"))).first()
    between = g.agg(F.sum(F.col("n") * (F.col("m") - F.lit(grand)) ** 2)).first()[0] / (k - 1)
    within, size = inner / (n - k), (n - nn / n) / (k - 1)
    return small(df.sparkSession, [((between - within) / (between + (size - 1) * within), between / within)], "icc double, f double")


def raters(df: DataFrame, item: str, rating: str) -> DataFrame:
    """Agreement of any number of raters on items (a row a rating, items with two at least): Fleiss' kappa, Gwet's AC1
    and Krippendorff's nominal alpha."""
    counts = df.na.drop(subset=[item, rating]).groupBy(item, rating).agg(F.count(F.lit(1)).cast("double").alias("n"))
    sizes = counts.groupBy(F.col(item).alias("_i")).agg(F.sum("n").alias("m")).where("m > 1")
    cells = counts.join(sizes, F.col(item) == F.col("_i"))
    items, total, agree, pairs = cells.groupBy("_i").agg(F.first("m").alias("m"), F.sum(F.col("n") * (F.col("n") - 1)).alias("a")).agg(F.count(F.lit(1)), F.sum("m"), F.sum(F.col("a") / (F.col("m") * (F.col("m") - 1))), F.sum(F.col("a") / (F.col("m") - 1))).first()
    shares = cells.groupBy(rating).agg(F.sum("n").alias("n"), F.sum(F.col("n") / F.col("m")).alias("p"))
    q, pe, spread, same = shares.agg(F.count(F.lit(1)), F.sum((F.col("n") / total) ** 2), F.sum(F.col("p") / items * (1 - F.col("p") / items)), F.sum(F.col("n") * (F.col("n") - 1))).first()
    po, gwet = agree / items, spread / (q - 1)
    alpha = 1 - (total - pairs) / ((total * (total - 1) - same) / (total - 1))
    return small(df.sparkSession, [(items, po, (po - pe) / (1 - pe), (po - gwet) / (1 - gwet), alpha)], "items long, agreement double, fleiss double, gwet double, krippendorff double")


def missing_patterns(df: DataFrame, columns: list[str]) -> DataFrame:
    """pattern (a letter a column: x known, - missing) and its number of rows."""
    mark = F.concat(*[F.when(F.col(c).isNull(), "-").otherwise("x") for c in columns])
    return df.groupBy(mark.alias("pattern")).agg(F.count(F.lit(1)).alias("n"))


def life_table(df: DataFrame, time: str, event: str, width: float) -> DataFrame:
    """Deaths, losses and survival by intervals; losses count for half of theirs."""
    cells = df.na.drop(subset=[time, event]).groupBy(F.floor(F.col(time) / width).cast("long").alias("i")).agg(F.sum(F.col(event).cast("long")).alias("deaths"), F.sum((F.col(event) == 0).cast("long")).alias("lost"))
    rows = running(cells.withColumn("all", F.col("deaths") + F.col("lost")), "i", "all", "entering", descending=True)
    keep = rows.withColumn("p", 1 - F.col("deaths") / (F.col("entering") - F.col("lost") / 2))
    logged = keep.withColumns({"l": F.when(F.col("p") > 0, F.log("p")).otherwise(0.0), "z": (F.col("p") <= 0).cast("int")})
    out = running(logged, "i", ["l", "z"], ["sum_l", "sum_z"])
    return out.select((F.col("i") * width).alias("start"), "entering", "deaths", "lost", F.when(F.col("sum_z") > 0, 0.0).otherwise(F.exp("sum_l")).alias("survival"))
