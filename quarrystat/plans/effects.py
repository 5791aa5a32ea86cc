"""Queries on local polynomials, discontinuities, staggered adoption, treatment effects and resampled scores, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystat.functions import jets as J
from quarrystat.operators import local, mle, staggered, wild
from quarrystat.plans.basic import query, rounded
from quarrystat.plans.spec import Spec
from quarrystat.sources.tables import small, table


def _priced(spark: SparkSession, sf: str) -> DataFrame:
    """Lines' quantities, higher by five where the price passes 50,000."""
    d = table(spark, sf, "lineitem")
    x = F.col("l_extendedprice")
    jump = (x >= 50_000).cast("double")
    return d.select(x.alias("x"), (F.col("l_quantity") + 5 * jump).alias("y"), (F.col("l_tax") * 5 + jump * 0.4).alias("d"))


PRICED = "l AS (SELECT l_extendedprice AS x, l_quantity + CASE WHEN l_extendedprice >= 50000 THEN 5.0 ELSE 0.0 END AS y FROM lineitem)"

#: Weighted least squares on a line by group, with the sandwich of its own squared residuals.
LINE = """s AS (SELECT g, sum(w) AS s0, sum(w * u) AS s1, sum(w * u * u) AS s2, sum(w * y) AS t0, sum(w * u * y) AS t1 FROM k GROUP BY g),
b AS (SELECT *, s0 * s2 - s1 * s1 AS det, (s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1) AS b0, (s0 * t1 - s1 * t0) / (s0 * s2 - s1 * s1) AS b1 FROM s),
v AS (SELECT g, sum((w * (s2 - s1 * u) / det * (y - b0 - b1 * u)) ** 2) AS v FROM k JOIN b USING (g) GROUP BY g)"""


@query(f"""WITH {PRICED}, k AS (SELECT pt AS g, (x - pt) / 15000 AS u, y, 0.75 * (1 - ((x - pt) / 15000) ** 2) AS w FROM l, (SELECT 10000.0::DOUBLE * i AS pt FROM range(1, 10) r(i)) WHERE abs(x - pt) < 15000), {LINE}
SELECT g AS x, round(b0, 6) AS estimate, round(b1 / 15000, 9) AS slope, round(sqrt(v), 6) AS std_error FROM b JOIN v USING (g)""")
def local_lines(spark, sf):
    rows = local.local_polynomial(_priced(spark, sf), "y", "x", points=[10_000.0 * i for i in range(1, 10)], bandwidth=15_000.0)
    return rows.select("x", F.round("estimate", 6).alias("estimate"), F.round("slope", 9).alias("slope"), F.round("std_error", 6).alias("std_error"))


@query(f"""WITH {PRICED}, k AS (SELECT x >= 50000 AS g, (x - 50000) / 20000 AS u, y, 1 - abs((x - 50000) / 20000) AS w FROM l WHERE abs(x - 50000) < 20000), {LINE}
SELECT round(sum(CASE WHEN g THEN b0 ELSE -b0 END), 6) AS estimate, round(sqrt(sum(v)), 6) AS std_error FROM b JOIN v USING (g)""")
def discontinuity_conventional(spark, sf):
    rows = local.discontinuity(_priced(spark, sf), "y", "x", 50_000.0, bandwidth=20_000.0).where("method = 'conventional'")
    return rounded(rows.select("estimate", "std_error"), 6)


@query()
def discontinuity_robust(spark, sf):
    return rounded(local.discontinuity(_priced(spark, sf), "y", "x", 50_000.0), 3)


@query()
def discontinuity_fuzzy(spark, sf):
    return rounded(local.discontinuity(_priced(spark, sf), "y", "x", 50_000.0, bandwidth=20_000.0, treated="d"), 4)


@query(f"""WITH {PRICED}, r AS (SELECT min(x) AS low, max(x) AS high FROM l), p AS (SELECT CASE WHEN x >= 50000 THEN 1 ELSE -1 END AS side, CASE WHEN x >= 50000 THEN (high - 50000) / 15 ELSE (50000 - low) / 15 END AS width, abs(x - 50000) AS d, y FROM l, r),
q AS (SELECT side, width, CAST(least(floor(d / width), 14) AS INTEGER) AS bin, y FROM p)
SELECT side, bin, round(50000 + side * (bin + 0.5) * max(width), 4) AS middle, count(*) AS n, round(avg(y), 6) AS mean, round(stddev(y) / sqrt(count(*)), 6) AS std_error FROM q GROUP BY side, bin""")
def discontinuity_bins(spark, sf):
    rows = local.rd_plot(_priced(spark, sf), "y", "x", 50_000.0, bins=15)
    return rows.select("side", "bin", F.round("middle", 4).alias("middle"), "n", F.round("mean", 6).alias("mean"), F.round("std_error", 6).alias("std_error"))


def _adopters(spark: SparkSession, sf: str) -> DataFrame:
    """What each customer orders a year, in thousands; a fifth of the customers adopts something in 1997, one in 1999, and gains
    with it."""
    years = F.explode(F.sequence(F.lit(1995), F.lit(2000))).alias("t")
    everyone = table(spark, sf, "customer").select(F.col("c_custkey").alias("u"), "c_acctbal", years)
    spent = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("u"), F.year("o_orderdate").alias("t")).agg(F.sum("o_totalprice").alias("s"))
    g = F.when(F.col("u") % 5 == 1, 1997).when(F.col("u") % 5 == 2, 1999)
    gain = F.when(F.col("t") >= g, 20.0 * (F.col("t") - g + 1)).otherwise(0.0)
    return everyone.join(spent, ["u", "t"], "left").select("u", "t", g.alias("g"), (F.coalesce("s", F.lit(0.0)) / 1000 + gain).alias("y"), (F.col("c_acctbal") / 1000).alias("x"))


ADOPTERS = """o AS (SELECT o_custkey AS u, year(o_orderdate) AS t, sum(o_totalprice) AS s FROM orders GROUP BY 1, 2),
e AS (SELECT c_custkey AS u, t, CASE c_custkey % 5 WHEN 1 THEN 1997 WHEN 2 THEN 1999 END AS g FROM customer, range(1995, 2001) r(t)),
a AS (SELECT u, t, g, coalesce(s, 0) / 1000 + CASE WHEN t >= g THEN 20.0 * (t - g + 1) ELSE 0 END AS y FROM e LEFT JOIN o USING (u, t))"""
CHANGES = f"""{ADOPTERS}, c AS (SELECT DISTINCT g AS cohort, t AS time, CASE WHEN t >= g THEN g - 1 ELSE t - 1 END AS base FROM a WHERE g IS NOT NULL AND t > 1995),
x AS (SELECT cohort, time, p.g IS NOT NULL AS own, avg(p.y - q.y) AS m, var_pop(p.y - q.y) AS v, count(*) AS n FROM c JOIN a p ON p.t = time JOIN a q ON q.u = p.u AND q.t = base WHERE p.g = cohort OR p.g IS NULL GROUP BY 1, 2, 3),
f AS (SELECT cohort, time, sum(CASE WHEN own THEN m ELSE -m END) AS estimate, sqrt(sum(v / n)) AS std_error, max(n) FILTER (own) AS n FROM x GROUP BY 1, 2)"""


@query(f"WITH {CHANGES} SELECT CAST(cohort AS BIGINT) AS cohort, CAST(time AS BIGINT) AS time, round(estimate, 5) AS estimate, round(std_error, 5) AS std_error FROM f")
def group_time_effects(spark, sf):
    fit = staggered.group_time(_adopters(spark, sf), "y", "u", "t", "g")
    return rounded(fit.frame(spark).select("cohort", "time", "estimate", "std_error"), 5)


@query(f"""WITH {CHANGES}, k AS (SELECT CAST(time - cohort AS BIGINT) AS key, sum(n * estimate) / sum(n) AS estimate FROM f GROUP BY 1)
SELECT key, round(estimate, 5) AS estimate FROM k UNION ALL SELECT NULL, round(avg(estimate), 5) FROM k WHERE key >= 0""")
def group_time_by_event(spark, sf):
    fit = staggered.group_time(_adopters(spark, sf), "y", "u", "t", "g")
    return rounded(fit.aggregate(spark, "event").select("key", "estimate"), 5)


@query()
def group_time_adjusted(spark, sf):
    fit = staggered.group_time(_adopters(spark, sf), "y", "u", "t", "g", ("x",), draws=500)
    return rounded(fit.frame(spark).drop("p_value"), 3)


@query()
def group_time_overall(spark, sf):
    fit = staggered.group_time(_adopters(spark, sf), "y", "u", "t", "g", controls="notyet")
    return rounded(fit.aggregate(spark, "simple").drop("p_value"), 4)


@query(f"""WITH {ADOPTERS}, d AS (SELECT *, CASE WHEN t >= g THEN 1.0 ELSE 0.0 END AS d FROM a), w AS (SELECT u, t, d - avg(d) OVER (PARTITION BY u) - avg(d) OVER (PARTITION BY t) + avg(d) OVER () AS d, y FROM d)
SELECT round(sum(d * y) / sum(d * d), 6) AS coefficient FROM w""")
def bacon_total(spark, sf):
    parts = staggered.bacon(_adopters(spark, sf), "y", "u", "t", "g")
    return rounded(parts.agg(F.sum(F.col("weight") * F.col("estimate")).alias("coefficient")), 6)


@query()
def bacon_parts(spark, sf):
    return rounded(staggered.bacon(_adopters(spark, sf), "y", "u", "t", "g"), 5)


@query("""WITH l AS (SELECT CAST(l_linestatus = 'F' AS DOUBLE) AS d, CAST(l_quantity > 30 AS DOUBLE) AS x, l_extendedprice / 1000 + 5 * CAST(l_linestatus = 'F' AS DOUBLE) * CAST(l_quantity > 30 AS DOUBLE) AS y FROM lineitem),
c AS (SELECT x, avg(d) AS p, avg(y) FILTER (d = 1) AS m1, avg(y) FILTER (d = 0) AS m0, count(*) AS n FROM l GROUP BY x), a AS (SELECT sum(n * (m1 - m0)) / sum(n) AS ate FROM c),
s AS (SELECT sum((d / p * (y - m1) - (1 - d) / (1 - p) * (y - m0) + m1 - m0 - ate) ** 2) AS v, count(*) AS n FROM l JOIN c USING (x), a)
SELECT method, round(ate, 6) AS estimate, round(sqrt(v) / s.n, 6) AS std_error FROM a, s, (VALUES ('ra'), ('ipw'), ('aipw')) m(method)""")
def treatment_effects_saturated(spark, sf):
    d = table(spark, sf, "lineitem")
    treated, x = (F.col("l_linestatus") == "F").cast("double"), (F.col("l_quantity") > 30).cast("double")
    rows = d.select(treated.alias("d"), x.alias("x"), (F.col("l_extendedprice") / 1000 + 5 * treated * x).alias("y"))
    return rounded(staggered.treatment_effects(rows, "y", "d", ("x",)).select("method", "estimate", "std_error"), 6)


@query()
def treatment_effects_adjusted(spark, sf):
    d = table(spark, sf, "lineitem")
    treated = (F.col("l_quantity") + 40 * F.col("l_discount") * 10 > 45).cast("double")
    rows = d.select(treated.alias("d"), "l_discount", "l_tax", (F.col("l_extendedprice") / 1000 + 5 * treated).alias("y"))
    return rounded(staggered.treatment_effects(rows, "y", "d", ("l_discount", "l_tax")), 3)


@query()
def wild_cluster_few(spark, sf):
    """Seven clusters, so all sign patterns are taken."""
    d = table(spark, sf, "lineitem").select((F.col("l_extendedprice") / 1000).alias("p"), F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"), F.col("l_linenumber").alias("g"))
    test = wild.wild_cluster(d, Spec("p", ("q", "d")), "q", "g")
    return rounded(small(spark, [("q", test.estimate, test.statistic(0.0)[0], test.p_value(), *test.confidence_set())], "term string, estimate double, t double, p_value double, ci_low double, ci_high double"), 4)


@query("""WITH d AS (SELECT l_extendedprice / 1000 AS y, l_quantity AS x, l_suppkey AS g FROM lineitem), m AS (SELECT avg(y) AS my, avg(x) AS mx, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_sxx(y, x) AS s FROM d),
u AS (SELECT g, sum((x - mx) / s * (y - a - b * x)) AS z FROM d, m GROUP BY g) SELECT round(max(b), 6) AS estimate, round(max(b) / sqrt(sum(z * z)), 5) AS t FROM u, m""")
def wild_cluster_statistic(spark, sf):
    d = table(spark, sf, "lineitem").select((F.col("l_extendedprice") / 1000).alias("p"), F.col("l_quantity").alias("q"), F.col("l_suppkey").alias("g"))
    test = wild.wild_cluster(d, Spec("p", ("q",)), "q", "g", draws=199)
    return small(spark, [(round(test.estimate, 6), round(float(test.statistic(0.0)[0]), 5))], "estimate double, t double")


@query()
def score_bootstrap_logit(spark, sf):
    d = table(spark, sf, "lineitem").select((F.col("l_returnflag") == "R").cast("double").alias("y"), F.col("l_quantity").alias("q"), (F.col("l_tax") * 10).alias("t"), F.col("l_suppkey").alias("g"))
    problem = mle.Problem(lambda y, e: e[0] * y["y"] - J.softplus(e[0]), ("y",), (mle.Equation("y", ("q", "t")),))
    return rounded(small(spark, [("q", *wild.score_test(d, problem, "q", "g"))], "term string, t double, p_value double"), 4)
