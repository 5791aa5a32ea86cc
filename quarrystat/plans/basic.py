"""Queries on preparation, descriptive statistics, tests and linear models, with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystat.operators import descriptive as d
from quarrystat.operators import linear, prepare
from quarrystat.plans.spec import Spec, formula
from quarrystat.sources.tables import table


def rounded(df: DataFrame, digits: int = 6, drop: tuple[str, ...] = ()) -> DataFrame:
    """Doubles rounded, for comparison across engines; columns that SQL can't make are left out."""
    return df.select(*[(F.round(c, digits) if kind == "double" else F.col(c)).alias(c) for c, kind in df.dtypes if c not in drop])


def estimates(fit: linear.Fit, spark: SparkSession, digits: int = 6) -> DataFrame:
    return rounded(fit.frame(spark).select("term", "estimate", "std_error", "statistic"), digits)


def ols_sql(source: str, y: str, a: str, b: str, meat: str, factor: str, digits: int = 6, cluster: str = "NULL") -> str:
    """Least squares on two regressors by partialling out: each coefficient from the residual of its regressor on the
    other. ``meat``: the variance's numerator from r (that residual) and e (the model's), before / (sum r^2)^2."""
    return f"""
    WITH d AS (SELECT CAST({y} AS DOUBLE) AS y, CAST({a} AS DOUBLE) AS a, CAST({b} AS DOUBLE) AS b, {cluster} AS g FROM {source}),
    s AS (SELECT count(*) AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb FROM d),
    c AS (SELECT y - my AS y, a - ma AS a, b - mb AS b, g, n, my, ma, mb FROM d, s),
    p AS (SELECT sum(a * b) / sum(b * b) AS pa, sum(a * b) / sum(a * a) AS pb FROM c),
    r AS (SELECT *, a - pa * b AS ra, b - pb * a AS rb FROM c, p),
    k AS (SELECT sum(ra * y) / sum(ra * ra) AS ba, sum(rb * y) / sum(rb * rb) AS bb, sum(ra * ra) AS ssa, sum(rb * rb) AS ssb FROM r),
    e AS (SELECT r.*, k.*, y - ba * a - bb * b AS e FROM r, k),
    h AS (SELECT *, 1.0 / n - (ma * ra / ssa + mb * rb / ssb) AS rc FROM e),
    v AS ({meat})
    SELECT t.term, round(t.est, {digits}) AS estimate, round(sqrt(t.v * {factor}), {digits}) AS std_error, round(t.est / sqrt(t.v * {factor}), {digits}) AS statistic
    FROM (SELECT DISTINCT n, ba, bb, my, ma, mb FROM e) x, v, LATERAL (VALUES ('{a}', ba, va), ('{b}', bb, vb), ('_cons', my - ba * ma - bb * mb, vc)) t(term, est, v)"""


PLAIN = "SELECT sum(e * e) / max(ssa) AS va, sum(e * e) / max(ssb) AS vb, sum(e * e) * sum(rc * rc) AS vc, 0 AS groups FROM h"
ROBUST = "SELECT sum((e * ra / ssa) ** 2) AS va, sum((e * rb / ssb) ** 2) AS vb, sum((e * rc) ** 2) AS vc, 0 AS groups FROM h"
CLUSTER = """SELECT sum(xa * xa) AS va, sum(xb * xb) AS vb, sum(xc * xc) AS vc, count(*) AS groups
FROM (SELECT g, sum(e * ra / ssa) AS xa, sum(e * rb / ssb) AS xb, sum(e * rc) AS xc FROM h GROUP BY g)"""
#: 1 - h of each row, with h from the partialled-out residuals.
LEVER = "(1 - 1.0 / n - (a * a * ssb0 - 2 * a * b * sab + b * b * ssa0) / (ssa0 * ssb0 - sab * sab))"
HC = """SELECT sum((e / {d} * ra / ssa) ** 2) AS va, sum((e / {d} * rb / ssb) ** 2) AS vb, sum((e / {d} * rc) ** 2) AS vc, 0 AS groups
FROM (SELECT *, sum(a * a) OVER () AS ssa0, sum(b * b) OVER () AS ssb0, sum(a * b) OVER () AS sab FROM h)"""

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


Y, A, B = "l_extendedprice", "l_quantity", "l_discount"


def _ols(spark: SparkSession, sf: str, **options) -> DataFrame:
    return estimates(linear.ols(table(spark, sf, "lineitem"), Spec(Y, (A, B), **options)), spark, 4)


@query(ols_sql("lineitem", Y, A, B, PLAIN, "1.0 / (n - 3)", 4))
def ols_nonrobust(spark, sf):
    return _ols(spark, sf)


@query(ols_sql("lineitem", Y, A, B, ROBUST, "1.0", 4))
def ols_hc0(spark, sf):
    return _ols(spark, sf, covariance="HC0")


@query(ols_sql("lineitem", Y, A, B, ROBUST, "n / (n - 3)", 4))
def ols_hc1(spark, sf):
    return _ols(spark, sf, covariance="HC1")


@query(ols_sql("lineitem", Y, A, B, HC.format(d=f"sqrt{LEVER}"), "1.0", 4))
def ols_hc2(spark, sf):
    return _ols(spark, sf, covariance="HC2")


@query(ols_sql("lineitem", Y, A, B, HC.format(d=LEVER), "1.0", 4))
def ols_hc3(spark, sf):
    return _ols(spark, sf, covariance="HC3")


@query(ols_sql("lineitem", Y, A, B, CLUSTER, "groups / (groups - 1.0) * (n - 1) / (n - 3)", 4, "l_suppkey"))
def ols_cluster(spark, sf):
    return _ols(spark, sf, cluster=("l_suppkey",))


@query(f"""SELECT CAST(count(*) AS DOUBLE) AS n, round(regr_r2({Y}, {A}), 8) AS r2, round(sqrt((sum({Y} ** 2) / count(*) - avg({Y}) ** 2) * (1 - regr_r2({Y}, {A}))), 4) AS rmse FROM lineitem""")
def ols_metrics(spark, sf):
    m = linear.ols(table(spark, sf, "lineitem"), Spec(Y, (A,))).metrics
    return d.one_row(spark, {"n": m["n"], "r2": round(m["r2"], 8), "rmse": round(m["rmse"], 4)})


@query(f"""WITH g AS (SELECT {Y} - avg({Y}) OVER (PARTITION BY l_suppkey) AS y, {A} - avg({A}) OVER (PARTITION BY l_suppkey) AS a, count(DISTINCT l_suppkey) OVER () AS k FROM lineitem),
s AS (SELECT sum(a * y) / sum(a * a) AS b, sum(a * a) AS ss, count(*) AS n, max(k) AS k FROM g)
SELECT '{A}' AS term, round(max(b), 4) AS estimate, round(sqrt(sum((y - b * a) ** 2) / (max(n) - max(s.k) - 1) / max(ss)), 4) AS std_error,
  round(max(b) / sqrt(sum((y - b * a) ** 2) / (max(n) - max(s.k) - 1) / max(ss)), 4) AS statistic FROM g, s""")
def areg(spark, sf):
    return estimates(linear.areg(table(spark, sf, "lineitem"), Spec(Y, (A,)), ["l_suppkey"]), spark, 4)


@query()
def reghdfe_two_effects(spark, sf):
    return estimates(linear.areg(table(spark, sf, "lineitem"), Spec(Y, (A, B)), ["l_suppkey", "l_returnflag"]), spark, 4)


@query(f"""SELECT '{A}' AS term, round(covar_samp({Y}, l_tax) / covar_samp({A}, l_tax), 3) AS estimate FROM lineitem""")
def iv_2sls(spark, sf):
    fit = linear.ivregress(table(spark, sf, "lineitem"), Spec(Y, ()), (A,), ("l_tax",))
    return rounded(fit.frame(spark).select("term", "estimate").where(f"term = '{A}'"), 3)


@query(f"""SELECT term, round(e, 4) AS estimate FROM (SELECT sum({A} * {Y} * l_tax) / 1 AS z, regr_slope({Y}, {A}) AS u,
  (sum(l_tax * {A} * {Y}) / sum(l_tax) - sum(l_tax * {A}) / sum(l_tax) * sum(l_tax * {Y}) / sum(l_tax)) / (sum(l_tax * {A} * {A}) / sum(l_tax) - (sum(l_tax * {A}) / sum(l_tax)) ** 2) AS e, '{A}' AS term FROM lineitem WHERE l_tax > 0)""")
def wls(spark, sf):
    fit = linear.ols(table(spark, sf, "lineitem"), Spec(Y, (A,), weights="l_tax"))
    return rounded(fit.frame(spark).select("term", "estimate").where(f"term = '{A}'"), 4)


@query("""WITH d AS (SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS t, sum(value) AS y, CAST(count(*) AS DOUBLE) AS x FROM events GROUP BY 1),
s AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS c, avg(x) AS mx, regr_sxx(y, x) AS ss, count(*) AS n FROM d),
e AS (SELECT t, (y - c - b * x) * (x - mx) / ss AS q FROM d, s),
v AS (SELECT sum(a.q * b.q * CASE WHEN a.t = b.t THEN 1.0 ELSE 1 - abs(a.t - b.t) / 4.0 END) AS v FROM e a JOIN e b ON abs(a.t - b.t) <= 3)
SELECT 'x' AS term, round(b, 6) AS estimate, round(sqrt(v * n / (n - 2.0)), 6) AS std_error FROM s, v""")
def newey_west(spark, sf):
    days = table(spark, sf, "events").groupBy(F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long").alias("t")).agg(F.sum("value").alias("y"), F.count(F.lit(1)).cast("double").alias("x"))
    fit = linear.ols(days, Spec("y", ("x",), covariance="hac", time="t", lags=3))
    return rounded(fit.frame(spark).select("term", "estimate", "std_error").where("term = 'x'"))


@query("""WITH o AS (SELECT *, o_totalprice > 150000 AS big FROM orders)
SELECT 'o_orderpriority[' || p || ']' AS term, round(avg(o_totalprice) FILTER (o_orderpriority = p) - avg(o_totalprice) FILTER (o_orderpriority = f), 4) AS estimate
FROM orders, (SELECT min(o_orderpriority) AS f FROM orders) f, (SELECT DISTINCT o_orderpriority AS p FROM orders) WHERE p <> f GROUP BY p""")
def ols_formula_categories(spark, sf):
    fit = linear.ols(table(spark, sf, "orders"), formula("o_totalprice ~ C(o_orderpriority)"))
    return rounded(fit.frame(spark).select("term", "estimate").where("term <> '_cons'"), 4)


@query("""SELECT 'log(l_quantity)' AS term, round(regr_slope(ln(l_extendedprice), ln(l_quantity)), 8) AS estimate FROM lineitem""")
def ols_formula_logs(spark, sf):
    fit = linear.ols(table(spark, sf, "lineitem"), formula("log(l_extendedprice) ~ log(l_quantity)"))
    return rounded(fit.frame(spark).select("term", "estimate").where("term <> '_cons'"), 8)


@query(f"""WITH l AS (SELECT l_returnflag, u.* FROM lineitem, LATERAL (VALUES ('l_quantity', l_quantity), ('l_extendedprice', l_extendedprice)) u(variable, v)),
r AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY l_returnflag, variable) AS n FROM l WINDOW w AS (PARTITION BY l_returnflag, variable ORDER BY v))
SELECT l_returnflag, variable, count(*) AS n, round(avg(v), 4) AS mean, round(stddev(v), 4) AS sd, min(v) AS min, max(v) AS max,
  round((avg(v ** 3) - 3 * avg(v) * avg(v ** 2) + 2 * avg(v) ** 3) / var_pop(v) ** 1.5, 4) AS skewness, round(kurtosis_pop(v) + 3, 4) AS kurtosis,
  round(avg(v) FILTER (n * 25 % 100 <> 0 AND i = n * 25 // 100 + 1 OR n * 25 % 100 = 0 AND i IN (n * 25 // 100, n * 25 // 100 + 1)), 4) AS p25,
  round(avg(v) FILTER (n * 50 % 100 <> 0 AND i = n * 50 // 100 + 1 OR n * 50 % 100 = 0 AND i IN (n * 50 // 100, n * 50 // 100 + 1)), 4) AS p50,
  round(avg(v) FILTER (n * 75 % 100 <> 0 AND i = n * 75 // 100 + 1 OR n * 75 % 100 = 0 AND i IN (n * 75 // 100, n * 75 // 100 + 1)), 4) AS p75
FROM r GROUP BY l_returnflag, variable""")
def describe_by(spark, sf):
    return rounded(d.describe(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"], ["l_returnflag"]), 4)


@query("""WITH c AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL),
m AS (SELECT *, sum(n) OVER (PARTITION BY o_orderstatus) AS r, sum(n) OVER (PARTITION BY o_orderpriority) AS k, sum(n) OVER () AS t FROM c)
SELECT o_orderstatus, o_orderpriority, n, round(n / r, 6) AS row_share, round(n / k, 6) AS col_share, round(r * k / t, 6) AS expected, round((n - r * k / t) ** 2 / (r * k / t), 6) AS chi2_part FROM m""")
def crosstab(spark, sf):
    return rounded(d.crosstab(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority"))


@query("""WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY ALL),
m AS (SELECT *, sum(n) OVER (PARTITION BY a) AS r, sum(n) OVER (PARTITION BY b) AS k, sum(n) OVER () AS t FROM c)
SELECT round(max(t) * (sum(n * n / CAST(r * k AS DOUBLE)) - 1), 6) AS chi2, round(2 * sum(n * ln(n * t / CAST(r * k AS DOUBLE))), 6) AS lr,
 CAST((count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS INTEGER) AS df, CAST(max(t) AS BIGINT) AS n FROM m""")
def chi2_independence(spark, sf):
    return rounded(d.chi2_test(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority"), drop=("p_value", "cramers_v"))


@query("""SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, count(*) AS n, round(corr(l_quantity, l_extendedprice), 8) AS corr FROM lineitem
UNION ALL SELECT 'l_quantity', 'l_tax', count(*), round(corr(l_quantity, l_tax), 8) FROM lineitem
UNION ALL SELECT 'l_extendedprice', 'l_tax', count(*), round(corr(l_extendedprice, l_tax), 8) FROM lineitem""")
def correlations(spark, sf):
    return rounded(d.correlate(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"]), 8, ("t",))


TT = """WITH g AS (SELECT l_linestatus AS g, count(*) AS n, avg(l_extendedprice) AS m, var_samp(l_extendedprice) AS v FROM lineitem GROUP BY 1),
x AS (SELECT a.n AS n1, b.n AS n2, a.m - b.m AS diff, a.v AS v1, b.v AS v2 FROM g a, g b WHERE a.g = 'F' AND b.g = 'O')"""


@query(TT + """SELECT round(diff, 4) AS diff, round(sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)), 4) AS std_error,
round(diff / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)), 4) AS t, CAST(n1 + n2 - 2 AS DOUBLE) AS df FROM x""")
def ttest_pooled(spark, sf):
    return rounded(d.ttest(table(spark, sf, "lineitem"), "l_extendedprice", "l_linestatus", ("F", "O")), 4, ("p_value",))


@query(TT + """SELECT round(diff, 4) AS diff, round(sqrt(v1 / n1 + v2 / n2), 4) AS std_error, round(diff / sqrt(v1 / n1 + v2 / n2), 4) AS t,
round((v1 / n1 + v2 / n2) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1)), 4) AS df FROM x""")
def ttest_welch(spark, sf):
    return rounded(d.ttest(table(spark, sf, "lineitem"), "l_extendedprice", "l_linestatus", ("F", "O"), unequal=True), 4, ("p_value",))


@query(TT + "SELECT round(v1 / v2, 6) AS f, n1 - 1 AS df1, n2 - 1 AS df2 FROM x")
def sdtest(spark, sf):
    return rounded(d.sdtest(table(spark, sf, "lineitem"), "l_extendedprice", "l_linestatus", ("F", "O")), drop=("p_value",))


@query("""WITH g AS (SELECT o_orderpriority, count(*) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v FROM orders GROUP BY 1),
t AS (SELECT avg(o_totalprice) AS gm FROM orders),
s AS (SELECT sum(n * (m - gm) ** 2) AS b, sum((n - 1) * v) AS w, CAST(count(*) - 1 AS INTEGER) AS k, CAST(sum(n) - count(*) AS INTEGER) AS r, sum((n - 1) * ln(v)) AS lv, sum(1.0 / (n - 1)) AS rec FROM g, t)
SELECT round(b / 1e6, 4) AS ss_between, round(w / 1e6, 4) AS ss_within, k AS df_between, r AS df_within, round((b / k) / (w / r), 6) AS f,
round((r * ln(w / r) - lv) / (1 + (rec - 1.0 / r) / (3 * k)), 6) AS bartlett FROM s""")
def oneway_anova(spark, sf):
    out = d.oneway(table(spark, sf, "orders"), "o_totalprice", "o_orderpriority")
    return rounded(out.withColumns({c: F.round(F.col(c) / 1e6, 4) for c in ("ss_between", "ss_within")}), drop=("p_value", "bartlett_p"))


RANKS = """WITH d AS (SELECT {g} AS g, {v} AS v FROM {t}), c AS (SELECT v, count(*) AS t FROM d GROUP BY v),
r AS (SELECT v, t, sum(t) OVER (ORDER BY v) - (t - 1) / 2.0 AS rk FROM c), j AS (SELECT g, rk FROM d JOIN r USING (v)),
q AS (SELECT sum(CAST(t AS DOUBLE) ** 3 - t) AS ties, CAST(sum(t) AS DOUBLE) AS n FROM c), s AS (SELECT g, CAST(count(*) AS DOUBLE) AS m, sum(rk) AS w FROM j GROUP BY g) """


@query(RANKS.format(g="l_linestatus", v="l_quantity", t="lineitem") + """SELECT a.w AS rank_sum1, b.w AS rank_sum2, a.w - a.m * (a.m + 1) / 2 AS u,
round((a.w - a.m * (n + 1) / 2) / sqrt(a.m * b.m / 12 * (n + 1 - ties / (n * (n - 1)))), 6) AS z FROM s a, s b, q WHERE a.g = 'F' AND b.g = 'O'""")
def ranksum(spark, sf):
    return rounded(d.ranksum(table(spark, sf, "lineitem"), "l_quantity", "l_linestatus", ("F", "O")), drop=("p_value",))


@query(RANKS.format(g="l_returnflag", v="l_quantity", t="lineitem") + """SELECT round(12 / (max(n) * (max(n) + 1)) * sum(w * w / m) - 3 * (max(n) + 1), 5) AS h,
round((12 / (max(n) * (max(n) + 1)) * sum(w * w / m) - 3 * (max(n) + 1)) / (1 - max(ties) / (max(n) ** 3 - max(n))), 5) AS h_tied, CAST(count(*) - 1 AS INTEGER) AS df FROM s, q""")
def kruskal_wallis(spark, sf):
    return rounded(d.kruskal(table(spark, sf, "lineitem"), "l_quantity", "l_returnflag"), 5, ("p_value",))


@query("""WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS ra, rank() OVER (ORDER BY l_tax) + (count(*) OVER (PARTITION BY l_tax) - 1) / 2.0 AS rb FROM lineitem)
SELECT count(*) AS n, round(corr(ra, rb), 8) AS rho FROM r""")
def spearman(spark, sf):
    return rounded(d.spearman(table(spark, sf, "lineitem"), "l_quantity", "l_tax"), 8, ("t",))


@query("SELECT count(*) FILTER (l_quantity > 25) AS above, count(*) FILTER (l_quantity < 25) AS below, count(*) FILTER (l_quantity = 25) AS equal, round((count(*) FILTER (l_quantity > 25) - count(*) FILTER (l_quantity < 25)) / sqrt(count(*) FILTER (l_quantity <> 25)), 6) AS z FROM lineitem")
def sign_test(spark, sf):
    return rounded(d.signtest(table(spark, sf, "lineitem"), "l_quantity", 25), drop=("p_value",))


@query("""WITH x AS (SELECT l_quantity - 25 AS d FROM lineitem), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY abs(d)) AS t FROM x),
s AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(r) FILTER (d > 0) AS p, sum(r) FILTER (d < 0) AS m, CAST(count(*) FILTER (d = 0) AS DOUBLE) AS z, sum(CAST(t AS DOUBLE) ** 2 - 1) FILTER (d <> 0) AS ties FROM r)
SELECT p AS sum_plus, m AS sum_minus, round((p - (n * (n + 1) - z * (z + 1)) / 4) / sqrt((n * (n + 1) * (2 * n + 1) - z * (z + 1) * (2 * z + 1)) / 24 - ties / 48), 6) AS z FROM s""")
def signed_rank(spark, sf):
    return rounded(d.signrank(table(spark, sf, "lineitem"), "l_quantity", 25), drop=("p_value",))


@query("""WITH b AS (SELECT min(l_quantity) AS lo, (max(l_quantity) - min(l_quantity)) / 20 AS w FROM lineitem), c AS (SELECT CAST(least(floor((l_quantity - lo) / w), 19) AS INTEGER) AS bin, count(*) AS n FROM lineitem, b GROUP BY 1)
SELECT CAST(i AS INTEGER) AS bin, round(lo + i * w, 6) AS low, round(lo + (i + 1) * w, 6) AS high, coalesce(n, 0) AS n FROM range(20) t(i) CROSS JOIN b LEFT JOIN c ON c.bin = i""")
def histogram(spark, sf):
    return rounded(d.histogram(table(spark, sf, "lineitem"), "l_quantity", 20))


@query("SELECT event_type, round(avg(value), 8) AS mean FROM events GROUP BY 1")
def categorical_mean(spark, sf):
    return rounded(d.categorical(table(spark, sf, "events"), "event_type", "value", "mean"), 8)


@query("""WITH n AS (SELECT count(*) AS n FROM orders), r AS (SELECT o_totalprice AS x, CAST(o_custkey AS DOUBLE) AS y, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders)
SELECT x, y FROM r, n WHERE n <= 500 OR floor(ceil(i / ((n - 1) / 499.0)) * ((n - 1) / 499.0) + 1e-9) = i""")
def scatter_sample(spark, sf):
    return d.scatter(table(spark, sf, "orders"), "o_totalprice", "o_custkey", ["o_orderkey"], 500)


@query("""WITH d AS (SELECT CAST(n_chars AS DOUBLE) AS s, quality AS y FROM labels JOIN documents USING (doc_id)), r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM d)
SELECT CAST(sum(y) AS BIGINT) AS positives, CAST(sum(1 - y) AS BIGINT) AS negatives, round((sum(r * y) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)), 8) AS auc FROM r""")
def roc_auc(spark, sf):
    rows = prepare.join(table(spark, sf, "labels"), table(spark, sf, "documents").select("doc_id", "n_chars"), ["doc_id"])
    return rounded(d.roc(rows, "n_chars", "quality"), 8)


@query("""WITH n AS (SELECT count(*) AS n, avg(CAST(quality = toxic AS INTEGER)) AS po, avg(quality) * avg(toxic) + (1 - avg(quality)) * (1 - avg(toxic)) AS pe FROM labels)
SELECT n, round(po, 8) AS agreement, round(pe, 8) AS expected, round((po - pe) / (1 - pe), 8) AS kappa FROM n""")
def kappa(spark, sf):
    return rounded(d.kappa(table(spark, sf, "labels"), "quality", "toxic"), 8)


@query("""SELECT count(*) FILTER (quality = 1 AND toxic = 0) AS n10, count(*) FILTER (quality = 0 AND toxic = 1) AS n01,
round((count(*) FILTER (quality = 1 AND toxic = 0) - count(*) FILTER (quality = 0 AND toxic = 1)) ** 2 / CAST(count(*) FILTER (quality <> toxic) AS DOUBLE), 6) AS chi2 FROM labels""")
def mcnemar(spark, sf):
    return rounded(d.mcnemar(table(spark, sf, "labels"), "quality", "toxic"), drop=("p_value",))


@query("SELECT c_custkey, c_mktsegment, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0")
def prepare_join_filter(spark, sf):
    c = table(spark, sf, "customer").withColumnRenamed("c_nationkey", "n_nationkey")
    joined = prepare.join(c, table(spark, sf, "nation").select("n_nationkey", "n_name"), ["n_nationkey"])
    return prepare.filter_rows(joined, F.col("c_acctbal") > 0).select("c_custkey", "c_mktsegment", "n_name")


@query("""SELECT l_orderkey, l_linenumber, 'l_tax' AS variable, l_tax AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_discount', l_discount FROM lineitem""")
def reshape_long(spark, sf):
    return prepare.reshape_long(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_tax", "l_discount"])


@query("""SELECT l_suppkey, sum(q) FILTER (f = 'A') AS A, sum(q) FILTER (f = 'N') AS N, sum(q) FILTER (f = 'R') AS R FROM (SELECT l_suppkey, l_returnflag AS f, sum(l_quantity) AS q FROM lineitem GROUP BY ALL) GROUP BY 1""")
def reshape_wide(spark, sf):
    sums = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.sum("l_quantity").alias("q"))
    return prepare.reshape_wide(sums, ["l_suppkey"], "l_returnflag", "q", ["A", "N", "R"])


DAYS = "SELECT user_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS t, round(sum(value), 6) AS v FROM events GROUP BY ALL"


def _days(spark: SparkSession, sf: str) -> DataFrame:
    t = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long")
    return table(spark, sf, "events").groupBy("user_id", t.alias("t")).agg(F.round(F.sum("value"), 6).alias("v"))


@query(f"WITH d AS ({DAYS}) SELECT d.user_id, d.t, d.v, b.v AS L1_v FROM d LEFT JOIN d b ON b.user_id = d.user_id AND b.t = d.t - 1")
def lag_exact(spark, sf):
    return prepare.lag(_days(spark, sf), "v", "t", 1, ["user_id"])


@query(f"WITH d AS ({DAYS}) SELECT d.user_id, d.t, d.v, round(d.v - b.v, 6) AS D1_v FROM d LEFT JOIN d b ON b.user_id = d.user_id AND b.t = d.t - 1")
def difference_exact(spark, sf):
    return prepare.difference(_days(spark, sf), "v", "t", 1, ["user_id"]).withColumn("D1_v", F.round("D1_v", 6))


@query(f"""WITH d AS ({DAYS}) SELECT user_id, t, v, round(avg(v) OVER w, 6) AS roll_mean, round(sum(v) OVER w, 6) AS roll_sum, count(v) OVER w AS roll_n FROM d
WINDOW w AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN 6 PRECEDING AND CURRENT ROW)""")
def rolling_week(spark, sf):
    return rounded(prepare.rolling(_days(spark, sf), "v", "t", 6, 0, ["user_id"]))


@query("SELECT count(*) AS rows FROM orders")
def receipt_rows(spark, sf):
    return prepare.receipt(table(spark, sf, "orders")).select("rows")
