"""Queries on likelihood models, panels, survival, series, surveys, multivariate methods and graphs, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystat.operators import likelihood, linear, multivariate, network, panel, series, survival
from quarrystat.plans.basic import DAYS, _days, estimates, query, rounded
from quarrystat.plans.spec import Spec
from quarrystat.sources.tables import small, table
from quarrystat.streaming import moments


def _binary(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "lineitem")
    return d.select((F.col("l_returnflag") == "R").cast("double").alias("y"), (F.col("l_linestatus") == "F").cast("double").alias("g"), "l_quantity", "l_suppkey")


#: A saturated model's coefficients are those of its cells.
@query("""WITH c AS (SELECT l_linestatus = 'F' AS g, avg(CAST(l_returnflag = 'R' AS INTEGER)) AS p, count(*) AS n FROM lineitem GROUP BY 1), x AS (SELECT a.p AS p1, a.n AS n1, b.p AS p0, b.n AS n0 FROM c a, c b WHERE a.g AND NOT b.g)
SELECT 'g' AS term, round(ln(p1 / (1 - p1)) - ln(p0 / (1 - p0)), 5) AS estimate, round(sqrt(1 / (n1 * p1 * (1 - p1)) + 1 / (n0 * p0 * (1 - p0))), 5) AS std_error FROM x
UNION ALL SELECT '_cons', round(ln(p0 / (1 - p0)), 5), round(sqrt(1 / (n0 * p0 * (1 - p0))), 5) FROM x""")
def logit_saturated(spark, sf):
    return estimates(likelihood.fit(_binary(spark, sf), Spec("y", ("g",)), "logit"), spark, 5).drop("statistic")


@query("""WITH c AS (SELECT l_linestatus = 'F' AS g, avg(l_quantity) AS m, sum(l_quantity) AS s FROM lineitem GROUP BY 1), x AS (SELECT a.m AS m1, a.s AS s1, b.m AS m0, b.s AS s0 FROM c a, c b WHERE a.g AND NOT b.g)
SELECT 'g' AS term, round(ln(m1 / m0), 6) AS estimate, round(sqrt(1 / s1 + 1 / s0), 6) AS std_error FROM x UNION ALL SELECT '_cons', round(ln(m0), 6), round(sqrt(1 / s0), 6) FROM x""")
def poisson_saturated(spark, sf):
    return estimates(likelihood.fit(_binary(spark, sf), Spec("l_quantity", ("g",)), "poisson"), spark, 6).drop("statistic")


@query()
def logit_cluster(spark, sf):
    return estimates(likelihood.fit(_binary(spark, sf), Spec("y", ("l_quantity",), cluster=("l_suppkey",)), "logit"), spark)


@query()
def probit(spark, sf):
    return estimates(likelihood.fit(_binary(spark, sf), Spec("y", ("l_quantity",), covariance="HC1"), "probit"), spark)


@query()
def cloglog(spark, sf):
    return estimates(likelihood.fit(_binary(spark, sf), Spec("y", ("l_quantity",)), "cloglog"), spark)


@query("SELECT '_cons' AS term, round(ln(avg(l_extendedprice)), 8) AS estimate FROM lineitem")
def glm_gamma(spark, sf):
    fit = likelihood.fit(table(spark, sf, "lineitem"), Spec("l_extendedprice", ()), "gamma")
    return rounded(fit.frame(spark).select("term", "estimate"), 8)


PANEL = f"d AS ({DAYS}), p AS (SELECT user_id, t, v, CAST(t % 7 AS DOUBLE) AS x FROM d)"


def _panel(spark: SparkSession, sf: str) -> DataFrame:
    return _days(spark, sf).withColumn("x", (F.col("t") % 7).cast("double"))


@query(f"""WITH {PANEL}, w AS (SELECT v - avg(v) OVER u AS y, x - avg(x) OVER u AS x FROM p WINDOW u AS (PARTITION BY user_id)), k AS (SELECT count(DISTINCT user_id) AS g, count(*) AS n FROM p),
b AS (SELECT sum(x * y) / sum(x * x) AS b, sum(x * x) AS ss FROM w) SELECT 'x' AS term, round(max(b), 6) AS estimate, round(sqrt(sum((y - b * x) ** 2) / (max(n) - max(g) - 1) / max(ss)), 6) AS std_error FROM w, b, k""")
def xtreg_fe(spark, sf):
    return estimates(panel.fixed_effects(_panel(spark, sf), Spec("v", ("x",)), "user_id"), spark).drop("statistic")


@query(f"""WITH {PANEL}, m AS (SELECT avg(v) AS v, avg(x) AS x FROM p GROUP BY user_id) SELECT 'x' AS term, round(regr_slope(v, x), 6) AS estimate FROM m""")
def xtreg_be(spark, sf):
    return estimates(panel.between(_panel(spark, sf), Spec("v", ("x",)), "user_id"), spark).where("term = 'x'").select("term", "estimate")


@query(f"""WITH {PANEL}, f AS (SELECT p.v - q.v AS y, p.x - q.x AS x FROM p JOIN p q ON q.user_id = p.user_id AND q.t = p.t - 1) SELECT 'x' AS term, round(sum(x * y) / sum(x * x), 6) AS estimate FROM f""")
def xtreg_fd(spark, sf):
    return estimates(panel.first_difference(_panel(spark, sf), Spec("v", ("x",)), "user_id", "t"), spark).select("term", "estimate")


@query()
def xtreg_re(spark, sf):
    return estimates(panel.random_effects(_panel(spark, sf), Spec("v", ("x",)), "user_id"), spark)


@query()
def hausman(spark, sf):
    rows, spec = _panel(spark, sf), Spec("v", ("x",))
    chi2, df = panel.hausman(panel.fixed_effects(rows, spec, "user_id"), panel.random_effects(rows, spec, "user_id"))
    return small(spark, [(chi2, df)], "chi2 double, df int")


@query("""WITH s AS (SELECT l_shipdate, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS c FROM (SELECT *, year(l_shipdate) * 12 + month(l_shipdate) AS m FROM lineitem) GROUP BY l_shipdate HAVING false),
q AS (SELECT year(l_shipdate) AS y, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS c FROM lineitem GROUP BY 1)
SELECT 'l_quantity' AS term, round(avg(b), 4) AS estimate, round(stddev(b) / sqrt(count(*)), 4) AS std_error, count(*) AS periods FROM q UNION ALL SELECT '_cons', round(avg(c), 4), round(stddev(c) / sqrt(count(*)), 4), count(*) FROM q""")
def fama_macbeth(spark, sf):
    return rounded(panel.fama_macbeth(table(spark, sf, "lineitem").withColumn("y", F.year("l_shipdate")), "l_extendedprice", "l_quantity", "y"), 4)


@query("""WITH e AS (SELECT value AS y, user_id % 2 AS g, CAST(ts >= TIMESTAMP '2024-01-15' AS INTEGER) AS p FROM events), c AS (SELECT g, p, avg(y) AS m, count(*) AS n, var_pop(y) * count(*) AS ss FROM e GROUP BY g, p)
SELECT round(sum(CASE WHEN g = p THEN m ELSE -m END), 6) AS att, round(sqrt(sum(ss) / (sum(n) - 4) * sum(1.0 / n)), 6) AS std_error, CAST(sum(n) AS BIGINT) AS n FROM c""")
def did_two_by_two(spark, sf):
    rows = table(spark, sf, "events").select("value", (F.col("user_id") % 2).alias("g"), (F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz")).cast("int").alias("p"))
    return rounded(panel.did(rows, "value", "g", "p"))


@query(f"""WITH {PANEL}, c AS (SELECT *, CASE user_id % 3 WHEN 0 THEN 10 WHEN 1 THEN 20 END AS g FROM p), m AS (SELECT g, t, avg(v) AS m, count(*) AS n FROM c GROUP BY g, t),
z AS (SELECT t, m AS c FROM m WHERE g IS NULL), tr AS (SELECT m.*, c FROM m JOIN z USING (t) WHERE g IS NOT NULL), b AS (SELECT g, m AS m0, c AS c0 FROM tr WHERE t = g - 1)
SELECT CAST(g AS INTEGER) AS g, t, t - g AS event_time, round(m - m0 - c + c0, 6) AS att, n FROM tr JOIN b USING (g)""")
def event_study(spark, sf):
    rows = _panel(spark, sf).withColumn("g", F.when(F.col("user_id") % 3 == 0, 10).when(F.col("user_id") % 3 == 1, 20))
    return rounded(panel.event_study(rows, "v", "g", "t"))


def _arms(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_totalprice", (F.col("o_orderstatus") == "F").cast("int").alias("d"), (F.col("o_custkey") % 100).cast("double").alias("x"))


ARMS = "WITH a AS (SELECT o_totalprice AS y, CAST(o_orderstatus = 'F' AS INTEGER) AS d, CAST(o_custkey % 100 AS DOUBLE) AS x FROM orders)"


@query(ARMS + """, p AS (SELECT *, 0.3 + x / 400 AS p FROM a), q AS (SELECT sum(d / p * y) / sum(d / p) AS mean1, sum((1 - d) / (1 - p) * y) / sum((1 - d) / (1 - p)) AS mean0 FROM p)
SELECT round(mean1, 4) AS mean1, round(mean0, 4) AS mean0, round(mean1 - mean0, 4) AS ate FROM q""")
def teffects_ipw(spark, sf):
    return rounded(panel.ipw(_arms(spark, sf).withColumn("p", 0.3 + F.col("x") / 400), "o_totalprice", "d", "p"), 4)


@query(ARMS + """, q AS (SELECT regr_slope(y, x) FILTER (d = 1) * avg(x) + regr_intercept(y, x) FILTER (d = 1) AS mean1, regr_slope(y, x) FILTER (d = 0) * avg(x) + regr_intercept(y, x) FILTER (d = 0) AS mean0 FROM a)
SELECT round(mean1, 4) AS mean1, round(mean0, 4) AS mean0, round(mean1 - mean0, 4) AS ate FROM q""")
def teffects_ra(spark, sf):
    return rounded(panel.regression_adjustment(_arms(spark, sf), "o_totalprice", "d", "x"), 4)


@query("""WITH a AS (SELECT o_totalprice AS y, CAST(o_orderstatus = 'F' AS INTEGER) AS d, CAST(o_custkey AS DOUBLE) AS x FROM orders),
c AS (SELECT x, avg(y) AS m, count(*) AS n FROM a WHERE d = 0 GROUP BY x), t AS (SELECT x, sum(y) AS y, count(*) AS n FROM a WHERE d = 1 GROUP BY x),
j AS (SELECT t.x, t.y, t.n, c.m, c.n AS k, rank() OVER (PARTITION BY t.x ORDER BY abs(t.x - c.x)) AS r FROM t, c), s AS (SELECT x, max(y) AS y, max(n) AS n, sum(m * k) / sum(k) AS m FROM j WHERE r = 1 GROUP BY x)
SELECT round((sum(y) - sum(n * m)) / sum(n), 4) AS att, CAST(sum(n) AS BIGINT) AS treated FROM s""")
def teffects_nnmatch(spark, sf):
    rows = table(spark, sf, "orders").select("o_totalprice", (F.col("o_orderstatus") == "F").cast("int").alias("d"), F.col("o_custkey").cast("double").alias("x"))
    return rounded(panel.match_nearest(rows, "o_totalprice", "d", "x"), 4)


SURV = "s AS (SELECT CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS DOUBLE) AS raw, l_linestatus AS g, l_returnflag, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey), u AS (SELECT abs(raw) % 97 + 1 AS time, CAST(l_returnflag <> 'R' AS INTEGER) AS event, g, l_quantity FROM s)"


def _spells(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    days = F.datediff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date")).cast("double")
    return rows.select((F.abs(days) % 97 + 1).alias("time"), (F.col("l_returnflag") != "R").cast("int").alias("event"), F.col("l_linestatus").alias("g"), "l_quantity")


@query(f"""WITH {SURV}, c AS (SELECT g, time, sum(event) AS d, count(*) AS m FROM u GROUP BY g, time), r AS (SELECT *, sum(m) OVER (PARTITION BY g ORDER BY time DESC) AS at_risk FROM c),
k AS (SELECT *, CASE WHEN max(CAST(at_risk = d AS INTEGER)) OVER w = 1 THEN 0 ELSE exp(sum(CASE WHEN at_risk > d THEN ln((at_risk - d) / at_risk) ELSE 0 END) OVER w) END AS s,
  sum(CASE WHEN at_risk > d THEN d / (at_risk * (at_risk - d)) ELSE 0 END) OVER w AS gw, sum(d / at_risk) OVER w AS hazard FROM r WINDOW w AS (PARTITION BY g ORDER BY time))
SELECT g, time, CAST(at_risk AS BIGINT) AS at_risk, CAST(d AS BIGINT) AS events, round(s, 8) AS survival, round(s * sqrt(gw), 8) AS std_error, round(hazard, 8) AS hazard FROM k WHERE d > 0""")
def kaplan_meier(spark, sf):
    return rounded(survival.kaplan_meier(_spells(spark, sf), "time", "event", ["g"]), 8)


@query(f"""WITH {SURV}, c AS (SELECT time, count(*) FILTER (g = 'F') AS m0, count(*) FILTER (g = 'O') AS m1, sum(event) FILTER (g = 'F') AS e0, sum(event) AS d FROM u GROUP BY time),
r AS (SELECT coalesce(e0, 0) AS e0, d, sum(m0) OVER w AS r0, sum(m0 + m1) OVER w AS r FROM c WINDOW w AS (ORDER BY time DESC)), x AS (SELECT sum(e0) AS o, sum(d * r0 / r) AS e, sum(CASE WHEN r > 1 THEN d * (r - d) / (r - 1) * r0 / r * (1 - r0 / r) ELSE 0 END) AS v FROM r)
SELECT CAST(o AS DOUBLE) AS observed, round(e, 6) AS expected, round((o - e) ** 2 / v, 6) AS chi2, 1 AS df FROM x""")
def logrank(spark, sf):
    return rounded(survival.logrank(_spells(spark, sf), "time", "event", "g"), drop=("p_value",))


@query()
def cox(spark, sf):
    return estimates(survival.cox(_spells(spark, sf), "time", "event", ("l_quantity",)), spark)


@query(f"WITH {SURV} SELECT g, CAST(sum(event) AS DOUBLE) AS events, sum(time) AS exposure, round(sum(event) / sum(time), 8) AS rate, round(1 / sqrt(sum(event)), 8) AS log_std_error FROM u GROUP BY g")
def incidence_rates(spark, sf):
    return rounded(survival.exponential(_spells(spark, sf), "time", "event", ["g"]), 8)


DAILY = "s AS (SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS t, sum(value) AS v, CAST(count(*) AS DOUBLE) AS c FROM events GROUP BY 1)"


def _daily(spark: SparkSession, sf: str) -> DataFrame:
    t = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long")
    return table(spark, sf, "events").groupBy(t.alias("t")).agg(F.sum("value").alias("v"), F.count(F.lit(1)).cast("double").alias("c"))


@query(f"""WITH {DAILY}, m AS (SELECT t, v - (SELECT avg(v) FROM s) AS d FROM s), n AS (SELECT count(*) AS n, sum(d * d) AS c0 FROM m),
a AS (SELECT l AS lag, sum(x.d * y.d) / max(c0) AS ac, max(n) AS n FROM m x, m y, n, range(1, 6) r(l) WHERE y.t = x.t - l GROUP BY l)
SELECT CAST(lag AS INTEGER) AS lag, round(ac, 8) AS ac, round(n * (n + 2) * sum(ac ** 2 / (n - lag)) OVER (ORDER BY lag), 8) AS q FROM a""")
def corrgram(spark, sf):
    return rounded(series.corrgram(_daily(spark, sf), "v", "t", 5), 8)


@query(f"""WITH {DAILY}, d AS (SELECT x.v - y.v AS dv, y.v AS level FROM s x JOIN s y ON y.t = x.t - 1), r AS (SELECT regr_slope(dv, level) AS b, regr_r2(dv, level) AS r2, regr_sxx(dv, level) AS sxx, regr_syy(dv, level) AS syy, count(*) AS n FROM d)
SELECT 'level' AS term, round(b, 6) AS estimate, round(b / sqrt(syy * (1 - r2) / (n - 2) / sxx), 6) AS statistic FROM r""")
def dickey_fuller(spark, sf):
    return estimates(series.dickey_fuller(_daily(spark, sf), "v", "t"), spark).where("term = 'level'").drop("std_error")


@query(f"""WITH {DAILY}, e AS (SELECT t, v - (SELECT avg(v) FROM s) AS e FROM s), c AS (SELECT *, sum(e) OVER (ORDER BY t) AS cs FROM e),
g AS (SELECT sum(a.e * b.e * (1 - (a.t - b.t) / 4.0)) AS g FROM e a JOIN e b ON a.t - b.t BETWEEN 1 AND 3) SELECT round(sum(cs ** 2) / (count(*) * (sum(e ** 2) + 2 * max(g))), 8) AS kpss, count(*) AS n FROM c, g""")
def kpss(spark, sf):
    return rounded(series.kpss(_daily(spark, sf), "v", "t", 3), 8)


@query()
def var_model(spark, sf):
    names, b, residual, n = series.var(_daily(spark, sf), ["v", "c"], "t", 1)
    return small(spark, [(e, name, round(b[i, j], 6)) for j, e in enumerate(["v", "c"]) for i, name in enumerate(names)], "equation string, term string, estimate double")


@query()
def impulse_responses(spark, sf):
    _, b, residual, _ = series.var(_daily(spark, sf), ["v", "c"], "t", 1)
    out = series.irf(b, residual, 1, 8)
    return small(spark, [(s, i, j, round(out[s, i, j], 6)) for s in range(9) for i in range(2) for j in range(2)], "step int, response int, shock int, value double")


@query()
def granger(spark, sf):
    return rounded(series.granger(_daily(spark, sf), "v", "c", "t", 2))


SUP = "s AS (SELECT s_nationkey AS h, s_suppkey AS u, s_acctbal AS y, 1.0 + s_suppkey % 3 AS w FROM supplier)"


@query(f"""WITH {SUP}, t AS (SELECT sum(w) AS tw, sum(w * y) AS ty FROM s), z AS (SELECT h, (w * y - ty / tw * w) / tw AS z, w * y AS t FROM s, t), v AS (SELECT h, count(*) AS m, var_samp(z) AS vz, var_samp(t) AS vt FROM z GROUP BY h)
SELECT round(max(ty / tw), 6) AS mean, round(sqrt(coalesce(sum(m * vz) FILTER (m > 1), 0)), 6) AS std_error, round(max(ty), 4) AS total, round(sqrt(coalesce(sum(m * vt) FILTER (m > 1), 0)), 4) AS total_se, CAST(sum(m) AS BIGINT) AS psus, count(*) AS strata FROM v, t""")
def survey_mean(spark, sf):
    rows = table(spark, sf, "supplier").withColumn("w", 1.0 + F.col("s_suppkey") % 3)
    out = multivariate.survey_mean(rows, "s_acctbal", "w", "s_nationkey", "s_suppkey")
    return out.select(F.round("mean", 6).alias("mean"), F.round("std_error", 6).alias("std_error"), F.round("total", 4).alias("total"), F.round("total_se", 4).alias("total_se"), "psus", "strata")


@query("""WITH u AS (SELECT c_nationkey AS h, c_custkey AS u, sum(o_totalprice) AS a, CAST(count(*) AS DOUBLE) AS b FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), t AS (SELECT sum(a) AS ta, sum(b) AS tb FROM u),
z AS (SELECT h, (a - ta / tb * b) / tb AS z FROM u, t), v AS (SELECT h, count(*) AS m, var_samp(z) AS v FROM z GROUP BY h) SELECT round(max(ta / tb), 4) AS ratio, round(sqrt(coalesce(sum(m * v) FILTER (m > 1), 0)), 4) AS std_error FROM v, t""")
def survey_ratio(spark, sf):
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("c_nationkey", "c_custkey", "o_totalprice", F.lit(1.0).alias("one"), F.lit(1.0).alias("w"))
    return rounded(multivariate.survey_ratio(rows, "o_totalprice", "one", "w", "c_nationkey", "c_custkey"), 4)


@query()
def pca(spark, sf):
    return rounded(multivariate.pca(table(spark, sf, "embeddings"), "embedding", 64)[0])


@query()
def kmeans(spark, sf):
    return rounded(multivariate.kmeans(table(spark, sf, "embeddings"), "embedding", 64, 8, rounds=8)[0], 4)


@query("""WITH c AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS position FROM embeddings WHERE label IS NOT NULL)
SELECT label, CAST(position AS INTEGER) AS position, round(avg(CAST(x AS DOUBLE)), 8) AS mean, round(var_samp(CAST(x AS DOUBLE)), 8) AS variance FROM c GROUP BY ALL""")
def group_means(spark, sf):
    rows = table(spark, sf, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    return rounded(multivariate.group_means(rows, "embedding", "label"), 8)


@query("SELECT round(3.0 / 2 * (1 - (var_samp(l_quantity) + var_samp(l_tax * 100) + var_samp(l_discount * 100)) / var_samp(l_quantity + l_tax * 100 + l_discount * 100)), 8) AS alpha, count(*) AS n FROM lineitem")
def cronbach_alpha(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_quantity", (F.col("l_tax") * 100).alias("a"), (F.col("l_discount") * 100).alias("b"))
    return rounded(multivariate.cronbach(rows, ["l_quantity", "a", "b"]), 8)


@query("WITH r AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) AS i, count(*) OVER () AS n FROM orders) SELECT round(2 * sum(i * v) / (max(n) * sum(v)) - (max(n) + 1.0) / max(n), 8) AS gini FROM r")
def gini(spark, sf):
    return rounded(multivariate.lorenz(table(spark, sf, "orders"), "o_totalprice"), 8)


@query("""WITH e AS (SELECT nation, avg(b) AS y, var_samp(b) / count(*) AS v FROM (SELECT c_nationkey AS nation, c_acctbal AS b FROM customer) GROUP BY 1), f AS (SELECT sum(y / v) / sum(1 / v) AS fx, sum(1 / v) AS sw, sum(1 / v / v) AS sww, count(*) AS k FROM e),
q AS (SELECT sum((y - fx) ** 2 / v) AS q FROM e, f), t AS (SELECT greatest(0, (q - (k - 1)) / (sw - sww / sw)) AS tau2, fx, sw, q, k FROM f, q), r AS (SELECT sum(y / (v + tau2)) / sum(1 / (v + tau2)) AS re, sum(1 / (v + tau2)) AS rw FROM e, t)
SELECT round(fx, 4) AS fixed, round(1 / sqrt(sw), 4) AS fixed_se, round(re, 4) AS random, round(1 / sqrt(rw), 4) AS random_se, round(q, 4) AS q, round(greatest(0, (q - k + 1) / q), 4) AS i2, round(tau2, 4) AS tau2 FROM t, r""")
def meta_analysis(spark, sf):
    rows = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal"), F.sqrt(F.var_samp("c_acctbal") / F.count(F.lit(1)))).collect()
    return rounded(panel.meta(spark, [(r[1], r[2]) for r in rows]), 4)


#: Lines that a task of _ring pairs, each with some two others, and of _graph joins.
LINES_A_TASK = 250_000


def _tasks(lines: DataFrame) -> int:
    """Of a number that grows with the lines, so what one holds doesn't."""
    return math.ceil(lines.count() / LINES_A_TASK) or 1


def _graph(spark: SparkSession, sf: str) -> DataFrame:
    """Parts to the suppliers they come from, over all lines: a bipartite graph, parts with even ids and suppliers with odd ones."""
    lines = table(spark, sf, "lineitem").select((F.col("l_partkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst"))
    return lines.repartition(_tasks(lines), "src", "dst").distinct()


GRAPH = "g AS (SELECT DISTINCT l_partkey * 2 AS src, l_suppkey * 2 + 1 AS dst FROM lineitem)"


@query(f"WITH {GRAPH} SELECT node, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o + i) AS BIGINT) AS degree FROM (SELECT src AS node, 1 AS o, 0 AS i FROM g UNION ALL SELECT dst, 0, 1 FROM g) GROUP BY node")
def network_degree(spark, sf):
    return network.degree(_graph(spark, sf))


def _components_sql(rounds: int = 16) -> str:
    """Labels fall to the smallest of the neighbours', round by round; more rounds than the graph is wide."""
    steps = ["c0 AS (SELECT DISTINCT src AS node, src AS c FROM b)"]
    for i in range(1, rounds + 1):
        steps.append(f"c{i} AS (SELECT x.node, least(any_value(x.c), min(y.c)) AS c FROM c{i - 1} x JOIN b ON b.src = x.node JOIN c{i - 1} y ON y.node = b.dst GROUP BY x.node)")
    return f"WITH {GRAPH}, b AS (SELECT src, dst FROM g UNION SELECT dst, src FROM g), {', '.join(steps)} SELECT node, c AS component FROM c{rounds}"


@query(_components_sql())
def network_components(spark, sf):
    return network.components(_graph(spark, sf))


def _pagerank_sql(rounds: int) -> str:
    steps = ["r0 AS (SELECT node, 1.0 / (SELECT count(*) FROM n) AS rank FROM n)"]
    for i in range(1, rounds + 1):
        steps.append(f"""v{i} AS (SELECT dst, sum(rank / o.k) AS x FROM g JOIN o USING (src) JOIN r{i - 1} ON node = src GROUP BY dst),
        r{i} AS (SELECT node, 0.15 / (SELECT count(*) FROM n) + 0.85 * (coalesce(x, 0) + (1 - (SELECT sum(x) FROM v{i})) / (SELECT count(*) FROM n)) AS rank FROM n LEFT JOIN v{i} ON node = dst)""")
    return f"WITH {GRAPH}, o AS (SELECT src, count(*) AS k FROM g GROUP BY src), n AS (SELECT src AS node FROM g UNION SELECT dst FROM g), {', '.join(steps)} SELECT node, round(rank, 10) AS rank FROM r{rounds}"


@query(_pagerank_sql(8))
def network_pagerank(spark, sf):
    return rounded(network.pagerank(_graph(spark, sf), rounds=8), 10)


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    """The pairs of _ring as often as lines make them, for what takes each once by itself: another shuffle of all pairs less."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    dealt = rows.repartition(_tasks(rows), "l_orderkey")
    one = dealt.select("l_orderkey", F.col("l_linenumber").alias("i"), F.col("l_partkey").alias("src"))
    two = dealt.select("l_orderkey", F.col("l_linenumber").alias("j"), F.col("l_partkey").alias("dst"))
    return one.join(two, "l_orderkey").where("i <= j AND src <> dst").select("src", "dst")


def _ring(spark: SparkSession, sf: str) -> DataFrame:
    """A graph with triangles: each line's part to the parts of the lines after it in its order (lines of the same number: both ways), over all lines."""
    return _pairs(spark, sf).repartition(_tasks(table(spark, sf, "lineitem")), "src", "dst").distinct()


LINES = "SELECT DISTINCT x.l_partkey AS s, y.l_partkey AS d FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_linenumber <= y.l_linenumber AND x.l_partkey <> y.l_partkey"
RING = f"g AS (SELECT DISTINCT least(s, d) AS src, greatest(s, d) AS dst FROM ({LINES})), b AS (SELECT src, dst FROM g UNION SELECT dst, src FROM g)"


@query(f"""WITH {RING}, t AS (SELECT x.src AS a, x.dst AS b, y.dst AS c FROM g x JOIN g y ON y.src = x.dst JOIN g z ON z.src = x.src AND z.dst = y.dst), k AS (SELECT src AS node, count(*) AS k FROM b GROUP BY 1),
n AS (SELECT node, count(*) AS t FROM (SELECT a AS node FROM t UNION ALL SELECT b FROM t UNION ALL SELECT c FROM t) GROUP BY 1)
SELECT node, coalesce(t, 0) AS triangles, round(CASE WHEN k > 1 THEN 2.0 * coalesce(t, 0) / (k * (k - 1)) ELSE 0 END, 8) AS clustering FROM k LEFT JOIN n USING (node)""")
def network_triangles(spark, sf):
    return rounded(network.triangles(_pairs(spark, sf)), 8)


@query()
def network_cores(spark, sf):
    return network.core_numbers(_pairs(spark, sf))


@query(f"WITH {GRAPH} SELECT x.dst AS a, y.dst AS b, count(*) AS shared FROM g x JOIN g y ON x.src = y.src AND x.dst < y.dst GROUP BY 1, 2")
def network_projection(spark, sf):
    return network.projection(_graph(spark, sf), "dst", "src")


@query(f"""WITH {RING}, p AS (SELECT i AS a, i + 7 AS b FROM range(0, 200) r(i)), k AS (SELECT src AS node, count(*) AS k FROM b GROUP BY 1),
c AS (SELECT p.a, p.b, count(*) AS n, sum(1 / ln(kc.k)) AS aa FROM p JOIN b x ON x.src = p.a JOIN b y ON y.src = p.b AND y.dst = x.dst JOIN k kc ON kc.node = x.dst GROUP BY 1, 2)
SELECT p.a, p.b, coalesce(n, 0) AS common, round(CASE WHEN coalesce(ka.k, 0) + coalesce(kb.k, 0) - coalesce(n, 0) > 0 THEN coalesce(n, 0) / CAST(coalesce(ka.k, 0) + coalesce(kb.k, 0) - coalesce(n, 0) AS DOUBLE) ELSE 0 END, 8) AS jaccard, round(coalesce(aa, 0), 8) AS adamic_adar, coalesce(ka.k, 0) * coalesce(kb.k, 0) AS preferential
FROM p LEFT JOIN c ON c.a = p.a AND c.b = p.b LEFT JOIN k ka ON ka.node = p.a LEFT JOIN k kb ON kb.node = p.b""")
def network_link_scores(spark, sf):
    return rounded(network.link_scores(_ring(spark, sf), spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 7).alias("b"))), 8)


@query(f"WITH {RING}, m AS (SELECT count(*) AS m, sum(CAST(src % 5 = dst % 5 AS INTEGER)) AS i FROM g), v AS (SELECT sum(v * v) AS vv FROM (SELECT src % 5 AS p, count(*) AS v FROM b GROUP BY 1)) SELECT round(i / CAST(m AS DOUBLE) - vv / (4.0 * m * m), 8) AS modularity FROM m, v")
def network_modularity(spark, sf):
    edges = _ring(spark, sf)
    parts = edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct().withColumn("part", F.col("node") % 5)
    return rounded(network.modularity(edges, parts), 8)


@query(f"""WITH RECURSIVE {RING}, w(node, hops) AS (SELECT 0::BIGINT, 0 UNION SELECT b.dst, w.hops + 1 FROM w JOIN b ON b.src = w.node WHERE w.hops < 12) SELECT node, CAST(min(hops) AS INTEGER) AS hops FROM w GROUP BY node""")
def network_distances(spark, sf):
    return network.distances(network.both_ways(network.undirected(_ring(spark, sf))), spark.range(1).select(F.col("id").alias("node")))


@query(f"WITH g AS ({LINES}) SELECT round(avg(CAST(h.s IS NOT NULL AS DOUBLE)), 8) AS reciprocity FROM g LEFT JOIN g h ON h.s = g.d AND h.d = g.s")
def network_reciprocity(spark, sf):
    return rounded(network.reciprocity(_ring(spark, sf)), 8)


@query("""WITH s AS (SELECT user_id, event_type, min(epoch(ts)) AS start, max(epoch(ts)) AS end_ FROM events GROUP BY ALL) SELECT user_id, event_type FROM s WHERE start <= epoch(TIMESTAMP '2024-01-10') AND end_ > epoch(TIMESTAMP '2024-01-10')""")
def network_at(spark, sf):
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    spells = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min(t).alias("start"), F.max(t).alias("end"))
    return network.at(spells, 1704844800.0).select("user_id", "event_type")


@query("SELECT 'l_quantity' AS term, round(regr_slope(l_extendedprice, l_quantity), 4) AS estimate FROM lineitem")
def lincom(spark, sf):
    fit = linear.ols(table(spark, sf, "lineitem"), Spec("l_extendedprice", ("l_quantity",)))
    return small(spark, [("l_quantity", round(fit.lincom({"l_quantity": 1.0})[0], 4))], "term string, estimate double")


@query("SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS start, event_type, count(value) AS n, round(avg(value), 8) AS mean, round(var_samp(value), 8) AS variance FROM events GROUP BY ALL")
def windowed_moments(spark, sf):
    out = moments.windowed_moments(table(spark, sf, "events"), "ts", "value", ["event_type"], "1 day")
    return rounded(out.withColumn("start", F.unix_seconds("start")), 8)
