"""Queries on moment models, further tests, likelihood models and graphs, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystat.operators import graphs, mle, moments, tests
from quarrystat.plans.basic import estimates, query, rounded
from quarrystat.plans.models import GRAPH, LINES, RING, SURV, _graph, _pairs, _ring, _spells
from quarrystat.plans.spec import Spec
from quarrystat.sources.tables import small, table


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "lineitem")
    return d.select((F.col("l_returnflag") == "R").cast("double").alias("y"), (F.col("l_linestatus") == "F").cast("double").alias("g"), F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("p"), F.col("l_discount").alias("d"), F.col("l_tax").alias("t"), F.col("l_suppkey").alias("s"), F.col("l_linenumber").cast("double").alias("i"), F.col("l_returnflag").alias("f"), F.col("l_orderkey").alias("o"))


L = "l AS (SELECT CAST(l_returnflag = 'R' AS DOUBLE) AS y, CAST(l_linestatus = 'F' AS DOUBLE) AS g, l_quantity AS q, l_extendedprice AS p, l_discount AS d, l_tax AS t, l_suppkey AS s, CAST(l_linenumber AS DOUBLE) AS i, l_returnflag AS f FROM lineitem)"


# ---- moments

@query(f"WITH {L}, z AS (SELECT p, q + 1000 * d AS x FROM l) SELECT 'q' AS term, round(regr_slope(p, x), 5) AS estimate FROM z UNION ALL SELECT 'd', round(1000 * regr_slope(p, x), 5) FROM z UNION ALL SELECT '_cons', round(regr_intercept(p, x), 5) FROM z")
def constrained_ols(spark, sf):
    fit = moments.constrained(_lines(spark, sf), Spec("p", ("q", "d")), [({"d": 1.0, "q": -1000.0}, 0.0)])
    return rounded(fit.frame(spark).select("term", "estimate"), 5)


@query(f"WITH {L}, m AS (SELECT var_pop(q) AS v, covar_pop(p, q) AS c, avg(p) AS mp, avg(q) AS mq FROM l) SELECT 'q' AS term, round(c / v / 1.5, 6) AS estimate FROM m UNION ALL SELECT '_cons', round(mp - c / v / 1.5 * mq, 4) FROM m")
def ridge_line(spark, sf):
    got = moments.ridge(_lines(spark, sf), "p", ["q"], 0.5)
    return small(spark, [("q", round(got["q"], 6)), ("_cons", round(got["_cons"], 4))], "term string, estimate double")


@query(f"WITH {L}, m AS (SELECT stddev_pop(q) AS s, covar_pop(p, q) / stddev_pop(q) AS c, avg(p) AS mp, avg(q) AS mq FROM l), b AS (SELECT *, sign(c) * greatest(abs(c) - 100, 0) / s AS b FROM m) SELECT 'q' AS term, round(b, 6) AS estimate FROM b UNION ALL SELECT '_cons', round(mp - b * mq, 4) FROM b")
def lasso_line(spark, sf):
    got = moments.elastic_net(_lines(spark, sf), "p", ["q"], 100.0)
    return small(spark, [("q", round(got["q"], 6)), ("_cons", round(got["_cons"], 4))], "term string, estimate double")


@query(f"WITH {L}, m AS (SELECT stddev_pop(q) AS s, covar_pop(p, q) / stddev_pop(q) AS c FROM l) SELECT 'q' AS term, round(sign(c) * greatest(abs(c) - 15, 0) / 86 / s, 8) AS estimate FROM m")
def elastic_net_line(spark, sf):
    got = moments.elastic_net(_lines(spark, sf), "p", ["q"], 100.0, mix=0.15)
    return small(spark, [("q", round(got["q"], 8))], "term string, estimate double")


@query(f"WITH {L}, c AS (SELECT corr(p, q) AS a, corr(p, d) AS b, corr(q, d) AS c FROM l) SELECT 'q' AS b, round((a - b * c) / sqrt((1 - b * b) * (1 - c * c)), 8) AS corr FROM c UNION ALL SELECT 'd', round((b - a * c) / sqrt((1 - a * a) * (1 - c * c)), 8) FROM c")
def partial_correlation(spark, sf):
    return rounded(moments.partial_correlations(_lines(spark, sf), "p", ["q", "d"]).select("b", "corr"), 8)


@query(f"WITH {L}, c AS (SELECT corr(q, p) AS r FROM l) SELECT unnest(['q', 'p']) AS term, round(1 / (1 - r * r), 6) AS vif, round(1 - r * r, 6) AS tolerance FROM c")
def variance_inflation(spark, sf):
    return rounded(moments.inflation(_lines(spark, sf), ["q", "p"]))


@query()
def stepwise_terms(spark, sf):
    return small(spark, [(i, t) for i, t in enumerate(moments.stepwise(_lines(spark, sf).withColumn("v", F.col("q") + 90 * F.col("d") + F.col("s") % 7), "v", ["p", "t", "d", "i", "q"]))], "place int, term string")


#: With the same predictors in all equations, least squares by equation.
@query(f"WITH {L} SELECT 'p:q' AS term, round(regr_slope(p, q), 5) AS estimate FROM l UNION ALL SELECT 'p:_cons', round(regr_intercept(p, q), 5) FROM l UNION ALL SELECT 'd:q', round(regr_slope(d, q), 5) FROM l UNION ALL SELECT 'd:_cons', round(regr_intercept(d, q), 5) FROM l")
def seemingly_unrelated(spark, sf):
    return rounded(moments.seemingly_unrelated(_lines(spark, sf), [("p", ("q",)), ("d", ("q",))]).frame(spark).select("term", "estimate"), 5)


#: Just identified, all methods are the ratio of covariances.
IV = f"WITH {L}, c AS (SELECT covar_pop(p, i) / covar_pop(q, i) AS b, avg(p) AS mp, avg(q) AS mq FROM l) SELECT 'q' AS term, round(b, 3) AS estimate FROM c UNION ALL SELECT '_cons', round(mp - b * mq, 2) FROM c"


def _iv(spark, sf, method):
    fit = moments.k_class(_lines(spark, sf), "p", ("q",), (), ("i",), method)
    return small(spark, [(n, round(b, 3 if n == "q" else 2)) for n, b in zip(fit.names, map(float, fit.beta), strict=True)], "term string, estimate double")


@query(IV)
def iv_liml(spark, sf):
    return _iv(spark, sf, "liml")


@query(IV)
def iv_gmm(spark, sf):
    return _iv(spark, sf, "gmm")


@query(f"WITH {L}, r AS (SELECT regr_r2(q, i) AS r2, count(*) AS n FROM l) SELECT round(r2 / ((1 - r2) / (n - 2)), 6) AS f FROM r")
def iv_first_stage(spark, sf):
    return small(spark, [(round(float(moments.k_class(_lines(spark, sf), "p", ("q",), (), ("i",), "2sls").metrics["first_stage_f_q"]), 6),)], "f double")


@query(f"""WITH {L}, m AS (SELECT avg(p) AS m FROM l), a AS (SELECT f, avg(p) AS mf, count(*) AS n FROM l GROUP BY f), c AS (SELECT f, g, avg(p) AS mc, count(*) AS n FROM l GROUP BY f, g), e AS (SELECT sum((p - mc) ** 2) AS rss, count(*) AS n FROM l JOIN c USING (f, g))
SELECT 'f' AS source, round(sum(a.n * (mf - m) ** 2) / 1e6, 5) AS ss, CAST(count(*) - 1 AS DOUBLE) AS df FROM a, m UNION ALL SELECT 'residual', round(rss / 1e6, 5), CAST(n - (SELECT count(*) FROM c) AS DOUBLE) FROM e""")
def anova_two_way(spark, sf):
    out = moments.anova(_lines(spark, sf), "p", ["f", "g"], interactions=True)
    return out.where("source IN ('f', 'residual')").select("source", F.round(F.col("ss") / 1e6, 5).alias("ss"), "df")


@query()
def ols_bootstrap(spark, sf):
    return rounded(moments.bootstrap(_lines(spark, sf), Spec("p", ("q",)), draws=100, key="s").frame(spark).select("term", "estimate"))


@query(f"WITH {L} SELECT 'q' AS term, round(regr_slope(p, q), 5) AS estimate FROM l UNION ALL SELECT '_cons', round(regr_intercept(p, q), 5) FROM l")
def ols_jackknife(spark, sf):
    return rounded(moments.jackknife(_lines(spark, sf), Spec("p", ("q",)), "s").frame(spark).select("term", "estimate"), 5)


# ---- tests

@query("SELECT count(toxic) AS n, CAST(sum(toxic) AS BIGINT) AS k, round(avg(toxic), 8) AS share FROM labels")
def binomial_test(spark, sf):
    return rounded(tests.binomial(table(spark, sf, "labels"), "toxic", 0.25), 8, drop=("p_value",))


@query(f"WITH {L}, c AS (SELECT avg(y) FILTER (g = 1) AS a, avg(y) FILTER (g = 0) AS b, avg(y) AS m, count(*) FILTER (g = 1) AS na, count(*) FILTER (g = 0) AS nb FROM l) SELECT round(a, 8) AS share1, round(b, 8) AS share2, round(a - b, 8) AS diff, round((a - b) / sqrt(m * (1 - m) * (1.0 / na + 1.0 / nb)), 6) AS z FROM c")
def proportions_test(spark, sf):
    out = tests.proportions(_lines(spark, sf), "y", "g", (1.0, 0.0))
    return out.select(F.round("share1", 8).alias("share1"), F.round("share2", 8).alias("share2"), F.round("diff", 8).alias("diff"), F.round("z", 6).alias("z"))


@query("WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1), t AS (SELECT sum(n) / count(*) AS e FROM c) SELECT round(sum((n - e) ** 2 / e), 6) AS chi2, CAST(count(*) - 1 AS INTEGER) AS df FROM c, t")
def goodness_of_fit(spark, sf):
    kinds = [r[0] for r in table(spark, sf, "events").select("event_type").distinct().limit(100).collect()]
    return rounded(tests.goodness(table(spark, sf, "events"), "event_type", dict.fromkeys(kinds, 1.0)), drop=("p_value",))


@query(f"WITH {L} SELECT count(q) AS n, round(avg(q), 8) AS mean, round(stddev(q) / sqrt(count(q)), 8) AS std_error, round((avg(q) - 25) / (stddev(q) / sqrt(count(q))), 6) AS t FROM l")
def ttest_one_sample(spark, sf):
    out = tests.one_sample(_lines(spark, sf), "q", 25.0)
    return out.select("n", F.round("mean", 8).alias("mean"), F.round("std_error", 8).alias("std_error"), F.round("t", 6).alias("t"))


@query(f"""WITH {L}, c AS (SELECT f, count(*) AS n, avg(p) AS m, count(*) / var_samp(p) AS w FROM l GROUP BY f), t AS (SELECT sum(w) AS w, sum(w * m) / sum(w) AS g, count(*) AS k FROM c),
x AS (SELECT sum(c.w * (m - g) ** 2) / (max(k) - 1) AS a, 3 * sum((1 - c.w / t.w) ** 2 / (n - 1)) / (max(k) * max(k) - 1) AS lam, max(k) AS k FROM c, t) SELECT round(a / (1 + 2 * (k - 2) / 3.0 * lam), 6) AS f, CAST(k - 1 AS DOUBLE) AS df1, round(1 / lam, 4) AS df2 FROM x""")
def anova_welch(spark, sf):
    out = tests.welch_anova(_lines(spark, sf), "p", "f")
    return out.select(F.round("f", 6).alias("f"), "df1", F.round("df2", 4).alias("df2"))


@query(f"""WITH {L}, m AS (SELECT f, avg(p) AS m FROM l GROUP BY f), z AS (SELECT f, abs(p - m) AS z FROM l JOIN m USING (f)), g AS (SELECT f, count(*) AS n, avg(z) AS m, var_pop(z) * count(*) AS ss FROM z GROUP BY f), t AS (SELECT avg(z) AS g FROM z)
SELECT round(sum(n * (m - g) ** 2) / (count(*) - 1) / (sum(ss) / (sum(n) - count(*))), 6) AS f, CAST(count(*) - 1 AS INTEGER) AS df_between, CAST(sum(n) - count(*) AS INTEGER) AS df_within FROM g, t""")
def levene_test(spark, sf):
    return rounded(tests.levene(_lines(spark, sf), "p", "f"), drop=("p_value",))


BLOCKS = "b AS (SELECT user_id, event_type, avg(value) AS v FROM events GROUP BY 1, 2), w AS (SELECT user_id FROM b GROUP BY 1 HAVING count(*) = 5), r AS (SELECT user_id, event_type, rank() OVER (PARTITION BY user_id ORDER BY v) + (count(*) OVER (PARTITION BY user_id, v) - 1) / 2.0 AS r, v FROM b JOIN w USING (user_id))"


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    # values have two decimals: summed as such, means on a threshold or equal to each other are so whatever the order of rows
    mean = F.sum(F.col("value").cast("decimal(20,2)")).cast("double") / F.count("value")
    b = table(spark, sf, "events").groupBy("user_id", "event_type").agg(mean.alias("v"))
    return b.join(b.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).where("n = 5").select("user_id"), "user_id")


@query(f"""WITH {BLOCKS}, s AS (SELECT event_type, sum(r) AS s FROM r GROUP BY 1), n AS (SELECT count(DISTINCT user_id) AS b, sum(r * r) AS q FROM r) SELECT round(4 * sum((s - b * 3.0) ** 2) / (max(q) - max(b) * 5 * 36 / 4.0), 6) AS chi2, 4 AS df FROM s, n""")
def friedman_test(spark, sf):
    return rounded(tests.friedman(_blocks(spark, sf), "v", "user_id", "event_type"), drop=("p_value",))


@query(f"""WITH {BLOCKS}, o AS (SELECT user_id, event_type, CAST(v > 50 AS DOUBLE) AS o FROM r), c AS (SELECT sum(s) AS t, sum(s * s) AS cc FROM (SELECT sum(o) AS s FROM o GROUP BY event_type)), d AS (SELECT sum(s * s) AS rr FROM (SELECT sum(o) AS s FROM o GROUP BY user_id)) SELECT round(4 * (5 * cc - t * t) / (5 * t - rr), 6) AS q, 4 AS df FROM c, d""")
def cochran_test(spark, sf):
    return rounded(tests.cochran_q(_blocks(spark, sf).withColumn("o", (F.col("v") > 50).cast("double")), "o", "user_id", "event_type"), drop=("p_value",))


@query(f"""WITH {L}, c AS (SELECT p, count(*) FILTER (g = 1) AS a, count(*) FILTER (g = 0) AS b FROM l GROUP BY p), r AS (SELECT sum(a) OVER (ORDER BY p) / sum(a) OVER () - sum(b) OVER (ORDER BY p) / sum(b) OVER () AS d FROM c) SELECT round(greatest(max(d), 0), 8) AS above, round(greatest(-min(d), 0), 8) AS below, round(max(abs(d)), 8) AS d FROM r""")
def kolmogorov_smirnov(spark, sf):
    return rounded(tests.kolmogorov(_lines(spark, sf), "p", "g", (1.0, 0.0)), 8, drop=("p_value",))


@query(f"""WITH {L}, m AS (SELECT quantile_cont(q, 0.5) AS m FROM l), c AS (SELECT f, q > m AS a, count(*) AS n FROM l, m GROUP BY 1, 2), x AS (SELECT n * 1.0 * n / (sum(n) OVER (PARTITION BY f) * sum(n) OVER (PARTITION BY a)) AS x, n, f FROM c) SELECT round(sum(n) * (sum(x) - 1), 6) AS chi2, CAST(count(DISTINCT f) - 1 AS INTEGER) AS df FROM x""")
def median_equality(spark, sf):
    return rounded(tests.median_test(_lines(spark, sf), "q", "f"), drop=("p_value",))


@query(f"WITH {L}, m AS (SELECT avg(p) AS m, stddev_pop(p) AS s FROM l), z AS (SELECT avg(((p - m.m) / m.s) ** 3) AS sk, avg(((p - m.m) / m.s) ** 4) AS ku, count(*) AS n FROM l, m) SELECT n, round(sk, 7) AS skewness, round(ku, 7) AS kurtosis, round(n / 6.0 * (sk * sk + (ku - 3) ** 2 / 4), 3) AS jarque_bera FROM z")
def normality(spark, sf):
    out = tests.skewness_kurtosis(_lines(spark, sf), "p")
    return out.select("n", F.round("skewness", 7).alias("skewness"), F.round("kurtosis", 7).alias("kurtosis"), F.round("jarque_bera", 3).alias("jarque_bera"))


@query("""WITH c AS (SELECT p_size AS a, b, count(*) AS n FROM (SELECT p_size, floor(p_retailprice / 10) AS b FROM part) GROUP BY 1, 2), s AS (SELECT sum(x.n * y.n * sign(y.b - x.b)) AS s FROM c x JOIN c y ON y.a > x.a), n AS (SELECT sum(n) AS n FROM c), ta AS (SELECT sum(t * (t - 1) / 2.0) AS t FROM (SELECT sum(n) AS t FROM c GROUP BY a)), tb AS (SELECT sum(t * (t - 1) / 2.0) AS t FROM (SELECT sum(n) AS t FROM c GROUP BY b))
SELECT CAST(n AS BIGINT) AS n, CAST(s AS DOUBLE) AS score, round(s / (n * (n - 1) / 2.0), 8) AS tau_a, round(s / sqrt((n * (n - 1) / 2.0 - ta.t) * (n * (n - 1) / 2.0 - tb.t)), 8) AS tau_b FROM s, n, ta, tb""")
def kendall_tau(spark, sf):
    rows = table(spark, sf, "part").select("p_size", F.floor(F.col("p_retailprice") / 10).alias("b"))
    return rounded(tests.kendall(rows, "p_size", "b"), 8)


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS t, sum(value) AS v FROM events GROUP BY 1), c AS (SELECT avg(v) AS c FROM d), u AS (SELECT t, CAST(v > c AS INTEGER) AS u FROM d, c), r AS (SELECT u, CASE WHEN lag(u) OVER (ORDER BY t) = u THEN 0 ELSE 1 END AS n FROM u)
SELECT CAST(sum(n) AS BIGINT) AS runs, CAST(sum(u) AS BIGINT) AS above, CAST(count(*) - sum(u) AS BIGINT) AS below FROM r""")
def runs_test(spark, sf):
    d = table(spark, sf, "events").groupBy(F.col("ts").cast("date").alias("t")).agg(F.sum("value").alias("v"))
    return tests.runs(d, "v", "t", d.agg(F.avg("v")).first()[0]).select("runs", "above", "below")


@query(f"""WITH {L}, k AS (SELECT i, rank() OVER (ORDER BY q) + (count(*) OVER (PARTITION BY q) - 1) / 2.0 AS r FROM l), s AS (SELECT sum(r * i) AS t, sum(i) AS l1, sum(i * i) AS l2, CAST(count(*) AS DOUBLE) AS n FROM k), e AS (SELECT sum(c * c * c - c) AS e FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM l GROUP BY q))
SELECT round(t, 2) AS score, round((t - (n + 1) * l1 / 2) / sqrt((n + 1) / 12 * (n * l2 - l1 * l1) * (1 - e / (n * n * n - n))), 6) AS z FROM s, e""")
def trend_test(spark, sf):
    return tests.trend(_lines(spark, sf), "q", "i").select(F.round("score", 2).alias("score"), F.round("z", 6).alias("z"))


@query("SELECT round(count(*) FILTER (quality = 1 AND toxic = 1) * count(*) FILTER (quality = 0 AND toxic = 0) / CAST(count(*) FILTER (quality = 1 AND toxic = 0) * count(*) FILTER (quality = 0 AND toxic = 1) AS DOUBLE), 8) AS odds_ratio FROM labels")
def fisher_table(spark, sf):
    return rounded(tests.fisher_exact(table(spark, sf, "labels"), "quality", "toxic"), 8, drop=("p_value",))


@query("""WITH g AS (SELECT c_nationkey AS g, count(*) AS n, avg(c_acctbal) AS m, var_pop(c_acctbal) AS v FROM customer GROUP BY 1), t AS (SELECT sum(n * m) / sum(n) AS a, sum(n) AS n, count(*) AS k, sum(n * v) AS w, sum(n * n) AS nn FROM g), b AS (SELECT sum(g.n * (m - a) ** 2) / (max(k) - 1) AS b, max(w) / (max(t.n) - max(k)) AS w, (max(t.n) - max(nn) / CAST(max(t.n) AS DOUBLE)) / (max(k) - 1) AS s FROM g, t)
SELECT round((b - w) / (b + (s - 1) * w), 8) AS icc, round(b / w, 8) AS f FROM b""")
def intraclass_correlation(spark, sf):
    return rounded(tests.intraclass(table(spark, sf, "customer"), "c_acctbal", "c_nationkey"), 8)


@query("""WITH c AS (SELECT l_orderkey AS i, l_returnflag AS r, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1, 2), m AS (SELECT i, sum(n) AS m, sum(n * (n - 1)) AS a FROM c GROUP BY i HAVING sum(n) > 1), t AS (SELECT count(*) AS items, sum(m) AS total, sum(a / (m * (m - 1))) AS agree FROM m), s AS (SELECT r, sum(n) AS n FROM c JOIN m USING (i) GROUP BY r), e AS (SELECT sum((n / total) ** 2) AS pe FROM s, t)
SELECT items, round(agree / items, 8) AS agreement, round((agree / items - pe) / (1 - pe), 8) AS fleiss FROM t, e""")
def rater_agreement(spark, sf):
    return rounded(tests.raters(table(spark, sf, "lineitem"), "l_orderkey", "l_returnflag").select("items", "agreement", "fleiss"), 8)


@query("SELECT CASE WHEN quality IS NULL THEN '-' ELSE 'x' END || CASE WHEN toxic IS NULL THEN '-' ELSE 'x' END AS pattern, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def missing_patterns(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    return tests.missing_patterns(rows, ["quality", "toxic"])


@query(f"""WITH {SURV}, c AS (SELECT CAST(floor(time / 10) AS BIGINT) AS i, sum(event) AS deaths, count(*) - sum(event) AS lost FROM u GROUP BY 1), e AS (SELECT *, sum(deaths + lost) OVER (ORDER BY i DESC) AS entering FROM c)
SELECT CAST(i * 10 AS DOUBLE) AS start, CAST(entering AS BIGINT) AS entering, CAST(deaths AS BIGINT) AS deaths, CAST(lost AS BIGINT) AS lost, round(CASE WHEN max(CAST(deaths >= entering - lost / 2.0 AS INTEGER)) OVER w = 1 THEN 0 ELSE exp(sum(CASE WHEN deaths < entering - lost / 2.0 THEN ln(1 - deaths / (entering - lost / 2.0)) ELSE 0 END) OVER w) END, 8) AS survival FROM e WINDOW w AS (ORDER BY i)""")
def life_table(spark, sf):
    return rounded(tests.life_table(_spells(spark, sf), "time", "event", 10.0), 8)


# ---- likelihood: models with a canonical link reproduce the sums of their outcomes, by every level they have a term for

@query(f"WITH {L} SELECT g, round(sum(y), 3) AS fitted, count(*) AS n FROM l GROUP BY g")
def logit_fitted_totals(spark, sf):
    rows = _lines(spark, sf)
    fit = mle.logit(rows, "y", ("g", "q"))
    return mle.predict(rows, fit, ("g", "q"), "logit").groupBy("g").agg(F.round(F.sum("predicted"), 3).alias("fitted"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {L} SELECT g, round(sum(i), 2) AS fitted FROM l GROUP BY g")
def poisson_fitted_totals(spark, sf):
    rows = _lines(spark, sf)
    return mle.predict(rows, mle.poisson(rows, "i", ("g", "q")), ("g", "q"), "log").groupBy("g").agg(F.round(F.sum("predicted"), 2).alias("fitted"))


@query(f"""WITH {L}, c AS (SELECT g, ln(count(*) FILTER (f = 'N') / CAST(count(*) FILTER (f = 'A') AS DOUBLE)) AS n, ln(count(*) FILTER (f = 'R') / CAST(count(*) FILTER (f = 'A') AS DOUBLE)) AS r FROM l GROUP BY g)
SELECT '1:_cons' AS term, round(n, 5) AS estimate FROM c WHERE g = 0 UNION ALL SELECT '2:_cons', round(r, 5) FROM c WHERE g = 0 UNION ALL SELECT '1:g', round((SELECT n FROM c WHERE g = 1) - n, 5) FROM c WHERE g = 0 UNION ALL SELECT '2:g', round((SELECT r FROM c WHERE g = 1) - r, 5) FROM c WHERE g = 0""")
def multinomial_saturated(spark, sf):
    rows = _lines(spark, sf).withColumn("k", F.when(F.col("f") == "A", 0.0).when(F.col("f") == "N", 1.0).otherwise(2.0))
    return rounded(mle.multinomial_logit(rows, "k", ("g",)).frame(spark).select("term", "estimate"), 5)


#: Value spent by user and day is overdispersed; with a dummy alone the means are those of its two cells.
@query("WITH c AS (SELECT user_id % 2 AS g, floor(value) AS z FROM events WHERE value IS NOT NULL), m AS (SELECT g, avg(z) AS m FROM c GROUP BY g) SELECT 'z:_cons' AS term, round(ln(m), 4) AS estimate FROM m WHERE g = 0 UNION ALL SELECT 'z:g', round(ln((SELECT m FROM m WHERE g = 1)) - ln(m), 4) FROM m WHERE g = 0")
def negative_binomial_means(spark, sf):
    rows = table(spark, sf, "events").where("value IS NOT NULL").select((F.col("user_id") % 2).cast("double").alias("g"), F.floor("value").cast("double").alias("z"))
    return rounded(mle.negative_binomial(rows, "z", ("g",), first=3.0).frame(spark).where("term LIKE 'z:%'").select("term", "estimate"), 4)


@query(f"WITH {L}, a AS (SELECT count(*) FILTER (q <= 10) / CAST(count(*) AS DOUBLE) AS a, count(*) FILTER (q <= 30) / CAST(count(*) AS DOUBLE) AS b FROM l) SELECT 'cut1:_cons' AS term, round(ln(a / (1 - a)), 5) AS estimate FROM a UNION ALL SELECT 'cut2:_cons', round(ln(b / (1 - b)), 5) FROM a")
def ordered_logit_cuts(spark, sf):
    rows = _lines(spark, sf).withColumn("k", (F.col("q") > 10).cast("double") + (F.col("q") > 30).cast("double"))
    return rounded(mle.ordered_logit(rows, "k", ()).frame(spark).select("term", "estimate"), 5)


@query(f"WITH {SURV}, c AS (SELECT CAST(g = 'F' AS DOUBLE) AS z, ln(sum(event) / sum(time)) AS r FROM u GROUP BY 1) SELECT '_cons' AS term, round(r, 5) AS estimate FROM c WHERE z = 0 UNION ALL SELECT 'z', round((SELECT r FROM c WHERE z = 1) - r, 5) FROM c WHERE z = 0")
def exponential_regression(spark, sf):
    rows = _spells(spark, sf).withColumn("z", (F.col("g") == "F").cast("double"))
    return rounded(mle.survival_regression(rows, "time", "event", ("z",), "exponential").frame(spark).select("term", "estimate"), 5)


@query(f"WITH {L}, c AS (SELECT avg(y) FILTER (g = 1) AS a, avg(y) FILTER (g = 0) AS b FROM l) SELECT 'g' AS term, round(ln(-ln(1 - a)) - ln(-ln(1 - b)), 5) AS estimate FROM c UNION ALL SELECT '_cons', round(ln(-ln(1 - b)), 5) FROM c")
def cloglog_saturated(spark, sf):
    return rounded(mle.cloglog(_lines(spark, sf), "y", ("g",)).frame(spark).select("term", "estimate"), 5)


@query(f"WITH {L} SELECT 'p:_cons' AS term, round(avg(p), 3) AS estimate FROM l UNION ALL SELECT 'lnsigma:_cons', round(ln(stddev_pop(p)), 3) FROM l")
def tobit_uncensored(spark, sf):
    return rounded(mle.tobit(_lines(spark, sf), "p", (), low=-1e12).frame(spark).select("term", "estimate"), 3)


def _registered(name, fit):
    """A model over lineitem whose estimates no SQL gives; tests hold the operator against data of known coefficients."""
    def run(spark, sf):
        return estimates(fit(_lines(spark, sf)), spark, 4)

    run.__name__ = name
    return query()(run)


for _name, _fit in {
    "ordered_probit": lambda d: mle.ordered_probit(d, "i", ("q",)),
    "truncated_regression": lambda d: mle.truncated_regression(d, "p", ("q",), low=2_000.0),
    "interval_regression": lambda d: mle.interval_regression(d.withColumns({"a": F.floor(F.col("p") / 5_000), "b": F.floor(F.col("p") / 5_000) + 1}), "a", "b", ("q",)),
    "truncated_poisson": lambda d: mle.truncated_poisson(d, "i", ("q",)),
    "median_regression": lambda d: mle.quantile_regression(d, "p", ("q",)),
    "fractional_logit": lambda d: mle.fraction_logit(d.withColumn("r", F.col("d") * 5), "r", ("q",), robust=True),
    "conditional_logit": lambda d: mle.conditional_logit(d.withColumn("c", (F.col("i") == 1).cast("double")), "c", ("q",), "o"),
}.items():
    _registered(_name, _fit)


@query()
def weibull_regression(spark, sf):
    return estimates(mle.survival_regression(_spells(spark, sf), "time", "event", ("l_quantity",), "weibull"), spark, 4)


# ---- graphs

@query(f"WITH g AS ({LINES}), n AS (SELECT s AS node FROM g UNION SELECT d FROM g), m AS (SELECT count(*) AS n FROM (SELECT least(s, d), greatest(s, d) FROM g GROUP BY 1, 2 HAVING count(*) = 2)), o AS (SELECT count(*) AS n FROM (SELECT least(s, d), greatest(s, d) FROM g GROUP BY 1, 2 HAVING count(*) = 1)), k AS (SELECT count(*) AS k FROM n) SELECT m.n AS mutual, o.n AS one_way, CAST(k * (k - 1) / 2 AS BIGINT) - m.n - o.n AS none FROM m, o, k")
def network_dyads(spark, sf):
    return graphs.dyads(_ring(spark, sf))


@query(f"WITH {RING}, k AS (SELECT src AS node, CAST(count(*) AS DOUBLE) AS k FROM b GROUP BY 1) SELECT round(corr(x.k, y.k), 8) AS assortativity FROM b JOIN k x ON x.node = b.src JOIN k y ON y.node = b.dst")
def network_assortativity(spark, sf):
    return rounded(graphs.assortativity(_ring(spark, sf)), 8)


@query(f"WITH {RING}, c AS (SELECT src % 5 AS x, dst % 5 AS y, count(*) AS n FROM b GROUP BY 1, 2), t AS (SELECT sum(n) AS t FROM c), s AS (SELECT sum((n / t) ** 2) AS s FROM (SELECT x, CAST(sum(n) AS DOUBLE) AS n FROM c GROUP BY x), t) SELECT round((sum(n) FILTER (x = y) / max(t) - max(s)) / (1 - max(s)), 8) AS mixing FROM c, t, s")
def network_mixing(spark, sf):
    kinds = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("node")).distinct().withColumn("kind", F.col("node") % 5)
    return rounded(graphs.attribute_mixing(_pairs(spark, sf), kinds), 8)


def _katz_sql(alpha: float, rounds: int) -> str:
    steps = [f"k{i} AS (SELECT n.node, 1 + {alpha} * coalesce(sum(k), 0) AS k FROM n LEFT JOIN g ON g.d = n.node LEFT JOIN k{i - 1} k ON k.node = g.s GROUP BY 1)" for i in range(1, rounds + 1)]
    return f"WITH g AS ({LINES}), n AS (SELECT s AS node FROM g UNION SELECT d FROM g), k0 AS (SELECT node, 1.0::DOUBLE AS k FROM n), {', '.join(steps)} SELECT node, round(k, 6) AS katz FROM k{rounds}"


@query(_katz_sql(0.001, 12))
def network_katz(spark, sf):
    return rounded(graphs.katz(_ring(spark, sf), alpha=0.001, tolerance=1e-12), 6)


@query()
def network_hits(spark, sf):
    return rounded(graphs.hits(_graph(spark, sf)), 8)


@query()
def network_eigenvector(spark, sf):
    return rounded(graphs.eigenvector(_pairs(spark, sf)), 6)


@query()
def network_strong_components(spark, sf):
    return graphs.strong_components(_ring(spark, sf))


@query()
def network_closeness(spark, sf):
    return rounded(graphs.closeness(_ring(spark, sf), spark.range(1, 4).select(F.col("id").alias("node"))), 8)


@query()
def network_weighted_distances(spark, sf):
    edges = _ring(spark, sf).withColumn("w", (F.col("src") * 7 + F.col("dst") * 3) % 11 + 1)
    return graphs.weighted_distances(edges, spark.range(1, 2).select(F.col("id").alias("node")), "w")


@query(f"WITH {GRAPH} SELECT 'bipartite' AS what, count(*) AS nodes FROM (SELECT src FROM g UNION SELECT dst FROM g)")
def network_bipartite(spark, sf):
    even, sides = graphs.two_colours(_graph(spark, sf))
    return sides.agg(F.lit("bipartite" if even else "odd").alias("what"), F.count(F.lit(1)).alias("nodes"))


@query()
def network_label_communities(spark, sf):
    return graphs.label_communities(_pairs(spark, sf))


@query("WITH e AS (SELECT DISTINCT l_orderkey AS e, l_suppkey AS v FROM lineitem), s AS (SELECT e, count(*) AS k FROM e GROUP BY 1) SELECT x.v AS a, y.v AS b, round(sum(1.0 / (k - 1)), 8) AS weight FROM e x JOIN e y ON x.e = y.e AND x.v < y.v JOIN s ON s.e = x.e GROUP BY 1, 2")
def hypergraph_cliques(spark, sf):
    return rounded(graphs.clique_projection(table(spark, sf, "lineitem"), "l_orderkey", "l_suppkey", normalised=True), 8)


@query("""WITH s AS (SELECT DISTINCT CAST(year(l_shipdate) AS INTEGER) AS t, l_partkey AS a, l_suppkey AS b FROM lineitem) SELECT x.t, count(*) AS edges, round(avg(CAST(y.a IS NOT NULL AS DOUBLE)), 8) AS persistence FROM s x LEFT JOIN s y ON y.t = x.t + 1 AND y.a = x.a AND y.b = x.b WHERE x.t < (SELECT max(t) FROM s) GROUP BY 1""")
def snapshot_persistence(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.year("l_shipdate").alias("t"), F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    return rounded(graphs.edge_persistence(rows, "t"), 8)


@query("WITH e AS (SELECT l_returnflag AS layer, l_partkey * 2 AS src, l_suppkey * 2 + 1 AS dst FROM lineitem), n AS (SELECT layer, src AS v FROM e UNION SELECT layer, dst FROM e), c AS (SELECT layer, count(*) AS edges FROM e GROUP BY 1) SELECT layer, edges, count(*) AS nodes FROM n JOIN c USING (layer) GROUP BY 1, 2")
def multilayer_sizes(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("layer"), (F.col("l_partkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst"))
    return graphs.layers(rows, "layer")


@query("WITH e AS (SELECT l_partkey * 2 AS src, l_suppkey * 2 + 1 AS dst, l_quantity - 25 AS w FROM lineitem) SELECT node, round(sum(greatest(w, 0)), 4) AS positive, round(sum(least(w, 0)), 4) AS negative FROM (SELECT src AS node, w FROM e UNION ALL SELECT dst, w FROM e) GROUP BY 1")
def signed_strengths(spark, sf):
    rows = table(spark, sf, "lineitem").select((F.col("l_partkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst"), (F.col("l_quantity") - 25).alias("w"))
    return rounded(graphs.signed_strength(rows, "w"), 4)
