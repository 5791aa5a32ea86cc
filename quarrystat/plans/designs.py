"""Queries on survey designs of several stages, replicates and calibration, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystat.operators import survey
from quarrystat.operators.linear import Fit
from quarrystat.operators.survey import Design, Stage
from quarrystat.plans.basic import query, rounded
from quarrystat.sources.tables import table, written


def _sampled(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as drawn in stages: customers by nation, their orders, and lines; populations are what the counts come from, and more."""
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return lines.select(
        F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("customer"), F.col("o_orderkey").alias("ordered"), F.col("l_linenumber").alias("line"),
        (1 + F.col("l_linenumber") / 4).alias("w"), F.lit(20_000).alias("customers"), F.lit(60).alias("orders"), F.lit(9).alias("lines"),
        F.col("l_quantity").alias("y"), (F.col("l_extendedprice") / 1000).alias("x"), F.col("l_returnflag").alias("flag"), (F.col("l_returnflag") == "R").cast("double").alias("d"), (F.col("o_orderkey") % 2).alias("half"),
    )


#: The same lines; keep those with several lines at the last stage, which a variance needs, is the operator's ``certainty``.
SAMPLED = "s AS (SELECT c_nationkey AS nation, c_custkey AS customer, o_orderkey AS ordered, l_linenumber AS line, 1 + l_linenumber / 4 AS w, l_quantity AS y, l_extendedprice / 1000 AS x, l_returnflag AS flag FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"

STAGES = (Stage("customer", "nation", "customers"), Stage("ordered", None, "orders"), Stage("line", None, "lines"))


def _staged(score: str, before: str = "") -> str:
    """The variance of the sum of ``score`` over three stages; strata of one unit add nothing."""
    return f"""{SAMPLED}{before}, z AS (SELECT nation, customer, ordered, line, {score} AS z FROM s{", m" if before else ""}),
    l3 AS (SELECT nation, customer, ordered, line, sum(z) AS z FROM z GROUP BY ALL), g3 AS (SELECT nation, customer, ordered, count(*) AS m, var_samp(z) AS v, sum(z) AS z FROM l3 GROUP BY ALL),
    g2 AS (SELECT nation, customer, count(*) AS m, var_samp(z) AS v, sum(z) AS z, least(count(*) / 60.0, 1) AS f FROM g3 GROUP BY ALL), g1 AS (SELECT nation, count(*) AS m, var_samp(z) AS v, least(count(*) / 20000.0, 1) AS f FROM g2 GROUP BY ALL),
    t AS (SELECT (SELECT sum((1 - f) * m * coalesce(v, 0)) FROM g1) + (SELECT sum(g1.f * (1 - g2.f) * g2.m * coalesce(g2.v, 0)) FROM g2 JOIN g1 USING (nation))
      + (SELECT sum(g1.f * g2.f * (1 - least(g3.m / 9.0, 1)) * g3.m * coalesce(g3.v, 0)) FROM g3 JOIN g2 USING (nation, customer) JOIN g1 USING (nation)) AS v)"""


def _told(fit: Fit, spark: SparkSession, digits: int) -> DataFrame:
    return rounded(fit.frame(spark).select("term", "estimate", "std_error"), digits)


@query(f"WITH {_staged('w * y')} SELECT 'y' AS term, round((SELECT sum(w * y) FROM s), 2) AS estimate, round(sqrt(v), 2) AS std_error FROM t")
def survey_three_stage_total(spark, sf):
    return _told(survey.totals(_sampled(spark, sf), ["y"], Design("w", STAGES, "certainty")), spark, 2)


@query(f"WITH {_staged('w * (y - r) / tw', ', m AS (SELECT sum(w * y) / sum(w) AS r, sum(w) AS tw FROM s)')} SELECT 'y' AS term, round((SELECT r FROM m), 6) AS estimate, round(sqrt(v), 6) AS std_error FROM t")
def survey_three_stage_mean(spark, sf):
    return _told(survey.means(_sampled(spark, sf), ["y"], Design("w", STAGES, "certainty")), spark, 6)


@query(f"WITH {_staged('w * (x - r * y) / tw', ', m AS (SELECT sum(w * x) / sum(w * y) AS r, sum(w * y) AS tw FROM s)')} SELECT 'x/y' AS term, round((SELECT r FROM m), 6) AS estimate, round(sqrt(v), 6) AS std_error FROM t")
def survey_three_stage_ratio(spark, sf):
    return _told(survey.ratios(_sampled(spark, sf), [("x", "y")], Design("w", STAGES, "certainty")), spark, 6)


@query(f"""WITH {SAMPLED}, m AS (SELECT flag AS term, sum(w) / (SELECT sum(w) FROM s) AS r FROM s GROUP BY 1), u AS (SELECT term, nation, customer, sum(w * (CAST(flag = term AS DOUBLE) - r)) / (SELECT sum(w) FROM s) AS z FROM s, m GROUP BY ALL),
g AS (SELECT term, nation, count(*) AS n, var_samp(z) AS v FROM u GROUP BY ALL) SELECT term, round(max(r), 6) AS estimate, round(sqrt(sum(n * coalesce(v, 0))), 6) AS std_error FROM g JOIN m USING (term) GROUP BY term""")
def survey_proportions(spark, sf):
    return _told(survey.proportions(_sampled(spark, sf), "flag", Design("w", (Stage("customer", "nation"),), "certainty")), spark, 6)


@query(f"""WITH {SAMPLED}, u AS (SELECT nation, ordered % 2 AS half, sum(w * y) / 1000 AS z, sum(w * x) / 1000 AS q FROM s GROUP BY ALL), d AS (SELECT max(z) FILTER (half = 0) - max(z) FILTER (half = 1) AS y, max(q) FILTER (half = 0) - max(q) FILTER (half = 1) AS x FROM u GROUP BY nation)
SELECT 'ky' AS term, round((SELECT sum(z) FROM u), 6) AS estimate, round(sqrt(sum(y * y)), 6) AS std_error FROM d UNION ALL SELECT 'kx', round((SELECT sum(q) FROM u), 6), round(sqrt(sum(x * x)), 6) FROM d""")
def survey_balanced_totals(spark, sf):
    """Halves of each nation's orders as its two units."""
    rows = _sampled(spark, sf).withColumns({"ky": F.col("y") / 1000, "kx": F.col("x") / 1000})
    return _told(survey.balanced(rows, survey.total_statistic(["ky", "kx"]), Design("w", (Stage("half", "nation"),)), fay=0.3), spark, 6)


@query(f"""WITH {SAMPLED}, u AS (SELECT nation, customer, sum(w) AS w, sum(w * y) AS y FROM s GROUP BY ALL), h AS (SELECT nation, count(*) AS m, sum(w) AS w, sum(y) AS y FROM u GROUP BY ALL), t AS (SELECT sum(w) AS w, sum(y) AS y FROM u),
l AS (SELECT m, (t.y - u.y + (h.y - u.y) / (m - 1)) / (t.w - u.w + (h.w - u.w) / (m - 1)) - t.y / t.w AS d FROM u JOIN h USING (nation), t WHERE m > 1)
SELECT 'y' AS term, round((SELECT y / w FROM t), 6) AS estimate, round(sqrt(sum((m - 1) / m * d * d)), 6) AS std_error FROM l""")
def survey_jackknife_mean(spark, sf):
    # the SQL leaves units out as the operator does: the others of a stratum count m / (m - 1) times
    return _told(survey.jackknifed(_sampled(spark, sf), survey.mean_statistic(["y"]), Design("w", (Stage("customer", "nation"),))), spark, 6)


@query(f"""WITH {SAMPLED}, a AS (SELECT sum(w) AS n, sum(w * x) AS x, sum(w * x * x) AS xx, sum(w) * 1.1 - sum(w) AS g0, sum(w * x) * 1.2 - sum(w * x) AS g1 FROM s), b AS (SELECT (xx * g0 - x * g1) / (n * xx - x * x) AS l0, (n * g1 - x * g0) / (n * xx - x * x) AS l1 FROM a)
SELECT round(sum(w * (1 + l0 + l1 * x)) / 1000, 6) AS weight, round(sum(w * (1 + l0 + l1 * x) * x) / 1000, 6) AS x, round(sum(w * (1 + l0 + l1 * x) * y) / 1000, 6) AS y FROM s, b""")
def survey_calibrated(spark, sf):
    rows = _sampled(spark, sf).withColumn("one", F.lit(1.0))
    n, x = rows.agg(F.sum("w"), F.sum(F.col("w") * F.col("x"))).first()
    got = survey.calibrate(rows, "w", {"one": 1.1 * n, "x": 1.2 * x})
    w = F.col("calibrated") / 1000
    return rounded(got.agg(F.sum(w).alias("weight"), F.sum(w * F.col("x")).alias("x"), F.sum(w * F.col("y")).alias("y")), 6)


@query()
def survey_raked_total(spark, sf):
    rows = _sampled(spark, sf).withColumns({f: (F.col("flag") == f).cast("double") for f in ("A", "N", "R")})
    rows = written(rows.select("w", "A", "N", "R", "y", "customer", "nation"))  # the joins of three tables, read again by every step
    counts = rows.agg(*[F.sum(F.col("w") * F.col(f)) for f in ("A", "N", "R")]).first()
    goal = {f: float(c) * s for f, c, s in zip(("A", "N", "R"), counts, (1.3, 0.9, 1.0), strict=True)}
    return _told(survey.calibrated_total(rows, "y", goal, Design("w", (Stage("customer", "nation"),), "certainty"), method="raking"), spark, 1)


def _registered(name, fit, digits=4):
    """Estimates that no SQL gives; tests hold the operator against a recursion over the stages."""

    def run(spark, sf):
        return _told(fit(_sampled(spark, sf)), spark, digits)

    run.__name__ = name
    return query()(run)


for _name, _fit in {
    "survey_three_stage_regression": lambda d: survey.regression(d, "x", ("y",), Design("w", STAGES, "certainty")),
    "survey_three_stage_logit": lambda d: survey.regression(d, "d", ("y",), Design("w", STAGES, "certainty"), "logit"),
    "survey_two_stage_probit": lambda d: survey.regression(d, "d", ("y",), Design("w", STAGES[:2], "certainty"), "probit"),
    "survey_two_stage_poisson": lambda d: survey.regression(d, "y", ("x",), Design("w", STAGES[:2], "certainty"), "poisson"),
    "survey_balanced_regression": lambda d: survey.balanced(d, survey.regression_statistic("x", ("y",)), Design("w", (Stage("half", "nation"),))),
    "survey_bootstrap_mean": lambda d: survey.bootstrapped(d, survey.mean_statistic(["y"]), Design("w", (Stage("customer", "nation"),))),
}.items():
    _registered(_name, _fit)
