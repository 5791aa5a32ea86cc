"""Queries on models with random effects, with their SQL where one can integrate densely."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystat.functions import jets as J
from quarrystat.operators import mle, random_effects
from quarrystat.plans.basic import estimates, query, rounded
from quarrystat.sources.tables import table


def _supplied(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with outcomes that depend on the supplier: how far the quantity, moved by the supplier's number, lies above 25."""
    d = table(spark, sf, "lineitem")
    moved = F.col("l_quantity") + 2 * ((F.col("l_suppkey") * 7) % 11 - 5)
    return d.select(F.col("l_suppkey").alias("s"), (moved > 25).cast("double").alias("y"), (moved / 10).alias("v"), F.floor(F.greatest(moved, F.lit(0)) / 15).cast("double").alias("k"), (F.col("l_discount") * 10).alias("x"), F.col("l_linenumber").cast("double").alias("i"))


SUPPLIED = "l AS (SELECT l_suppkey AS s, l_quantity + 2 * ((l_suppkey * 7) % 11 - 5) AS m, l_discount * 10 AS x FROM lineitem)"


def _integrated(row: str) -> str:
    """Each supplier's likelihood and mean effect by 401 points of the effect's distribution, at the query's coefficients."""
    return f"""
    WITH {SUPPLIED}, c AS (SELECT s, x, CASE WHEN m > 25 THEN 1.0 ELSE 0.0 END AS y, floor(greatest(m, 0) / 15) AS k, count(*) AS n FROM l GROUP BY 1, 2, 3, 4),
    g AS (SELECT -8 + i * 0.04 AS u FROM range(401) r(i)),
    e AS (SELECT s, u, sum(n * ({row})) - u * u / 2 - 0.5 * ln(2 * pi()) + ln(0.04) AS t FROM (SELECT *, 0.1 + 0.05 * x + 0.6 * u AS eta FROM c, g) GROUP BY s, u),
    p AS (SELECT s, max(t) AS top FROM e GROUP BY s)
    SELECT CAST(s AS VARCHAR) AS s, round(ln(sum(exp(t - top))) + max(top), 4) AS loglik, round(0.6 * sum(u * exp(t - top)) / sum(exp(t - top)), 4) AS effect FROM e JOIN p USING (s) GROUP BY s"""


def _problem(outcome: str, row) -> mle.Problem:
    return mle.Problem(lambda y, e: row(y[outcome], e[0]), (outcome,), (mle.Equation(outcome, ("x",)),))


def _panels(spark, sf, outcome, row):
    found = random_effects.evaluated(_supplied(spark, sf), _problem(outcome, row), "s", [0.05, 0.1, math.log(0.6)], nodes=20)
    return rounded(found.select("s", "loglik", "effect"), 4)


@query(_integrated("eta * y - ln(1 + exp(eta))"))
def random_logit_panels(spark, sf):
    return _panels(spark, sf, "y", lambda y, e: e * y - J.softplus(e))


@query(_integrated("eta * k - exp(eta) - lgamma(k + 1)"))
def random_poisson_panels(spark, sf):
    return _panels(spark, sf, "k", mle._count)


def _registered(name, fit):
    """A model whose estimates no SQL gives; tests hold it against dense integration."""

    def run(spark, sf):
        return estimates(fit(_supplied(spark, sf)), spark, 3)

    run.__name__ = name
    return query()(run)


for _name, _fit in {
    "random_logit": lambda d: mle.logit(d, "y", ("x",), panel="s"),
    "random_probit": lambda d: mle.probit(d, "y", ("x",), panel="s"),
    "random_cloglog": lambda d: mle.cloglog(d, "y", ("x",), panel="s"),
    "random_poisson": lambda d: mle.poisson(d, "k", ("x",), panel="s"),
    "random_ordered_logit": lambda d: mle.ordered_logit(d, "k", ("x",), panel="s"),
    "random_ordered_probit": lambda d: mle.ordered_probit(d, "k", ("x",), panel="s"),
    "random_tobit": lambda d: mle.tobit(d, "v", ("x",), low=1.0, panel="s"),
    "random_linear": lambda d: mle.gaussian(d, "v", ("x",), panel="s"),
}.items():
    _registered(_name, _fit)


@query()
def random_effects_of_suppliers(spark, sf):
    return rounded(mle.logit(_supplied(spark, sf), "y", ("x",), panel="s").effects, 3)
