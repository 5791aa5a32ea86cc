"""Queries on ordered recurrences: smoothing, ARIMA, GARCH and unobserved components, with their SQL by recursion."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystat.functions.scan import Model
from quarrystat.operators import recurrence as R
from quarrystat.plans.basic import estimates, query, rounded
from quarrystat.sources.tables import table


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("user_id", "event_id", "value")


#: The events of each user in order.
EVENTS = "e AS (SELECT user_id, event_id, value AS y, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events)"


def _daily(spark: SparkSession, sf: str) -> DataFrame:
    """Each day's mean order in thousands; days without orders are gaps."""
    return table(spark, sf, "orders").groupBy(F.datediff("o_orderdate", F.lit("1970-01-01")).cast("long").alias("day")).agg((F.avg("o_totalprice") / 1000).alias("price"))


DAILY = "o AS (SELECT date_diff('day', TIMESTAMP '1970-01-01', o_orderdate) AS day, avg(o_totalprice) / 1000 AS y FROM orders GROUP BY 1), d AS (SELECT *, row_number() OVER (ORDER BY day) AS i FROM o)"


@query(f"""WITH RECURSIVE {EVENTS}, s AS (SELECT user_id, event_id, i, NULL::DOUBLE AS forecast, y AS level FROM e WHERE i = 1
UNION ALL SELECT e.user_id, e.event_id, e.i, s.level, s.level + 0.2 * (e.y - s.level) FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1)
SELECT user_id, event_id, round(forecast, 6) AS forecast, round(level, 6) AS level FROM s""")
def smooth_simple(spark, sf):
    rows = R.smooth(_events(spark, sf), "value", "event_id", 0.2, ("user_id",)).withColumnRenamed("t", "event_id")
    return rounded(rows.drop("trend"), 6)


@query(f"""WITH RECURSIVE {EVENTS}, w AS (SELECT 1.0::DOUBLE / 7 AS al, 1.0::DOUBLE / 19 AS be, 1.0::DOUBLE / 11 AS ga, 6.0::DOUBLE / 7 AS d), s AS (SELECT user_id, event_id, i, NULL::DOUBLE AS forecast, y AS level, 0.0::DOUBLE AS trend, [0.0::DOUBLE, 0, 0, 0] AS season FROM e WHERE i = 1
UNION ALL SELECT e.user_id, e.event_id, e.i, level + d * trend + season[4], level + d * trend + al * (y - level - d * trend - season[4]), d * trend + be * (y - level - d * trend - season[4]),
  list_prepend(season[4] + ga * (y - level - d * trend - season[4]), season[1:3]) FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1, w)
SELECT user_id, event_id, round(forecast, 4) AS forecast, round(level, 4) AS level, round(trend, 4) AS trend, round(season[1], 4) AS season FROM s""")
def smooth_holt_winters(spark, sf):
    rows = R.smooth(_events(spark, sf), "value", "event_id", 1 / 7, ("user_id",), beta=1 / 19, gamma=1 / 11, period=4, damping=6 / 7)
    return rounded(rows.withColumnRenamed("t", "event_id"), 4)


@query("SELECT user_id, event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING), 6) AS average FROM events")
def smooth_moving_average(spark, sf):
    return rounded(R.moving_average(_events(spark, sf), "value", "event_id", 3, 1, ("user_id",)).withColumnRenamed("t", "event_id"), 6)


@query(f"""WITH RECURSIVE {EVENTS}, v AS (SELECT user_id, event_id, i, y, 100.0::DOUBLE AS h, 20 + 0.1 * (y - 50) ** 2 + (CASE WHEN y < 50 THEN 0.05 * (y - 50) ** 2 ELSE 0 END) + 0.7 * 100 AS next FROM e WHERE i = 1
UNION ALL SELECT e.user_id, e.event_id, e.i, e.y, next, 20 + 0.1 * (e.y - 50) ** 2 + (CASE WHEN e.y < 50 THEN 0.05 * (e.y - 50) ** 2 ELSE 0 END) + 0.7 * next FROM v JOIN e ON e.user_id = v.user_id AND e.i = v.i + 1)
SELECT user_id, event_id, round(h, 5) AS variance, round(next, 5) AS next FROM v""")
def garch_variances(spark, sf):
    parameters = {"mean": 50.0, "lnomega": math.log(20), "arch1": 0.1, "tarch1": 0.05, "garch1": 0.7}
    return rounded(R.garch_variance(_events(spark, sf), "value", "event_id", parameters, 100.0, ("user_id",)).withColumnRenamed("t", "event_id"), 5)


@query(f"""WITH RECURSIVE {EVENTS}, f AS (SELECT user_id, event_id, i, y - 50 AS x, y - 50 AS e, (1 + 2 * 0.5 * 0.3 + 0.3 * 0.3) / (1 - 0.5 * 0.5) AS f FROM e WHERE i = 1
UNION ALL SELECT e.user_id, e.event_id, e.i, e.y - 50, e.y - 50 - 0.5 * x - 0.3 * f.e / f, 1 + 0.3 * 0.3 - 0.3 * 0.3 / f FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
SELECT user_id, event_id, round(e, 6) AS error, round(400 * f, 6) AS variance, round(-0.5 * (ln(2 * pi()) + ln(400 * f) + e * e / (400 * f)), 6) AS loglik FROM f""")
def arma_errors(spark, sf):
    # AR and MA of order one as a state-space model, over the rows of each user as its periods
    f, g = np.array([[0.5, 1.0], [0.0, 0.0]]), np.array([1.0, 0.3])
    variance = np.array([[(1 + 2 * 0.5 * 0.3 + 0.3 * 0.3) / (1 - 0.5 * 0.5), 0.3], [0.3, 0.09]])
    model = Model(f[None], 400 * np.outer(g, g)[None], np.array([[1.0, 0.0]]), np.zeros(1), np.array([50.0]), np.zeros((1, 2)), 400 * variance[None])
    return rounded(R.state_space_filter(_events(spark, sf), "value", "event_id", model, ("user_id",)).withColumnRenamed("t", "event_id"), 6)


@query(f"""WITH RECURSIVE {DAILY}, k AS (SELECT day, i, y, 200.0::DOUBLE AS prediction, 9e9::DOUBLE + 900 AS s, 200 + 9e9 / (9e9 + 900) * (y - 200) AS a, 9e9 - 9e9 * 9e9 / (9e9 + 900) AS p FROM d WHERE i = 1
UNION ALL SELECT d.day, d.i, d.y, a, p + 4 + 900, a + (p + 4) / (p + 4 + 900) * (d.y - a), (p + 4) - (p + 4) * (p + 4) / (p + 4 + 900) FROM k JOIN d ON d.i = k.i + 1)
SELECT day, round(prediction, 4) AS prediction, round(s, 4) AS variance, round(a, 4) AS level FROM k""")
def local_level_filter(spark, sf):
    rows = R.components_filter(_daily(spark, sf), "price", "day", {"irregular": 900.0, "level": 4.0}, variance=9e3, middle=200.0)
    return rounded(rows.withColumnRenamed("t", "day"), 4)


@query()
def arima_estimates(spark, sf):
    return estimates(R.arima(_daily(spark, sf), "price", "day", R.Arima(p=2)).fit, spark, 3)


@query()
def arima_forecasts(spark, sf):
    days = _daily(spark, sf)
    return rounded(R.arima_forecast(days, R.arima(days, "price", "day", R.Arima(d=1, q=1), constant=False), 30), 3)


@query()
def garch_estimates(spark, sf):
    return estimates(R.garch(_events(spark, sf), "value", "event_id", ("user_id",), arch=2, garch=0), spark, 3)


@query()
def component_estimates(spark, sf):
    return estimates(R.components(_daily(spark, sf), "price", "day"), spark, 2)


@query()
def smoothing_weights(spark, sf):
    fit = R.exponential_fit(_daily(spark, sf), "price", "day")
    return rounded(fit.frame(spark).select("term", "estimate"), 2)
