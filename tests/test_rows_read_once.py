"""Calibrated totals read written rows in every step, not the joins that the rows come from."""

import pytest
from pyspark.sql import functions as F

from quarrystat.operators import survey
from quarrystat.operators.survey import Design, Stage


def test_calibrated_totals(spark, monkeypatch):
    held, before = [], survey.calibrate
    monkeypatch.setattr(survey, "calibrate", lambda df, *a, **k: held.append("written_at" in vars(df)) or before(df, *a, **k))
    rows = spark.range(400).select((F.col("id") % 40).alias("u"), (F.col("id") % 4).alias("h"), F.lit(2.0).alias("w"), (F.col("id") % 7).cast("double").alias("y"), F.lit(1.0).alias("one"))
    fit = survey.calibrated_total(rows, "y", {"one": 1_000.0}, Design("w", (Stage("u", "h"),)), method="raking")
    assert held == [True]
    assert fit.beta[0] == pytest.approx(1_000 / 400 * sum(i % 7 for i in range(400)))
