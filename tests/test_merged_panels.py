"""Rows of panels, merged and in ranges."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarrystat.operators import random_effects
from quarrystat.plans import panels


def test_equal_rows_of_a_panel_are_one(spark, monkeypatch):
    """The random_ models: passes over 40 panels of 500 rows met a vector of sums for each panel and batch; now rows are few and in ranges."""
    rng = np.random.default_rng(2)
    rows = [(int(g), float(y), float(x)) for g, y, x in zip(rng.integers(0, 40, 20_000), rng.integers(0, 2, 20_000), rng.integers(0, 5, 20_000), strict=True)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["s", "y", "x"])).repartition(9)
    problem = panels._problem("y", lambda y, e: e * y - panels.J.softplus(e))
    kept = random_effects._panel_rows(df, problem, "s")
    assert kept.count() == 400 and kept.agg(F.sum("n")).first()[0] == 20_000
    assert kept.select("cluster", F.input_file_name().alias("file")).distinct().count() <= 40 + 4
    beta = [0.05, 0.1, math.log(0.6)]
    got = {r["s"]: r["loglik"] for r in random_effects.evaluated(df, problem, "s", beta, nodes=20).collect()}
    monkeypatch.setattr(random_effects, "BROADCAST", 0)
    joined = {r["s"]: r["loglik"] for r in random_effects.evaluated(df, problem, "s", beta, nodes=20).collect()}
    u = np.linspace(-8, 8, 4001)
    for g in range(40):
        own = np.array([r[1:] for r in rows if r[0] == g])
        eta = 0.1 + 0.05 * own[:, 1:] + 0.6 * u
        t = (eta * own[:, :1] - np.logaddexp(0, eta)).sum(axis=0) - u * u / 2 - 0.5 * math.log(2 * math.pi) + math.log(u[1] - u[0])
        assert got[str(g)] == pytest.approx(np.logaddexp.reduce(t), rel=1e-8)
        assert joined[str(g)] == pytest.approx(got[str(g)], rel=1e-12)
