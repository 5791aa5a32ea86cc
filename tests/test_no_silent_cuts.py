"""What used to end early now goes on to the end, or is an error."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrystat.operators import moments, multivariate, network, series, survival, tests
from quarrystat.operators.mle import NotConverged
from quarrystat.plans.spec import Spec


def test_distances_reach_the_end_of_a_chain(spark):
    chain = spark.range(30).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    start = spark.range(1).toDF("node")
    assert network.distances(chain, start).agg(F.count("*"), F.max("hops")).first()[:] == (31, 30)
    assert network.distances(chain, start, 6).count() == 7
    assert network.distances(chain, start.where("false")).count() == 0


def test_pagerank_settles_or_says_so(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 3), (4, 3)], "src long, dst long")
    got = {r["node"]: r["rank"] for r in network.pagerank(edges, tolerance=1e-10).collect()}
    n, out = 5, {0: [1], 1: [2], 2: [0, 3], 4: [3]}
    ranks = np.full(n, 1 / n)
    for _ in range(400):
        moved = np.zeros(n)
        for a, to in out.items():
            for b in to:
                moved[b] += ranks[a] / len(to)
        ranks = 0.15 / n + 0.85 * (moved + (1 - moved.sum()) / n)
    assert [got[i] for i in range(n)] == pytest.approx(list(ranks), abs=1e-9)
    with pytest.raises(ValueError, match="not settled"):
        network.pagerank(edges, tolerance=1e-10, most=8)
    assert network.pagerank(edges.where("false")).count() == 0


def test_kmeans_says_when_centres_still_move(spark):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([([float(x) for x in rng.normal(size=2)],) for _ in range(500)], "v array<double>")
    with pytest.raises(ValueError, match="still move"):
        multivariate.kmeans(rows, "v", 2, 6, most=2)
    done, centres = multivariate.kmeans(rows, "v", 2, 6)
    again, same = multivariate.kmeans(rows, "v", 2, 6, rounds=200)
    assert np.allclose(centres, same)
    assert done.agg(F.sum("size")).first()[0] == 500


def test_cox_on_separated_events_is_an_error(spark):
    rows = spark.createDataFrame([(float(i + 1), 1, float(i < 10)) for i in range(40)], "t double, d int, x double")
    with pytest.raises(NotConverged):
        survival.cox(rows, "t", "d", ("x",))


@pytest.mark.parametrize("n", [1, 7, 50])
def test_binomial_is_exact(n):
    for p in (0.1, 0.5, 0.83):
        f = [math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(n + 1)]
        for k in range(n + 1):
            assert tests.binomial_chance(n, k, p) == pytest.approx(min(1.0, sum(x for x in f if x <= f[k] * (1 + 1e-9))), abs=1e-10)


def test_binomial_of_many_rows_stays_exact():
    n, k = 10**6, 500_980
    z = (k - 0.5 - n / 2) / math.sqrt(n / 4)
    assert tests.binomial_chance(n, k, 0.5) == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-4)


def test_smoothing_counts_all_rows(spark):
    rows = spark.range(400).select(F.lit("a").alias("g"), F.col("id").alias("t"), (F.col("id") == 0).cast("double").alias("y"))
    assert series.smooth(rows, "y", "t", 0.01, ["g"]).where("t = 399").first()["smooth"] == pytest.approx(0.99**398)


def test_bootstrap_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 12, 600)
    y = 2 * x + rng.integers(-20, 20, 600)
    rows = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, x, strict=True)], "y double, x double")
    one = moments.bootstrap(rows.repartition(2), Spec("y", ("x",)), draws=300)
    other = moments.bootstrap(rows.repartition(5), Spec("y", ("x",)), draws=300)
    assert np.allclose(one.covariance, other.covariance)
    d = np.column_stack([x - x.mean(), np.ones(600)])
    e = y - np.column_stack([x, np.ones(600)]) @ one.beta
    robust = (d[:, 0] ** 2 * e**2).sum() / (d[:, 0] ** 2).sum() ** 2
    assert one.covariance[0, 0] == pytest.approx(robust, rel=0.25)
