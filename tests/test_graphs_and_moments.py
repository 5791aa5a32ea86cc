"""Graph operators, resampling and files against plain Python on small cases."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrystat.operators import graphs, moments, tests
from quarrystat.plans.spec import Spec
from quarrystat.sources import files


@pytest.fixture(scope="module")
def arcs():
    rng = random.Random(3)
    return sorted({(rng.randrange(30), rng.randrange(30)) for _ in range(55)} | {(40, 41), (41, 42), (42, 40), (42, 43)})


def reach(arcs, start):
    seen, todo = {start: 0}, [start]
    for x in todo:
        for a, b in arcs:
            if a == x and b not in seen:
                seen[b] = seen[x] + 1
                todo.append(b)
    return seen


def test_strong_components_and_closeness(spark, arcs):
    df = spark.createDataFrame(arcs, "src long, dst long").repartition(3)
    nodes = sorted({x for a in arcs for x in a})
    far = {x: reach(arcs, x) for x in nodes}
    got = {r["node"]: r["component"] for r in graphs.strong_components(df).collect()}
    assert set(got) == set(nodes)
    for a, b in itertools.combinations(nodes, 2):
        assert (got[a] == got[b]) == (b in far[a] and a in far[b])
    some = nodes[:4]
    for r in graphs.closeness(df, spark.createDataFrame([(x,) for x in some], "node long")).collect():
        hops = [h for h in far[r["node"]].values() if h]
        assert r["reached"] == len(hops) and r["harmonic"] == pytest.approx(sum(1 / h for h in hops))
        assert r["closeness"] == pytest.approx(len(hops) / sum(hops) * len(hops) / (len(nodes) - 1) if hops else 0)


def test_weighted_distances_and_scores(spark, arcs):
    weights = {a: (a[0] * 7 + a[1] * 3) % 11 + 1.0 for a in arcs}
    df = spark.createDataFrame([(*a, w) for a, w in weights.items()], "src long, dst long, w double")
    best = {arcs[0][0]: 0.0}
    for _ in range(40):
        for (a, b), w in weights.items():
            if a in best and best[a] + w < best.get(b, np.inf):
                best[b] = best[a] + w
    got = graphs.weighted_distances(df, spark.createDataFrame([(arcs[0][0],)], "node long"), "w")
    assert {r["node"]: r["distance"] for r in got.collect()} == best
    nodes = sorted({x for a in arcs for x in a})
    m = np.zeros((len(nodes), len(nodes)))
    for a, b in arcs:
        m[nodes.index(a), nodes.index(b)] = 1
    h, a = np.ones(len(nodes)), None
    for _ in range(3_000):
        a = m.T @ h
        h = m @ a
        h, a = h / h.sum(), a / a.sum()
    got = {r["node"]: (r["hub"], r["authority"]) for r in graphs.hits(df, tolerance=1e-4).collect()}
    assert [got[x][0] for x in nodes] == pytest.approx(h, abs=1e-2) and [got[x][1] for x in nodes] == pytest.approx(a, abs=1e-2)
    with pytest.raises(ValueError):
        graphs.weighted_distances(df.withColumn("w", -F.col("w")), spark.range(1).toDF("node"), "w")


def test_colours_communities_and_elements(spark, tmp_path):
    ring = lambda n, at=0: [(at + i, at + (i + 1) % n) for i in range(n)]
    even, sides = graphs.two_colours(spark.createDataFrame(ring(6), "src long, dst long"))
    assert even and {r["node"]: r["side"] for r in sides.collect()} == {str(i): i % 2 for i in range(6)}
    assert not graphs.two_colours(spark.createDataFrame(ring(5) + ring(4, 10), "src long, dst long"))[0]
    cliques = [(a, b) for at in (0, 10) for a, b in itertools.combinations(range(at, at + 5), 2)] + [(4, 10)]
    got = {r["node"]: r["community"] for r in graphs.label_communities(spark.createDataFrame(cliques, "src long, dst long")).collect()}
    assert len({got[i] for i in range(5)}) == 1 and len({got[i] for i in range(10, 15)}) == 1
    edges = spark.createDataFrame([("a", "<b>")], "src string, dst string")
    lines = files.graph_lines(graphs.nodes_of(edges), edges)
    files.write(lines, f"{tmp_path}/g", "text")
    assert spark.read.text(f"{tmp_path}/g").count() == 3
    assert 'target="&lt;b&gt;"' in files.gexf_elements(graphs.nodes_of(edges), edges)[1].first()[0]
    table = spark.createDataFrame([(1, "x,y"), (2, None)], "a long, b string")
    files.write(table, f"{tmp_path}/c", "csv")
    assert sorted(map(tuple, files.read_csv(spark, f"{tmp_path}/c", "a long, b string").collect())) == [(1, "x,y"), (2, None)]
    files.write(table, f"{tmp_path}/j", "json")
    assert files.read_json(spark, f"{tmp_path}/j", "a long, b string").count() == 2


def test_resampling_and_penalties(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((400, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0.3], [0, 0, 1]])
    y = x @ [1.0, 0.0, -0.5] + 2 + rng.standard_normal(400)
    g = rng.integers(0, 40, 400)
    df = spark.createDataFrame([(*map(float, r), float(v), int(k)) for r, v, k in zip(x, y, g, strict=True)], "a double, b double, c double, y double, g int").repartition(3)
    spec = Spec("y", ("a", "b"))
    d = np.column_stack([x[:, :2], np.ones(400)])
    beta = np.linalg.lstsq(d, y, rcond=None)[0]
    leave = np.array([np.linalg.lstsq(d[g != k], y[g != k], rcond=None)[0] - beta for k in range(40)])
    assert moments.jackknife(df, spec, "g").covariance == pytest.approx(leave.T @ leave * 39 / 40, rel=1e-7)
    boot = moments.bootstrap(df, spec, draws=300, key="g")
    again = moments.bootstrap(df.repartition(5), spec, draws=300, key="g")
    assert boot.covariance == pytest.approx(again.covariance, rel=1e-9)
    assert np.sqrt(np.diag(boot.covariance)) == pytest.approx(np.sqrt(np.diag(leave.T @ leave * 39 / 40)), rel=0.3)
    z = (x - x.mean(0)) / x.std(0)
    got = moments.elastic_net(df, "y", ["a", "b", "c"], 0.1, mix=0.7)
    b = np.array([got[k] for k in "abc"]) * x.std(0)
    slope = z.T @ (y - y.mean() - z @ b) / 400 - 0.1 * 0.3 * b
    assert all(abs(s - 0.07 * np.sign(v)) < 1e-8 if v else abs(s) <= 0.07 + 1e-8 for s, v in zip(slope, b, strict=True))
    ridge = moments.ridge(df, "y", ["a", "b", "c"], 0.2)
    want = np.linalg.solve(z.T @ z / 400 + 0.2 * np.eye(3), z.T @ (y - y.mean()) / 400) / x.std(0)
    assert [ridge[k] for k in "abc"] == pytest.approx(want)
    assert moments.stepwise(df, "y", ["a", "b", "c"])[:2] == ["a", "c"]


def test_instruments_and_constraints(spark):
    rng = np.random.default_rng(7)
    n = 3_000
    z, w, u = rng.standard_normal((n, 2)), rng.standard_normal(n), rng.standard_normal(n)
    x = z @ [0.6, 0.4] + 0.3 * w + 0.8 * u + rng.standard_normal(n)
    y = 1 + 0.5 * x - w + u
    df = spark.createDataFrame([tuple(map(float, r)) for r in np.column_stack([y, x, w, z])], "y double, x double, w double, z1 double, z2 double")
    for method in ("2sls", "liml", "gmm"):
        fit = moments.k_class(df, "y", ("x",), ("w",), ("z1", "z2"), method)
        assert fit.beta == pytest.approx([0.5, -1, 1], abs=0.15) and fit.metrics["first_stage_f_x"] > 100 and 0 <= fit.metrics["overid_p"] <= 1
    assert moments.k_class(df, "y", ("x",), ("w",), ("z1", "z2"), "liml").metrics["kappa"] >= 1
    fit = moments.constrained(df, Spec("y", ("x", "w")), [({"x": 1.0, "w": 1.0}, -0.25)])
    assert fit.beta[0] + fit.beta[1] == pytest.approx(-0.25)


def test_exact_tests(spark):
    df = spark.createDataFrame([(1,)] * 7 + [(0,)] * 3, "v int")
    assert tests.binomial(df, "v", 0.5).first()["p_value"] == pytest.approx(0.34375)
    tea = spark.createDataFrame([(1, 1)] * 3 + [(1, 0)] + [(0, 1)] + [(0, 0)] * 3, "a int, b int")
    assert tests.fisher_exact(tea, "a", "b").first()["p_value"] == pytest.approx(34 / 70)
    rows = spark.createDataFrame([(i, r) for i, rs in enumerate(["aab", "bbb", "abc", "ccb"]) for r in rs], "i int, r string")
    got = tests.raters(rows, "i", "r").first()
    po = (1 / 3 + 1 + 0 + 1 / 3) / 4
    pe = (3 / 12) ** 2 + (6 / 12) ** 2 + (3 / 12) ** 2
    assert got["agreement"] == pytest.approx(po) and got["fleiss"] == pytest.approx((po - pe) / (1 - pe))
    disagree = 1 - po
    expected = (12 * 11 - (3 * 2 + 6 * 5 + 3 * 2)) / (12 * 11)
    assert got["krippendorff"] == pytest.approx(1 - disagree / expected)
