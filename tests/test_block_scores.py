"""Scores, labels and strong components by blocks of nodes, against plain loops; several blocks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrystat.operators import blocks, graphs


def _pairs(seed, nodes, n):
    rng = random.Random(seed)
    return [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(n)]


def _state(pairs, kind="long"):
    return lambda spark: spark.createDataFrame(pairs, f"src {kind}, dst {kind}").repartition(3)


@pytest.fixture
def edges_stay(monkeypatch):
    """Small blocks, and how often a round met them."""
    monkeypatch.setattr(blocks, "EDGES", 60)
    calls, before = [], blocks.moved
    monkeypatch.setattr(blocks, "moved", lambda *a: calls.append(a[0].blocks) or before(*a))
    return calls


def test_label_communities(spark, edges_stay):
    pairs = _pairs(5, 60, 150)
    df = _state(pairs)(spark)
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    turn = {r["n"]: r["t"] for r in spark.range(60).select(F.col("id").alias("n"), F.pmod(F.xxhash64("id"), F.lit(2)).alias("t")).collect()}
    label = {a: a for a in near}
    for i in range(100):
        best = {}
        for a in near:
            votes = [label[b] for b in near[a]] + [label[a]]
            best[a] = min(votes, key=lambda x: (-votes.count(x), x))
        wants = any(best[a] != label[a] for a in near)
        label = {a: best[a] if turn[a] == i % 2 else label[a] for a in near}
        if not wants:
            break
    assert {r["node"]: r["community"] for r in graphs.label_communities(df).collect()} == label
    assert edges_stay and min(edges_stay) > 1


def test_eigenvector(spark, edges_stay):
    pairs = _pairs(6, 40, 200)
    m = np.zeros((40, 40))
    for a, b in pairs:
        if a != b:
            m[a, b] = m[b, a] = 1
    w, v = np.linalg.eigh(m)
    got = {r["node"]: r["score"] for r in graphs.eigenvector(_state(pairs, "int")(spark)).collect()}
    assert [got[i] for i in range(40)] == pytest.approx(np.abs(v[:, -1]), abs=1e-5)
    assert edges_stay and min(edges_stay) > 1


def test_katz(spark, edges_stay):
    pairs = _pairs(7, 40, 200)  # with loops and edges that stand there twice
    m = np.zeros((40, 40))
    for a, b in pairs:
        m[b, a] += 1
    want = np.linalg.solve(np.eye(40) - 0.02 * m, np.ones(40))
    got = {r["node"]: r["katz"] for r in graphs.katz(_state(pairs)(spark), alpha=0.02).collect()}
    assert [got[i] for i in range(40)] == pytest.approx(want, abs=1e-8)
    assert edges_stay and min(edges_stay) > 1


def test_strong_components(spark, edges_stay):
    pairs = _pairs(8, 50, 90) + [(60 + i, 60 + (i + 1) % 30) for i in range(30)] + [(99, 99)]
    nodes = sorted({x for p in pairs for x in p})
    far = {a: {a} for a in nodes}
    for _ in nodes:
        for a, b in pairs:
            far[a] |= far[b]
    want = {a: {b for b in far[a] if a in far[b]} for a in nodes}
    got = {r["node"]: r["component"] for r in graphs.strong_components(_state(pairs)(spark)).collect()}
    assert set(got) == set(nodes)
    for a in nodes:
        assert {b for b in nodes if got[b] == got[a]} == want[a] and got[a] in want[a]
    assert edges_stay and max(edges_stay) > 1


@pytest.mark.parametrize("kind", ["long", "string"])
def test_mixing_counts_edges_where_they_lie(spark, monkeypatch, kind):
    """Before, all edges were shuffled for the kind of each end; null kinds are a group whose nodes are not the same."""
    monkeypatch.setattr(blocks, "EDGES", 200)
    met, before = [], blocks.met
    monkeypatch.setattr(blocks, "met", lambda *a: met.append(a[0].blocks) or before(*a))
    pairs = _pairs(9, 60, 400)
    of = {i: f"k{i % 4}" if i % 7 else None for i in range(55)}  # some nodes have no kind
    ends = [(a, b) for x, y in {(min(p), max(p)) for p in pairs if p[0] != p[1]} for a, b in ((x, y), (y, x)) if a in of and b in of]
    counts = {k: sum(of[a] == k for a, _ in ends) for k in set(of.values())}
    share = sum((n / len(ends)) ** 2 for n in counts.values())
    same = sum(of[a] is not None and of[a] == of[b] for a, b in ends) / len(ends)
    kinds = spark.createDataFrame(list(of.items()), "node long, kind string").withColumn("node", F.col("node").cast(kind))
    got = graphs.attribute_mixing(_state(pairs)(spark).select(F.col("src").cast(kind).alias("src"), F.col("dst").cast(kind).alias("dst")), kinds)
    assert got.first()[0] == pytest.approx((same - share) / (1 - share))
    assert met and min(met) > 1
    with pytest.raises(ValueError, match="several kinds"):
        graphs.attribute_mixing(_state(pairs)(spark).select(F.col("src").cast(kind).alias("src"), F.col("dst").cast(kind).alias("dst")), kinds.union(kinds))
