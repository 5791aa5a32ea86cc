"""Triangles are closed in blocks of nodes, without a row for each wedge."""

import pytest
from pyspark.sql import functions as F

from quarrystat.operators import network


@pytest.mark.parametrize("block, wedges, text", [(1_000_000, 4_000_000, False), (40, 50, False), (40, 50, True)])
def test_triangles_equal_the_join_of_wedges(spark, monkeypatch, block, wedges, text):
    monkeypatch.setattr(network, "BLOCK", block, raising=False)
    monkeypatch.setattr(network, "WEDGES", wedges, raising=False)
    far = F.when(F.col("id") % 5 == 0, F.lit(10**9)).otherwise(F.lit(0))
    edges = spark.range(900).select((far + F.col("id") * 7919 % 53).alias("src"), (F.col("id") * 104729 % 47).alias("dst"))
    edges = edges.union(spark.range(60).select(F.lit(3).cast("long"), F.col("id")))
    if text:
        edges = edges.select(F.concat(F.lit("n"), "src").alias("src"), F.concat(F.lit("n"), "dst").alias("dst"))
    near: dict = {}
    for s, d in edges.collect():
        if s != d:
            near.setdefault(s, set()).add(d)
            near.setdefault(d, set()).add(s)
    want = {v: sum(len(near[v] & near[w]) for w in near[v]) // 2 for v in near}
    got = {r["node"]: (r["triangles"], r["clustering"]) for r in network.triangles(edges).collect()}
    assert sum(want.values()) > 0 and {v: t for v, (t, _) in got.items()} == want
    for v, (t, c) in got.items():
        k = len(near[v])
        assert c == pytest.approx(2 * t / (k * (k - 1)) if k > 1 else 0.0)


def test_no_wedge_is_a_row(spark):
    """Before, every wedge was shuffled to meet the edge that closes it."""
    edges = spark.range(200 * 200).select((F.col("id") / 200).cast("long").alias("src"), (F.col("id") % 200).alias("dst"))
    found = network.triangles(edges)
    assert found.agg(F.min("triangles"), F.max("clustering"), F.count(F.lit(1))).first()[:] == (199 * 198 // 2, 1.0, 200)


def test_an_empty_graph(spark):
    assert network.triangles(spark.range(3).select(F.col("id").alias("src"), F.col("id").alias("dst"))).isEmpty()


def test_edges_are_kept_once_in_cells(spark, monkeypatch):
    """Before, a node's whole list was copied to every block that it points into: nearly all blocks, where numbers say nothing about who is near."""
    kept, before = [], network._kept

    def noted(df, **how):
        made = before(df, **how)
        kept.append(made.agg(F.sum(F.length("a") / 4)).first()[0] if "a" in df.columns else None)
        return made

    monkeypatch.setattr(network, "BLOCK", 200)
    monkeypatch.setattr(network, "_kept", noted)
    edges = spark.range(1500).select((F.col("id") * 7919 % 101).alias("src"), (F.col("id") * F.col("id") % 97).alias("dst"))
    found = network.triangles(edges)
    once = network.undirected(edges).count()
    assert [n for n in kept if n is not None] == [once] and once > 400
    assert len(kept) == 1 + -(-((once / 200) ** 0.5) // 1)  # a table of the cells, and of the counts of each group
    assert found.count() == edges.where("src <> dst").select("src").union(edges.where("src <> dst").select("dst")).distinct().count()
