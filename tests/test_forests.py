"""Components and sides come from a forest of each task's edges."""

import random

import pytest
from pyspark.sql import functions as F

from quarrystat.operators import graphs, network
from quarrystat.plans import models


def _parts(pairs):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    part, side, odd = {}, {}, set()
    for root in sorted(near):
        if root in part:
            continue
        part[root], side[root], todo = root, 0, [root]
        for x in todo:
            for y in near[x]:
                if y not in part:
                    part[y], side[y] = root, 1 - side[x]
                    todo.append(y)
                elif side[y] == side[x]:
                    odd.add(root)
    return part, side, odd


@pytest.mark.parametrize("tree", [7, 1_000_000])
def test_components_and_sides(spark, monkeypatch, tree):
    monkeypatch.setattr(network, "TREE", tree)
    rng = random.Random(4)
    pairs = [(rng.randrange(100), 100 + rng.randrange(100)) for _ in range(80)] + [(300 + i, 300 + (i + 1) % 9) for i in range(9)]
    part, side, odd = _parts(pairs)
    df = spark.createDataFrame(pairs, "src long, dst long").repartition(3)
    assert {r["node"]: r["component"] for r in network.components(df).collect()} == part
    even, sides = graphs.two_colours(df)
    got = {int(r["node"]): r["side"] for r in sides.collect()}
    assert not even and odd == {300} and set(got) == set(part)
    for a, b in pairs:
        assert (got[a] != got[b]) == (part[a] not in odd)
    assert graphs.two_colours(df.where("src < 300"))[0]


def test_dense_graphs_become_forests(spark):
    pairs = spark.range(200).select(F.col("id").alias("src")).crossJoin(spark.range(200).select((F.col("id") + 200).alias("dst"))).coalesce(1)
    assert network.forest(pairs).count() <= 399 * 8 and network.forest(pairs, sides=True).count() <= 399 * 8


def test_tasks_of_the_graph_grow_with_the_lines(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(models, "LINES_A_TASK", 100)
    spark.range(1_000).select((F.col("id") % 90).alias("l_partkey"), (F.col("id") % 7).alias("l_suppkey")).write.parquet(f"{tmp_path}/lineitem.parquet")
    graph = models._graph(spark, str(tmp_path))
    assert graph.rdd.getNumPartitions() == 10 and graph.count() == 630


@pytest.mark.parametrize("shift, kind", [(0, "long"), (0, "string"), (2**62, "long"), (-(2**62) - 500, "long")])
def test_sides_of_tasks_with_several_batches(spark, monkeypatch, shift, kind):
    """Before, a task with more rows than TREE failed: the forest's batches and those of Spark disagreed on null values."""
    monkeypatch.setattr(network, "TREE", 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)
    try:
        at = F.col("id") % 12 + shift
        path = spark.range(400).select(at.cast(kind).alias("src"), (at + 1).cast(kind).alias("dst")).coalesce(1)
        even, sides = graphs.two_colours(path)
        got = {int(r["node"]): r["side"] for r in sides.collect()}
        assert even and len(got) == 13 and sides.schema["node"].dataType == path.schema["src"].dataType
        assert all(got[i + shift] != got[i + shift + 1] for i in range(12))
        if kind == "long":
            assert got[shift] == 0
            loop = path.union(spark.createDataFrame([(shift + 2, shift)], path.schema))
            assert not graphs.two_colours(loop)[0]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
