"""Loops over edges go by blocks of nodes whose edges don't move, with the results of plain loops."""

import random

import numpy as np
import pytest

from quarrystat.operators import blocks, graphs, network


def _pairs(seed, nodes, n):
    rng = random.Random(seed)
    return sorted({(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(n)})


def _near(pairs):
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    return near


def _cores(near):
    near, core, k = {a: set(b) for a, b in near.items()}, {}, 0
    while near:
        low = min(near, key=lambda a: len(near[a]))
        k = max(k, len(near[low]))
        core[low] = k
        for b in near.pop(low):
            near[b].discard(low)
    return core


@pytest.mark.parametrize("size", [40, 1_000_000])
def test_cores(spark, monkeypatch, size):
    monkeypatch.setattr(blocks, "EDGES", size)
    pairs = _pairs(1, 90, 500) + [(200 + i, 201 + i) for i in range(40)]
    got = {r["node"]: r["core"] for r in network.core_numbers(spark.createDataFrame(pairs, "src int, dst int")).collect()}
    assert got == _cores(_near(pairs))
    named = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in pairs], "src string, dst string")
    assert {r["node"]: r["core"] for r in network.core_numbers(named).collect()} == {f"n{a}": c for a, c in got.items()}


def test_rounds_do_not_shuffle_edges(spark, monkeypatch):
    """Along a path each core's bound moves in one round within a block; the plain loop takes a round a node."""
    calls, before = [], blocks.moved
    monkeypatch.setattr(blocks, "moved", lambda *a: calls.append(1) or before(*a))
    got = network.core_numbers(spark.createDataFrame([(i, i + 1) for i in range(60)], "src long, dst long")).collect()
    assert len(got) == 61 and {r["core"] for r in got} == {1} and len(calls) == 2
    graph = blocks.laid(spark.createDataFrame(_pairs(2, 50, 200), "src long, dst long"), both=True, size=60)
    assert graph.blocks > 1
    rows = blocks.begun(graph, {"x": "long"}, lambda nodes, lens: {"x": nodes})
    plan = rows.groupBy("block").cogroup(graph.lists.groupBy("block")).applyInArrow(lambda a, b: a, rows.schema)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_no_edges(spark):
    none = spark.createDataFrame([], "src long, dst long")
    assert network.core_numbers(none).isEmpty()


def test_a_round_sends_an_array_from_block_to_block(spark):
    """Before, each node's value was a row for every block that knows it: where numbers say nothing about who is near, nearly a row an edge."""
    graph = blocks.laid(spark.createDataFrame(_pairs(3, 300, 3000), "src long, dst long"), both=True, size=1500)
    assert graph.blocks > 2 and graph.lists.count() == graph.blocks
    state = blocks.begun(graph, {"x": "long"}, lambda nodes, lens: {"x": nodes})
    assert state.count() == graph.blocks
    near = _near(_pairs(3, 300, 3000))
    summed = blocks.moved(graph, state, {"x": "long"}, lambda block, known: {"x": block.reduced(np.add, known["x"][block.into], 0)}, "x")
    assert {r["node"]: r["x"] for r in blocks.home(summed).collect()} == {a: sum(b) for a, b in near.items()}
    assert graph.nodes == len(near)


def test_chains_that_fall_apart_within_a_block():
    """Only nodes next to a fallen one are looked at again, down to the end of the chain."""
    n = 50
    into = np.concatenate([[b for b in (i - 1, i + 1) if 0 <= b < n] for i in range(n)]).astype(np.int32)
    lens = np.array([1, *[2] * (n - 2), 1], np.int32)
    block = blocks.Block(np.arange(n), np.arange(n), into, lens)
    assert (network._cores(block, lens.astype(np.int64)) == 1).all()
