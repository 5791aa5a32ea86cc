"""Further graph analytics: spectral scores, strong components, weighted paths, mixing, communities, signed and layered edges.

Every iteration joins a small table of node states with the edges and is written out; states that don't settle in the
stated number of rounds are an error, never a silent cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystat.operators import blocks
from quarrystat.operators.network import both_ways, components, degree, forest, undirected
from quarrystat.sources.tables import release, written
from quarrystat.sources.tables import written as _kept


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()


def _sent(edges: DataFrame, state: DataFrame, value: str, name: str, *, back: bool = False) -> DataFrame:
    """The sum of a value over the edges into (with ``back`` out of) each node: _to and the sum."""
    here, there = ("dst", "src") if back else ("src", "dst")
    return edges.join(state, edges[here] == state["node"]).groupBy(F.col(there).alias("_to")).agg(F.sum(value).alias(name))


def _filled(nodes: DataFrame, sums: DataFrame, value: Column, name: str) -> DataFrame:
    return nodes.join(sums, F.col("node") == F.col("_to"), "left").select("node", value.alias(name))


def hits(edges: DataFrame, *, tolerance: float = 1e-10, rounds: int = 200) -> DataFrame:
    """node, hub, authority; both of sum one."""
    links, nodes = _kept(edges.select("src", "dst")), _kept(nodes_of(edges))
    n = nodes.count()
    state = nodes.withColumns({"hub": F.lit(1.0 / n), "authority": F.lit(0.0)})
    for _ in range(rounds):
        a = _filled(nodes, _sent(links, state, "hub", "s"), F.coalesce("s", F.lit(0.0)), "authority")
        h = _filled(nodes, _sent(links, a, "authority", "s", back=True), F.coalesce("s", F.lit(0.0)), "hub")
        both = a.join(h, "node")
        sa, sh = both.agg(F.sum("authority"), F.sum("hub")).first()
        moved = both.select("node", (F.col("hub") / sh).alias("hub"), (F.col("authority") / sa).alias("authority"))
        gap = moved.join(state.select("node", F.col("hub").alias("_h")), "node").agg(F.sum(F.abs(F.col("hub") - F.col("_h")))).first()[0]
        state = _kept(moved)
        if gap < tolerance * n:
            return state
    raise ValueError(f"hits did not settle in {rounds} rounds")


def katz(edges: DataFrame, *, alpha: float, beta: float = 1.0, rounds: int = 100, tolerance: float = 1e-10) -> DataFrame:
    """node and katz: ``beta`` and ``alpha`` times the scores of the nodes that point here. alpha must be below the
    inverse of the largest eigenvalue."""
    graph, schema = blocks.laid(edges), {"katz": "double", "gap": "double"}
    state = blocks.begun(graph, schema, lambda nodes, lens: {"katz": np.full(len(nodes), float(beta)), "gap": np.zeros(len(nodes))})

    def step(block: blocks.Block, known: blocks.Values) -> blocks.Values:
        score = beta + alpha * block.reduced(np.add, known["katz"][block.into], 0.0)
        return {"katz": score, "gap": np.abs(score - known["katz"][block.places])}

    for _ in range(rounds):
        last, state = state, blocks.moved(graph, state, schema, step, "katz")
        release(last)
        gap = blocks.home(state).agg(F.max("gap")).first()[0]
        if gap is None or gap < tolerance:
            return graph.named(blocks.home(state).select("node", "katz"), "node")
    raise ValueError(f"katz did not settle in {rounds} rounds; alpha may be too large")


def eigenvector(edges: DataFrame, *, rounds: int = 200, tolerance: float = 1e-7) -> DataFrame:
    """node and score of the undirected graph, of length one; each round adds the node's own score, so bipartite graphs settle too."""
    graph, schema = blocks.laid(edges, both=True), {"score": "double", "old": "double"}
    n = graph.nodes
    state = blocks.begun(graph, schema, lambda nodes, lens: {"score": np.full(len(nodes), n**-0.5), "old": np.zeros(len(nodes))})
    size = 1.0
    for _ in range(rounds):

        def step(block: blocks.Block, known: blocks.Values, size: float = size) -> blocks.Values:
            score = known["score"] / size
            return {"score": score[block.places] + block.reduced(np.add, score[block.into], 0.0), "old": score[block.places]}

        last, state = state, blocks.moved(graph, state, schema, step, "score")
        release(last)
        own = blocks.home(state)
        size = own.agg(F.sqrt(F.sum(F.col("score") ** 2))).first()[0]
        gap = own.agg(F.sum(F.abs(F.col("score") / size - F.col("old")))).first()[0]
        if gap < tolerance * n**0.5:
            return graph.named(own.select("node", (F.col("score") / size).alias("score")), "node")
    raise ValueError(f"the eigenvector did not settle in {rounds} rounds")


def closeness(edges: DataFrame, sources: DataFrame, *, rounds: int = 1_000) -> DataFrame:
    """For stated sources (node): reached, closeness (Wasserman-Faust) and harmonic, over hops of directed edges. All
    sources go out together, so the state holds a row for each source and node reached."""
    links = _kept(edges.select("src", "dst").distinct())
    n = nodes_of(edges).count()
    seen = _kept(sources.select(F.col("node").alias("source"), "node").distinct().withColumn("hops", F.lit(0)))
    front = seen
    for hop in range(1, rounds + 1):
        found = links.join(front, links["src"] == front["node"]).select("source", F.col("dst").alias("node")).distinct()
        front = _kept(found.join(seen.select("source", "node"), ["source", "node"], "left_anti").withColumn("hops", F.lit(hop)))
        if front.isEmpty():
            break
        seen = _kept(seen.union(front))
    else:
        raise ValueError(f"nodes are left after {rounds} hops")
    sums = seen.groupBy(F.col("source").alias("node")).agg((F.count(F.lit(1)) - 1).alias("reached"), F.sum("hops").alias("far"), F.sum(F.when(F.col("hops") > 0, 1.0 / F.col("hops")).otherwise(0.0)).alias("harmonic"))
    near = F.when(F.col("far") > 0, F.col("reached") / F.col("far") * F.col("reached") / F.lit(n - 1.0)).otherwise(0.0)
    return sums.select("node", "reached", near.alias("closeness"), "harmonic")


def weighted_distances(edges: DataFrame, sources: DataFrame, weight: str, *, rounds: int = 1_000) -> DataFrame:
    """node and distance from the nearest source, over directed edges of weight zero or more; only nodes whose distance
    fell in a round send it on."""
    if not edges.where(F.col(weight) < 0).isEmpty():
        raise ValueError("a weight is negative")
    links = _kept(edges.groupBy("src", "dst").agg(F.min(F.col(weight).cast("double")).alias("w")))
    known = _kept(sources.select("node").distinct().withColumn("distance", F.lit(0.0)))
    front = known
    for _ in range(rounds):
        sent = links.join(front, links["src"] == front["node"]).groupBy(F.col("dst").alias("_to")).agg(F.min(F.col("distance") + F.col("w")).alias("_d"))
        better = sent.join(known, F.col("_to") == F.col("node"), "left").where(F.col("distance").isNull() | (F.col("_d") < F.col("distance")))
        front = _kept(better.select(F.col("_to").alias("node"), F.col("_d").alias("distance")))
        if front.isEmpty():
            return known
        known = _kept(known.join(front.select(F.col("node").alias("_n")), F.col("node") == F.col("_n"), "left_anti").union(front))
    raise ValueError(f"distances did not settle in {rounds} rounds")


def _coloured(graph: blocks.Laid) -> DataFrame:
    """The values of blocks with node and colour: the smallest node from which it is reached, in rounds within which blocks settle
    among themselves."""
    schema = {"colour": "long", "fell": "boolean"}
    state = blocks.begun(graph, schema, lambda nodes, lens: {"colour": nodes, "fell": np.ones(len(nodes), bool)})

    def step(block: blocks.Block, known: blocks.Values) -> blocks.Values:
        before = known["colour"][block.places]
        fallen = lambda c: np.minimum(c[block.places], block.reduced(np.minimum, c[block.into], np.iinfo(np.int64).max))
        colour = blocks.settled(block, known["colour"], fallen)
        return {"colour": colour, "fell": colour < before}

    while True:
        last, state = state, blocks.moved(graph, state, schema, step, "colour")
        release(last)
        if state.where(F.exists("fell", lambda x: x)).isEmpty():
            return state.select("block", "node", "colour")


def _reached(graph: blocks.Laid, colours: DataFrame) -> DataFrame:
    """node, colour (``colours``: values of the same blocks), and whether (``found``) it is reached from its colour's first node over
    nodes of its colour."""
    schema = {"colour": "long", "found": "boolean", "fell": "boolean"}
    state = colours.withColumns({"found": F.zip_with("node", "colour", lambda n, c: n == c), "fell": F.transform("node", lambda n: F.lit(True))})

    def step(block: blocks.Block, known: blocks.Values) -> blocks.Values:
        colour, before, owner = known["colour"], known["found"][block.places], block.owner
        same = colour[block.into] == colour[block.places][owner]
        reached = lambda left: left[block.places] & ~block.reduced(np.logical_or, same & ~left[block.into], False)
        found = ~blocks.settled(block, ~known["found"], reached)
        return {"colour": colour[block.places], "found": found, "fell": found & ~before}

    while True:
        last, state = state, blocks.moved(graph, state, schema, step, "colour", "found")
        release(last)
        if state.where(F.exists("fell", lambda x: x)).isEmpty():
            return blocks.home(state).select("node", "colour", "found")


def strong_components(edges: DataFrame, *, rounds: int = 1_000) -> DataFrame:
    """node and component (a node of it): colours flow forward until each node has the smallest that reaches it; then
    what reaches a colour's first node within the colour is a component, leaves, and the rest goes on."""
    plain, kind, names = blocks.numbered(edges)
    left = written(plain.select("src", F.when(F.col("src") != F.col("dst"), F.col("dst")).alias("dst")))  # a node without edges has a null there
    done = None
    for _ in range(rounds):
        forward = blocks.laid(left, once=True)
        colours = _coloured(forward)
        back = blocks.laid(left.select(F.col("dst").alias("src"), F.col("src").alias("dst")), once=True, plan=forward.plan)
        reached = _reached(back, colours)
        part = reached.where("found").select("node", F.col("colour").alias("component"))
        done = part if done is None else written(done.union(part))
        rest = written(reached.where("NOT found").select("node"))
        release(forward.lists, back.lists)
        if rest.isEmpty():
            return blocks.named(done, kind, names, "node", "component")
        a, b = rest.select(F.col("node").alias("_a")), rest.select(F.col("node").alias("_b"))
        inner = left.join(a, F.col("src") == F.col("_a"), "left_semi").join(b, F.col("dst") == F.col("_b"), "left_semi")
        last, left = left, written(inner.union(rest.select("node", F.lit(None).cast("long"))))
        release(last)
    raise ValueError(f"components are left after {rounds} rounds")


def assortativity(edges: DataFrame) -> DataFrame:
    """The correlation of degrees over the ends of undirected edges."""
    pairs = both_ways(undirected(edges))
    k = degree(undirected(edges)).select("node", "degree")
    a, b = k.select(F.col("node").alias("src"), F.col("degree").alias("ka")), k.select(F.col("node").alias("dst"), F.col("degree").alias("kb"))
    return pairs.join(a, "src").join(b, "dst").agg(F.corr(F.col("ka").cast("double"), F.col("kb").cast("double")).alias("assortativity"))


def attribute_mixing(edges: DataFrame, kinds: DataFrame) -> DataFrame:
    """Newman's coefficient of mixing by a node's kind (node, kind) over undirected edges; edges of nodes without a kind don't count.
    Kinds go to blocks of nodes as numbers, and edges are counted where they lie."""
    graph = blocks.laid(edges, both=True)
    codes = written(kinds.select("kind").distinct().select("kind", (F.monotonically_increasing_id() * 2 + F.col("kind").isNull().cast("long")).alias("code")))
    known = blocks.home(blocks.begun(graph, {}, lambda nodes, lens: {})).select("node", F.col("node").alias("_node"))
    held = kinds.select(F.col("node").alias("_n"), "kind").join(codes.withColumnRenamed("kind", "_k"), F.col("kind").eqNullSafe(F.col("_k")))
    found = written(graph.named(known, "node").join(held, F.col("node") == F.col("_n"), "left").select("_node", "code"))
    if not found.groupBy("_node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        raise ValueError("a node has several kinds")
    rows = graph.lists.select("block", "node").mapInArrow(_places, "block int, place long, node long")
    state = rows.join(found, F.col("node") == F.col("_node")).groupBy("block").agg(F.array_sort(F.collect_list(F.struct("place", F.coalesce("code", F.lit(-1)).alias("code")))).alias("x")).select("block", F.col("x.code").alias("code"))

    def counted(number: int, block: blocks.Block, known: blocks.Values) -> pa.Table:
        x, y = known["code"][block.places][block.owner], known["code"][block.into]
        there = (x >= 0) & (y >= 0)
        names, at = np.unique(known["code"], return_inverse=True)
        at = at.astype(np.int64)
        cells = np.sort((at[block.places][block.owner] * len(names) + at[block.into])[there])
        starts = np.flatnonzero(np.append(True, np.diff(cells) != 0)[: len(cells)])
        pair = cells[starts]
        return pa.table({"x": pa.array(names[pair // len(names)]), "y": pa.array(names[pair % len(names)]), "n": pa.array(np.diff(np.append(starts, len(cells))))})

    parts = blocks.met(graph, state, {"code": "long"}, counted, "x long, y long, n long", ("code",))
    cells = written(parts.groupBy("x", "y").agg(F.sum("n").alias("n")))
    release(graph.lists, found)
    # an odd code is that of the null, which is not the same as another
    total, same = cells.agg(F.sum("n"), F.coalesce(F.sum(F.when((F.col("x") == F.col("y")) & (F.col("x") % 2 == 0), F.col("n"))), F.lit(0))).first()
    ends = cells.groupBy("x").agg(F.sum("n").alias("n")).agg(F.sum((F.col("n") / total) ** 2)).first()[0]
    return cells.limit(1).select(F.lit((same / total - ends) / (1 - ends)).alias("mixing"))


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of blocks with their places in them."""
    for b in batches:
        for block, node in zip(b["block"].to_pylist(), b["node"].to_pylist(), strict=True):
            nodes = np.frombuffer(node, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(nodes), block, np.int32)), pa.array(np.arange(len(nodes))), pa.array(nodes)], ["block", "place", "node"])


def dyads(edges: DataFrame) -> DataFrame:
    """Pairs of nodes that point at each other, one way, and not at all."""
    pairs = edges.where("src <> dst").select("src", "dst").distinct()
    both = pairs.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    n = nodes_of(edges).count()
    counts = both.agg(F.count(F.when(F.col("n") == 2, 1)).alias("mutual"), F.count(F.when(F.col("n") == 1, 1)).alias("one_way"))
    return counts.withColumn("none", F.lit(n * (n - 1) // 2) - F.col("mutual") - F.col("one_way"))


def two_colours(edges: DataFrame) -> tuple[bool, DataFrame]:
    """Whether the graph is bipartite, and node, side (0: as the smallest node of its component). A node is looked at
    twice, once for each side; it is bipartite if no component holds both."""
    # a forest of each task's edges has the same components; ``odd`` is 1 where its ends are on different sides
    pairs = written(forest(edges.where("src <> dst"), sides=True))
    far = pairs.agg(F.max(F.greatest(F.abs(F.col("src") / 2), F.abs(F.col("dst") / 2)))).first()[0] if {dict(pairs.dtypes)[c] for c in ("src", "dst")} <= set(blocks.WHOLE) else 0
    plain, kind, names = blocks.numbered(pairs, dense=(far or 0) >= 2**61)  # so that twice a number is a long
    flipped = F.col("dst") * 2 + F.col("odd")
    twice = plain.select((F.col("src") * 2).alias("src"), flipped.alias("dst")).union(plain.select((F.col("src") * 2 + 1).alias("src"), (flipped + 1 - 2 * F.col("odd")).alias("dst")))
    sides = written(components(twice)).select(F.shiftright("node", 1).alias("number"), F.pmod("node", F.lit(2)).alias("sign"), "component")
    ends = sides.groupBy("number").agg(F.count_distinct("component").alias("parts"), F.min(F.struct("component", "sign")).alias("m"))
    both = written(ends.select(F.col("number").alias("node"), (F.col("m.sign") == 1).cast("int").alias("side"), (F.col("parts") == 1).alias("odd")))
    return both.where("odd").isEmpty(), blocks.named(both.select("node", "side"), kind, names, "node")


def _voted(block: blocks.Block, label: np.ndarray) -> np.ndarray:
    """For each node of a block the label that most of its neighbours and itself have, the smallest of several."""
    names, code = np.unique(label, return_inverse=True)
    m = len(names)
    keys = np.sort(np.concatenate([block.owner.astype(np.int64) * m + code[block.into], np.arange(len(block.nodes)) * m + code[block.places]]))
    starts = np.flatnonzero(np.append(True, np.diff(keys) != 0))
    votes, owner = np.diff(np.append(starts, len(keys))), keys[starts] // m
    most = np.maximum.reduceat(votes, np.flatnonzero(np.append(True, np.diff(owner) != 0)))
    best = np.flatnonzero(votes == most[owner])
    first = best[np.append(True, np.diff(owner[best]) != 0)]
    return names[keys[starts[first]] % m]


def label_communities(edges: DataFrame, *, rounds: int = 100) -> DataFrame:
    """node and community by label propagation: a node takes the label that most of its neighbours and itself have (the
    smallest of several), until none would change. Half of the nodes, by a hash, move in turn, so two don't swap for ever."""
    graph, schema = blocks.laid(edges, both=True), {"community": "long", "wants": "boolean", "half": "long"}
    state = blocks.begun(graph, schema, lambda nodes, lens: {"community": nodes, "wants": np.ones(len(nodes), bool), "half": np.zeros(len(nodes), np.int64)})
    whole = (lambda n: n.cast(graph.kind)) if graph.names is None else (lambda n: n)
    state = state.withColumn("half", F.transform("node", lambda n: F.pmod(F.xxhash64(whole(n)), F.lit(2))))
    for i in range(rounds):

        def step(block: blocks.Block, known: blocks.Values, turn: int = i % 2) -> blocks.Values:
            old, new = known["community"][block.places], _voted(block, known["community"])
            return {"community": np.where(known["half"] == turn, new, old), "wants": new != old, "half": known["half"]}

        last, state = state, blocks.moved(graph, state, schema, step, "community")
        release(last)
        if state.where(F.exists("wants", lambda x: x)).isEmpty():
            return graph.named(blocks.home(state).select("node", "community"), "node", "community")
    raise ValueError(f"communities did not settle in {rounds} rounds")


def signed_strength(edges: DataFrame, weight: str) -> DataFrame:
    """node, and the sums of its positive and negative weights over both ends."""
    ends = edges.select(F.col("src").alias("node"), F.col(weight).cast("double").alias("w")).union(edges.select(F.col("dst").alias("node"), F.col(weight).cast("double").alias("w")))
    return ends.groupBy("node").agg(F.sum(F.greatest("w", F.lit(0.0))).alias("positive"), F.sum(F.least("w", F.lit(0.0))).alias("negative"))


def edge_persistence(snapshots: DataFrame, time: str) -> DataFrame:
    """For each time but the last: edges, and the share that the next time still has. Times are whole numbers."""
    now = snapshots.select(time, "src", "dst").distinct()
    later = now.select((F.col(time) - 1).alias(time), "src", "dst", F.lit(1).alias("stays"))
    out = now.join(later, [time, "src", "dst"], "left").groupBy(time).agg(F.count(F.lit(1)).alias("edges"), F.avg(F.coalesce("stays", F.lit(0)).cast("double")).alias("persistence"))
    last = now.agg(F.max(time)).first()[0]
    return out.where(F.col(time) < F.lit(last))


def layers(edges: DataFrame, layer: str) -> DataFrame:
    """layer, nodes, edges of a multilayer graph."""
    return edges.groupBy(layer).agg(F.count(F.lit(1)).alias("edges")).join(edges.select(layer, F.explode(F.array("src", "dst")).alias("node")).distinct().groupBy(layer).agg(F.count(F.lit(1)).alias("nodes")), layer)


def clique_projection(members: DataFrame, edge: str, node: str, *, normalised: bool = False) -> DataFrame:
    """Pairs of nodes in the same hyperedges, and in how many; normalised: each hyperedge of k nodes counts 1 / (k - 1)."""
    rows = members.select(F.col(edge).alias("e"), F.col(node).alias("v")).distinct()
    sized = rows.join(rows.groupBy(F.col("e").alias("_e")).agg(F.count(F.lit(1)).alias("k")), F.col("e") == F.col("_e")).select("e", "v", "k")
    pairs = sized.select("e", F.col("v").alias("a"), "k").join(sized.select("e", F.col("v").alias("b")), "e").where("a < b")
    return pairs.groupBy("a", "b").agg((F.sum(1.0 / (F.col("k") - 1)) if normalised else F.count(F.lit(1)).cast("double")).alias("weight"))


def star_projection(members: DataFrame, edge: str, node: str) -> DataFrame:
    """Hyperedges as nodes: the bipartite edges from members to them, as text."""
    return members.select(F.concat(F.lit("n:"), F.col(node).cast("string")).alias("src"), F.concat(F.lit("e:"), F.col(edge).cast("string")).alias("dst")).distinct()
