"""Graphs as edge tables: degrees, components, PageRank, triangles, cores, projections, link scores, modularity, paths.

Iterations keep a small state table, written out each round, and join it with the edges. Counts are summed before they
are shuffled, so a hub is a row in the shuffle and not a group in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystat.operators import blocks
from quarrystat.sources.tables import release
from quarrystat.sources.tables import written as _kept


def undirected(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Each pair of different nodes once, src < dst."""
    return edges.where(F.col(src) != F.col(dst)).select(F.least(src, dst).alias("src"), F.greatest(src, dst).alias("dst")).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def degree(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """node, out_degree, in_degree, degree (sums of weights, if any)."""
    w = F.col(weight).cast("double") if weight else F.lit(1).cast("long")
    ends = edges.select(F.col("src").alias("node"), w.alias("o"), (w * 0).alias("i")).union(edges.select(F.col("dst").alias("node"), (w * 0).alias("o"), w.alias("i")))
    return ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.sum(F.col("o") + F.col("i")).alias("degree"))


#: Edges that a task joins to a forest at a time.
TREE = 2_000_000


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node of the component of each of n nodes."""
    root = np.arange(n)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        a, b = low[low < high], high[low < high]
        np.minimum.at(root, b, a)
        while (root[root] != root).any():
            root = root[root]
    return root


def _forest(table: pa.Table, sides: bool) -> pa.Table:
    """Each node with the smallest of its component; with ``sides`` also whether it lies on the other side than that (``odd``). A
    component whose sides contradict each other has an odd edge of its smallest node with itself."""
    kind = table.schema.field("src").type
    names, code = np.unique(np.concatenate([table[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("src", "dst")]), return_inverse=True)
    a, b = np.split(code, 2)
    if not sides:
        root = _roots(a, b, len(names))
        node = np.flatnonzero(root != np.arange(len(names)))
        return pa.table({"src": pa.array(names[node], kind), "dst": pa.array(names[root[node]], kind)})
    odd = table["odd"].to_numpy()
    root, mirrored = _roots(np.concatenate([2 * a, 2 * a + 1]), np.concatenate([2 * b + odd, 2 * b + 1 - odd]), 2 * len(names)).reshape(-1, 2).T
    against = mirrored == root
    node = np.flatnonzero((root // 2 != np.arange(len(names))) | against)
    ends, first = root[node] // 2, root // 2 == np.arange(len(names))
    loops = first[node] & against[node]
    return pa.table({"src": pa.array(names[node], kind), "dst": pa.array(names[ends], kind), "odd": pa.array(np.where(loops, 1, root[node] % 2).astype(np.int32))})


def forest(edges: DataFrame, *, sides: bool = False) -> DataFrame:
    """src, dst (and ``odd``, see ``_forest``): edges with the same components as the given ones, of which each task that holds
    a range of nodes keeps one a node."""
    rows = edges.select("src", "dst", *([F.lit(1).alias("odd")] if sides else [])).repartitionByRange("src")

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            # what Spark sends says that no value is null, what _forest makes does not
            held, n = [*held, pa.RecordBatch.from_arrays(b.columns, b.schema.names)], n + b.num_rows
            if n >= TREE:
                tree = _forest(pa.Table.from_batches(held), sides)
                if len(tree) > TREE // 2:
                    yield from tree.to_batches()
                    held, n = [], 0
                else:
                    held, n = tree.to_batches(), len(tree)
        if n:
            yield from _forest(pa.Table.from_batches(held), sides).to_batches()

    return rows.mapInArrow(grown, rows.schema)


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node). Labels move over a forest of the edges and then jump to their label's label."""
    links = _kept(both_ways(undirected(forest(edges.where("src <> dst")))).distinct())
    labels = held = _kept(links.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("component")))
    while True:
        near = links.join(labels, links["dst"] == labels["node"]).groupBy("src").agg(F.min("component").alias("near"))
        moved = labels.join(near, labels["node"] == near["src"], "left").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        above = labels.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
        jumped = _kept(moved.join(above, F.col("component") == F.col("_n"), "left").select("node", "old", F.least("component", "_c").alias("component")))
        release(held)
        labels, held = jumped.select("node", "component"), jumped
        if jumped.where(F.col("component") != F.col("old")).isEmpty():
            return labels


def pagerank(edges: DataFrame, *, damping: float = 0.85, rounds: int | None = None, tolerance: float = 1e-8, most: int = 500) -> DataFrame:
    """node and rank (summing to 1); nodes without edges out spread their rank evenly. Rounds go on until the ranks change by
    less than ``tolerance`` together; what has not settled after ``most`` rounds is an error. ``rounds``: exactly so many."""
    links = _kept(edges.select("src", "dst").join(edges.groupBy("src").agg(F.count(F.lit(1)).alias("out")), "src"))
    nodes = _kept(edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct())
    n = nodes.count()
    if not n:
        return nodes.withColumn("rank", F.lit(0.0))
    ranks = nodes.withColumn("rank", F.lit(1.0 / n))
    for i in range(rounds if rounds is not None else most):
        given = links.join(ranks, links["src"] == ranks["node"]).groupBy("dst").agg(F.sum(F.col("rank") / F.col("out")).alias("given"))
        got = _kept(nodes.join(given, nodes["node"] == given["dst"], "left").select("node", F.coalesce("given", F.lit(0.0)).alias("given")))
        base = (1 - damping) / n + damping * (1 - got.agg(F.sum("given")).first()[0]) / n
        moved = got.select("node", (F.lit(base) + damping * F.col("given")).alias("rank"))
        if rounds is None and i % 4 == 3:
            before = ranks.select("node", F.col("rank").alias("old"))
            if moved.join(before, "node").agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] < tolerance:
                return moved
        ranks = moved
    if rounds is None:
        raise ValueError(f"ranks have not settled in {most} rounds")
    return ranks


#: Edges of one cell, from nodes of one group to those of another, and wedges looked at together in it.
BLOCK, WEDGES = 2_000_000, 4_000_000


def _oriented(block: blocks.Block, known: blocks.Values, groups: int) -> pa.Table:
    """A row a cell (i, j) of the edges of a block from the end with fewer neighbours to the other (ties by number): no node has more
    than sqrt(2 m) edges out, so wedges stay few even around hubs. A node of number x is the x // groups-th of the group x % groups."""
    k, number, owner = known["k"], known["number"], block.owner
    near, own = k[block.into], k[block.places][owner]
    a, b = number[block.places][owner], number[block.into]
    first = (own < near) | ((own == near) & (a < b))
    a, b = a[first], b[first]
    cell = a % groups * groups + b % groups
    order = np.argsort(cell, kind="stable")
    found, starts = np.unique(cell[order], return_index=True)
    ends = [np.split((x // groups).astype(np.int32)[order], starts[1:]) if len(found) else [] for x in (a, b)]
    parts = [pa.array([blocks.planes(x) for x in end], pa.binary()) for end in ends]
    return pa.table({"i": pa.array(found // groups, pa.int32()), "j": pa.array(found % groups, pa.int32()), "a": parts[0], "b": parts[1]})


def _closed(table: pa.Table, groups: int, last: int, size: int) -> pa.Table:
    """The triangles a -> b -> c with a -> c of three groups of ``size`` nodes, c in the group ``last``: for each group how many each of
    its nodes is in. The edges have part 0 (a -> b), 1 (b -> c) and 2 (a -> c)."""
    part = table["part"].to_numpy()
    key = table["key"][0].as_py()

    def keys(which: int) -> np.ndarray:
        rows = table.filter(pa.array(part == which))
        a, b = (blocks.unplaned(rows[c].to_pylist(), np.int32).astype(np.int64) for c in ("a", "b"))
        return np.sort(a * size + b)

    (xa, xb), (yb, yc), closing = np.divmod(keys(0), size), np.divmod(keys(1), size), keys(2)
    found = np.zeros((3, size), np.int64)
    if len(xa) and len(yb) and len(closing):
        seen = np.zeros(1 << min(26, (8 * len(closing)).bit_length()), bool)  # by the last bits of a key: most wedges end here
        mask = len(seen) - 1
        seen[closing & mask] = True
        lens = np.bincount(yb, minlength=size)
        begins, wedges = (np.cumsum(lens) - lens)[xb], lens[xb]
        for some in np.split(np.arange(len(xa)), np.flatnonzero(np.diff(np.cumsum(wedges) // WEDGES)) + 1):
            n = wedges[some]
            ends = np.cumsum(n)
            c = yc[np.arange(ends[-1]) + np.repeat(begins[some] - (ends - n), n)]
            wedge = np.repeat(xa[some] * size, n) + c
            maybe = np.flatnonzero(seen[wedge & mask])
            wedge = wedge[maybe]
            hit = maybe[closing[np.minimum(np.searchsorted(closing, wedge), len(closing) - 1)] == wedge]
            edge = some[np.searchsorted(ends, hit, side="right")]
            for f, end in zip(found, (xa[edge], xb[edge], c[hit]), strict=True):
                f += np.bincount(end, minlength=size)
    return pa.table({"group": pa.array([key // groups, key % groups, last], pa.int32()), "n": pa.array([blocks.planes(f) for f in found], pa.binary())})


def _summed(table: pa.Table) -> pa.Table:
    total = sum(blocks.unplaned([part.as_py()], np.int64) for part in table["n"])
    return pa.table({"group": table["group"][:1], "n": pa.array([blocks.planes(total)], pa.binary())})


def triangles(edges: DataFrame) -> DataFrame:
    """node, triangles, clustering. Nodes fall into groups, and edges into cells from group to group, of some BLOCK edges; a task
    closes the wedges of three groups, and they never are rows. A round for each third group sends every cell once as the first
    edges of wedges, and those into the group to as many tasks as there are groups, so it moves all edges some three times."""
    graph = blocks.laid(edges, both=True)
    sizes = {r[0]: (r[1], r[2]) for r in graph.lists.select("block", (F.length("node") / 8).cast("long"), (F.length("into") / 4).cast("long")).collect()}
    groups = max(1, int(np.ceil((sum(m for _, m in sizes.values()) / 2 / BLOCK) ** 0.5)))
    size, begin, begins = -(-graph.nodes // groups) or 1, 0, []
    for number, (n, _) in sizes.items():
        begins += [F.lit(number), F.lit(begin).cast("long")]
        begin += n
    schema = {"k": "long", "number": "long"}
    start = F.element_at(F.create_map(*begins), F.col("block")) if begins else F.lit(0)
    state = blocks.begun(graph, {"k": "long"}, lambda nodes, lens: {"k": lens}).withColumn("number", F.transform("k", lambda _, i: start + i))
    lines = _kept(blocks.met(graph, state, schema, lambda number, block, known: _oriented(block, known, groups), "i int, j int, a binary, b binary", ("k", "number")), compression="zstd")
    release(graph.lists)
    closing = lambda last: lambda t: _closed(t, groups, last, size)
    found, every = [], F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    for last in range(groups):
        to = lines.where(F.col("j") == last).withColumn("e", every)
        one = lines.select((F.col("i") * groups + F.col("j")).alias("key"), F.lit(0).alias("part"), "a", "b")
        two = to.select((F.col("e") * groups + F.col("i")).alias("key"), F.lit(1).alias("part"), "a", "b")
        three = to.select((F.col("i") * groups + F.col("e")).alias("key"), F.lit(2).alias("part"), "a", "b")
        counts = one.union(two).union(three).repartition(4 * groups**2, "key").groupBy("key").applyInArrow(closing(last), "group int, n binary")
        found.append(_kept(counts.groupBy("group").applyInArrow(_summed, "group int, n binary")))
    release(lines)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for group, part in zip(b["group"].to_pylist(), b["n"].to_pylist(), strict=True):
                n = blocks.unplaned([part], np.int64)
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(at * groups + group), pa.array(n[at])], ["_number", "triangles"])

    all_ = found[0]
    for more in found[1:]:
        all_ = all_.union(more)
    sums = all_.groupBy("group").applyInArrow(_summed, "group int, n binary").mapInArrow(rows, "_number long, triangles long")
    out = blocks.home(state).join(sums, F.col("number") == F.col("_number"), "left").select("node", "k", F.coalesce("triangles", F.lit(0)).alias("triangles"))
    share = F.when(F.col("k") > 1, 2 * F.col("triangles") / (F.col("k") * (F.col("k") - 1))).otherwise(0.0)
    return graph.named(out.select("node", "triangles", share.alias("clustering")), "node")


def _h_index(own: np.ndarray, owner: np.ndarray, near: np.ndarray) -> np.ndarray:
    """For each node the largest h, up to its bound ``own``, so that h of its neighbours (``near``, by ``owner``) have a bound of
    at least h."""
    begins = np.cumsum(own + 1) - (own + 1)
    counts = np.bincount(np.minimum(near, own[owner]) + begins[owner], minlength=int((own + 1).sum()))
    upto = np.cumsum(counts)
    after = np.repeat(upto[begins + own], own + 1) - upto + counts  # neighbours with this bound or more
    level = np.arange(len(counts)) - np.repeat(begins, own + 1)
    return np.add.reduceat(((after >= level) & (level > 0)).astype(np.int64), begins)


def _edges(begins: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The places of runs of edges, end to end."""
    ends = np.cumsum(lens)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - (ends - lens), lens)


def _cores(block: blocks.Block, bounds: np.ndarray) -> np.ndarray:
    """The bounds of a block's nodes once they have settled among themselves; after the first time only nodes next to one whose
    bound fell are looked at."""
    bounds = bounds.astype(np.int32)
    own, n, begins = bounds[block.places], len(block.nodes), np.cumsum(block.lens) - block.lens
    rows = np.flatnonzero(block.lens)
    while len(rows):
        lens = block.lens[rows]
        near = bounds[block.into[_edges(begins[rows], lens)] if len(rows) < n else block.into]
        falls = np.add.reduceat((near >= np.repeat(own[rows], lens)).astype(np.int32), np.cumsum(lens) - lens) < own[rows]
        fallen, size = rows[falls], lens[falls]
        if not len(fallen):
            break
        own[fallen] = _h_index(own[fallen], np.repeat(np.arange(len(fallen)), size), near[np.repeat(falls, lens)])
        bounds[block.places[fallen]] = own[fallen]
        next_ = block.into[_edges(begins[fallen], size)] - block.places[0]
        touched = np.zeros(n, bool)
        touched[next_[(next_ >= 0) & (next_ < n)]] = True
        rows = np.flatnonzero(touched)
    return own


def core_numbers(edges: DataFrame) -> DataFrame:
    """node and core, by rounds in which a node's bound falls to the h-index of its neighbours' bounds; blocks of nodes settle
    among themselves within a round."""
    graph, schema = blocks.laid(edges, both=True), {"core": "long", "fell": "boolean"}
    bounds = blocks.begun(graph, schema, lambda nodes, lens: {"core": lens, "fell": np.ones(len(lens), bool)})

    def step(block: blocks.Block, known: blocks.Values) -> blocks.Values:
        before = known["core"][block.places]
        core = _cores(block, known["core"])
        return {"core": core, "fell": core < before}

    while True:
        last, bounds = bounds, blocks.moved(graph, bounds, schema, step, "core")
        release(last)
        if bounds.where(F.exists("fell", lambda x: x)).isEmpty():
            return graph.named(blocks.home(bounds).select("node", "core"), "node")


def projection(edges: DataFrame, node: str, via: str, most: int | None = None) -> DataFrame:
    """Pairs of nodes (a < b) of one side of a bipartite graph, and how many neighbours they share. ``most`` refuses
    graphs with more two-paths than stated, before any are made."""
    pairs = edges.select(F.col(node).alias("n"), F.col(via).alias("v")).distinct()
    if most is not None:
        paths = pairs.groupBy("v").agg(F.count(F.lit(1)).alias("k")).agg(F.coalesce(F.sum(F.col("k") * (F.col("k") - 1) / 2), F.lit(0.0))).first()[0]
        if paths > most:
            raise ValueError(f"{paths:.0f} two-paths, more than {most}")
    return pairs.select(F.col("n").alias("a"), "v").join(pairs.select(F.col("n").alias("b"), "v"), "v").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


def link_scores(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """For stated pairs (a, b): common neighbours, Jaccard, Adamic-Adar, preferential attachment."""
    links = both_ways(undirected(edges))
    deg = links.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("k"))
    common = pairs.join(links.select(F.col("src").alias("a"), F.col("dst").alias("c")), "a").join(links.select(F.col("src").alias("b"), F.col("dst").alias("c")), ["b", "c"]).join(deg.select(F.col("node").alias("c"), F.col("k").alias("kc")), "c")
    sums = common.groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"), F.sum(1 / F.log("kc")).alias("adamic_adar"))
    out = pairs.join(sums, ["a", "b"], "left").join(deg.select(F.col("node").alias("a"), F.col("k").alias("ka")), "a", "left").join(deg.select(F.col("node").alias("b"), F.col("k").alias("kb")), "b", "left")
    c, ka, kb = F.coalesce("common", F.lit(0)), F.coalesce("ka", F.lit(0)), F.coalesce("kb", F.lit(0))
    return out.select("a", "b", c.alias("common"), F.when(ka + kb - c > 0, c / (ka + kb - c)).otherwise(0.0).alias("jaccard"), F.coalesce("adamic_adar", F.lit(0.0)).alias("adamic_adar"), (ka * kb).alias("preferential"))


def modularity(edges: DataFrame, parts: DataFrame, resolution: float = 1.0) -> DataFrame:
    """The modularity of a partition (node, part) of an undirected graph."""
    pairs = undirected(edges)
    a, b = parts.select(F.col("node").alias("src"), F.col("part").alias("pa")), parts.select(F.col("node").alias("dst"), F.col("part").alias("pb"))
    inner = pairs.join(a, "src").join(b, "dst").agg(F.count(F.lit(1)).alias("m"), F.sum((F.col("pa") == F.col("pb")).cast("long")).alias("inside"))
    volume = both_ways(pairs).join(a, "src").groupBy("pa").agg(F.count(F.lit(1)).alias("v")).agg(F.sum(F.col("v") * F.col("v")).alias("vv"))
    x = inner.withColumn("_k", F.lit(1)).join(volume.withColumn("_k", F.lit(1)), "_k")
    return x.select((F.col("inside") / F.col("m") - resolution * F.col("vv") / (4 * F.col("m") * F.col("m"))).alias("modularity"))


def distances(edges: DataFrame, sources: DataFrame, most: int | None = None) -> DataFrame:
    """node and hops from the nearest of the source nodes over directed edges, one round a hop, to the end; with ``most``,
    the nodes within so many hops."""
    links = _kept(edges.select("src", "dst").distinct())
    front = _kept(sources.select("node").distinct().withColumn("hops", F.lit(0)))
    reached, hop = front, 0
    while (most is None or hop < most) and not front.isEmpty():
        hop += 1
        last, had = front, reached
        front = _kept(links.join(last, links["src"] == last["node"]).select(F.col("dst").alias("node")).distinct().join(had, "node", "left_anti").withColumn("hops", F.lit(hop)))
        reached = _kept(had.union(front))
        release(last, had)
    return reached


def reciprocity(edges: DataFrame) -> DataFrame:
    """The share of directed edges whose reverse exists."""
    pairs = edges.where("src <> dst").select("src", "dst").distinct()
    back = pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("back"))
    return pairs.join(back, ["src", "dst"], "left").agg(F.avg(F.coalesce("back", F.lit(0)).cast("double")).alias("reciprocity"))


def at(spells: DataFrame, time: float, start: str = "start", end: str = "end") -> DataFrame:
    """Edges of a dynamic graph that exist at a time: start <= time < end, open where null."""
    return spells.where((F.col(start).isNull() | (F.col(start) <= time)) & (F.col(end).isNull() | (F.col(end) > time)))


def window(spells: DataFrame, low: float, high: float, mode: str = "overlap", start: str = "start", end: str = "end") -> DataFrame:
    """Edges that exist at some time of [low, high), or with mode ``cover`` at every time of it."""
    s, e = F.coalesce(F.col(start).cast("double"), F.lit(float("-inf"))), F.coalesce(F.col(end).cast("double"), F.lit(float("inf")))
    return spells.where((s < high) & (e > low) if mode == "overlap" else (s <= low) & (e >= high))
