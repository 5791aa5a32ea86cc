"""Rounds over a graph whose edges stay where they are.

Nodes are dealt to blocks, ranges of whole numbers with some EDGES edges in, so that neighbours in number share a block. The
edges into a block's nodes are laid out once, as places in the list of the nodes that the block knows, in a table with a row a
block, bucketed by it. A round shuffles only the values of nodes, each once to every block that knows it, as one array from a
block to a block in the order that both know, and meets the edges without moving them. A task holds one block: its edges at four
bytes each, and the values that it knows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystat.sources.tables import bucketed, release, written

#: Edges into the nodes of one block; a block may hold up to two times as many where many nodes share few numbers.
EDGES = 4_000_000

#: Values of nodes by name.
Values = dict[str, np.ndarray]
WHOLE = ("tinyint", "smallint", "int", "bigint")


@dataclass(frozen=True)
class Plan:
    """The blocks of nodes: ranges of whole numbers with some ``size`` ends of edges each, split further by hash where a range has more."""

    low: int
    width: int
    first: np.ndarray
    parts: np.ndarray
    numbers: np.ndarray
    small: bool

    @property
    def blocks(self) -> int:
        return len(self.numbers)

    def of(self, nodes: np.ndarray) -> np.ndarray:
        if self.blocks == 1:
            return np.full(len(nodes), self.numbers[0], np.int32)
        cell = np.clip((nodes - self.low) // self.width, 0, len(self.first) - 1)
        mixed = (nodes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        return self.numbers[self.first[cell] + (mixed % self.parts[cell].astype(np.uint64)).astype(np.int64)]

    def packed(self, nodes: np.ndarray) -> bytes:
        return planes((nodes - self.low).astype(np.int32) if self.small else nodes.astype(np.int64))

    def nodes(self, parts: list[bytes]) -> np.ndarray:
        found = unplaned(parts, np.int32 if self.small else np.int64)
        return found.astype(np.int64) + self.low if self.small else found


def planes(numbers: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second and so on, so that small or like numbers compress."""
    return np.ascontiguousarray(numbers).view(np.uint8).reshape(len(numbers), numbers.dtype.itemsize).T.tobytes()


def unplaned(parts: list[bytes], kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    rows = [np.frombuffer(p, np.uint8).reshape(width, -1).T for p in parts if p]
    return np.ascontiguousarray(np.concatenate(rows)).view(kind).ravel() if rows else np.zeros(0, kind)


def distinct(numbers: np.ndarray) -> np.ndarray:
    """In order; by sorting, which for many numbers is faster than the hashing of numpy's own."""
    found = np.sort(numbers)
    return found[np.append(True, found[1:] != found[:-1])[: len(found)]]


def _buckets(edges: DataFrame, blocks: int) -> list[int]:
    """A number for each block, so that each falls into a bucket of its own of ``blocks`` buckets."""
    at, found, spark = 0, {}, edges.sparkSession
    while len(found) < blocks:
        tried = spark.range(at, at + 16 * blocks).select(F.col("id").cast("int").alias("i"))
        found = {r[0]: r[1] for r in tried.groupBy(F.pmod(F.hash("i"), F.lit(blocks))).agg(F.min("i")).collect()} | found
        at += 16 * blocks
    return [found[i] for i in range(blocks)]


def planned(links: DataFrame, size: int) -> Plan:
    """A plan for edges of whole numbers."""
    ends = links.select(F.explode(F.array("src", "dst")).alias("node")).where("node IS NOT NULL")
    bounds = [f(c) for c in ("src", "dst") for f in (F.count, F.min, F.max)]
    n, m, lo, hi = (lambda r: (r[0], r[3], min((x for x in (r[1], r[4]) if x is not None), default=0), max((x for x in (r[2], r[5]) if x is not None), default=0)))(links.agg(*bounds).first())
    cells = 8 * math.ceil((n + m) / size) if n + m > size else 1
    width = -(-(hi - lo + 1) // cells)
    counts = {0: n + m}
    if cells > 1:
        cell = F.floor((F.col("node") - lo) / width) if hi - lo < 2**53 else F.expr(f"(CAST(node AS DECIMAL(38, 0)) - {lo}) DIV {width}")
        counts = {int(r[0]): r[1] for r in ends.groupBy(cell.alias("cell")).agg(F.count(F.lit(1))).collect()}
    first, parts, at, load = [], [], 0, 0
    for i in range(cells):
        k = max(1, math.ceil(counts.get(i, 0) / size))
        if load and load + counts.get(i, 0) > size:
            at, load = at + 1, 0
        first.append(at)
        parts.append(k)
        at, load = (at + k, 0) if k > 1 else (at, load + counts.get(i, 0))
    return Plan(lo, width, np.array(first), np.array(parts), np.array(_buckets(links, at + 1), np.int32), hi - lo < 2**31)


@dataclass(frozen=True)
class Laid:
    """``lists``, a row a block: its nodes, how many and which places of known nodes point to each (``lens``, ``into``), where its own
    nodes stand among those it knows (``start``), and which of its nodes go to which other blocks (``goes``, ``sizes``, ``which``).
    Known nodes are in order of their block, then of their number. ``names``: the nodes of these numbers, where the graph's own are
    not whole numbers. ``nodes``: how many there are."""

    lists: DataFrame
    plan: Plan
    kind: str
    names: DataFrame | None
    nodes: int

    @property
    def blocks(self) -> int:
        return self.plan.blocks

    def named(self, rows: DataFrame, *columns: str) -> DataFrame:
        return named(rows, self.kind, self.names, *columns)


def named(self, rows: DataFrame, *columns: str) -> DataFrame:
        return named(rows, self.kind, self.names, *columns)


def named(rows: DataFrame, kind: str, names: DataFrame | None, *columns: str) -> DataFrame:
    """``rows`` with the numbers of nodes in ``columns`` as the graph has them: the way back from ``numbered``."""
    for c in columns:
        if names is None:
            rows = rows.withColumn(c, F.col(c).cast(kind))
        else:
            called = names.select(F.col("node").alias("_name"), F.col("number").alias("_number"))
            rows = rows.join(called, F.col(c) == F.col("_number")).withColumn(c, F.col("_name")).drop("_name", "_number")
    return rows


def numbered(edges: DataFrame, *, dense: bool = False) -> tuple[DataFrame, str, DataFrame | None]:
    """src and dst as longs, the type they had, and the names of the numbers (in order of the names), if they were not whole, or
    with ``dense`` always: such numbers are from 0, and twice their value is a long. Other columns stay."""
    kinds = {dict(edges.dtypes)[c] for c in ("src", "dst")}
    others = [c for c in edges.columns if c not in ("src", "dst")]
    if kinds <= set(WHOLE) and not dense:
        return edges.select(F.col("src").cast("long"), F.col("dst").cast("long"), *others), max(kinds, key=WHOLE.index), None
    nodes = edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct().where("node IS NOT NULL")
    names = written(nodes.orderBy("node").select("node", F.monotonically_increasing_id().alias("number")))
    a, b = (names.select(F.col("node").alias(f"_{c}"), F.col("number").alias(f"n{c}")) for c in ("src", "dst"))
    joined = edges.join(a, F.col("src") == F.col("_src"), "left").join(b, F.col("dst") == F.col("_dst"), "left")
    return joined.select(F.col("nsrc").alias("src"), F.col("ndst").alias("dst"), *others), dict(names.dtypes)["node"], names


#: Edges that a task packs together.
PACK = 1_000_000

PACKED = "block int, node binary, into binary, sender binary, goes binary"


def _split(block: np.ndarray, *columns: np.ndarray) -> dict[int, list[np.ndarray]]:
    order = np.argsort(block.astype(np.uint16) if block.max(initial=0) < 2**16 else block, kind="stable")
    found, starts = np.unique(block[order], return_index=True)
    parts = [np.split(c[order], starts[1:]) for c in columns]
    return {int(x): [p[i] for p in parts] for i, x in enumerate(found)}


def _packed(chunk: pa.Table, both: bool, plan: Plan) -> pa.RecordBatch:
    """A row a block of the edges of a chunk: the ends of those into it and the other ends, and which of its nodes go to which
    blocks (-1: nowhere, the node is just there)."""
    there = [pa.compute.is_valid(chunk[c]).to_numpy() for c in ("src", "dst")]
    src, dst = (pa.compute.fill_null(chunk[c], 0).to_numpy() for c in ("src", "dst"))
    whole = there[0] & there[1]
    s, d = src[whole], dst[whole]
    if both:
        s, d = np.concatenate([s, d]), np.concatenate([d, s])
    if plan.small:  # in order, so that they compress
        keys = np.sort((d - plan.low) << 32 | (s - plan.low))
        d, s = (keys >> 32) + plan.low, (keys & 0xFFFFFFFF) + plan.low
    bd = plan.of(d)
    into = _split(bd, d, s)
    senders, goes = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
    if not both:
        order = np.lexsort((bd, s))
        new = np.append(True, (np.diff(s[order]) != 0) | (np.diff(bd[order]) != 0))[: len(order)]
        senders, goes = [s[order[new]]], [bd[order[new]]]
    for node, ok in ((src, there[0]), (dst, there[1])):
        senders.append(node[ok & ~whole])
        goes.append(np.full(len(senders[-1]), -1, np.int32))
    senders, goes = np.concatenate(senders), np.concatenate(goes)
    out = _split(plan.of(senders), senders, goes)
    none = [np.zeros(0, np.int64)] * 2
    rows = [(x, *map(plan.packed, into.get(x, none)), plan.packed(out.get(x, none)[0]), planes(out.get(x, none)[1].astype(np.int32))) for x in sorted({*into, *out})]
    kinds = [pa.int32(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [c.split()[0] for c in PACKED.split(", ")])


LISTS = pa.schema([("block", pa.int32()), ("node", pa.binary()), ("lens", pa.binary()), ("into", pa.binary()), ("start", pa.int32()), ("goes", pa.binary()), ("sizes", pa.binary()), ("which", pa.binary())])


def _laid(table: pa.Table, once: bool, both: bool, plan: Plan) -> pa.Table:
    block = table["block"][0].as_py()
    a, b, sender = (plan.nodes(table[c].to_pylist()) for c in ("node", "into", "sender"))
    own = distinct(np.concatenate([a, sender]))
    other, at_b = np.unique(b, return_inverse=True)
    home = plan.of(other)
    far = home != block
    order = np.lexsort((other[far], home[far]))
    start = int((home[far] < block).sum())
    place = np.empty(len(other), np.int64)  # of each other end among the known nodes
    place[np.flatnonzero(far)[order]] = np.arange(len(order)) + np.where(np.arange(len(order)) < start, 0, len(own))
    place[~far] = start + np.searchsorted(own, other[~far])
    m = len(order) + len(own) or 1
    keys = np.searchsorted(own, a) * m + place[at_b]
    keys = distinct(keys) if once else np.sort(keys)
    if both:
        known = np.empty(m, np.int64)
        known[place] = home
        at, to = keys // m, known[keys % m]
    else:
        at, to = np.searchsorted(own, sender), unplaned(table["goes"].to_pylist(), np.int32).astype(np.int64)
    sends = (to >= 0) & (to != block)
    pairs = distinct(to[sends] * (len(own) or 1) + at[sends])
    goes, sizes = np.unique(pairs // (len(own) or 1), return_counts=True)
    row = [block, own, np.bincount(keys // m, minlength=len(own)).astype(np.int32), (keys % m).astype(np.int32), start, goes.astype(np.int32), sizes.astype(np.int32), (pairs % (len(own) or 1)).astype(np.int32)]
    return pa.table([pa.array([v.tobytes() if isinstance(v, np.ndarray) else v], f.type) for v, f in zip(row, LISTS, strict=True)], schema=LISTS)


def laid(edges: DataFrame, *, both: bool = False, once: bool = False, size: int | None = None, plan: Plan | None = None) -> Laid:
    """The edges src -> dst, of which values go from src to dst. ``both``: and back, without loops, each pair once. ``once``: each edge
    counts once, however often it stands there. Edges with a null end only make their other end a node. ``plan``: that of a graph
    of the same nodes, so that values of blocks fit both."""
    plain, kind, names = numbered(edges)
    plain = plain.select("src", "dst")
    links = written(plain.where("src <> dst") if both else plain, compression="zstd")
    plan = plan or planned(links, (size or EDGES) * (1 if both else 2))

    def packed(batches):
        held, rows = [], 0
        for b in batches:
            held, rows = [*held, b], rows + b.num_rows
            if rows >= PACK:
                yield _packed(pa.Table.from_batches(held).combine_chunks(), both, plan)
                held, rows = [], 0
        if rows:
            yield _packed(pa.Table.from_batches(held).combine_chunks(), both, plan)

    text = ", ".join(f"{f.name} {'binary' if f.type == pa.binary() else 'int'}" for f in LISTS)
    lists = links.mapInArrow(packed, PACKED).repartition(plan.blocks, "block").groupBy("block").applyInArrow(lambda t: _laid(t, once or both, both, plan), text)
    made = bucketed(lists, "block", plan.blocks)
    release(links)
    return Laid(made, plan, kind, names, made.agg(F.coalesce(F.sum(F.length("node") / 8), F.lit(0)).cast("long")).first()[0])


@dataclass(frozen=True)
class Block:
    """What a task holds: the nodes whose values it makes, their places among those it knows, and the places and number of the
    nodes that point to each."""

    nodes: np.ndarray
    places: np.ndarray
    into: np.ndarray
    lens: np.ndarray

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.nodes), dtype=np.int32), self.lens)

    def reduced(self, ufunc: np.ufunc, values: np.ndarray, empty: float) -> np.ndarray:
        """The values of all edges, joined by node; ``empty`` where a node has none."""
        out = np.full(len(self.nodes), empty, values.dtype)
        has = np.flatnonzero(self.lens)
        if len(has):
            out[has] = ufunc.reduceat(values, (np.cumsum(self.lens) - self.lens)[has])
        return out


def _ints(table: pa.Table, name: str, kind: type = np.int32) -> np.ndarray:
    return np.frombuffer(table[name][0].as_py(), kind)


KINDS = {"long": (pa.int64(), np.int64), "double": (pa.float64(), np.float64), "boolean": (pa.bool_(), np.bool_), "int": (pa.int32(), np.int32)}


def _rows(block: int, nodes: np.ndarray, values: Values, schema: dict[str, str]) -> pa.Table:
    """A block's nodes with their values, as one row of arrays."""
    arrays = {"node": (nodes, "long")} | {k: (np.asarray(values[k]), v) for k, v in schema.items()}
    lists = {k: pa.ListArray.from_arrays(pa.array([0, len(nodes)], pa.int32()), pa.array(v, KINDS[kind][0])) for k, (v, kind) in arrays.items()}
    return pa.table({"block": pa.array([block], pa.int32())} | lists)


def _text(schema: dict[str, str]) -> str:
    return ", ".join(["block int", "node array<long>", *[f"{k} array<{v}>" for k, v in schema.items()]])


def begun(graph: Laid, schema: dict[str, str], start: Callable[[np.ndarray, np.ndarray], Values]) -> DataFrame:
    """The values that ``start`` makes of nodes and of how many nodes point to them, for the first round: a row of arrays a block."""

    def first(batches):
        for b in batches:
            for i in range(b.num_rows):
                t = pa.Table.from_batches([b.slice(i, 1)])
                nodes = _ints(t, "node", np.int64)
                yield from _rows(t["block"][0].as_py(), nodes, start(nodes, _ints(t, "lens").astype(np.int64)), schema).to_batches()

    return written(graph.lists.select("block", "node", "lens").mapInArrow(first, _text(schema)))


def _narrow(values: np.ndarray) -> np.ndarray:
    """In fewer bytes, where whole numbers fit them."""
    if values.dtype.kind != "i" or not len(values):
        return values
    return values.astype(np.promote_types(np.min_scalar_type(values.min()), np.min_scalar_type(values.max())))


def met(graph: Laid, values: DataFrame, schema: dict[str, str], step: Callable[[int, Block, Values], pa.Table], out: str, sent: tuple[str, ...]) -> DataFrame:
    """What ``step`` makes of each block and the values that it knows: of all nodes it knows where these are ``sent``, else of its own."""

    def send(own: pa.Table, lists: pa.Table) -> pa.Table:
        block = lists["block"][0].as_py()
        at = {k: own[k].combine_chunks().flatten().to_numpy(zero_copy_only=False) for k in schema}
        which = np.split(_ints(lists, "which"), np.cumsum(_ints(lists, "sizes"))[:-1])
        rows = [(block, at)] + [(int(to), {k: at[k][i] for k in sent}) for to, i in zip(_ints(lists, "goes"), which, strict=False)]
        rows = [(to, {k: _narrow(v) for k, v in some.items()}) for to, some in rows]
        names = {f"kind_{k}": pa.array([some[k].dtype.str if k in some else None for _, some in rows], pa.string()) for k in schema}
        parts = {f"part_{k}": pa.array([some[k].tobytes() if k in some else None for _, some in rows], pa.binary()) for k in schema}
        return pa.table({"block": pa.array([to for to, _ in rows], pa.int32()), "sender": pa.array([block] * len(rows), pa.int32())} | names | parts)

    def meet(news: pa.Table, lists: pa.Table) -> pa.Table:
        number = lists["block"][0].as_py()
        order = np.argsort(news["sender"].to_numpy())
        nodes, start = _ints(lists, "node", np.int64), lists["start"][0].as_py()
        block = Block(nodes, np.arange(start, start + len(nodes)), _ints(lists, "into"), _ints(lists, "lens"))
        known = {}
        for k, kind in schema.items():
            whose = [i for i in order if k in sent or news["sender"][i].as_py() == number]
            parts = [np.frombuffer(news[f"part_{k}"][i].as_py(), news[f"kind_{k}"][i].as_py()) for i in whose]
            known[k] = np.concatenate(parts).astype(KINDS[kind][1])
        return step(number, block, known)

    kinds = "".join(f", kind_{k} string" for k in schema) + "".join(f", part_{k} binary" for k in schema)
    sends, lists = graph.lists.select("block", "goes", "sizes", "which"), graph.lists.select("block", "node", "start", "into", "lens")
    news = values.groupBy("block").cogroup(sends.groupBy("block")).applyInArrow(send, f"block int, sender int{kinds}")
    return news.groupBy("block").cogroup(lists.groupBy("block")).applyInArrow(meet, out)


def moved(graph: Laid, values: DataFrame, schema: dict[str, str], step: Callable[[Block, Values], Values], *sent: str) -> DataFrame:
    """A round: ``step`` makes a block's new values from those that it knows, of which those of other blocks' nodes are ``sent``."""
    made = lambda number, block, known: _rows(number, block.nodes, step(block, known), schema)
    return written(met(graph, values, schema, made, _text(schema), sent))


def settled(block: Block, value: np.ndarray, again: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Values of a block's own nodes by rounds within it, until none changes; for steps in which values only ever fall."""
    while True:
        new = again(value)
        if (new == value[block.places]).all():
            return new
        value[block.places] = new


def home(values: DataFrame) -> DataFrame:
    """The nodes of the graph, once each, with their values."""
    return values.select(F.explode(F.arrays_zip(*values.drop("block").columns)).alias("_x")).select("_x.*")
