"""Nearest neighbours by inner product over several shifted Hilbert orders.

Vectors are lengthened by one component so that all have the largest norm; nearest in distance is then largest inner
product. Each curve projects them onto a few random directions, shifts the grid, and takes the Hilbert index as key.
Keys, lengthened by a few bits of a hash of the id so that one crowded cell can be cut too, are cut into ranges of
about ``block_rows`` rows. A query meets the rows of its range and of the two beside it: it is sent to all three, and
a task streams a range's rows past its queries. The curves' findings are merged and reranked.

How many curves and how wide ranges are needed depends on the vectors: where they have structure, a neighbour is near
on some curve and narrow ranges do; vectors that point in all directions alike need wide ones. A pilot finds out: a
bounded number of queries is compared with all rows, and the cheapest setting that finds ``recall`` of their true
neighbours, by keys cut at the quantiles of a bounded sample, is taken.

Of equal vectors only the ``k + 1`` smallest ids can be among the k nearest of any query, so the others leave before
the first shuffle and copies never fill a range.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a range is sent, queries before rows.
ASK, ROW = range(2)
#: Into so many ranges at least a curve is cut, if these find enough.
RANGES = 16
#: Bits of the id's hash below a Hilbert index.
TIE = 7


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """The Hilbert index of grid cells (n by dimensions, each below 2 ** bits)."""
    x = cells.astype(np.int64).T.copy()
    bit = 1 << (bits - 1)
    while bit > 1:
        low = bit - 1
        for i in range(len(x)):
            high = (x[i] & bit) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        bit >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn, bit = np.zeros_like(x[0]), 1 << (bits - 1)
    while bit > 1:
        turn ^= np.where((x[-1] & bit) != 0, bit - 1, 0)
        bit >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for row in x:
            key = (key << 1) | ((row >> b) & 1)
    return key


def best(q: np.ndarray, x: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query the k rows of the largest inner product (ties to the smaller id, the query itself left out): query, id,
    score. A matrix product finds them; their scores are then summed in one order, so equal vectors score equally."""
    scores = q @ x.T
    scores[ids[None, :] == own[:, None]] = -np.inf
    slack = 1e-12 * max(1.0, float(np.abs(scores[np.isfinite(scores)]).max(initial=0)))
    if scores.shape[1] > k:
        cut = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        scores[scores < cut[:, None] - slack] = -np.inf
    row, col = np.nonzero(scores > -np.inf)
    return first_of(row, ids[col], (q[row] * x[col]).sum(1), k)


def first_of(row: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k largest scores of each row number, ties to the smaller id."""
    order = np.lexsort((ids, -score, row))
    row, ids, score = row[order], ids[order], score[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[kept], ids[kept], score[kept]


def usable(vector: Column) -> Column:
    """Whether a vector takes part: no null, no component null or not finite, not all zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0)


def matrix(lists: pa.Array, dims: int) -> np.ndarray:
    """Rows of up to ``dims`` numbers, filled up with zeros."""
    lengths = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), dims))
    out[np.arange(dims)[None, :] < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


@dataclass(frozen=True)
class Curves:
    """Random directions and shifts; ``most`` is the largest norm."""

    turns: np.ndarray
    shifts: np.ndarray
    bits: int
    most: float

    @staticmethod
    def drawn(number: int, dims: int, directions: int, bits: int, most: float, seed: int) -> Curves:
        rng = np.random.default_rng(seed)
        return Curves(rng.standard_normal((number, dims + 1, directions)) / np.sqrt(dims + 1), rng.random((number, directions)), bits, most)

    def keys(self, curve: int, x: np.ndarray, ids: np.ndarray, asks: bool) -> np.ndarray:
        """The keys of vectors as rows, lengthened to the largest norm, or as queries, scaled to it."""
        norms = np.sqrt((x * x).sum(1))
        y = x * (self.most / norms)[:, None] if asks else x
        last = np.zeros(len(x)) if asks else np.sqrt(np.maximum(self.most**2 - norms**2, 0))
        p = np.column_stack([y, last]) @ self.turns[curve] / (self.most / np.sqrt(x.shape[1] + 1))  # about standard normal
        cells = np.clip((p + 4 + 4 * self.shifts[curve]) / 12 * (1 << self.bits), 0, (1 << self.bits) - 1)
        tie = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - TIE)).astype(np.int64)
        return hilbert(cells, self.bits) << TIE | tie


@dataclass(frozen=True)
class Plan:
    """The keys at which each curve is cut, and the share of the pilot's neighbours that this finds."""

    cuts: list[np.ndarray]
    recall: float


def planned(curves: Curves, sample: tuple[np.ndarray, np.ndarray], pilot: tuple[np.ndarray, np.ndarray], near: list[tuple[np.ndarray, np.ndarray]], n: int, recall: float, least: int) -> Plan:
    """The cheapest of growing numbers of curves and widths. ``sample`` and ``pilot``: ids and vectors; ``near``: of each
    pilot query its true neighbours. Cost: the rows a query meets."""
    number = len(curves.turns)
    owner = np.repeat(np.arange(len(near)), [len(v[0]) for v in near])
    ids, x = np.concatenate([v[0] for v in near]), np.concatenate([v[1] for v in near])
    keys = [np.sort(curves.keys(c, sample[1], sample[0], False)) for c in range(number)]
    of_query = [curves.keys(c, pilot[1], pilot[0], True) for c in range(number)]
    of_near = [curves.keys(c, x, ids, False) for c in range(number)]
    found = None
    blocks = max(1, n // least)
    while True:
        hit = np.zeros(len(ids), bool)
        for c in range(number):
            cuts = keys[c][np.arange(1, blocks) * len(keys[c]) // blocks]
            hit |= np.abs(np.searchsorted(cuts, of_query[c], "right")[owner] - np.searchsorted(cuts, of_near[c], "right")) <= 1
            share = float(hit.mean()) if len(hit) else 1.0
            if share >= recall:
                cost = (c + 1) * min(3, blocks) / blocks
                if found is None or cost < found[0]:
                    found = (cost, c + 1, blocks, share)
                break
        # ranges wider than a 16th only if nothing else does; a single range finds all
        if blocks == 1 or (found and blocks <= RANGES):
            break
        blocks = max(blocks * 3 // 4, RANGES) if blocks > RANGES else blocks * 3 // 4
    _, taken, blocks, share = found
    return Plan([keys[c][np.arange(1, blocks) * len(keys[c]) // blocks] for c in range(taken)], share)


def search(
    vectors: DataFrame,
    queries: Column,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 20,
    curves: int = 12,
    directions: int = 8,
    bits: int = 7,
    block_rows: int = 1024,
    recall: float = 0.94,
    pilot: int = 128,
    sample: int = 20_000,
    seed: int = 0,
) -> DataFrame:
    """query_id, rank (int, from 1), vec_id, score (double): the k nearest found of each query, ties to the smaller id.

    ``queries`` is a condition on the column ``id``. Null, all-zero and not finite vectors and null ids take no part; a
    vector shorter than the longest counts as filled up with zeros. Repeated ids count once, with their largest score.
    An empty table gives no rows, and so does one without queries. Other columns are not read. ``curves`` at most and
    ranges of ``block_rows`` rows at least are tried for ``recall``, measured on ``pilot`` queries (the first by a hash
    of the id); ranges are cut by about ``sample`` rows. Every row is searched. A table of less than two ranges is compared whole.
    """
    # vectors travel in the precision they have; all arithmetic is in double precision
    packing = np.float32 if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else np.float64
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    rows = rows.withColumn("asks", F.coalesce(queries, F.lit(False)))
    dims, most, n, asked = rows.agg(F.max(F.size("v")), F.max(F.sqrt(squares)), F.count(F.lit(1)), F.sum(F.col("asks").cast("long"))).first()
    if not asked:
        return rows.limit(0).select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))
    # repeated ids and vectors count once; the limit holds in each task before the rows are dealt by vector
    copies = Window.partitionBy("v").orderBy("id")
    sole = rows.select("id", "v").withColumn("n", F.dense_rank().over(copies)).where(F.col("n") <= k + 1).dropDuplicates(["v", "id"]).select("id", "v")
    asking = rows.where("asks").select("id", "v")
    mine = Curves.drawn(curves, dims, directions, bits, most, seed)
    plan = pilot_plan(sole, asking, mine, dims, n, k=k, recall=recall, pilot=pilot, sample=sample, least=block_rows)

    def send(kind: int):
        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids, x = b.column(0).to_numpy(), matrix(b.column(1), dims)
                packed = pa.array([r.tobytes() for r in x.astype(packing)], pa.binary())
                for c, cuts in enumerate(plan.cuts):
                    block = np.searchsorted(cuts, mine.keys(c, x, ids, kind == ASK), "right")
                    for shift in (0,) if kind == ROW else (-1, 0, 1):
                        to = block + shift
                        within = pa.array((to >= 0) & (to <= len(cuts)))
                        whole = pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), c, np.int32)), pa.array(to.astype(np.int64)), pa.array(np.full(len(ids), kind, np.int32)), b.column(0), packed], ["curve", "block", "kind", "id", "v"])
                        yield whole.filter(within)

        return dealt

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Streams a range's rows past its queries."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        at, asks, q, held = None, np.zeros(0, np.int64), np.zeros((0, dims)), none

        def out() -> Iterator[pa.RecordBatch]:
            if len(held[0]):
                yield pa.RecordBatch.from_arrays([pa.array(asks[held[0]]), pa.array(held[1]), pa.array(held[2])], ["query_id", "vec_id", "score"])

        for b in batches:
            curve, block, kind, ids = (b.column(i).to_numpy() for i in range(4))
            x = np.frombuffer(b"".join(b.column(4).to_pylist()), packing).reshape(-1, dims).astype(np.float64)
            turn = np.flatnonzero((np.diff(curve) != 0) | (np.diff(block) != 0) | (np.diff(kind) != 0)) + 1
            for lo, hi in zip([0, *turn], [*turn, len(ids)], strict=True):
                if hi == lo:
                    continue
                if at != (curve[lo], block[lo]):
                    yield from out()
                    at, asks, q, held = (curve[lo], block[lo]), np.zeros(0, np.int64), np.zeros((0, dims)), none
                if kind[lo] == ASK:
                    asks, q = np.concatenate([asks, ids[lo:hi]]), np.concatenate([q, x[lo:hi]])
                    continue
                for i in range(lo, hi, 4096):
                    j = min(i + 4096, hi)
                    for a in range(0, len(asks), 1024):
                        row, vec, score = best(q[a : a + 1024], x[i:j], ids[i:j], asks[a : a + 1024], k)
                        held = tuple(np.concatenate([h, new]) for h, new in zip(held, (row + a, vec, score), strict=True))
                    held = first_of(*held, k)
        yield from out()

    kinds = "curve int, block long, kind int, id long, v binary"
    sent = sole.mapInArrow(send(ROW), kinds).union(asking.mapInArrow(send(ASK), kinds))
    found = sent.repartition("curve", "block").sortWithinPartitions("curve", "block", "kind").mapInArrow(compare, "query_id long, vec_id long, score double")
    hits = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def pilot_plan(rows: DataFrame, asking: DataFrame, curves: Curves, dims: int, n: int, *, k: int, recall: float, pilot: int, sample: int, least: int) -> Plan:
    """Compares ``pilot`` queries with all rows, and plans by their nearest; a table of less than two ranges needs no plan."""
    if n < 2 * least:
        return Plan([np.zeros(0, np.int64)], 1.0)
    lists = lambda t: (t.column("id").to_numpy(), matrix(t.column("v").combine_chunks(), dims))
    chosen = lists(asking.orderBy(F.xxhash64("id"), "id").limit(pilot).toArrow())
    part = 1_000_000
    known = lists(rows.where(F.pmod(F.xxhash64("id"), F.lit(part)) < F.lit(-(-part * sample // n))).toArrow())

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, x = b.column(0).to_numpy(), matrix(b.column(1), dims)
            row, vec, score = best(chosen[1], x, ids, chosen[0], k)
            at = {int(i): j for j, i in enumerate(ids)}
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(vec), pa.array(score), b.column(1).take(pa.array([at[int(i)] for i in vec], pa.int64()))], ["q", "id", "score", "v"])

    hits = rows.mapInArrow(nearest, "q long, id long, score double, v array<double>").dropDuplicates(["q", "id"])
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), "id")
    top = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("q", "id", "v").toArrow()
    ids, x = lists(top)
    of = top.column("q").to_numpy()
    near = [(ids[of == q], x[of == q]) for q in range(len(chosen[0]))]
    return planned(curves, known, chosen, near, n, recall, least)
