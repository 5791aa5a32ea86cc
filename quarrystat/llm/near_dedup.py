"""Near-duplicate detection: ProbMinHash signatures, banding and verification.

A document is the set of its five-word shingles, weighted by 1 + ln(times). ProbMinHash sends each shingle's arrivals,
a Poisson process with the weight as its rate, to random registers; a register keeps the shingle that arrived first.
Two registers agree with the probability Jaccard of the weights, the plain Jaccard where no shingle repeats. An
element stops once its next arrival is later than every register. Documents that agree on all registers of a band
share a bucket. Links are decided on the plain Jaccard, which may be far above that of the weights where a part of a
text repeats; a text with repeated shingles is therefore signed a second time with all weights 1, into the same
buckets. Without repeats both signatures are the same.

Texts that are equal as word lists are one node from the start, so groups of copies cost one row each, and buckets
with the same nodes are one bucket. In a first round every node meets one leader: of the smallest nodes of its
buckets the one whose map of bits differs least. As md5 hashes order nodes alike in all buckets, a group of near copies
falls into few classes at once. In each further round a few leaders of a bucket are compared with the bucket's nodes of
other classes, and leave. Rounds go on, with twice the leaders each time, until no bucket holds nodes of two classes
that haven't met. What ``rounds`` of them (one round) leave over (many different texts that share a common passage) moves on to buckets
of an exact prefix filter over the same nodes. Before two nodes become a pair, their sizes and maps of bits must allow
the similarity: the bits in which two maps differ never outnumber the shingles in which the sets differ, so this drops
no link, and texts that only share a passage seldom become pairs. A link needs a Jaccard similarity of the shingle sets
of at least ``threshold``, counted exactly. Classes are the connected parts. A round's links join classes and are then
forgotten: what is kept is one row for each node with its class, and tables are deleted once their successor is written.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystat.llm.common import release, settle, text_or_empty, words_of, wrapped

SHINGLE = 5
#: Bits of the map that says of each set, by parity, in which of so many parts its shingles lie; a multiple of 64.
MAP_BITS = 512


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each output bit depends on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: list[str], known: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a text's distinct shingles, sorted, and how often each occurs. A text of fewer than five words,
    but one at least, is one shingle. ``known`` holds the hashes of words seen before."""
    import xxhash

    codes = []
    for w in words:
        h = known.get(w)
        if h is None:
            if len(known) > 200_000:
                known.clear()
            h = known[w] = xxhash.xxh64_intdigest(w)
        codes.append(h)
    h = np.array(codes, np.uint64)
    width = min(SHINGLE, len(h))
    out = np.zeros(len(h) - width + 1 if width else 0, np.uint64)
    for k in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(out)]
    return np.unique(mixed(out + np.uint64(width)), return_counts=True)


def signature(elements: np.ndarray, weights: np.ndarray, registers: int) -> np.ndarray:
    """For each register the element whose arrival there is first. Arrivals are drawn a block at a time for all
    elements that may still win; one round is usually enough."""
    first = np.full(registers, np.inf)
    winner = np.zeros(registers, np.uint64)
    times = np.zeros(len(elements))
    live = np.arange(len(elements))
    drawn = 0
    # as many arrivals as fill all registers with good odds, over all elements
    size = max(1, int(registers * (np.log(registers) + 2) / max(len(elements), 1)) + 1)
    while len(live):
        counter = np.arange(drawn, drawn + size, dtype=np.uint64)
        h = mixed(elements[live][:, None] + mixed(counter + np.uint64(1))[None, :])
        gaps = -np.log((h >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / weights[live][:, None]
        arrivals = np.cumsum(gaps, axis=1) + times[live][:, None]
        times[live] = arrivals[:, -1]
        at = (mixed(h ^ np.uint64(0xD6E8FEB86659FD93)) % np.uint64(registers)).astype(np.int64)
        t, r, e = arrivals.ravel(), at.ravel(), np.repeat(elements[live], size)
        early = t < first[r]
        t, r, e = t[early], r[early], e[early]
        order = np.argsort(-t, kind="stable")  # the earliest is written last
        first[r[order]] = t[order]
        winner[r[order]] = e[order]
        live = live[times[live] < first.max()]
        drawn += size
    return winner


def band_keys(winner: np.ndarray, rows: int) -> np.ndarray:
    """A key for each band of ``rows`` registers; the band's number is part of it."""
    bands = winner.reshape(-1, rows)
    key = np.arange(len(bands), dtype=np.uint64) + np.uint64(1)
    for k in range(rows):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + bands[:, k])
    return key.astype(np.int64)


def normal(text: Column) -> Column:
    """The words of a text in lower case, one blank between them."""
    return F.array_join(words_of(F.lower(text)), " ")


def node_of(norm: Column) -> Column:
    return F.unhex(F.md5(norm))


def banded(nodes: DataFrame, registers: int, rows: int) -> DataFrame:
    """(doc_id, node, norm) to (doc_id, node, bands: array of long, empty for no words)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for b in batches:
            bands = []
            for norm in b.column(2).to_pylist():
                if norm:
                    found, times = shingles(norm.split(" "), known)
                    keys = band_keys(signature(found, 1 + np.log(times), registers), rows)
                    if times.max() > 1:
                        keys = np.union1d(keys, band_keys(signature(found, np.ones(len(found)), registers), rows))
                    bands.append(keys)
                else:
                    bands.append(np.zeros(0, np.int64))
            offsets = pa.array(np.cumsum([0, *map(len, bands)]), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int64), *bands])))], ["doc_id", "node", "bands"])

    return nodes.mapInArrow(sign, "doc_id long, node binary, bands array<long>")


def shingled(nodes: DataFrame) -> DataFrame:
    """(node, norm) to (node, shingles: array of long, bits: the set's map as an array of long)."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for b in batches:
            sets = [shingles(norm.split(" "), known)[0] for norm in b.column(1).to_pylist()]
            maps = [np.packbits(np.bincount((x % np.uint64(MAP_BITS)).astype(np.int64), minlength=MAP_BITS) & 1).view(np.int64) for x in sets]
            lists = lambda xs: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, xs)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *[x.view(np.int64) for x in xs]])))
            yield pa.RecordBatch.from_arrays([b.column(0), lists(sets), lists(maps)], ["node", "shingles", "bits"])

    return nodes.mapInArrow(split, "node binary, shingles array<long>, bits array<long>")


def described(members: DataFrame, sets: DataFrame) -> DataFrame:
    """``members`` with the size and the map of each node's set."""
    return members.join(sets.select(F.col("node").alias("_node"), F.size("shingles").alias("size"), "bits"), F.col("node") == F.col("_node")).drop("_node")


def apart() -> Column:
    """In how many bits the maps of a pair (bits, _bits) differ."""
    return F.aggregate(F.zip_with("bits", "_bits", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)


def allowed(threshold: float) -> Column:
    """Whether sizes and maps allow a pair (size, bits and _size, _bits) the threshold. Of n and m shingles in all,
    similar sets differ in ``(n + m) (1 - t) / (1 + t)`` at most, and maps in no more bits than that."""
    total = F.col("size") + F.col("_size")
    ratio = F.least("size", "_size") >= F.lit(threshold) * F.greatest("size", "_size") - 1e-9
    return ratio & (apart() <= F.lit((1 - threshold) / (1 + threshold)) * total + 1e-9)


def parts(links: DataFrame) -> DataFrame:
    """The connected parts of links (a, b): node and part, its smallest node. Labels travel over links and then jump
    to their label's label, so chains shorten by doubling."""
    edges = settle(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = settle(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("part")))
    while True:
        near = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("part").alias("near"))
        moved = labels.join(near, labels["node"] == near["a"], "left").select("node", F.col("part").alias("old"), F.least("part", "near").alias("part"))
        above = labels.select(F.col("node").alias("_node"), F.col("part").alias("_part"))
        jumped = settle(moved.join(above, F.col("part") == F.col("_node"), "left").select("node", "old", F.least("part", "_part").alias("part")), labels)
        labels = jumped
        if jumped.where(F.col("part") != F.col("old")).isEmpty():
            release(edges)
            return labels


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b and other columns) whose shingle sets have at least the threshold's similarity."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    sizes = F.least(F.size("x"), F.size("y")) >= F.lit(threshold) * F.greatest(F.size("x"), F.size("y"))
    return pairs.join(left, "a").join(right, "b").where(sizes).where(both >= F.lit(threshold) * (F.size("x") + F.size("y") - both)).drop("x", "y")


@dataclass(frozen=True)
class Classes:
    """The part of each node that has a link: (node, part); None while there are none."""

    labels: DataFrame | None = None

    def joined_by(self, links: DataFrame) -> Classes:
        """The classes after links between parts (a, b: parts of linked nodes, different ones)."""
        if links.isEmpty():
            return self
        merged = parts(links)
        if self.labels is None:
            return Classes(merged)
        above = merged.select(F.col("node").alias("_node"), F.col("part").alias("_part"))
        moved = self.labels.join(above, F.col("part") == F.col("_node"), "left").select("node", F.coalesce("_part", "part").alias("part"))
        fresh = merged.join(self.labels.select(F.col("node").alias("_node")), F.col("node") == F.col("_node"), "left_anti").select("node", "part")
        return Classes(settle(moved.union(fresh), self.labels, merged))

    def of(self, nodes: DataFrame) -> DataFrame:
        """``nodes`` with the part of each; a node without links is its own part."""
        if self.labels is None:
            return nodes.withColumn("part", F.col("node"))
        labels = self.labels.select(F.col("node").alias("_node"), F.col("part").alias("_part"))
        return nodes.join(labels, F.col("node") == F.col("_node"), "left").withColumn("part", F.coalesce("_part", "node")).drop("_node", "_part")


MEMBER = ["bucket", "node", "leads", "size", "bits"]


def still_open(members: DataFrame, found: Classes) -> DataFrame:
    """The members of buckets that hold nodes of several classes and one that may lead, with part and n (the members
    of that part in the bucket)."""
    classed = found.of(members)
    sizes = classed.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("n"), F.max("leads").alias("able"))
    undone = sizes.groupBy(F.col("bucket").alias("_bucket")).agg(F.count(F.lit(1)).alias("parts"), F.max("able").alias("able")).where("parts > 1 AND able").select("_bucket")
    sizes = sizes.join(undone, F.col("bucket") == F.col("_bucket")).select(F.col("bucket").alias("_bucket"), F.col("part").alias("_part"), "n")
    return classed.join(sizes, (F.col("bucket") == F.col("_bucket")) & (F.col("part") == F.col("_part"))).select(*MEMBER, "part", "n")


def first_meeting(members: DataFrame, sets: DataFrame, threshold: float) -> tuple[Classes, DataFrame]:
    """Every node meets one leader, of its buckets' smallest nodes the one whose map differs least: the classes that
    makes, and the pairs (a, b) tried. One pair a node at most."""
    heads = members.groupBy(F.col("bucket").alias("_bucket")).agg(F.min(F.struct("node", "size", "bits")).alias("head"))
    heads = heads.select("_bucket", F.col("head.node").alias("leader"), F.col("head.size").alias("_size"), F.col("head.bits").alias("_bits"))
    met = members.join(heads, F.col("bucket") == F.col("_bucket")).where((F.col("leader") < F.col("node")) & allowed(threshold))
    nearest = F.struct((apart() / (F.col("size") + F.col("_size"))).alias("apart"), "leader")
    pairs = settle(met.groupBy(F.col("node").alias("b")).agg(F.min(nearest).alias("head")).select(F.col("head.leader").alias("a"), "b"))
    links = settle(verified(pairs, sets, threshold).select("a", "b"))
    found = Classes().joined_by(links)
    release(links)
    return found, pairs


def resolve(members: DataFrame, sets: DataFrame, found: Classes, tested: DataFrame | None, threshold: float, rounds: int | None, leaders: int = 1) -> tuple[Classes, DataFrame]:
    """Rounds of leaders over buckets: members (settled: bucket, node, leads: whether the node may lead, size, bits); ``tested``: pairs
    that have met. Returns the classes and the members of buckets that still hold a leader of a class which hasn't met
    the others (none, if the rounds have no limit). The number of a bucket's leaders starts at ``leaders`` and doubles
    each round, or where rounds have no limit becomes sixteen times as many."""
    tries = [] if tested is None else [tested]
    done = 0
    while True:
        open_ = settle(still_open(members, found), members)
        if open_.isEmpty() or done == rounds:
            release(*tries)
            return found, open_
        # leaders come from a bucket's smallest classes: outsiders meet a large class, not the other way round
        order = Window.partitionBy("bucket").orderBy("n", "part", "node")
        heads = open_.where("leads").withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= leaders << (done if rounds else 4 * done))
        heads = settle(heads.select(F.col("bucket").alias("_bucket"), F.col("node").alias("leader"), F.col("part").alias("of"), F.col("size").alias("_size"), F.col("bits").alias("_bits")))
        met = open_.join(heads, F.col("bucket") == F.col("_bucket")).where((F.col("part") != F.col("of")) & allowed(threshold))
        ends = [F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b"), F.least("of", "part").alias("pa"), F.greatest("of", "part").alias("pb")]
        pairs = met.select(*ends).distinct()
        for t in tries:
            pairs = pairs.join(t.select("a", "b"), ["a", "b"], "left_anti")
        pairs = settle(pairs)
        links = settle(verified(pairs, sets, threshold).select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct())
        found = found.joined_by(links)
        tries.append(pairs)
        # the leaders have met all other classes of their buckets
        members = settle(open_.join(heads, (F.col("bucket") == F.col("_bucket")) & (F.col("node") == F.col("leader")), "left_anti").select(*MEMBER), open_, heads, links)
        done += 1


def prefixes(nodes: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Buckets of an exact filter: (bucket, node, leads). In the order of frequency, rarest first, sets of n and m >= n
    shingles that are as similar as the threshold t share ``need = ceil(t (n + m) / (1 + t))`` shingles, and the first
    that they share is among the first ``m - need + 1`` of the larger and ``n - need + 1`` of the smaller. With m <= n / t
    and m >= n that is within ``m - ceil(t m) + 1`` and ``n - ceil(2 t n / (1 + t)) + 1``. A node leads in a bucket if
    it lies within the second, shorter bound; others only meet leaders. Shingles of a passage that many texts share
    come late in the order, and their buckets seldom have a leader."""
    each = nodes.join(sets, "node").select("node", F.size("shingles").alias("n"), F.explode("shingles").alias("bucket"))
    counts = each.groupBy("bucket").agg(F.count(F.lit(1)).alias("times"))
    placed = each.join(counts, "bucket").withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy("times", "bucket")))
    bound = lambda share: F.col("n") - F.ceil(F.lit(share) * F.col("n") - 1e-9) + 1
    return placed.where((F.col("place") <= bound(threshold)) & (F.col("times") > 1)).select("bucket", "node", (F.col("place") <= bound(2 * threshold / (1 + threshold))).alias("leads"))


def classes(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = 0.8,
    registers: int = 192,
    band_rows: int = 6,
    rounds: int = 1,
) -> DataFrame:
    """doc_id, class_id (long: the smallest id of its class), kept (boolean: the class's row that stays), node (binary:
    equal for equal word lists), a row for each row of ``docs``.

    Null, empty and wordless texts are copies of one another. Of rows that repeat with the same id and text one is
    kept. Null ids are less than others only if a class has no other. An empty table gives no rows. With the default
    banding a pair at similarity 0.8 is missed with odds of 6 in 100,000, and at 0.85 of 3 in 10 million.
    """
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), normal(text_or_empty(text_col)).alias("norm")).select("doc_id", node_of(F.col("norm")).alias("node"), "norm")
    signed = settle(banded(read, registers, band_rows).withColumn("number", F.monotonically_increasing_id()))
    rows = settle(signed.select("doc_id", "number", "node"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("void"), "doc_id", "number"))
    nodes = signed.groupBy("node").agg(first.alias("first"), F.first("bands").alias("bands"))
    nodes = settle(nodes.select("node", F.col("first.doc_id").alias("rep"), F.col("first.number").alias("number"), "bands"), signed)
    buckets = nodes.select("node", F.explode("bands").alias("bucket"))
    # a bucket of one node says nothing; of buckets with the same nodes (by number and sum of hashes) one is enough
    shared = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("all"), F.min("node").alias("low"), F.max("node").alias("high")).where("n > 1")
    shared = settle(shared.groupBy("n", "all", "low", "high").agg(F.min("bucket").alias("_bucket")).select("_bucket"))
    members = settle(buckets.join(shared, F.col("bucket") == F.col("_bucket")).select("bucket", "node", F.lit(True).alias("leads")))
    reps = settle(nodes.select("node", "rep", "number"), nodes, shared)
    involved = members.select("node").distinct().join(reps, "node").select(F.col("node").alias("_node"), F.col("rep").alias("_rep"))
    texts = read.join(involved, (F.col("node") == F.col("_node")) & F.col("doc_id").eqNullSafe(F.col("_rep"))).select("node", "norm")
    sets = settle(shingled(texts).dropDuplicates(["node"]))
    members = settle(described(members, sets), members)
    found, tested = first_meeting(members, sets, threshold)
    found, rest = resolve(members, sets, found, tested, threshold, rounds)
    if not rest.isEmpty():
        left = settle(rest.select("node").distinct(), rest)
        found, rest = resolve(settle(described(prefixes(left, sets, threshold), sets), left), sets, found, None, threshold, None, leaders=4)
    release(sets, rest)
    labelled = found.of(reps)
    # the row that stays: the smallest id, of equal ids the smallest node, and of equal rows the first written
    low = labelled.groupBy("part").agg(F.min(F.struct(F.col("rep").isNull().alias("void"), "rep", "node", "number")).alias("low"))
    low = low.select(F.col("part").alias("_part"), "low")
    grouped = labelled.join(low, F.col("part") == F.col("_part")).select(F.col("node").alias("_node"), F.col("low.rep").alias("class_id"), F.col("low.number").alias("stays"))
    joined = rows.join(grouped, F.col("node") == F.col("_node"))
    return joined.select("doc_id", "class_id", (F.col("number") == F.col("stays")).alias("kept"), "node")


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, one for each class of near-duplicates; see ``classes``. Of rows alike in id and
    text the one that is first by a hash of all its columns stays, so reruns agree."""
    key = lambda node, doc: F.sha2(F.concat(F.hex(node), F.lit(":"), F.coalesce(doc.cast("string"), F.lit("null"))), 256)
    stay = settle(classes(docs, id_col=id_col, text_col=text_col, **options).where("kept").select(key(F.col("node"), F.col("doc_id")).alias("stay")).distinct())
    keyed = wrapped(docs, key=key(node_of(normal(text_or_empty(text_col))), F.col(id_col)))
    found = keyed.join(stay, F.col("key") == F.col("stay"), "left_semi")
    once = Window.partitionBy("key").orderBy(F.md5(F.to_json("row")))
    return found.withColumn("turn", F.row_number().over(once)).where("turn = 1").select("row.*")
