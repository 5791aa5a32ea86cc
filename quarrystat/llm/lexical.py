"""Ranked lexical search: the k documents with the highest term scores for each item.

A threshold-seeded join. For every term of the items the k-th highest impact that it has in any document is kept, with
its highest. An item's k-th score is at least the greatest k-th impact of its terms, since k documents have that much from
one term alone. The item's terms are put in order of highest impact, and those at the end whose highest impacts together
stay below that threshold are pruned: a document that holds no other term of the item can't be among its k. Candidates are
the documents that hold a term which is left, and they alone are scored, exactly and by all terms of the item.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrystat.llm.common import release, settle, text_or_empty

#: Bytes of text to bytes of terms with blanks between: digits, letters (A-Z as a-z) and all that isn't ASCII stay.
TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

#: Cells of a task's table of impacts (8 bytes each), and rows that a task holds before it keeps the best of them.
CELLS, HELD = 1 << 22, 1 << 18


class Corpus(NamedTuple):
    """Of all documents with a term: how many, and how many terms they have together."""

    documents: int
    terms: int


class Block(NamedTuple):
    """Some of the items: their terms by number, and for each item the numbers of its terms."""

    keys: list[int]
    numbers: dict[bytes, int]
    terms: list[np.ndarray]


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERMS).split()


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def impacts(weights: np.ndarray, times: np.ndarray, lengths: np.ndarray, corpus: Corpus) -> np.ndarray:
    """What a term adds to a document's score: its weight by its saturated frequency. All in 64-bit integers."""
    damping = 50 + 50 * lengths * corpus.documents // corpus.terms
    return weights * (1_000_000_000 * times // (1000 * times + 20 * damping))


def block_of(rows: list) -> Block:
    numbers: dict[bytes, int] = {}
    terms = [np.fromiter({numbers.setdefault(t, len(numbers)): 0 for t in terms_of(r["text"].encode())}, np.int64) for r in rows]
    return Block([r["key"] for r in rows], numbers, terms)


def profiles(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """Each document's count of terms, and how often it holds which of the numbered ones."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, held, times = [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                found = terms_of(text)
                at = np.fromiter(map(numbers.get, found, repeat(-1)), np.int32, len(found))
                own, counts = np.unique(at[at >= 0], return_counts=True)
                lengths.append(len(found))
                held.append(own)
                times.append(counts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), pa.array(held, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "times"])

    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string("n long, terms array<int>, times array<long>").fields])
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(count, schema)


def postings(batch: pa.RecordBatch, weights: np.ndarray, corpus: Corpus) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row in the batch, term and impact of all postings of a batch of profiles."""
    sizes = batch["terms"].value_lengths().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(batch)), sizes)
    term = batch["terms"].flatten().to_numpy()
    return row, term, impacts(weights[term], batch["times"].flatten().to_numpy(), batch["n"].to_numpy()[row], corpus)


def first_of(groups: np.ndarray, k: int) -> np.ndarray:
    """Which rows are among the first k of their group; ``groups`` is in order."""
    if not len(groups):
        return np.zeros(0, bool)
    begins = np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))
    return np.arange(len(groups)) - np.repeat(begins, np.diff(np.append(begins, len(groups)))) < k


def leading(rows: DataFrame, group: str, order: list, k: int) -> DataFrame:
    """The first k rows of each group and their place: first of each of 32 slices of it, then of all."""
    sliced = rows.withColumn("slice", F.spark_partition_id() % 32)
    sliced = sliced.withColumn("rank", F.row_number().over(Window.partitionBy(group, "slice").orderBy(*order))).where(F.col("rank") <= k)
    return sliced.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k).drop("slice")


def kept_impacts(profiled: DataFrame, weights: np.ndarray, corpus: Corpus, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each term its highest impact, and its k-th (0 if fewer documents hold it)."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        term, impact = np.zeros(0, np.int32), np.zeros(0, np.int64)

        def shorten() -> None:
            nonlocal term, impact
            order = np.lexsort((-impact, term))
            term, impact = term[order], impact[order]
            keep = first_of(term, k)
            term, impact = term[keep], impact[keep]

        least = 0
        for batch in batches:
            _, t, i = postings(batch, weights, corpus)
            term, impact = np.append(term, t), np.append(impact, i)
            if len(term) > 2 * least + HELD:
                shorten()
                least = len(term)
        shorten()
        yield pa.RecordBatch.from_arrays([pa.array(term, pa.int32()), pa.array(impact, pa.int64())], ["term", "impact"])

    rows = leading(profiled.select("n", "terms", "times").mapInArrow(best, "term int, impact long"), "term", [F.desc("impact")], k)
    found = rows.groupBy("term").agg(F.max("impact").alias("most"), F.coalesce(F.max(F.when(F.col("rank") == k, F.col("impact"))), F.lit(0)).alias("kth")).toPandas()
    most, kth = np.zeros(len(weights), np.int64), np.zeros(len(weights), np.int64)
    most[found["term"]], kth[found["term"]] = found["most"], found["kth"]
    return most, kth


def needed(terms: np.ndarray, most: np.ndarray, kth: np.ndarray) -> tuple[np.ndarray, int]:
    """An item's terms that generate candidates, and the lower bound of its k-th score."""
    threshold = int(kth[terms].max(initial=0))
    order = terms[np.argsort(-most[terms], kind="stable")]
    suffix = np.cumsum(most[order][::-1])[::-1]
    return order[suffix >= max(threshold, 1)], threshold


def scored(profiled: DataFrame, block: Block, weights: np.ndarray, corpus: Corpus, most: np.ndarray, kth: np.ndarray, k: int) -> DataFrame:
    """Candidates of the block's items with their exact scores, the first k of each item and task."""
    generating, thresholds = zip(*[needed(t, most, kth) for t in block.terms], strict=True)
    pairs = np.array(sorted((t, i) for i, own in enumerate(generating) for t in own.tolist()), np.int64).reshape(-1, 2)
    begins = np.searchsorted(pairs[:, 0], np.arange(len(weights) + 1))
    sizes = np.array([len(t) for t in block.terms])
    starts = np.append(0, np.cumsum(sizes))
    listed = np.concatenate(block.terms)
    step = max(1, CELLS // max(len(weights), len(listed), 1))
    kind = profiled.schema["doc_id"].dataType
    keys = np.array(block.keys, np.int64)

    def spread(begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which range, and which place, for all places of ranges."""
        which = np.repeat(np.arange(len(count)), count)
        return which, np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + begin[which]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = np.array(thresholds, np.int64)
        table = np.zeros((step, len(weights)), np.int64)
        held: list[pa.Table] = []
        rows = 0

        def shorten() -> None:
            nonlocal held, rows
            if not held:
                return
            joined = pa.concat_tables(held).sort_by([("item", "ascending"), ("score", "descending"), ("doc_id", "ascending")])
            item = joined["item"].to_numpy()
            joined = joined.filter(pa.array(first_of(item, k)))
            item, value = joined["item"].to_numpy(), joined["score"].to_numpy()
            full = np.flatnonzero(~first_of(item, k - 1))  # the k-th of items that have so many
            least[item[full]] = np.maximum(least[item[full]], value[full])
            held, rows = [joined.combine_chunks()], 0

        for batch in batches:
            row, term, impact = postings(batch, weights, corpus)
            for first in range(0, len(batch), step):
                a, b = np.searchsorted(row, [first, first + step])
                r, t = row[a:b] - first, term[a:b]
                table[r, t] = impact[a:b]
                which, at = spread(begins[t], begins[t + 1] - begins[t])
                candidates = np.unique(r[which] * len(sizes) + pairs[at, 1])
                doc, item = candidates // len(sizes), candidates % len(sizes)
                which, at = spread(starts[item], sizes[item])
                total = np.add.reduceat(table[doc[which], listed[at]], np.cumsum(sizes[item]) - sizes[item]) if len(item) else np.zeros(0, np.int64)
                table[r, t] = 0
                good = (total > 0) & (total >= least[item])
                held.append(pa.table({"item": item[good], "score": total[good], "doc_id": batch["doc_id"].take(pa.array(doc[good] + first))}))
                rows += int(good.sum())
                if rows > HELD:
                    shorten()
        shorten()
        for found in pa.concat_tables(held).to_batches() if held else []:
            yield pa.RecordBatch.from_arrays([pa.array(keys[found["item"].to_numpy()]), found["score"], found["doc_id"]], ["key", "score", "doc_id"])

    schema = T.StructType([*T._parse_datatype_string("key long, score long").fields, T.StructField("doc_id", kind)])
    return profiled.mapInArrow(score, schema)


def search(docs: DataFrame, items: DataFrame, *, k: int = 50, most_bytes: int = 8_000_000) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``k`` documents with the highest scores above 0 for each row of ``items``
    (item_id, text), out of all ``docs`` (doc_id, text).

    Terms are digits, letters and whatever isn't ASCII, A-Z in lower case, of whole texts. Null and empty texts have no
    terms: such documents aren't found and don't count, such items find nothing. Equal scores go by ascending doc_id, null
    ids last. Repeated rows of documents or items are rows of their own. Other columns are not read. An empty table on
    either side gives no rows. Items are dealt to as many blocks as their texts have ``most_bytes``, and each block meets
    all documents in turn: what a task holds of the items doesn't grow with their number.
    """
    spark = docs.sparkSession
    queue = settle(items.select("item_id", text_or_empty().alias("text"), F.monotonically_increasing_id().alias("key")))
    size = queue.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // most_bytes)
    found = []
    for b in range(blocks):
        block = block_of(queue.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b).select("key", "text").where(F.octet_length("text") > 0).collect())
        profiled = settle(profiles(docs, block.numbers))
        corpus = Corpus(*profiled.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first())
        if corpus.documents and block.numbers:
            holding = np.zeros(len(block.numbers), np.int64)
            for term, count in profiled.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
                holding[term] = count
            weights = np.array([weight(corpus.documents, int(c)) for c in holding], np.int64)
            most, kth = kept_impacts(profiled, weights, corpus, k)
            best = leading(scored(profiled, block, weights, corpus, most, kth, k), "key", [F.desc("score"), F.asc_nulls_last("doc_id")], k)
            found.append(settle(best.select("key", "rank", "doc_id", "score"), profiled))
        else:
            release(profiled)
    if not found:
        return spark.createDataFrame([], T.StructType([items.schema["item_id"], *T._parse_datatype_string("rank int").fields, docs.schema["doc_id"], *T._parse_datatype_string("score long").fields]))
    all_found = found[0]
    for part in found[1:]:
        all_found = all_found.unionAll(part)
    return all_found.join(queue.select("key", "item_id"), "key").select("item_id", "rank", "doc_id", "score")
