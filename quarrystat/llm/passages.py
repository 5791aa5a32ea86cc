"""Substring deduplication: passages of a window's length or more that stand in several places are removed.

Difference-cover anchors. Positions of a text whose remainder modulo a period lies in a difference cover are anchors; a
short hash of the words that follow is kept for them alone. For any two places there is an offset below the period at which
both have an anchor, so two equal windows share an aligned anchor of ``window - period + 1`` words. Only around anchors
that are shared is a match extended: the whole windows that hold such an anchor are compared, by 128 bits. Equal texts are
one text for all this, and a hash stands once or twice for a text, so no group has more rows than there are different texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrystat.llm.common import settle, text_or_empty

#: Difference covers: every remainder of the period is a difference of two members.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18), 57: (0, 1, 3, 13, 32, 36, 43, 52)}

#: Odd multipliers of the two rolling hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def period_for(window: int) -> int:
    """The longest period that leaves two fifths of a window to an anchor."""
    return max(p for p in COVERS if p == 1 or 5 * p <= 3 * window)


def powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.append(np.uint64(1), np.full(max(n, 1), base, np.uint64)))[: n + 1]


class Rolling:
    """Hashes of all runs of words of a text, by prefix sums modulo 2**64; the tables of powers grow with the longest text."""

    def __init__(self) -> None:
        self.up, self.down = ([np.ones(1, np.uint64)] * 2 for _ in range(2))

    def hashes(self, words: list[bytes], width: int, lane: int) -> np.ndarray:
        n = len(words)
        if n < width:
            return np.zeros(0, np.uint64)
        if len(self.up[lane]) <= n:
            self.up[lane], self.down[lane] = powers(BASES[lane], 2 * n), powers(pow(BASES[lane], -1, 1 << 64), 2 * n)
        h = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), "<u8").reshape(n, 2)[:, lane]
        sums = np.append(np.uint64(0), np.cumsum(h * self.up[lane][:n]))
        return (sums[width:] - sums[: n - width + 1]) * self.down[lane][: n - width + 1]


def twice_at_most(values: np.ndarray) -> np.ndarray:
    """Each value once, and again if it stands more than once."""
    single, counts = np.unique(values, return_counts=True)
    return np.append(single, single[counts > 1])


def same(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs: the number of each one's class, the place where each class stands first, and its size."""
    order = np.lexsort((b, a))
    new = np.append(True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1]))[: len(a)]
    number = np.zeros(len(a), np.int64)
    number[order] = np.cumsum(new) - 1
    return number, order[new], np.bincount(number)


def anchors(rolling: Rolling, words: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of a text's anchors; a text shorter than a window has none."""
    period = period_for(window)
    h = rolling.hashes(words, window - period + 1, 0) if len(words) >= window else np.zeros(0, np.uint64)
    at = np.flatnonzero(np.isin(np.arange(len(h)) % period, COVERS[period]))
    return at, h[at].view(np.int64)


def extended(rolling: Rolling, words: list[bytes], window: int, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and both hashes of the windows that hold a shared anchor."""
    at, h = anchors(rolling, words, window)
    at = at[np.isin(h, shared)]
    period, last = period_for(window), max(len(words) - window, -1)
    steps = np.zeros(last + 2, np.int64)
    np.add.at(steps, np.clip(at - period + 1, 0, last + 1), 1)
    np.add.at(steps, np.clip(at + 1, 0, last + 1), -1)
    starts = np.flatnonzero(np.cumsum(steps)[:-1] > 0)
    return starts, rolling.hashes(words, window, 0)[starts].view(np.int64), rolling.hashes(words, window, 1)[starts].view(np.int64)


def sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def profiles(texts: DataFrame, window: int) -> DataFrame:
    """Each text with its count of words, their hash, and its anchors."""

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for batch in batches:
            split = [t.split() for t in batch["text"].cast(pa.binary()).to_pylist()]
            found = [twice_at_most(anchors(rolling, w, window)[1]) for w in split]
            made = [pa.array([len(w) for w in split], pa.int64()), pa.array(map(sha, split)), pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "n_words", "kept", "anchors"])

    return texts.mapInArrow(profile, T.StructType([*texts.schema.fields, *T._parse_datatype_string("n_words long, kept string, anchors array<long>").fields]))


def windows(candidates: DataFrame, window: int) -> DataFrame:
    """The different windows that hold a shared anchor, twice where they stand more than once in their text."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for batch in batches:
            for key, text, shared in zip(batch["id"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist(), batch["shared"], strict=True):
                starts, a, b = extended(rolling, text.split(), window, shared.values.to_numpy())
                _, first, size = same(a, b)
                first = np.append(first, first[size > 1])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), key)), pa.array(starts[first]), pa.array(a[first]), pa.array(b[first])], ["id", "at", "a", "b"])

    return candidates.mapInArrow(hashes, "id long, at long, a long, b long")


def removed(marked: DataFrame, window: int) -> DataFrame:
    """The count of words that a repeated window covers, and the others' hash; ``repeated`` holds the first starts of repeated windows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for batch in batches:
            counts, kept = [], []
            for text, shared, repeated in zip(batch["text"].cast(pa.binary()).to_pylist(), batch["shared"], batch["repeated"], strict=True):
                words = text.split()
                starts, a, b = extended(rolling, words, window, shared.values.to_numpy())
                number, first, _ = same(a, b)
                starts = starts[np.isin(starts[first], repeated.values.to_numpy())[number]]
                steps = np.zeros(len(words) + 1, np.int64)
                np.add.at(steps, starts, 1)
                np.add.at(steps, starts + window, -1)
                keeps = np.cumsum(steps)[:-1] == 0
                counts.append(len(words) - int(keeps.sum()))
                kept.append(sha([words[i] for i in np.flatnonzero(keeps).tolist()]))
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(counts, pa.int64()), pa.array(kept, pa.string())], ["id", "n_removed", "kept_less"])

    return marked.mapInArrow(cut, "id long, n_removed long, kept_less string")


def both_hashes(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2")]


def several(rows: DataFrame, *names: str) -> DataFrame:
    """The values that stand in two rows or more."""
    return rows.groupBy(*names).agg(F.count("*").alias("times")).where("times > 1").select(*names)


def without_repeats(docs: DataFrame, *, window: int = 35) -> DataFrame:
    """Every row of ``docs``, whole as a struct ``row``, with n_words, n_removed and kept_sha256: of its text's words those
    are removed that a run of ``window`` words covers which starts anywhere else too, unchanged, in that text or another.

    Words are what white space separates. Null texts have none. All places of a passage lose it, and so do repeated rows.
    A text shorter than a window keeps all its words. No column of ``docs`` can clash, whatever its name, and ids are not
    read, so they may be null or repeat. An empty table gives no rows.
    """
    text = text_or_empty()
    texts = docs.select(text.alias("text")).groupBy("text").agg(F.count("*").alias("copies"))
    texts = texts.select(F.monotonically_increasing_id().alias("id"), *both_hashes(F.col("text")), "text", "copies")
    profiled = settle(profiles(texts, window))
    rows = profiled.select("id", F.explode("anchors").alias("anchor"))
    shared = settle(several(rows, "anchor"))
    held = settle(rows.join(shared, "anchor").groupBy("id").agg(F.collect_set("anchor").alias("shared")), shared)
    candidates = settle(profiled.select("id", "text").join(held, "id"), held)
    profiled = settle(profiled.drop("text", "anchors"), profiled)
    extended_rows = settle(windows(candidates, window))
    repeated = settle(several(extended_rows, "a", "b"))
    starts = extended_rows.join(repeated, ["a", "b"]).groupBy("id").agg(F.collect_set("at").alias("repeated"))
    less = settle(removed(candidates.join(starts, "id"), window), candidates, extended_rows, repeated)
    copied = (F.col("copies") > 1) & (F.col("n_words") >= window)
    judged = profiled.join(less, "id", "left").select(
        "k1", "k2", "n_words",
        F.when(copied, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copied, F.lit(sha([]))).otherwise(F.coalesce("kept_less", "kept")).alias("kept_sha256"),
    )
    judged = settle(judged, profiled, less)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *both_hashes(text))
    return whole.join(judged, ["k1", "k2"]).select("row", "n_words", "n_removed", "kept_sha256")
