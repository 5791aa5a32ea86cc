"""Periodic runs: stretches of words that repeat with a period, found by the algorithm of Kolpakov and Kucherov.

A text is cut into Lempel-Ziv factors by its suffix automaton. Main's algorithm finds the runs that cross or touch the
border of two factors: extensions of the words at the border to both sides, by Z-functions, for all periods at once. Runs
that lie inside a factor are copied from its earlier occurrence. All is linear in the words.

Before it, a text is reduced to the stretches in which every eight words stand elsewhere in the text as well. No run is
lost or cut by that. In a run of length max(24, 3 * period) or more, eight words at any place stand again a period further
or before, as do those that would extend it.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrystat.llm.common import text_or_empty
from quarrystat.llm.passages import Rolling

#: A run has so many words and periods at least.
LEAST, TIMES = 24, 3

#: Words of the strings that have to stand twice; 3 * NEAR is LEAST, which the reduction needs.
NEAR = LEAST // 3


class Run(NamedTuple):
    start: int
    length: int
    period: int


def factors(word: list[int]) -> list[tuple[int, int]]:
    """The Lempel-Ziv factors as (length, place of an earlier occurrence or -1): each the longest start of what is left
    that begins before, or a new letter."""
    link, size, end = [-1], [0], [-1]
    moves: list[dict[int, int]] = [{}]
    last = 0
    for i, c in enumerate(word):
        new = len(size)
        size.append(size[last] + 1)
        end.append(i)
        link.append(0)
        moves.append({})
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if size[p] + 1 == size[q]:
                link[new] = q
            else:
                copy = len(size)
                size.append(size[p] + 1)
                end.append(end[q])
                link.append(link[q])
                moves.append(dict(moves[q]))
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    found, i, n = [], 0, len(word)
    while i < n:
        state, j = 0, i
        while j < n:
            follows = moves[state].get(word[j])
            if follows is None or end[follows] >= j:
                break
            state, j = follows, j + 1
        found.append((j - i, end[state] - (j - i) + 1) if j > i else (1, -1))
        i = max(j, i + 1)
    return found


def z_function(s: list[int]) -> np.ndarray:
    """For each place the length of the longest common start of the whole and of what begins there."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return np.array(z, np.int64)


def bordering(word: list[int], low: int, border: int, high: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of the long runs within [low, high) that hold a whole period just before or after ``border``."""
    left, right = word[low:border], word[border:high]
    m, n = len(left), len(right)
    back = left[::-1]
    after_border, before_border = z_function(right), z_function(back)
    for size, sign in ((n, 1), (m, -1)):
        if not size:
            continue
        period = np.arange(1, size + 1)
        if sign > 0:  # what ends at border + period against what ends at the border; likewise forward
            before = z_function([*back, -1, *right[::-1], *back])[m + 1 : m + 1 + n][::-1]
            after = np.append(after_border[1:], 0)
        else:
            before = np.append(before_border[1:], 0)
            after = z_function([*right, -1, *left, *right])[n + 1 : n + 1 + m][::-1]
        for i in np.flatnonzero(before + period + after >= np.maximum(LEAST, TIMES * period)).tolist():
            base = border if sign > 0 else border - i - 1
            yield base - int(before[i]), base + i + 1 + int(after[i]), i + 1


def runs_of(word: list[int]) -> list[Run]:
    """All runs of the least length and number of periods, by start, then period."""
    n = len(word)
    period: dict[tuple[int, int], int] = {}  # the smallest of each stretch (start, end)
    order: list[tuple[int, int]] = []  # the stretches

    def add(start: int, end: int, q: int) -> None:
        if (start, end) not in period:
            insort(order, (start, end))
        period[start, end] = min(q, period.get((start, end), q))

    def at_border(border: int, before: int, after: int) -> None:
        """Runs that touch the border of factors of these lengths and end in the second. A longer one would make the
        first factor longer, so neither starts further left, nor is there one if both are short."""
        if before + after > 2 * LEAST // TIMES:
            low = max(0, border - 2 * before - after - 1)
            for s, e, q in bordering(word, low, border, min(n, border + after + 1)):
                if (s > low or low == 0) and e <= border + after:
                    add(s, e, q)

    begin = previous = 0
    for length, source in factors(word):
        at_border(begin, previous, length)
        if source >= 0 and length > LEAST:
            copied = order[bisect_left(order, (source + 1, 0)) : bisect_left(order, (source + length, 0))]
            for s, e in copied:  # grows where the factor overlaps its source
                if e < source + length:
                    new = (s - source + begin, e - source + begin)
                    if new[0] < source + length:
                        copied.append(new)
                    add(*new, period[s, e])
        begin, previous = begin + length, length
    at_border(n, previous, 0)
    return sorted((Run(s, e - s, q) for (s, e), q in period.items()), key=lambda r: (r.start, r.period))


def repeating(rolling: Rolling, words: list[bytes]) -> list[tuple[int, int]]:
    """The stretches of LEAST words or more in which every NEAR words stand elsewhere in the text too."""
    if len(words) < LEAST:
        return []
    _, place, counts = np.unique(rolling.hashes(words, NEAR, 0), return_inverse=True, return_counts=True)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], counts[place] > 1, [0]])))
    found = zip(edges[::2].tolist(), (edges[1::2] + NEAR - 1).tolist(), strict=True)
    return [(a, b) for a, b in found if b - a >= LEAST]


def find(rolling: Rolling, words: list[bytes]) -> list[Run]:
    """All runs of a text."""
    found = []
    for begin, end in repeating(rolling, words):
        numbers: dict[bytes, int] = {}
        found += [Run(begin + r.start, r.length, r.period) for r in runs_of([numbers.setdefault(w, len(numbers)) for w in words[begin:end]])]
    return sorted(set(found), key=lambda r: (r.start, r.period))


def kept(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without what runs repeat: all but a run's first period."""
    keeps = np.ones(len(words), bool)
    for r in runs:
        keeps[r.start + r.period : r.start + r.length] = False
    return [words[i] for i in np.flatnonzero(keeps).tolist()] if runs else words


def collapse(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """For each row of ``docs``, its other columns as a struct ``row``, and of its whole text: ``runs``, an array of (start,
    length, period) in words from 0, by start, then period; and ``collapsed``, its words with one blank between, each run
    cut to its first period.

    A run is a stretch of words with that smallest period, of 24 words and three periods at least, which no neighbouring
    word extends. Null and empty texts have no words: no runs and an empty text. Each row is for itself, so ids may be null
    or repeat, and no column can clash. A task holds the automaton of one stretch of repeating words at a time, some 500
    bytes a word. An empty table gives no rows.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for batch in batches:
            found, texts = [], []
            for text in batch["text"].cast(pa.binary()).to_pylist():
                words = text.split()
                found.append(find(rolling, words))
                texts.append(b" ".join(kept(words, found[-1])))
            made = pa.array([[r._asdict() for r in f] for f in found], pa.list_(pa.struct([(f, pa.int64()) for f in Run._fields])))
            yield pa.RecordBatch.from_arrays([batch["row"], made, pa.array(texts, pa.binary()).cast(pa.string())], ["row", "runs", "collapsed"])

    rows = docs.select(F.struct(F.lit(0).alias("nothing"), *[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row"), text_or_empty(text_col).alias("text"))
    schema = T.StructType([rows.schema["row"], *T._parse_datatype_string("runs array<struct<start: long, length: long, period: long>>, collapsed string").fields])
    return rows.mapInArrow(judge, schema).withColumn("row", F.col("row").dropFields("nothing") if len(docs.columns) > 1 else F.col("row"))
