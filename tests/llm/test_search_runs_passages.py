"""Lexical search, periodic runs and repeated passages against brute force; nulls, ties, repeated rows, clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarrystat.llm import lexical, passages, periodic
from quarrystat.llm import queries as registered


# ---- lexical search

def brute_search(docs, items, k):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(i, terms(t)) for i, t in docs]
    held = [(i, w) for i, w in held if w]
    n, length = len(held), sum(len(w) for _, w in held)
    df = Counter(x for _, w in held for x in set(w))
    found = []
    for item, text in items:
        scored = []
        for doc, w in held:
            tf = Counter(w)
            m = 50 + 50 * len(w) * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (1_000_000_000 * tf[x] // (1000 * tf[x] + 20 * m)) for x in set(terms(text)) if tf[x])
            if s > 0:
                scored.append((-s, doc is None, doc or 0, doc))
        found += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(found, key=str)


@pytest.fixture(scope="module")
def searched():
    rng = random.Random(3)
    word = lambda: f"W{int(300 * rng.random() ** 3)}"
    docs = [(i, " ".join(word() for _ in range(rng.randint(1, 60)))) for i in range(300)]
    docs += [(7, docs[3][1]), (301, docs[3][1]), (302, docs[3][1]), (None, docs[3][1]), (303, None), (304, ""), (305, "?? --"), (306, "Ünïcode é w1 W1 w1-w2_w3"), (307, "w5 " * 20_000)]
    items = [(i, " ".join(word() for _ in range(rng.randint(1, 12)))) for i in range(25)] + [(25, None), (26, ""), (27, "absent"), (3, "w1 w1 w2"), (None, "é w290 W291"), (28, "w0")]
    return docs, items


@pytest.mark.parametrize(("k", "most"), [(5, 8_000_000), (50, 300), (1, 8_000_000)])
def test_search_equals_brute_force(spark, searched, k, most):
    docs, items = searched
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"score": F.lit(-1), "rank": F.lit("x"), "a.b": F.lit(1)})
    got = lexical.search(table.repartition(5), spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit(2)), k=k, most_bytes=most)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_search(docs, items, k)


def test_search_prunes_only_what_cannot_win():
    import numpy as np

    most, kth = np.array([900, 500, 40, 30, 20]), np.array([0, 100, 35, 30, 20])
    left, threshold = lexical.needed(np.arange(5), most, kth)
    assert threshold == 100
    assert sorted(left.tolist()) == [0, 1]  # the last three have 90 together
    assert lexical.needed(np.arange(5), most, np.zeros(5, int))[0].tolist() == [0, 1, 2, 3, 4]


def test_search_of_empty_tables(spark):
    none, some = spark.createDataFrame([], "doc_id string, text string"), spark.createDataFrame([("a", "b c")], "doc_id string, text string")
    items = spark.createDataFrame([(1, "b")], "item_id long, text string")
    assert lexical.search(none, items).collect() == []
    assert lexical.search(some, items.where("false")).collect() == []
    assert [tuple(r) for r in lexical.search(some, items).collect()][0][:3] == (1, 1, "a")


# ---- periodic runs

def brute_runs(w):
    n, best = len(w), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(24, 3 * q):
                best.setdefault((i, j + q), q)
            i = j
    return sorted((s, e - s, q) for (s, e), q in best.items())


def words_with_runs(rng):
    letters = rng.choice([1, 2, 2, 3, 5])
    w = []
    for _ in range(rng.randint(1, 6)):
        kind = rng.choice(["any", "period", "copy", "tail"])
        if kind == "any" or not w:
            w += [rng.randrange(letters) for _ in range(rng.randint(1, 20))]
        elif kind == "period":
            unit = [rng.randrange(letters) for _ in range(rng.randint(1, 14))]
            w += (unit * 40)[: rng.randint(len(unit), len(unit) * 6 + 24)]
        elif kind == "copy":
            a = rng.randrange(len(w))
            w += w[a : rng.randint(a, len(w))]
        else:
            w += w[-rng.randint(1, 80) :] * rng.randint(1, 4)
    return w[:400]


def test_runs_equal_brute_force():
    rng, rolling, several = random.Random(8), passages.Rolling(), 0
    for _ in range(1500):
        w = words_with_runs(rng)
        expected = brute_runs(w)
        several += len(expected) > 1
        assert [tuple(r) for r in periodic.runs_of(w)] == expected
        assert [tuple(r) for r in periodic.find(rolling, [b"%d" % x for x in w])] == expected
    assert several > 100


def test_factors_are_the_longest_that_began_before():
    rng = random.Random(2)
    for _ in range(200):
        w = words_with_runs(rng)[:120]
        at = 0
        for length, source in periodic.factors(w):
            longest = max((next((k for k in range(len(w) - at) if w[p + k] != w[at + k]), len(w) - at) for p in range(at)), default=0)
            assert length == max(longest, 1)
            assert source == -1 or (source < at and w[source : source + length] == w[at : at + length])
            at += length
        assert at == len(w)


def test_runs_of_a_table(spark):
    long_text = "x y z " * 40_000
    rows = [(1, None), (None, ""), (3, "a b c " * 9), (3, "a b c " * 9), (4, "Same\nsame " * 15), (5, long_text), (6, " \t"), (7, "p q " * 11)]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"runs": F.lit(1), "row": F.lit(2), "a.b": F.lit(3)})
    got = [(r["row"]["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic.collapse(table).collect()]
    expected = [(1, [], ""), (None, [], ""), (3, [(0, 27, 3)], "a b c"), (3, [(0, 27, 3)], "a b c"), (4, [(0, 30, 2)], "Same same"), (5, [(0, 120_000, 3)], "x y z"), (6, [], ""), (7, [], "p q " * 10 + "p q")]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert set(periodic.collapse(table).schema["row"].dataType.names) == {"doc_id", "runs", "row", "a.b"}
    assert periodic.collapse(table.where("false")).collect() == []


def test_registered_runs_alter_one_text_in_ten(spark):
    import zlib

    rng = random.Random(4)
    rows = [(i, " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randint(1, 90)))) for i in range(120)] + [(None, "a b"), (200, None), (10, "")]
    got = {(r["doc_id"], r["text"]) for r in registered.periodic_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    expected = set()
    for i, t in rows:
        h, w = zlib.crc32(("null" if i is None else str(i)).encode()), (t or "").split()
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
        expected.add((i, " ".join(w)))
    assert {(i, " ".join(t.split())) for i, t in got} == expected


# ---- passages

def brute_passages(texts, window):
    split = [(t or "").encode().split() for t in texts]
    counts = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    found = []
    for w in split:
        gone = {j for i in range(len(w) - window + 1) if counts[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        found.append((len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()))
    return found


@pytest.mark.parametrize("period", sorted(passages.COVERS))
def test_covers_have_every_difference(period):
    assert {(a - b) % period for a in passages.COVERS[period] for b in passages.COVERS[period]} == set(range(period))


@pytest.mark.parametrize("window", [35, 8, 2])
def test_passages_equal_brute_force(spark, window):
    rng = random.Random(window)
    fresh = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    passage, long = fresh(window + 12), fresh(30_000)
    texts = [" ".join(fresh(rng.randint(0, 30)) + passage[rng.randint(0, 3) : window + rng.randint(-2, 12)] + fresh(rng.randint(0, 30))) for _ in range(60)]
    texts += [" ".join(passage), " ".join(passage[:window]), " ".join(passage[: window - 1]), " ".join(passage[: window // 2]), " ".join(passage[: window * 3 // 4]), None, "", " \n\t", texts[0], texts[0], " ".join(long), " ".join([*fresh(3), *long[100:25_000], *fresh(3)])]
    texts += ["same words again and " * 200, "same words again and", " ".join(fresh(40) * 2), "Ünï code x " * window, "a\x0bb\x0cc " * window, texts[3].replace(" ", "\n\t")]
    rows = [(None if i % 9 == 0 else i // 2, t) for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_words": F.lit(-1), "kept": F.lit("x"), "id": F.lit(1), "a.b": F.lit(1)})
    got = passages.without_repeats(table.repartition(4), window=window)
    assert got.columns == ["row", "n_words", "n_removed", "kept_sha256"]
    found = sorted(((r["row"]["doc_id"], r["row"]["text"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got.collect()), key=str)
    assert found == sorted(((i, t, *b) for (i, t), b in zip(rows, brute_passages(texts, window), strict=True)), key=str)


def test_passages_of_an_empty_table(spark):
    assert passages.without_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
