"""The operators on small fixtures: nulls, empty and long texts, ties, repeated rows, clashing columns, empty tables."""

import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarrystat.llm import ann, licenses, lm_scoring, mixing, near_dedup, packing, quality_model, quality_rules, quotations, toxicity
from quarrystat.llm import queries as registered
from quarrystat.llm.common import crc_remainder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=400):
    return [f"w{int(vocabulary * rng.random() ** 2)}" for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    made = [" ".join(words(rng, rng.randint(12, 120))) for _ in range(60)]
    made += [made[0], made[1], " ".join([*made[2].split()[:-1], "other"]), made[3] + " tail", None, "", " \t\n\x0b ", "a b c", "A B C"]
    made += ["Released under the MIT License.\nreleased under the mit license", "under the MIT license under the mit license, CC BY-NC 4.0", "é É apache license, version 2.0 ü", "line one is here\n" * 4]
    made += ["x*#| " * 40, " ".join(words(rng, 30_000, 9_000)), "same words again and " * 50, "<|endoftext|> ordinary text"]
    return made


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", ["a", "b", "hot", "hot", "hot", None][i % 6], 1) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, "a text without an id but with words enough to pass the rules of length", "en", "a", 1)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3, "doc_id").persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sql(docs, query, table="documents"):
    con = duckdb.connect()
    con.register(table, docs.toPandas())
    return con.sql(query).df()


def same(a, b):
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    key = lambda r: tuple("" if pd.isna(x) else f"{x:.9g}" if isinstance(x, float) else str(x) for x in r)
    norm = lambda f: Counter(key([None if pd.isna(x) else float(x) if isinstance(x, int | float | np.number) and not isinstance(x, bool | np.bool_) else x for x in r]) for r in f[columns].itertuples(index=False))
    assert norm(a) == norm(b)


def clashing(docs):
    """With columns named like the operators' helpers and results."""
    names = ["_m", "_f", "_s", "_t", "_words", "_blocks", "row", "key", "stay", "turn", "_key", "_stay", "node", "a", "b", "size", "place", "sent", "base", "bucket"]
    return docs.withColumns({n: F.lit("clash") for n in names})


def test_operators_keep_clashing_columns(docs, labelled):
    rows = clashing(docs)
    model = toxicity.fit(*labelled, fits=F.lit(True))
    for got in (licenses.scan(rows), toxicity.score(rows, model), near_dedup.deduplicate(rows), mixing.taken(rows)):
        assert set(rows.columns) <= set(got.columns)
        assert {r["_key"] for r in got.select("_key").distinct().collect()} == {"clash"}
    n = rows.count()
    assert lm_scoring.score(rows, crc_remainder("doc_id", 10) == 0, width=8).count() == n
    assert near_dedup.classes(rows).count() == n and mixing.mix(rows).count() == n
    assert packing.pack_documents(rows).select("doc_id").distinct().count() == rows.select("doc_id").distinct().count()


def test_only_ascii_letters_are_lowered(spark):
    text = "This wor\u212a is licensed under the GNU General Public License version 3"
    df = spark.createDataFrame([(1, text), (2, text.replace("\u212a", "K"))], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in licenses.scan(df).collect()}
    assert got[2] == 1.0 and got[1] < 1.0


def once(docs):
    """Without the repeated ids, which the SQL forms join on."""
    return docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])


def test_rules_match_sql(docs):
    rows = quality_rules.judge(once(docs).select("doc_id", "text")).drop("text")
    same(rows.toPandas(), sql(once(docs), registered.sql7()))


def test_rules_edges_and_ablations(spark, docs, empty):
    rows = quality_rules.judge(docs.withColumn("n_words", F.lit("clash")))
    assert rows.count() == docs.count() and dict(rows.dtypes)["n_words"] == "bigint"
    assert {"_m", "_f", "_words", "row"} <= set(quality_rules.judge(clashing(docs)).columns)
    assert not rows.where("text IS NULL OR trim(text) = ''").where("kept").count()
    assert quality_rules.judge(empty).count() == 0
    got = {r["rule"]: r for r in quality_rules.ablations(rows, "v1").collect()}
    bits = [r["fail_bits"] for r in rows.collect()]
    for i, rule in enumerate(quality_rules.RULES):
        assert got[rule.name]["failed"] == sum(b >> i & 1 for b in bits)
        assert got[rule.name]["only"] == sum(b == 1 << i for b in bits)
        assert got[rule.name]["without"] == sum(b & ~(1 << i) != 0 and b != 0 for b in bits)


def test_licenses_match_sql(docs):
    rows = licenses.scan(once(docs).select("doc_id", "text"))
    same(rows.drop("text").toPandas(), sql(once(docs), registered.sql5()))


def test_licenses_threshold_is_exact(spark):
    """Blocks with every share of a template's words: matched from the threshold on."""
    rng = random.Random(3)
    template = TEMPLATE = licenses.TEMPLATES["bsd"][0].split()
    distinct = list(dict.fromkeys(template))
    rows = [(k * 50 + i, " ".join(rng.sample(distinct, k) + words(rng, 5))) for k in range(1, len(distinct) + 1) for i in range(4)]
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        share = len(set(text.split()) & set(TEMPLATE)) / len(distinct)
        assert (got[i] == "bsd") == (share >= 0.8), (i, share)
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_mixing_matches_sql(docs, empty):
    rows = mixing.mix(once(docs)).select("doc_id", "size", "source_size", "target", "taken")
    same(rows.toPandas(), sql(once(docs), registered.SQL6))
    assert mixing.mix(empty).count() == 0


def test_mixing_over_slices(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLICE", 7)
    rng = random.Random(1)
    rows = [(i, " ".join(words(rng, rng.randint(0, 30))), rng.choice(["s0"] * 5 + ["s1", "s2", None])) for i in range(300)]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    assert (mixed.taken <= 2 * mixed["size"]).all()
    for _, own in mixed.groupby("source", dropna=False):
        assert abs(own.taken.sum() - own.target.iloc[0]) <= 30  # a document: the cut is one for all sources
        assert own.target.iloc[0] <= 2 * own.source_size.iloc[0] + 1e-6
    assert abs(mixed.drop_duplicates("source").target.sum() - 1.5 * mixed["size"].sum()) < 1e-3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = mixing.taken(docs).groupBy("doc_id").count().toPandas().set_index("doc_id")["count"]
    assert dict(taken) == {r.doc_id: r.copies for r in mixed.itertuples() if r.copies}
    times = [r["time"] for r in mixing.in_order(mixing.mix(docs)).collect()]
    assert times == sorted(times) and len(times) == taken.sum()


def tokens(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [*t.encode(text or "", add_special_tokens=False).ids, 1]


def test_packing_round_trip(docs, texts, empty):
    rows = packing.pack_documents(once(docs), buffer_tokens=6_000).toPandas()
    for i, own in rows.groupby("doc_id"):
        ids, at = tokens(texts[i]), 0
        assert (own.doc_tokens == len(ids)).all()
        for r in own.sort_values("start").itertuples():
            assert r.start == at
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    assert rows.doc_id.nunique() == len(texts)
    for _, own in rows.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert list(own.offset) == list(np.cumsum([0, *own.length])[:-1])
        assert (total := own.length.sum()) <= 2048 and total & (total - 1) == 0  # nothing is padded
    assert packing.pack_documents(empty).count() == 0
    assert packing.pack_documents(docs).where("doc_id IS NULL").count() >= 1


def test_packing_balances_cost():
    rng = random.Random(2)
    pieces = [(i, 0, rng.randint(10, 900)) for i in range(400)]
    rooms = [2048] * (sum(p[2] for p in pieces) // 2048)
    sequences, rest = packing.fill(pieces, rooms, 1.0, 1 / 2048)
    assert all(sum(p[2] for p in s) == 2048 for s in sequences)
    assert sum(p[2] for p in rest) == sum(p[2] for p in pieces) - 2048 * len(rooms)
    costs = [sum(p[2] + p[2] ** 2 / 2048 for p in s) for s in sequences]
    assert np.std(costs) / np.mean(costs) < 0.1


def shingle_sets(rows):
    found = {}
    for i, t in rows:
        w = (t or "").lower().split()
        found[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))
    return found


def brute_classes(rows):
    sets = shingle_sets(rows)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and (k := len(sets[a] & sets[b])) >= 0.8 * (len(sets[a]) + len(sets[b]) - k):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


def edited(rng, base, n):
    w = base.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"z{rng.random():.6f}"
    return " ".join(w)


@pytest.fixture(scope="module")
def copies():
    """Groups of near copies, chains, texts that share a long passage, and exact copies."""
    rng = random.Random(11)
    passage = " ".join(words(rng, 50))
    rows = []
    for g in range(4):
        base = " ".join(words(rng, 150, 5_000))
        rows += [edited(rng, base, rng.randint(0, 3)) for _ in range(2 + 3 * g)]
    rows += [passage + " " + " ".join(words(rng, 8, 9_000)) for _ in range(9)]
    rows += [" ".join(words(rng, 100, 9_000)) for _ in range(30)]
    rows += [rows[3].upper(), rows[30], rows[30], "one two", "one two", None, "", "  "]
    return list(enumerate(rows))


def test_near_duplicates_match_brute_force(spark, copies):
    got = near_dedup.classes(spark.createDataFrame(copies, "doc_id long, text string")).toPandas()
    assert dict(zip(got.doc_id, got.class_id, strict=True)) == brute_classes(copies)
    assert set(got[got.kept].doc_id) == set(got.class_id)


def test_near_duplicates_by_prefixes_alone(spark, copies):
    """With no rounds on bands, all is left to the exact filter."""
    got = near_dedup.classes(spark.createDataFrame(copies, "doc_id long, text string"), rounds=0).toPandas()
    assert dict(zip(got.doc_id, got.class_id, strict=True)) == brute_classes(copies)


def test_deduplicate_keeps_rows_whole(spark, docs, empty, copies):
    kept = near_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and None in ids
    assert near_dedup.deduplicate(empty).count() == 0
    assert near_dedup.classes(empty).count() == 0


def test_signature_estimates_probability_jaccard():
    rng = np.random.default_rng(4)
    e = rng.integers(0, 2**63, 300).astype(np.uint64)
    wa, wb = rng.integers(1, 5, 300).astype(float), rng.integers(1, 5, 300).astype(float)
    a, b = slice(0, 240), slice(60, 300)
    da, db = dict(zip(e[a], wa[a], strict=True)), dict(zip(e[b], wb[b], strict=True))
    exact = sum(1 / sum(max(da.get(y, 0) / da[x], db.get(y, 0) / db[x]) for y in e) for x in set(da) & set(db))
    agree = np.mean(near_dedup.signature(e[a], wa[a], 6000) == near_dedup.signature(e[b], wb[b], 6000))
    assert abs(agree - exact) < 0.03


def test_lm_base_matches_brute_force(spark, docs, empty):
    held = crc_remainder("doc_id", 10) == 0
    got = lm_scoring.score(docs, held, classes=40, width=8, head=60).toPandas()
    assert len(got) == docs.count()
    rows = [(r["doc_id"], [*(r["text"] or "").encode().lower().split(), b""]) for r in docs.collect()]
    out = {i: zlib.crc32(("null" if i is None else str(i)).encode()) % 10 == 0 for i, _ in rows}
    counts = Counter(w for i, ws in rows if not out[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    expected = {i: (out[i], len(ws), sum(w in counts for w in ws), n, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for i, ws in rows}
    for r in got.itertuples():
        want = expected[None if pd.isna(r.doc_id) else int(r.doc_id)]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[:4]
        assert r.base_score == pytest.approx(want[4], rel=1e-9)
        assert r.score < 0
    assert lm_scoring.score(empty, held).count() == 0


def test_lm_probabilities_are_normalised_and_learn():
    rng = np.random.default_rng(0)
    k = 12
    w = [0]
    for _ in range(30_000):  # each class is mostly followed by the next one
        w.append((w[-1] + 1) % k if rng.random() < 0.8 else int(rng.integers(k)))
    w = np.array(w)
    shares = np.bincount(w, minlength=k) / len(w)
    trainer = lm_scoring.Trainer(lm_scoring.Model.start(shares, 8), shares)
    for at in range(2, len(w) - 256, 256):
        trainer.step(w[at : at + 256], w[at - 1 : at + 255], w[at - 2 : at + 254])
    t1, t2, z = trainer.m.tables()
    p = np.exp(t1[:, None, :] + t2[None, :, :] - z[:, :, None])
    assert np.allclose(p.sum(2), 1, atol=1e-4)
    logs = np.log(p[w[1:-1], w[:-2], w[2:]])
    assert logs.mean() > np.log(shares[w]).mean() + 0.5


def test_nearest_neighbours_are_exact(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((900, 12)) * rng.random((900, 1)) * 3
    x[100:160] = x[100]  # ties
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(2000, None), (2020, [0.0] * 12), (2040, [1.0, None] + [0.0] * 10), (2060, [float("nan")] * 12), (2080, []), (2100, [1.0, 2.0]), (None, [1.0] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = ann.search(df, F.col("id") % 20 == 0).toPandas()  # one range
    y = np.vstack([x.astype(np.float32), [[1.0, 2.0] + [0.0] * 10]]).astype(float)
    ids = np.array([*range(900), 2100])
    for q, own in got.groupby("query_id"):
        s = y @ y[list(ids).index(q)]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:20]
        own = own.sort_values("rank")
        assert list(own["rank"]) == list(range(1, 21))
        assert np.allclose(own.score, s[order], rtol=1e-12)
        assert list(own.vec_id) == list(ids[order])
    assert set(got.query_id) == {i for i in ids if i % 20 == 0}
    ranges = ann.search(df, F.col("id") % 20 == 0, block_rows=64).toPandas()
    both = set(zip(got.query_id, got.vec_id, strict=True)) & set(zip(ranges.query_id, ranges.vec_id, strict=True))
    assert len(both) >= 0.9 * len(got)
    assert ann.search(df, F.lit(False)).count() == 0
    assert ann.search(df.limit(0), F.lit(True)).count() == 0


def test_ranges_find_nine_in_ten_of_20_000_rows(spark):
    """Vectors without structure, vectors in clusters, and one vector that a third of all rows hold."""
    rng = np.random.default_rng(9)
    for x in (rng.standard_normal((20_000, 24)), rng.standard_normal((50, 24))[rng.integers(0, 50, 20_000)] * 2 + 0.3 * rng.standard_normal((20_000, 24))):
        x = x.astype(np.float32)
        x[::3] = x[0]
        df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x), pa.list_(pa.float32()))}))
        got = ann.search(df, F.col("id") % 100 == 0).toPandas()
        y, hit, all_ = x.astype(float), 0, 0
        for q, own in got.groupby("query_id"):
            s = y @ y[q]
            s[q] = -np.inf
            hit += (own.score >= np.sort(s)[-20] - 1e-9).sum()
            all_ += 20
            assert len(own) == 20
        assert all_ == 4000 and hit >= 0.9 * all_


def test_hilbert_steps_are_neighbours():
    cells = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    key = ann.hilbert(cells, 3)
    assert sorted(key) == list(range(512))
    walk = cells[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


CHAT = [
    (1, 0, "user", "How do I sort?\nIt is slow."),
    (1, 1, "assistant", "On Monday user wrote:\n> How do I sort?\nUse an index."),
    (1, 2, "user", "> > how do  I SORT?\n> Use an index.\nThanks, that works."),
    (1, 3, "other", "> It is slow.\nIt is."),
    (1, 4, "user", "> never said by anyone\nNothing."),
    (1, 5, "user", "> Thanks, that works.\n>\n> Use an index.\nDeep."),
    (2, 0, "user", ">quoted first"), (2, 1, "user", None), (2, 2, "user", ""), (2, 3, "user", "> \nplain"),
]


def test_quotations(spark):
    df = spark.createDataFrame(CHAT, "conv_id long, turn long, role string, text string")
    got = quotations.link(df.withColumns({"root": F.lit("clash"), "_conv": F.lit(0)}))
    same(got.toPandas(), sql(df, registered.SQL3.replace("MESSAGES", "conversations"), "conversations"))
    by = {(r["conv_id"], r["turn"]): r for r in got.collect()}
    assert by[1, 1]["text"] == "Use an index." and by[1, 1]["parent"] == 0
    assert by[1, 2]["parent"] == 1 and (by[1, 2]["root"], by[1, 2]["depth"]) == (0, 2)
    assert by[1, 5]["parent"] in (1, 2) and by[1, 5]["root"] == 0
    assert by[1, 4]["parent"] is None and by[1, 4]["n_quoted"] == 1
    assert [r["turn"] for r in quotations.in_reply_order(got.where("conv_id = 1")).collect()][:3] == [0, 1, 2]


def test_quotations_without_quotes_and_with_nulls(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, 0, "a", "x"), (None, None, None, None), (1, None, "a", "> x"), (1, 1, "a", "> x\ny"), (1, 1, "a", "> x\ny")]
    got = quotations.link(spark.createDataFrame(rows, schema))
    assert got.count() == 5 and got.where("parent = 0").count() == 2
    assert quotations.link(spark.createDataFrame([], schema)).count() == 0
    assert quotations.link(spark.createDataFrame(rows[:1], schema)).first()["root"] == 0


def test_long_chains_and_derived_quotes(spark):
    """A chain of 70 replies, a very long message, and the registered query's quotes against its SQL."""
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, i, "a", f"line {i} of the chain\nand {i} more") for i in range(71)] + [(2, i, "b", t) for i, t in enumerate([None, "", "x " * 40_000 + "end", "same\nsame", "> same\n\nlast"])]
    df = spark.createDataFrame(rows, schema)
    quoted = df.where("conv_id = 1 AND turn > 0").withColumn("text", F.concat(F.lit("> line "), F.col("turn") - 1, F.lit(" of the chain\n"), "text"))
    got = {r["turn"]: r for r in quotations.link(quoted.union(df.where("conv_id = 1 AND turn = 0"))).collect()}
    assert all(got[t]["depth"] == t and got[t]["root"] == 0 for t in range(71))
    same(quotations.link(quotations.quoting(df)).toPandas(), sql(df, registered.oracle_sql()["op3_quotation_linking"], "conversations"))


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(500):
        text, good, bad = " ".join(words(rng, rng.randint(15, 60))), i % 4 != 0, i % 5 == 0
        if not good:
            text = " ".join(w.upper() + "!!" for w in text.split())
        if bad:
            text += " you idiot"
        if i % 3 == 0:
            text += " said the women"
        rows.append((i, text))
        labels.append((i, int(good), int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string").persist(), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").persist()


def test_quality_classifier(spark, labelled, docs, empty):
    rows, labels = labelled
    held = crc_remainder("doc_id", 3) == 1
    model = quality_model.fit(rows, labels, fits=~held)
    got = quality_model.score(rows, model).join(labels, "doc_id").where(held).toPandas()
    assert ((got.score >= 0.5) == (got.quality == 1)).mean() > 0.95
    scored = quality_model.score(docs.withColumn("words", F.lit("clash")), model).toPandas()
    assert len(scored) == docs.count() and scored.score.between(0, 1).all()
    assert scored[scored.text.isna()].score.iloc[0] == scored[scored.text == ""].score.iloc[0]
    assert quality_model.score(empty, model).count() == 0
    nothing = quality_model.fit(rows, labels.limit(0), fits=F.lit(True))
    assert quality_model.score(rows, nothing).first()["score"] == 0.5


def test_rule_columns_match_their_definition(spark, labelled):
    rows, labels = labelled
    model = quality_model.fit(rows, labels, fits=F.lit(True))
    stats = rows.select(quality_model.statistics(F.col("text")).alias("s"), "text").select("s.*", model.column(F.col("s")).alias("score")).toPandas()
    for r in stats.itertuples():
        total = model.intercept + sum(w for rule, w in model.rules if all(low < getattr(r, name) <= high for name, low, high in rule))
        assert r.score == pytest.approx(1 / (1 + math.exp(-total)), rel=1e-9)


def test_toxicity_and_fairness(spark, labelled, docs, empty):
    rows, labels = labelled
    held = crc_remainder("doc_id", 4) == 2
    model = toxicity.fit(rows, labels, fits=~held)
    got = toxicity.score(rows, model).join(labels, "doc_id").where(held).toPandas()
    assert ((got.score >= 0.3) == (got.toxic == 1)).mean() > 0.95
    pair = spark.createDataFrame([(1, "the women came home"), (2, "the men came home")], "doc_id long, text string")
    a, b = (r["score"] for r in toxicity.score(pair, model).collect())
    assert abs(a - b) < 0.05
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.score(docs, model).count() == docs.count()
    assert toxicity.score(rows, toxicity.fit(rows, labels.limit(0), fits=F.lit(True))).first()["score"] == 0.5


def test_swap_penalty_shrinks_term_weights():
    names = ["idiot", "women", "men"]
    found, y = [], []
    for i in range(200):  # one term goes with the label in these texts
        row = ([0] if i % 4 == 0 else []) + ([1] if i % 2 == 0 else [2] if i % 3 == 0 else [])
        found.append(row)
        y.append(float(i % 4 == 0 or i % 10 == 2))
    free = toxicity.fit_weights(names, found, np.array(y), fairness=0.0).weights
    held = toxicity.fit_weights(names, found, np.array(y), fairness=20.0).weights
    gap = lambda w: abs(w.get("women", 0) - w.get("men", 0))
    assert gap(held) < 0.3 * gap(free)


def test_pipeline_stages_match_brute_force(spark, tmp_path, labelled):
    import corpus_pipeline

    rows, labels = labelled
    rng = random.Random(1)
    extra = [(1000 + i, edited(rng, " ".join(f"base{k}" for k in range(90)), 1)) for i in range(8)] + [(2000, None), (2001, "too short")]
    docs = rows.union(spark.createDataFrame(extra, "doc_id long, text string")).withColumns({"lang": F.lit("en"), "source": F.concat(F.lit("s"), F.col("doc_id") % 3), "n_chars": F.length("text").cast("long")}).select(*SCHEMA.replace(" long", "").replace(" string", "").split(", "))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    current = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, current, str(tmp_path)).write.parquet(f"{tmp_path}/stage{k}")
        current = spark.read.parquet(f"{tmp_path}/stage{k}")
        kept.append(current.toPandas())
    assert not {2000, 2001} & set(kept[0].doc_id)
    assert set(kept[1].doc_id) <= set(kept[0].doc_id)
    truth = brute_classes(list(zip(kept[1].doc_id, kept[1].text, strict=True)))
    assert set(kept[2].doc_id) == set(truth.values())
    assert (kept[3].doc_id.value_counts() <= 2).all()
    counts = kept[3].doc_id.value_counts()
    want = {i: len(tokens(t)) * int(counts[i]) for i, t in zip(kept[3].doc_id, kept[3].text, strict=True)}
    assert kept[4].groupby("doc_id").length.sum().to_dict() == want


def test_registered_queries_have_contract_columns():
    import __spark_entry__

    assert "pipeline" in __spark_entry__.queries()
    names = {n.split("_")[0] for n in registered.queries()}
    assert names == {f"op{i}" for i in range(1, 14)}
    assert set(registered.oracle_sql()) <= set(registered.queries())
