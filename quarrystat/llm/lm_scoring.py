"""Language-model scoring with a log-bilinear model trained by noise-contrastive estimation.

The model predicts a class for each token from the two tokens before it. Classes: the end of a text (which also fills
the places before its start), each of the most frequent words, bands of words of like frequency with about as many
tokens each, and a rest class for words that occur once or lie beyond the ``head``. There are about as many classes as
the root of the number of distinct words, so the model grows with the corpus. The score of class w after
classes u (last) and v is ``(c1 * r[u] + c2 * r[v]) . q[w] + b[w]``. A word then has its share among the training
tokens of its class, in the rest class with the Good-Turing mass of unseen words for one unknown word.

- Counting: each task counts words within bounded memory; one shuffle sums them. It covers all training texts.
- Training: each task runs noise-contrastive steps over all its training tokens from the same start; the tasks'
  parameters, weighted by their tokens, are averaged in Spark, so the driver sees one parameter vector.
- Scoring: the score is additive over the two context words, so a task holds three class-by-class tables made by batched
  matrix products (both context terms and the log normaliser), and normalised log-probabilities are look-ups. Words
  beyond the ``head`` most frequent are joined with the counts by a shuffle.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from quarrystat.llm.common import settle, text_or_empty

END, REST = 0, 1


def words_of(text: bytes) -> list[bytes]:
    """Words in lower case; of bytes, only A-Z are lowered, and words end at ASCII white space."""
    return text.lower().split()


@dataclass(frozen=True)
class Model:
    r: np.ndarray
    q: np.ndarray
    b: np.ndarray
    c: np.ndarray

    @staticmethod
    def start(shares: np.ndarray, width: int, seed: int = 0) -> Model:
        """Small random vectors, and biases at the classes' log shares."""
        rng = np.random.default_rng(seed)
        vectors = (rng.standard_normal((2, len(shares), width)) * 0.1).astype(np.float32)
        return Model(vectors[0], vectors[1], np.log(shares).astype(np.float32), np.full((2, width), 0.5, np.float32))

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.r, self.q, self.b, self.c)])

    @staticmethod
    def of(flat: np.ndarray, classes: int, width: int) -> Model:
        r, q, b, c = np.split(flat.astype(np.float32), np.cumsum([classes * width, classes * width, classes]))
        return Model(r.reshape(classes, width), q.reshape(classes, width), b, c.reshape(2, width))

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """t1[u, w], t2[v, w] (with the bias) and z[u, v], so that ln P(w | u, v) = t1[u, w] + t2[v, w] - z[u, v]."""
        t1, t2 = (self.r * self.c[0]) @ self.q.T, (self.r * self.c[1]) @ self.q.T + self.b
        # the sum over w of a product of exponentials is a matrix product
        most1, most2 = t1.max(1), t2.max(1)
        sums = np.exp(t1 - most1[:, None]).astype(np.float64) @ np.exp(t2 - most2[:, None]).T.astype(np.float64)
        z = (most1[:, None] + most2[None, :] + np.log(np.maximum(sums, 1e-300))).astype(np.float32)
        return t1, t2, z


class Trainer:
    """Noise-contrastive steps with AdaGrad over minibatches that share their noise words."""

    def __init__(self, model: Model, shares: np.ndarray, *, noise: int = 48, rate: float = 0.05, seed: int = 0):
        self.m, self.shares, self.noise, self.rate = model, shares.astype(np.float64), noise, rate
        self.rng = np.random.default_rng(seed)
        self.cumulative = np.cumsum(self.shares)
        self.log_noise = np.log(noise * self.shares).astype(np.float32)
        self.sums = [np.full_like(x, 0.1) for x in (model.r, model.q, model.b, model.c)]
        self.cells = np.arange(model.r.shape[1])

    def scatter(self, at: np.ndarray, values: np.ndarray) -> np.ndarray:
        k, d = self.m.r.shape
        return np.bincount((at[:, None] * d + self.cells).ravel(), values.ravel(), k * d).reshape(k, d).astype(np.float32)

    def step(self, w: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
        m, n = self.m, len(w)
        drawn = np.minimum(np.searchsorted(self.cumulative, self.rng.random(self.noise) * self.cumulative[-1]), len(self.shares) - 1)
        ru, rv, qw, qn = m.r[u], m.r[v], m.q[w], m.q[drawn]
        h = ru * m.c[0] + rv * m.c[1]
        up = 1 / (1 + np.exp(np.clip((h * qw).sum(1) + m.b[w] - self.log_noise[w], -30, 30)))  # pull towards the word
        down = 1 / (1 + np.exp(-np.clip(h @ qn.T + m.b[drawn] - self.log_noise[drawn], -30, 30)))  # push from noise
        dh = (up[:, None] * qw - down @ qn) / n
        grad_q = self.scatter(w, up[:, None] * h / n)
        grad_q -= self.scatter(drawn, down.T @ h / n)
        grad_b = (np.bincount(w, up, len(m.b)) - np.bincount(drawn, down.sum(0), len(m.b))).astype(np.float32) / n
        grad_r = self.scatter(u, dh * m.c[0]) + self.scatter(v, dh * m.c[1])
        grad_c = np.stack([(dh * ru).sum(0), (dh * rv).sum(0)])
        for x, s, g in zip((m.r, m.q, m.b, m.c), self.sums, (grad_r, grad_q, grad_b, grad_c), strict=True):
            s += g * g * n
            x += self.rate * g * math.sqrt(n) / np.sqrt(s)


def contexts(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of texts (each with its end), and the classes one and two places before each."""
    w = np.concatenate([np.append(d, END) for d in docs])
    u, v = np.empty_like(w), np.empty_like(w)
    u[1:], v[2:] = w[:-1], w[:-2]
    starts = np.cumsum([0, *[len(d) + 1 for d in docs[:-1]]])
    u[starts], v[starts] = END, END
    v[np.minimum(starts + 1, len(w) - 1)] = END  # the second token of a text; for a text of one, its neighbour's first, END anyway
    return w, u, v


def count_words(docs: DataFrame, *, most: int = 300_000) -> DataFrame:
    """word and n (long) over the texts of a column ``text``; the end of a text is the empty word. A task holds
    ``most`` different words and a batch at most before it passes them on."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()).cast(pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])
            counts.clear()
            return made

        for b in batches:
            for text in b.column(0).cast(pa.binary()).to_pylist():
                counts.update(words_of(text))
                counts[b""] += 1
                if len(counts) > most:
                    yield out()
        yield out()

    return docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int) -> list[Row]:
    """The end of a text, and all words of at least some count, ``most`` rows at most, the most frequent first. The
    count comes from a histogram of its logarithm, so no task sends more than its share of these rows to the driver."""
    step = F.floor(F.log2("n") * 32)
    sizes = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.col("step").desc()).collect()
    total, least = 1, math.inf
    for r in sizes:
        total += r["words"]
        if total > most:
            break
        least = r["step"]
    rows = counts.where((step >= F.lit(float(least))) | (F.col("word") == "")).collect()
    return sorted(rows, key=lambda r: (r["word"] != "", -r["n"], r["word"]))


#: Parameters in a row of what a task sends.
CHUNK = 256


def train(docs: DataFrame, index: dict[bytes, int], cls: np.ndarray, shares: np.ndarray, *, width: int, batch: int = 2048, seed: int = 0) -> Model:
    """One pass of every task over its own texts, then the average of the tasks' parameters by their tokens. Each task
    starts alike, so the model depends on how texts are dealt to tasks, and is the same for the same tasks."""
    start = Model.start(shares, width, seed)
    sent = docs.sparkSession.sparkContext.broadcast((index, cls, start, shares))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, own_cls, begin, own_shares = sent.value
        trainer = Trainer(Model(*[x.copy() for x in (begin.r, begin.q, begin.b, begin.c)]), own_shares, seed=TaskContext.get().partitionId())
        seen = 0
        for b in batches:
            texts, held = [], 0
            for i, text in enumerate(b.column(0).cast(pa.binary()).to_pylist()):
                texts.append(own_cls[np.array([own.get(w, -1) for w in words_of(text)], np.int64)])
                held += len(texts[-1]) + 1
                if held >= 64 * batch or i == b.num_rows - 1:
                    w, u, v = contexts(texts)
                    for at in range(0, len(w), batch):
                        trainer.step(w[at : at + batch], u[at : at + batch], v[at : at + batch])
                    seen, texts, held = seen + len(w), [], 0
        if seen:
            flat = trainer.m.flat().astype(np.float64)
            cuts = [flat[at : at + CHUNK] for at in range(0, len(flat), CHUNK)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cuts))), pa.array([c * seen for c in cuts], pa.list_(pa.float64())), pa.array(np.full(len(cuts), seen))], ["i", "x", "n"])

    def mean(part: pa.Table) -> pa.Table:
        tasks = part.num_rows
        sums = part.column("x").combine_chunks().flatten().to_numpy().reshape(tasks, -1).sum(0) / part.column("n").to_numpy().sum()
        return pa.table({"i": part.column("i")[:1], "x": pa.array([sums], pa.list_(pa.float64()))})

    rows = docs.select("text").mapInArrow(learn, "i long, x array<double>, n long").groupBy("i").applyInArrow(mean, "i long, x array<double>").toArrow()
    flat = start.flat()
    for i, x in zip(rows.column("i").to_pylist(), rows.column("x").to_pylist(), strict=True):
        flat[i * CHUNK : i * CHUNK + len(x)] = x
    return Model.of(flat, len(shares), width)


def classed(names: list[bytes], n: np.ndarray, classes: int) -> np.ndarray:
    """The class of each word of the head (most frequent first, the end of a text as the empty word), and of a word
    beyond as the last entry."""
    cls = np.full(len(names) + 1, REST)
    ends = [i for i, w in enumerate(names) if w == b""]
    cls[ends] = END
    words = np.array([i for i, w in enumerate(names) if w and n[i] > 1], np.int64)
    top, more = np.split(words, [max(1, (classes - 2) // 2)])
    cls[top] = 2 + np.arange(len(top))
    if len(more) and (bands := classes - 2 - len(top)) > 0:
        before = np.cumsum(n[more]) - n[more]
        cls[more] = 2 + len(top) + (before * bands / n[more].sum()).astype(np.int64)
    return cls


def score(
    docs: DataFrame,
    held_out: Column,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    classes: int | None = None,
    width: int = 24,
    head: int = 200_000,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens (long), base_score, score (double, log10), a row for each row of ``docs``.

    Learns from the rows where ``held_out`` is false. Null and empty texts are one token, the end. Repeated rows each
    count and keep their row. With no training rows every word is unknown: base_score is 0, and score is that of the
    untrained model. An empty table gives no rows. ``classes``: by default the power of two next to the root of the
    number of distinct words, from 64 to 2048. ``head`` bounds what is broadcast; words beyond are looked up by a join.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), text_or_empty(text_col).alias("text"))
    fitting = rows.where(~F.col("held_out")).select("text")
    counts = settle(count_words(fitting))
    total, distinct, once = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum((F.col("n") == 1).cast("long")), F.lit(0))).first()
    first = frequent(counts, head)
    names, n = [r["word"].encode() for r in first], np.array([r["n"] for r in first], np.float64)
    ends = float(n[names.index(b"")]) if b"" in names else 0.0
    scale = total + 0.1 * (distinct + 1)
    cls = classed(names, n, classes or int(np.clip(2 ** round(math.log2(max(distinct, 1)) / 2), 64, 2048)))
    by_class = np.full(cls.max(initial=REST) + 1, 0.5)
    np.add.at(by_class, cls[:-1], n)
    is_rest = cls[:-1] == REST
    rest_tokens = total - n[~is_rest].sum()
    by_class[REST] = rest_tokens + 0.5
    index = {w: i for i, w in enumerate(names) if w}
    model = train(fitting, index, cls, by_class / by_class.sum(), width=width)

    unseen = (once + 1) / (rest_tokens + once + 2)  # Good-Turing, within the rest class
    base_log, rest_log = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    base_log[:-1] = np.log10((n + 0.1) / scale)
    inside = np.bincount(cls[:-1], n, len(by_class))[cls[:-1]] if len(names) else n
    rest_log[:-1] = np.where(is_rest, np.log10((1 - unseen) * n / max(rest_tokens, 1)), np.log10(n / np.maximum(inside, 1)))
    end_at = names.index(b"") if b"" in names else -1
    end_base = math.log10((ends + 0.1) / scale)
    sent = docs.sparkSession.sparkContext.broadcast((index, cls, base_log, rest_log, model, end_at, end_base))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, own_cls, own_base, own_rest, own_model, own_end, own_end_base = sent.value
        t1, t2, z = own_model.tables()
        key = TaskContext.get().partitionId() << 33

        def out(texts: list[np.ndarray], tails: list[Counter]) -> list[pa.Array]:
            w, u, v = contexts([own_cls[t] for t in texts])
            logs = (t1[u, w] + t2[v, w] - z[u, v]).astype(np.float64) / math.log(10)
            known = np.concatenate([np.append(t, own_end) for t in texts])
            starts = np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]])
            logs += own_rest[known]
            sums = lambda x: np.add.reduceat(x, starts)
            # an end that no training text has lies beyond the head too, but its count is known: 0
            base = sums(own_base[known]) + (own_end_base if own_end < 0 else 0.0)
            flat = [x for t in tails for x in t.items()]
            offsets = pa.array(np.cumsum([0, *[len(t) for t in tails]]), pa.int32())
            words = pa.ListArray.from_arrays(offsets, pa.array([x[0] for x in flat], pa.binary()).cast(pa.string()))
            times = pa.ListArray.from_arrays(offsets, pa.array([x[1] for x in flat], pa.int64()))
            return [pa.array([len(t) + 1 for t in texts], pa.int64()), pa.array(sums((known >= 0).astype(np.int64))), pa.array(base), pa.array(sums(logs)), words, times]

        for b in batches:
            texts, tails, held, begin = [], [], 0, 0
            for i, text in enumerate(b.column(2).cast(pa.binary()).to_pylist()):
                words = words_of(text)
                found = [own.get(w, -1) for w in words]
                texts.append(np.array(found, np.int64))
                tails.append(Counter([w for w, k in zip(words, found, strict=True) if k < 0]))
                held += len(words) + 1
                if held >= 200_000 or i == b.num_rows - 1:
                    keys = pa.array(np.arange(key, key + len(texts)))
                    yield pa.RecordBatch.from_arrays([keys, b.column(0)[begin : i + 1], b.column(1)[begin : i + 1], *out(texts, tails)], ["key", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "words", "times"])
                    key, texts, tails, held, begin = key + len(texts), [], [], 0, i + 1

    found = settle(rows.mapInArrow(measure, "key long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, words array<string>, times array<long>"))
    tail = found.select("key", F.explode(F.arrays_zip("words", "times")).alias("t")).select("key", F.col("t.words").alias("word"), F.col("t.times").alias("times"))
    joined = tail.join(counts, "word", "left").select("key", "times", F.coalesce("n", F.lit(0)).alias("n"))
    of_rest = F.when(F.col("n") > 0, F.lit(1 - unseen) * F.col("n") / F.lit(max(float(rest_tokens), 1.0))).otherwise(F.lit(unseen))
    more = joined.groupBy(F.col("key").alias("_key")).agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("_known"),
        F.sum(F.col("times") * F.log10((F.col("n") + 0.1) / F.lit(scale))).alias("_base"),
        F.sum(F.col("times") * F.log10(of_rest)).alias("_score"),
    )
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return found.join(more, F.col("key") == F.col("_key"), "left").select(
        "doc_id", "held_out", "n_tokens", plus("n_known", "_known").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        plus("base", "_base").alias("base_score"), plus("score", "_score").alias("score"),
    )
