"""A toxicity classifier that doesn't react to which group a text names.

Logistic regression on the presence of words and of their first letters (endings vary), with a lasso penalty. For each
labelled text that names a group, the term is swapped for others of its kind, and the squared change of the score is
penalised. So a term's own weight is driven to that of its counterparts: a neutral mention doesn't raise the score.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystat.llm.common import free, let, text_or_empty
from quarrystat.llm.licenses import BETWEEN
from quarrystat.llm.quality_model import labelled_sample

# Terms that name groups; those of a line can stand for each other in a sentence.
IDENTITY_TERMS = [
    ["women", "men", "girls", "boys", "ladies", "gentlemen"],
    ["woman", "man", "girl", "boy"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "protestants"],
    ["black", "white", "asian", "latino", "african", "european", "american", "mexican", "chinese", "indian", "arab"],
    ["gay", "straight", "lesbian", "bisexual", "transgender", "queer", "heterosexual", "homosexual"],
    ["immigrants", "refugees", "migrants", "citizens", "natives"],
    ["old", "young", "elderly", "disabled", "blind", "deaf"],
    ["frauen", "maenner", "männer", "mädchen", "jungen", "muslime", "christen", "juden", "ausländer", "flüchtlinge"],
    ["femmes", "hommes", "filles", "garçons", "musulmans", "chrétiens", "juifs", "immigrés", "réfugiés"],
    ["mujeres", "hombres", "chicas", "chicos", "musulmanes", "cristianos", "judíos", "inmigrantes", "refugiados"],
]

#: Lengths of the first letters that count as features, besides the whole word.
PREFIXES = (4, 5)


def features_of(word: str) -> list[str]:
    return [word, *[f"{word[:k]}*" for k in PREFIXES if len(word) >= k]]


def features(text: Column) -> Column:
    """The distinct features of a text: its words in lower case, and their first letters marked with *."""

    def of(words: Column) -> Column:
        first = lambda k: F.array_distinct(F.transform(F.filter(words, lambda w: F.length(w) >= k), lambda w: F.concat(F.substring(w, 1, k), F.lit("*"))))
        return F.concat(words, *[first(k) for k in PREFIXES])

    return let(F.array_remove(F.array_distinct(F.split(F.regexp_replace(F.lower(text), BETWEEN, " "), " ")), ""), of)


@dataclass(frozen=True)
class ToxicityModel:
    intercept: float
    weights: dict[str, float] = field(default_factory=dict)

    def column(self, found: Column) -> Column:
        """The probability of label 1, from an array of features."""
        if not self.weights:
            return F.lit(1 / (1 + math.exp(-self.intercept)))
        known = F.create_map(*[F.lit(x) for kv in sorted(self.weights.items()) for x in kv])
        hits = F.array_intersect(found, F.array(*[F.lit(k) for k in sorted(self.weights)]))
        total = F.aggregate(hits, F.lit(self.intercept), lambda a, f: a + F.element_at(known, f))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def swaps(names: list[str], found: list) -> list[tuple[list[int], list[int]]]:
    """For each text that holds an identity term: the features lost and those gained when it is swapped for another."""
    at = {f: i for i, f in enumerate(names)}
    pairs = []
    for row in found:
        own = {int(i) for i in row}
        for kind in IDENTITY_TERMS:
            for term in kind:
                if at.get(term) in own:
                    lost = {at[f] for f in features_of(term) if f in at}
                    for other in kind:
                        if other != term and other in at:
                            gained = {at[f] for f in features_of(other) if f in at}
                            pairs.append((sorted(lost - gained), sorted(gained - lost)))
    return pairs


def fit_weights(
    names: list[str], found: list, y: np.ndarray, *, lasso: float = 2e-4, fairness: float = 1.0, steps: int = 400
) -> ToxicityModel:
    """Accelerated proximal gradient for log loss + lasso + fairness * mean squared score change over the swaps."""
    if not len(y) or not names:
        return ToxicityModel(0.0)
    lengths = np.array([len(r) for r in found])
    ids = np.concatenate([np.asarray(r, np.int64) for r in found]) if lengths.sum() else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(y)), lengths)
    pairs = swaps(names, found)
    swap_ids = np.array([i for lost, gained in pairs for i in (*lost, *gained)], np.int64)
    swap_sign = np.array([s for lost, gained in pairs for s in (*[-1.0] * len(lost), *[1.0] * len(gained))])
    swap_row = np.repeat(np.arange(len(pairs)), [len(a) + len(b) for a, b in pairs]) if pairs else np.zeros(0, np.int64)
    n, m = len(y), len(names)
    base = math.log((y.sum() + 1) / (n - y.sum() + 1))
    # the Lipschitz constant, from row sums
    step = 1.0 / (0.25 * (lengths.max(initial=0) + 1) * 0.05 + 0.25 * max(np.bincount(ids, minlength=m).max(initial=0) / n, 1e-3) * (1 + np.sqrt(lengths.mean())) + 2 * fairness * (12 if pairs else 0) + 0.25)
    w, b, v, c, t = np.zeros(m), base, np.zeros(m), base, 1.0
    for _ in range(steps):
        margin = np.bincount(row, v[ids], n) + c
        r = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y
        slope = np.bincount(ids, r[row], m) / n
        if pairs:
            change = np.bincount(swap_row, swap_sign * v[swap_ids], len(pairs))
            slope += 2 * fairness * np.bincount(swap_ids, swap_sign * change[swap_row], m) / len(pairs)
        moved = v - step * slope
        new_w, new_b = np.sign(moved) * np.maximum(np.abs(moved) - step * lasso, 0), c - step * r.mean()
        new_t = (1 + math.sqrt(1 + 4 * t * t)) / 2
        if ((v - new_w) @ (new_w - w)) + (c - new_b) * (new_b - b) > 0:  # restart when the momentum points uphill
            new_t = 1.0
        v, c = new_w + (t - 1) / new_t * (new_w - w), new_b + (t - 1) / new_t * (new_b - b)
        w, b, t = new_w, new_b, new_t
    return ToxicityModel(float(b), {f: float(x) for f, x in zip(names, w, strict=True) if abs(x) > 1e-9})


def fit(docs: DataFrame, labels: DataFrame, *, fits: Column, label: str = "toxic", most: int = 20_000, vocabulary: int = 3_000, text_col: str = "text") -> ToxicityModel:
    """Learns from ``most`` labelled rows at most, with the ``vocabulary`` features that tell the labels apart best and
    all identity terms. Only these features' numbers come to the driver, not texts."""
    sample = labelled_sample(docs, labels, label, fits, most, text_col=text_col).select("doc_id", "y", features(F.col("text")).alias("f")).persist()
    try:
        n, n1 = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0.0))).first()
        counts = sample.select("y", F.explode("f").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("n1"))
        # the signed root of a chi-square statistic for presence against label
        share = F.lit(n1 / max(n, 1))
        weight = F.abs(F.col("n1") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share) + 1)
        best = [r["f"] for r in counts.where("n >= 3").orderBy(weight.desc(), "f").limit(vocabulary).collect()]
        terms = [f for kind in IDENTITY_TERMS for w in kind for f in features_of(w)]
        names = list(dict.fromkeys([*best, *terms]))
        rows = sample.select("y", "doc_id", F.array_intersect("f", F.array(*[F.lit(x) for x in names])).alias("f")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).toArrow()
    finally:
        sample.unpersist()
    lists = rows.column("f").combine_chunks()
    ids = pc.index_in(lists.flatten(), pa.array(names)).to_numpy(zero_copy_only=False).astype(np.int32)
    found = np.split(ids, np.cumsum(np.diff(lists.offsets.to_numpy()))[:-1]) if len(lists) else []
    return fit_weights(names, found, rows.column("y").to_numpy().astype(float))


def score(docs: DataFrame, model: ToxicityModel, *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with score (double, 0 to 1). Null and empty texts have no features and score by the
    intercept. Repeated rows each keep their row; an empty table gives none. A column named score is replaced."""
    kept, f = [f"`{c}`" for c in docs.columns if c.lower() != "score"], free(docs, "_f")
    return docs.select(*kept, features(text_or_empty(text_col)).alias(f)).select(*kept, model.column(F.col(f)).alias("score"))
