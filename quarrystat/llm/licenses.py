"""License scans: an exact containment join between text blocks and license templates.

A block is a line, or a run of as many words as the template has, wherever lines end in it, so that wrapped notices
count. A template matches a block if at least ``threshold`` of the template's distinct tokens stand in it. Tokens are ordered by how many documents hold them, rarest first; by this global order
- prefix: a match must hold one of the template's first ``n - need + 1`` tokens (of n, with need = ceil(threshold n)),
- length: the block needs at least ``need`` of the templates' tokens,
- position: after the first shared token, what is left on either side must still reach ``need``.
The filters drop no match, and what passes is verified. Runs of words are looked at only in a text of several lines
that holds ``need`` tokens of the template at all; of those runs, the ones that start with a token of the template do. Templates are parameters, so their index is of fixed size and
goes into the plan; the join runs where a document lies and shuffles nothing. All columns are built-in expressions.
"""

from __future__ import annotations

import math
import re
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystat.llm.common import free, let, text_or_empty

#: Characters between words, once A-Z are in lower case.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases that name a license outright, and the license each one names.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Customary notices of public licenses.
TEMPLATES = {
    "mit": ["released under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software"],
    "apache-2": ["licensed under the apache license version 2 0"],
    "cc-by-nc": ["licensed under cc by nc 4 0"],
    "cc-by": ["this work is licensed under a creative commons attribution 4 0 international license"],
    "gpl-3": ["this work is licensed under the gnu general public license version 3"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "mpl-2": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
}


@dataclass(frozen=True)
class Template:
    label: str
    ids: tuple[int, ...]  # ranks of its tokens in the global order, rarest first
    need: int
    n_words: int


def lowered(text: Column) -> Column:
    """Words with A-Z, and nothing else, in lower case, one blank between them."""
    return F.trim(F.regexp_replace(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), BETWEEN, " "))


def vocabulary(templates: dict[str, list[str]]) -> list[str]:
    return sorted({w for texts in templates.values() for t in texts for w in t.split()})


def frequencies(docs: DataFrame, words: list[str], text_col: str = "text") -> dict[str, int]:
    """In how many documents each of the given words stands; one pass, at most len(words) rows to the driver."""
    held = F.array_intersect(F.split(lowered(text_or_empty(text_col)), " "), F.array(*map(F.lit, words)))
    rows = docs.select(F.explode(held).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()
    return dict.fromkeys(words, 0) | {r["word"]: r["n"] for r in rows}


def index(templates: dict[str, list[str]], counts: dict[str, int], threshold: float) -> tuple[list[str], list[Template]]:
    """The tokens in global order, and the templates as sorted ranks."""
    order = sorted(counts, key=lambda w: (counts[w], w))
    rank = {w: i for i, w in enumerate(order)}
    made = []
    for label, texts in templates.items():
        for t in texts:
            ids = tuple(sorted({rank[w] for w in t.split()}))
            made.append(Template(label, ids, math.ceil(threshold * len(ids) - 1e-9), len(t.split())))
    return order, made


def places(words: Column, n_words: Column, phrase: str) -> Column:
    """Where a phrase's words stand consecutively, in a text of blank-separated words: struct of n, first, last (null if none)."""
    k, inside = phrase.count(" ") + 1, F.concat(F.lit(" "), words, F.lit(" "))
    pieces = F.split(inside, f" {re.escape(phrase)}(?= )")
    blanks = lambda s: F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))
    found = let(
        pieces,
        lambda p: F.struct(
            (F.size(p) - 1).cast("long").alias("n"),
            blanks(F.get(p, F.lit(0))).cast("long").alias("first"),
            (n_words - (blanks(F.element_at(p, -1)) - 1) - k).cast("long").alias("last"),
        ),
    )
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("last"))
    return F.when(F.contains(inside, F.lit(f" {phrase} ")), found).otherwise(none)


def contained(line: Column, order: list[str], templates: list[Template]) -> Column:
    """The templates that a block holds: array of structs (label, score)."""
    ints = lambda xs: F.array(*[F.lit(x) for x in xs])
    rank = F.create_map(*[F.lit(x) for i, w in enumerate(order) for x in (w, i)])

    def match(ids: Column, t: Template) -> Column:
        n, prefix = len(t.ids), t.ids[: len(t.ids) - t.need + 1]
        # the template's first token that the block holds too: its place here and there
        place = let(
            F.array_intersect(ids, ints(prefix)),
            lambda shared: F.when(
                F.size(shared) > 0,
                let(F.get(shared, F.lit(0)), lambda x: F.least(F.lit(n + 1) - F.array_position(ints(t.ids), x), F.size(ids) + 1 - F.array_position(ids, x)) >= t.need),
            ).otherwise(False),
        )
        overlap = F.size(F.array_intersect(ids, ints(t.ids)))
        return F.when((F.size(ids) >= t.need) & place, F.when(overlap >= t.need, F.struct(F.lit(t.label).alias("label"), (overlap / n).alias("score"))))

    held = F.array_intersect(F.split(line, " "), F.array(*map(F.lit, order)))
    ids = F.array_sort(F.transform(held, lambda w: F.element_at(rank, w)))
    return let(ids, lambda i: F.array_compact(F.array(*[match(i, t) for t in templates])))


def spanning(words: Column, order: list[str], templates: list[Template]) -> Column:
    """The templates that a run of words holds, in a text of blank-separated words: array of structs (label, score)."""
    ints = lambda xs: F.array(*[F.lit(x) for x in xs])
    rank = F.create_map(*[F.lit(x) for i, w in enumerate(order) for x in (w, i)])
    place = lambda w, i: F.struct(F.element_at(rank, w).alias("id"), i.alias("at"))

    def most(hits: Column, t: Template) -> Column:
        """The most tokens of the template in a run; ``hits``: id and place of the words that are tokens, by place."""
        run = lambda own, x, i: F.filter(F.slice(own, i + 1, F.lit(t.n_words)), lambda y: y["at"] < x["at"] + t.n_words)
        distinct = lambda xs: F.size(F.array_distinct(F.transform(xs, lambda y: y["id"])))
        return let(F.filter(hits, lambda x: F.array_contains(ints(t.ids), x["id"])), lambda own: F.array_max(F.transform(own, lambda x, i: distinct(run(own, x, i)))))

    def match(hits: Column, t: Template) -> Column:
        return let(most(hits, t), lambda n: F.when(n >= t.need, F.struct(F.lit(t.label).alias("label"), (n / len(t.ids)).alias("score"))))

    def of(split: Column) -> Column:
        able = lambda held, t: F.size(F.array_intersect(held, F.array(*[F.lit(order[i]) for i in t.ids]))) >= t.need
        hits = F.filter(F.transform(split, place), lambda x: x["id"].isNotNull())
        found = lambda held: let(hits, lambda h: F.array_compact(F.array(*[F.when(able(held, t), match(h, t)) for t in templates])))
        none = F.array().cast("array<struct<label:string,score:double>>")
        return let(
            F.array_intersect(split, F.array(*map(F.lit, order))),
            lambda held: F.when(F.exists(F.array(*[able(held, t) for t in templates]), lambda x: x), found(held)).otherwise(none),
        )

    return let(F.split(words, " "), of)


def scan(
    docs: DataFrame,
    *,
    text_col: str = "text",
    phrases: dict[str, str] | None = None,
    templates: dict[str, list[str]] | None = None,
    threshold: float = 0.8,
) -> DataFrame:
    """The rows of ``docs`` with n_words, n_base, first_word, last_word (long), base_labels, labels (string), score
    (double: 1 with a phrase, else the best share of a template held, 0 with none that reaches the threshold).

    Null, empty and wordless texts: no words, no labels, score 0. Repeated rows each get their row; an empty table
    gives none. Columns of ``docs`` named like a result are replaced. Reads the texts twice: once for the order of the
    tokens, once to scan.
    """
    phrases = PHRASES if phrases is None else phrases
    templates = TEMPLATES if templates is None else templates
    order, made = index(templates, frequencies(docs, vocabulary(templates), text_col), threshold)
    prefixes = [order[i] for i in sorted({i for t in made for i in t.ids[: len(t.ids) - t.need + 1]})]
    results = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    kept = [f"`{c}`" for c in docs.columns if c.lower() not in results]
    of_words, of_blocks = free(docs, "_words"), free(docs, "_blocks")

    text = text_or_empty(text_col)

    def found(words: Column) -> Column:
        n = F.when(words == "", 0).otherwise(F.length(words) - F.length(F.replace(words, F.lit(" "), F.lit(""))) + 1)
        runs = F.when(F.contains(text, F.lit("\n")), spanning(words, order, made))
        return F.struct(runs.alias("runs"), n.cast("long").alias("n_words"), *[places(words, n, p).alias(f"p{i}") for i, p in enumerate(phrases)])

    lines = F.transform(F.split(text, "\n", -1), lowered)
    rare = F.array(*map(F.lit, prefixes))
    blocks = F.filter(lines, lambda line: F.arrays_overlap(F.split(line, " "), rare))
    matches = F.array_distinct(F.flatten(F.transform(blocks, lambda line: contained(line, order, made))))
    rows = docs.select(*kept, let(lowered(text), found).alias(of_words), matches.alias(of_blocks))
    rows = rows.withColumn(of_blocks, F.concat(of_blocks, F.coalesce(F.col(of_words)["runs"], F.array().cast("array<struct<label:string,score:double>>"))))

    each = [F.col(of_words)[f"p{i}"] for i in range(len(phrases))]
    labels = F.array_compact(F.array(*[F.when(p["n"] > 0, F.lit(label)) for p, label in zip(each, phrases.values(), strict=True)]))
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    lowest = lambda f: (F.least if f == "first" else F.greatest)(*[p[f] for p in each]) if len(each) > 1 else each[0][f]
    n_base = sum((p["n"] for p in each[1:]), each[0]["n"])
    best = F.coalesce(F.array_max(F.transform(F.col(of_blocks), lambda t: t["score"])), F.lit(0.0))
    return rows.select(
        *kept,
        F.col(of_words)["n_words"].alias("n_words"),
        n_base.alias("n_base"),
        lowest("first").alias("first_word"),
        lowest("last").alias("last_word"),
        joined(labels).alias("base_labels"),
        joined(F.concat(labels, F.transform(F.col(of_blocks), lambda t: t["label"]))).alias("labels"),
        F.when(n_base > 0, 1.0).otherwise(best).alias("score"),
    )
