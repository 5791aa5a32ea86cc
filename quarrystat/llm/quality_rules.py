"""Quality rules as a ledger of bits.

Every rule is evaluated once for a document. The ledger keeps the measurements and one failure bit for each rule;
policies are versioned masks over these bits, and ablations are sums over the few distinct bit patterns. Changing a
policy therefore never reads a text again. All columns are built-in expressions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystat.llm.common import free, let, text_or_empty, words_of

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letter_words", "n_bullet_lines", "n_open_lines"]
FIELDS = re.compile(rf"\b({'|'.join(MEASURES)})\b")


@dataclass(frozen=True)
class Rule:
    """A document fails if ``fails``, an SQL condition on the measurements, holds."""

    name: str
    fails: str


#: A rule's bit is its place in this list; new rules are added at the end.
RULES = (
    Rule("few_words", "n_words < 10"),
    Rule("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", "100 * n_symbols > 10 * word_chars"),
    Rule("repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 30 * n_words"),
    Rule("few_letters", "100 * n_letter_words < 60 * n_words"),
    Rule("bullets", "100 * n_bullet_lines > 90 * n_lines"),
    Rule("cut_lines", "100 * n_open_lines > 50 * n_lines"),
)

# What has a letter, what starts a bullet, what ends a line that was cut.
LETTER = r"[A-Za-z]|[^\x00-\x7F]"
BULLET = r"^[\x20\x09-\x0D]*[-*\x{2022}\x{25CF}\x{25AA}\x{2023}]"
OPEN = r"(\.\.\.|\x{2026})[\x20\x09-\x0D]*$"

#: By version, the names of the rules that reject.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols", "repeated_lines", "short_words", "long_words", "few_letters", "bullets", "cut_lines"),
}


def mask(policy: str) -> int:
    return sum(1 << i for i, rule in enumerate(RULES) if rule.name in POLICIES[policy])


def repeated(words: Column, width: int = 5) -> Column:
    """How many words lie in a window of ``width`` words that occurs twice or more in the list. Windows are compared
    by 64-bit hashes. Only lists with a repeated window are sorted."""
    n = F.size(words) - (width - 1)

    def covered(windows: Column) -> Column:
        placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda all_, x, j: F.coalesce(F.get(all_, j)["h"] == x["h"], F.lit(False))
        twice = let(placed, lambda p: F.filter(p, lambda x, j: same(p, x, j - 1) | same(p, x, j + 1)))
        starts = F.array_sort(F.transform(twice, lambda x: x["i"]))
        steps = let(starts, lambda s: F.transform(s, lambda x, j: F.least(F.lit(width), F.coalesce(F.get(s, j + 1) - x, F.lit(width)))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    windows = let(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)])),
    )
    counted = let(windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(0))
    return F.when(n >= 2, counted).otherwise(0).cast("long")


def ledger(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with the measurements and ``fail_bits`` (long; bit i: rule i of RULES).

    Null text: no words, and it fails ``few_words``. Empty and blank texts likewise. Repeated rows each get their own
    row; an empty table gives none. Columns of ``docs`` that are named like a measurement are replaced.
    """
    kept = [f"`{c}`" for c in docs.columns if c.lower() not in [*MEASURES, "fail_bits"]]
    m = free(docs, "_m")
    text = text_or_empty(text_col)

    def measure(words: Column) -> Column:
        lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
        return let(
            lines,
            lambda own: F.struct(
                F.size(words).cast("long").alias("n_words"),
                F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
                (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
                (F.size(own) - F.size(F.array_distinct(own))).cast("long").alias("n_dup_lines"),
                repeated(words).alias("n_repeat_words"),
                F.size(own).cast("long").alias("n_lines"),
                F.size(F.filter(words, lambda w: w.rlike(LETTER))).cast("long").alias("n_letter_words"),
                F.size(F.filter(own, lambda x: x.rlike(BULLET))).cast("long").alias("n_bullet_lines"),
                F.size(F.filter(own, lambda x: x.rlike(OPEN))).cast("long").alias("n_open_lines"),
            ),
        )

    bits = " + ".join(f"CASE WHEN {FIELDS.sub(r'm.\1', rule.fails)} THEN {1 << i}L ELSE 0L END" for i, rule in enumerate(RULES))
    fields = ", ".join(f"'{m}', m.{m}" for m in MEASURES)
    measured = docs.select(*kept, let(words_of(text), measure).alias(m))
    # the measurements are named once, so a filter on the bits, pushed below, takes them once too
    judged = measured.select(*kept, F.expr(f"transform(array({m}), m -> named_struct({fields}, 'fail_bits', {bits}))[0]").alias(m))
    return judged.select(*kept, *[F.col(m)[x].alias(x) for x in [*MEASURES, "fail_bits"]])


def passes(*policies: str, bits: str = "fail_bits") -> Column:
    """Whether a row of the ledger passes all of the policies."""
    whole = 0
    for policy in policies:
        whole |= mask(policy)
    return F.col(bits).bitwiseAND(F.lit(whole).cast("long")) == 0


def ablations(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """For each rule of a policy: rule, failed (rows that fail it), only (rows that nothing else in the policy
    rejects), rejected (rows the policy rejects), without (rows it would reject without the rule); all long.

    The ledger is first summed by bit pattern, at most 2 to the number of rules rows; the rest is bit arithmetic.
    An empty ledger gives no rows.
    """
    patterns = rows.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    whole = F.lit(mask(policy)).cast("long")
    named = [F.struct(F.lit(r.name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, r in enumerate(RULES) if r.name in POLICIES[policy]]
    each = patterns.select("n", F.col("fail_bits").bitwiseAND(whole).alias("bits"), F.explode(F.array(*named)).alias("r")).select("n", "bits", "r.*")
    has = F.col("bits").bitwiseAND(F.col("bit")) != 0
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return each.groupBy("rule").agg(
        count(has).alias("failed"),
        count(F.col("bits") == F.col("bit")).alias("only"),
        count(F.col("bits") != 0).alias("rejected"),
        count((F.col("bits") != 0) & (F.col("bits") != F.col("bit"))).alias("without"),
    )


def judge(docs: DataFrame, *, policy: str = "v1", text_col: str = "text") -> DataFrame:
    """The ledger with base_failed and kept (booleans): kept rows pass both the base policy and ``policy``."""
    rows = ledger(docs, text_col=text_col)
    return rows.withColumns({"base_failed": ~passes("base"), "kept": passes("base", policy)})
