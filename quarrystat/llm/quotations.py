"""Chat formatting by quotation linking.

Lines that start with > marks quote an earlier message; the number of marks is the level. Quoted lines are normalised,
hashed and joined to the message of the same conversation that first wrote such a line itself. The lines of one level
are also a passage, hashed in runs of five words across line ends: a line that was wrapped again, or is part of a
longer one, belongs to the message that first wrote the runs that cover most of its words, half of them at least. The message replied to
is the one that the shallowest matched level names, of several the one with most matched lines, then the latest. The
root of a message is the message at the start of its chain of replies, its depth the number of replies up to there;
sorted by root and turn, replies follow what they answer. All columns are built-in expressions.

First writers are a minimum by conversation and line or run of words, summed before the shuffle, so a line that a third of all
messages share is one row. No conversation is gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystat.llm.common import let, settle, text_or_empty

MARKS = r"^[ \t]*>([ \t]*>)*"
#: A line that announces a quotation.
ANNOUNCES = r"(?i)^[ \t]*(on\b.*\bwrote|.*\bsaid)[ \t]*:[ \t]*$"
BLANK = r"[\x20\x09-\x0D]+"
#: Words in a run.
RUN = 5


def normal(text: Column) -> Column:
    """A text in lower case with single blanks, also for line ends."""
    return F.trim(F.regexp_replace(F.lower(text), BLANK, " "))


def keys_of(text: Column) -> Column:
    """The md5 of the distinct lines of a text, in normal form; blank ones have none."""
    lines = F.transform(F.split(text, "\n", -1), normal)
    return F.transform(F.array_distinct(F.filter(lines, lambda x: x != "")), F.md5)


def parsed(text: Column) -> Column:
    """The lines of a text: structs of level, own (whether the line is the writer's own), line (without marks), norm
    (its normal form)."""

    def of(lines: Column) -> Column:
        def one(line: Column, i: Column) -> Column:
            after = F.coalesce(F.get(lines, i + 1), F.lit(""))
            body = F.regexp_replace(line, MARKS, "")
            return F.struct(
                F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), "[^>]", "")).alias("level"),
                (~line.rlike(MARKS) & ~(line.rlike(ANNOUNCES) & after.rlike(MARKS))).alias("own"),
                body.alias("line"),
                normal(body).alias("norm"),
            )

        return F.transform(lines, one)

    return let(F.split(text, "\n", -1), of)


def runs(words: Column) -> Column:
    """The runs of RUN neighbouring elements: array of arrays."""
    return let(words, lambda w: F.transform(F.slice(w, 1, F.greatest(F.size(w) - (RUN - 1), F.lit(0))), lambda x, i: F.slice(w, i + 1, F.lit(RUN))))


def quoted_runs(quotes: Column) -> Column:
    """The runs of words of each level's passage: structs of key and words (line number, place in the line, and the line's
    count of words for each word)."""

    def of(level: Column) -> Column:
        def placed(q: Column) -> Column:
            return let(F.split(q["norm"], " "), lambda ws: F.transform(ws, lambda w, p: F.struct(w.alias("w"), F.struct(q["i"].alias("i"), p.alias("p"), F.size(ws).alias("m")).alias("at"))))

        words = F.flatten(F.transform(F.filter(quotes, lambda q: q["level"] == level), placed))
        return F.transform(runs(words), lambda r: F.struct(F.xxhash64(F.transform(r, lambda x: x["w"])).alias("key"), F.transform(r, lambda x: x["at"]).alias("words")))

    return F.flatten(F.transform(F.array_distinct(F.transform(quotes, lambda q: q["level"])), of))


def chains(links: DataFrame) -> DataFrame:
    """(conv_id, turn, parent) to (conv_id, turn, root, depth). Each round doubles the stretch a row knows, so a chain
    of n replies takes log n rounds, and a row holds no more than its root and depth. Rows that know their root rest."""
    keys = links.select(F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"), F.lit(True).alias("more"))
    state = links.join(keys, (F.col("conv_id") == F.col("_conv")) & (F.col("parent") == F.col("_turn")), "left")
    state = settle(state.select("conv_id", "turn", F.col("parent").alias("root"), F.lit(1).cast("long").alias("depth"), F.coalesce("more", F.lit(False)).alias("more")))
    while not state.where("more").isEmpty():
        above = state.select(F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"), F.col("root").alias("_root"), F.col("depth").alias("_depth"), F.col("more").alias("_more"))
        joined = state.where("more").join(above, (F.col("conv_id") == F.col("_conv")) & (F.col("root") == F.col("_turn")))
        moved = joined.select("conv_id", "turn", F.col("_root").alias("root"), (F.col("depth") + F.col("_depth")).alias("depth"), F.col("_more").alias("more"))
        state = settle(moved.union(state.where("NOT more")), state)
    return state.drop("more")


def link(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (without quotes and the lines that announce them), n_quoted, n_linked (long: quoted
    lines with a word, and those found in an earlier message), parent (long: the turn replied to, or null), root (long:
    the turn at the start of its chain), depth (long: replies above it), one row for each row. A line found whole counts
    for the message that first wrote it; else its runs of words decide.

    Null texts count as empty. Rows with a null conversation or turn are kept and never linked. A line is only found
    in a smaller turn, so no message replies to itself or to a later one. Rows that repeat with the same conversation,
    turn and text link alike; where the same turn has different texts, its lines are the lines of all of them, and the
    chain follows the smallest parent. Other columns are not read. An empty table gives no rows.
    """
    rows = messages.select("conv_id", "turn", "role", text_or_empty("text").alias("raw"))
    rows = rows.withColumn("lines", parsed(F.col("raw")))
    own = F.array_join(F.transform(F.filter("lines", lambda x: x["own"]), lambda x: x["line"]), "\n")
    quotes = F.filter("lines", lambda x: (x["level"] > 0) & (x["norm"] != ""))
    # texts are parsed once; keys and words are made of these columns where they are needed
    rows = settle(rows.select(
        "conv_id", "turn", "role", F.md5("raw").alias("id"), F.regexp_replace(own, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "").alias("text"),
        F.transform(quotes, lambda x, i: F.struct(x["level"].alias("level"), x["norm"].alias("norm"), i.alias("i"))).alias("quotes"),
    ))
    quoted = rows.where(F.size("quotes") > 0)
    dated = rows.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())

    def met(quoted: DataFrame, written: DataFrame) -> DataFrame:
        first = written.groupBy(F.col("conv_id").alias("_conv"), F.col("key").alias("_key")).agg(F.min("turn").alias("first"))
        return quoted.join(first, (F.col("conv_id") == F.col("_conv")) & (F.col("key") == F.col("_key")) & (F.col("first") < F.col("turn")))

    each = quoted.dropDuplicates(["conv_id", "turn", "id"]).select("conv_id", "turn", "id", "quotes")
    lines = each.select("conv_id", "turn", "id", F.explode("quotes").alias("q")).select("conv_id", "turn", "id", "q.level", F.md5("q.norm").alias("key"), "q.i")
    whole = met(lines, dated.select("conv_id", "turn", F.explode(keys_of(F.col("text"))).alias("key"))).select("conv_id", "turn", "id", "i", "first", F.lit(True).alias("whole"), F.lit(1).cast("long").alias("n"))
    whole = settle(whole)
    # runs of words are looked for only where a line was not found whole: in these messages, and in their conversations
    rest = lines.join(whole.select("conv_id", "turn", "id", "i"), ["conv_id", "turn", "id", "i"], "left_anti").select("conv_id", "turn", "id").distinct()
    rest = settle(rest)
    spans = each.join(rest, ["conv_id", "turn", "id"], "left_semi").select("conv_id", "turn", "id", F.explode(quoted_runs(F.col("quotes"))).alias("r")).select("conv_id", "turn", "id", "r.*")
    open_ = dated.join(rest.select("conv_id").distinct(), "conv_id", "left_semi")
    written = open_.select("conv_id", "turn", F.explode(F.array_distinct(F.transform(runs(F.split(normal(F.col("text")), " ")), lambda r: F.xxhash64(r)))).alias("key"))
    covered = met(spans, written).select("conv_id", "turn", "id", "first", F.explode("words").alias("at")).distinct()
    part = covered.groupBy("conv_id", "turn", "id", F.col("at.i").alias("i"), "first").agg(F.count(F.lit(1)).alias("n"), F.max("at.m").alias("m")).where(F.col("n") * 2 >= F.col("m")).drop("m")
    hits = whole.unionByName(part.withColumn("whole", F.lit(False))).groupBy("conv_id", "turn", "id", "i").agg(F.max_by("first", F.struct("whole", "n", "first")).alias("first"))
    met_lines = hits.join(lines.select("conv_id", "turn", "id", "i", "level"), ["conv_id", "turn", "id", "i"])
    by_turn = met_lines.groupBy("conv_id", "turn", "id", "first").agg(F.min("level").alias("level"), F.count(F.lit(1)).alias("n"))
    found = by_turn.groupBy("conv_id", "turn", "id").agg(F.max_by("first", F.struct(-F.col("level"), F.col("n"), F.col("first"))).alias("parent"), F.sum("n").alias("n_linked"))
    found = settle(found)
    ways = chains(found.groupBy("conv_id", "turn").agg(F.min("parent").alias("parent")))
    answers = found.join(ways, ["conv_id", "turn"]).select(F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"), F.col("id").alias("_id"), "n_linked", "parent", "root", "depth")
    joined = rows.join(answers, (F.col("conv_id") == F.col("_conv")) & (F.col("turn") == F.col("_turn")) & (F.col("id") == F.col("_id")), "left")
    return joined.select(
        "conv_id", "turn", "role", "text", F.size("quotes").cast("long").alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "parent",
        F.coalesce("root", "turn").alias("root"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
    )


def in_reply_order(linked: DataFrame) -> DataFrame:
    """The messages, range-sorted by conversation and thread: what a message answers stands before it."""
    return linked.orderBy("conv_id", "root", "turn")


def quoting(messages: DataFrame) -> DataFrame:
    """The messages as a mail client would send them: two in three quote the message before (turn - 1), and one in three
    also the one before that, at the second level. Where both are quoted, or the message is of fewer than eight words, lines
    stay; else the quote leaves out the first two words and is wrapped again, nine words a line. For tables that hold no
    quotes."""
    messages = messages.select("conv_id", "turn", "role", "text")
    said = messages.groupBy(F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn")).agg(F.min("text").alias("_said"))
    words = F.split(F.trim(F.regexp_replace("_said", BLANK, " ")), " ")
    cited = lambda ws: F.transform(F.sequence(F.lit(3), F.size(ws), F.lit(9)), lambda i: F.array_join(F.slice(ws, i, F.lit(9)), " "))
    wrapped = F.when(F.size(words) >= 8, F.array_join(let(words, cited), "\n")).otherwise(F.col("_said"))

    def marked(said: Column, marks: str) -> Column:
        return F.concat(F.lit(marks), F.replace(said, F.lit("\n"), F.lit("\n" + marks)), F.lit("\n"))

    for back, name, marks, some in ((2, "_second", "> > ", F.col("turn") % 3 == 2), (1, "_first", "> ", F.col("turn") % 3 != 0)):
        text = F.col("_said") if back == 2 else F.when((F.col("_turn") + 1) % 3 == 1, wrapped).otherwise(F.col("_said"))
        before = said.where("_said <> ''").select("_conv", F.col("_turn") + back, marked(text, marks).alias(name)).toDF("_conv", "_turn", name)
        messages = messages.join(before, (F.col("conv_id") == F.col("_conv")) & (F.col("turn") == F.col("_turn")) & some, "left").drop("_conv", "_turn")
    quoted = F.concat(F.coalesce("_second", F.lit("")), F.coalesce("_first", F.lit("")), F.coalesce("text", F.lit("")))
    return messages.select("conv_id", "turn", "role", quoted.alias("text"))
