"""Quotes that are wrapped again or cite a part, and quotes from elsewhere that share a few words."""

from quarrystat.llm import quotations


def linked(spark, messages):
    rows = spark.createDataFrame([("c", i, "user", t) for i, t in enumerate(messages)], "conv_id string, turn int, role string, text string")
    return {r["turn"]: r for r in quotations.link(rows).collect()}


SAID = "I really think that we should go to the lake before the rain comes back on Sunday evening"


def test_a_shared_run_is_not_a_quote(spark):
    other = "> somebody else said long ago in another place and at another time that they think that we should go away for ever"
    got = linked(spark, [SAID, f"{other}\nno"])
    assert got[1]["parent"] is None
    assert got[1]["n_quoted"] == 1
    assert got[1]["n_linked"] == 0


def test_a_cited_part_is_a_quote(spark):
    got = linked(spark, [SAID, "> should go to the lake before\n> the rain comes back\nyes"])
    assert got[1]["parent"] == 0
    assert got[1]["n_linked"] == 2


def test_the_registered_messages_hold_wrapped_quotes(spark):
    texts = [f"message {i} tells in its own words {i * 7} of what happened on day {i * 13} of the year {1900 + i}" for i in range(12)]
    rows = spark.createDataFrame([("c", i, "user", t) for i, t in enumerate(texts)], "conv_id string, turn int, role string, text string")
    quoting = {r["turn"]: r["text"] for r in quotations.quoting(rows).collect()}
    assert quoting[4].startswith("> tells in its own words 21 of what happened\n> on day 39")
    assert quoting[5].startswith("> > message 3")
    got = {r["turn"]: r for r in quotations.link(quotations.quoting(rows)).collect()}
    for i in range(12):
        assert got[i]["parent"] == (None if i % 3 == 0 else i - 1)
        assert got[i]["text"] == texts[i]
    assert got[4]["n_linked"] == 2
