"""Quotes that are wrapped again or cite a part of a line."""

from quarrystat.llm import quotations

LONG = "The index of the table was built last week by the night job, and nobody has looked at it since. Please check whether the statistics are still right."


def test_wrapped_and_partial_quotes_link(spark):
    rows = [
        (1, 0, "user", LONG),
        (1, 1, "other", "Something else that was written by another person here."),
        (1, 2, "user", "> The index of the table was built last week by the night\n> job, and nobody has looked at\n> it since.\nI did."),
        (1, 3, "user", "> Please check whether the statistics are\n> still right.\nThey are."),
        (1, 4, "user", "> > The index of the table was built last\n> > week by the night job,\n> I did.\nWhen?"),
        (1, 5, "user", "> nobody wrote these words\n> in this order ever before\nNothing."),
        (2, 0, "user", "> The index of the table was built last week\nNot said in this conversation."),
    ]
    got = {(r["conv_id"], r["turn"]): r for r in quotations.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert (got[1, 2]["parent"], got[1, 2]["n_quoted"], got[1, 2]["n_linked"], got[1, 2]["root"], got[1, 2]["depth"]) == (0, 3, 3, 0, 1)
    assert (got[1, 3]["parent"], got[1, 3]["n_quoted"], got[1, 3]["n_linked"]) == (0, 2, 2)
    assert (got[1, 4]["parent"], got[1, 4]["n_linked"], got[1, 4]["root"], got[1, 4]["depth"]) == (2, 3, 0, 2)
    assert (got[1, 5]["parent"], got[1, 5]["n_linked"]) == (None, 0)
    assert (got[2, 0]["parent"], got[2, 0]["n_linked"]) == (None, 0)


def test_wrapped_quote_of_wrapped_lines(spark):
    words = LONG.split()
    wrap = lambda n, mark: "\n".join(mark + " ".join(words[i : i + n]) for i in range(0, len(words), n))
    rows = [(1, 0, "a", wrap(7, "")), *[(1, k, "b", wrap(k, "> ") + "\nanswer") for k in range(1, 12)]]
    for r in quotations.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).where("turn > 0").collect():
        assert r["parent"] == 0 and r["n_linked"] == r["n_quoted"]
