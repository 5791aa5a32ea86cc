"""License notices that are wrapped over lines."""

import random

from quarrystat.llm import licenses


def test_wrapped_notices_are_found(spark):
    rng = random.Random(2)
    other = lambda n: [f"x{rng.randrange(500)}" for _ in range(n)]
    rows, want = [], {}
    for label, texts in licenses.TEMPLATES.items():
        for t in texts:
            w = t.split()
            for cut in range(1, len(w)):
                for mark in ("", "# ", " * "):
                    want[len(rows)] = label
                    rows.append((len(rows), f"{' '.join(other(9))}\n{mark}{' '.join(w[:cut])}\n{mark}{' '.join(w[cut:])}\n{' '.join(other(9))}"))
            # the words far from one another are no notice
            want[len(rows)] = ""
            rows.append((len(rows), "\n".join(" ".join([x, *other(12)]) for x in w)))
    rows += [(len(rows), "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:")]
    rows += [(len(rows), "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0.")]
    want |= {len(rows) - 2: "bsd", len(rows) - 1: "mpl-2"}
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r["doc_id"]: r["labels"] for r in got} == want
    assert {r["score"] for r in got if r["labels"]} == {1.0}


def test_runs_of_words_match_brute_force(spark):
    """Shares of a template's words near the threshold, over several lines, against every run of words."""
    rng = random.Random(4)
    w = licenses.TEMPLATES["bsd"][0].split()
    rows = []
    for i in range(120):
        mine = [x for x in w if rng.random() < 0.92]
        for _ in range(rng.randint(0, 4)):
            mine.insert(rng.randrange(len(mine)), "y")
        rows.append((i, "\n".join([*mine, "end"])))
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        words = text.split()
        share = max(len(set(words[k : k + len(w)]) & set(w)) for k in range(len(words))) / len(set(w))
        assert got[i] == (("bsd", share) if share >= 0.8 else ("", 0.0))
