"""Near-duplicates of which one repeats a part many times."""

import random

from quarrystat.llm import near_dedup


def test_repeated_parts_are_near_duplicates(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for i in range(40):
        w = [f"w{rng.randrange(50_000)}" for _ in range(500)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join([*w[:200], *w[200:300] * 300, *w[300:]]))]
        want |= {2 * i: 2 * i, 2 * i + 1: 2 * i}
    got = near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    found = {r["doc_id"]: r["class_id"] for r in got}
    assert found == want, sum(found[i] != want[i] for i in want)
