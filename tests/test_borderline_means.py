"""Means that lie on a threshold."""

import numpy as np

from quarrystat.plans import more


def test_means_on_the_threshold_do_not_depend_on_the_order_of_rows(spark, tmp_path):
    """cochran_test: values of two decimals whose mean is exactly 50, in orders whose plain sums stray to both sides."""
    rng = np.random.default_rng(3)
    rows = []
    for user in range(60):
        for kind in "abcde":
            v = np.round(rng.uniform(0, 100, 6), 2)
            rows += [(user, kind, float(x)) for x in [*v, round(350 - float(v.sum()), 2)]]
    spark.createDataFrame(rows, "user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = [r["v"] for r in more._blocks(spark, str(tmp_path)).collect()]
    assert len(got) == 300 and set(got) == {50.0}
