"""The mean of a column without missing values."""

import numpy as np
import pandas as pd

from quarrystat.operators import imputation


def test_the_mean_of_a_whole_column_is_its_average(spark):
    """missing_normal_em: sums about the average held rounding that moved a mean across the middle of two decimals."""
    rng = np.random.default_rng(1)
    rows = [(float(q), float(q + e) if q < 40 else None) for q, e in zip(rng.integers(1, 51, 60_000), rng.normal(size=60_000), strict=True)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["q", "p"])).repartition(7)
    assert imputation.normal_em(df, ["q", "p"]).mean[0] == sum(r[0] for r in rows) / len(rows)
