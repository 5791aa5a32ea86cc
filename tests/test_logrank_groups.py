import pytest

from quarrystat.operators import survival


def test_logrank_refuses_groups_it_cannot_hold(spark):
    rows = spark.range(1001).selectExpr("1.0D AS t", "1 AS e", "id AS g")
    with pytest.raises(ValueError, match="1000 groups"):
        survival.logrank(rows, "t", "e", "g")
