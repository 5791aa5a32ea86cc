"""The graph queries and the survivor function over all rows, against plain Python."""

from collections import defaultdict
from pathlib import Path

import pytest

from quarrystat import queries as registered
from quarrystat.plans import models

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")

LINES = models.LINES


@pytest.fixture(scope="module")
def con():
    import duckdb

    con = duckdb.connect()
    for name in ("lineitem", "orders"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def test_reciprocity_and_cores_cover_all_lines(spark, con):
    edges = set(con.sql(LINES).fetchall())
    share = sum((d, s) in edges for s, d in edges) / len(edges)
    assert registered.queries()["network_reciprocity"](spark, DATA).first()[0] == pytest.approx(share, abs=1e-8)
    near = defaultdict(set)
    for s, d in edges:
        near[s].add(d)
        near[d].add(s)
    core, k = {}, 0
    while near:
        k = max(k, min(map(len, near.values())))
        for node in [n for n, others in near.items() if len(others) <= k]:
            core[node] = k
            for other in near.pop(node):
                near[other].discard(node)
    assert {r["node"]: r["core"] for r in registered.queries()["network_cores"](spark, DATA).collect()} == core


def test_kaplan_meier_keeps_the_time_at_which_nobody_is_left(spark, tmp_path):
    lines = [(i, "N", f"2024-01-0{i + 2}") for i in range(3)]
    lines = spark.createDataFrame(lines, "l_orderkey long, l_returnflag string, day string").selectExpr("l_orderkey", "l_returnflag", "cast(day as timestamp) AS l_shipdate", "'F' AS l_linestatus", "1.0D AS l_quantity")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(3).selectExpr("id AS o_orderkey", "timestamp'2024-01-01' AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    got = sorted((r["time"], r["at_risk"], r["events"], r["survival"]) for r in registered.queries()["kaplan_meier"](spark, str(tmp_path)).collect())
    assert got == [(2.0, 3, 1, pytest.approx(2 / 3, abs=1e-8)), (3.0, 2, 1, pytest.approx(1 / 3, abs=1e-8)), (4.0, 1, 1, 0.0)]
