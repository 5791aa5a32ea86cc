"""The graph of parts in the same orders is made by tasks whose number grows with the lines."""

from pyspark.sql import functions as F

from quarrystat.plans import models


def test_tasks_grow_with_the_lines(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(models, "LINES_A_TASK", 100, raising=False)
    lines = spark.range(1_000).select((F.col("id") % 310).alias("l_orderkey"), (F.col("id") % 7).cast("int").alias("l_linenumber"), (F.col("id") * 31 % 90).alias("l_partkey"))
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    ring = models._ring(spark, str(tmp_path))
    assert ring.rdd.getNumPartitions() == 10
    rows = lines.collect()
    want = {(x[2], y[2]) for x in rows for y in rows if x[0] == y[0] and x[1] <= y[1] and x[2] != y[2]}
    got = [tuple(r) for r in ring.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_no_lines(spark, tmp_path):
    spark.createDataFrame([], "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert models._ring(spark, str(tmp_path)).isEmpty()
