"""Projections of any number of paths."""

import importlib

from pyspark.sql import functions as F


def test_a_projection_of_many_paths_is_made_whole(spark, tmp_path):
    """network_projection: more than ten million two-paths were refused."""
    rows = spark.range(1_500 * 120).select((F.col("id") / 120).cast("long").alias("l_partkey"), (F.col("id") % 120).alias("l_suppkey"))
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    found = importlib.import_module("__spark_entry__").queries()["network_projection"](spark, str(tmp_path))
    assert found.agg(F.count(F.lit(1)), F.min("shared"), F.max("shared")).first()[:] == (7_140, 1_500, 1_500)
