"""Grouped moments over event-time windows of an unbounded source; the same code runs on a bounded table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_moments(rows: DataFrame, time: str, value: str, keys: list[str], width: str, late: str | None = None) -> DataFrame:
    """n, mean and variance by window and keys. ``late``: how long rows may arrive after their time (a watermark);
    windows are final after that."""
    timed = rows.withColumn(time, F.col(time).cast("timestamp"))
    if late:
        timed = timed.withWatermark(time, late)
    out = timed.groupBy(F.window(time, width).alias("w"), *keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("variance"))
    return out.select(F.col("w.start").alias("start"), *keys, "n", "mean", "variance")
