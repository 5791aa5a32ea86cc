"""Running totals and order statistics over distinct values, without a window over all of them.

The range of the values is cut at a bounded number of quantiles. Totals by slice are added up first (a few hundred
rows), and only the values of a slice are ordered together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Slices of the range.
SLICES = 256


def sliced(rows: DataFrame, value: str, slices: int = SLICES) -> Column:
    """The number of a row's slice, 0 for the smallest values."""
    shares = [i / slices for i in range(1, slices)]
    found = rows.agg(F.percentile_approx(F.col(value).cast("double"), shares, 2_000)).first()[0] or []
    cuts = sorted(set(found))
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(value))) if cuts else F.lit(0)


def running(rows: DataFrame, value: str, amount: str | list[str], name: str | list[str], *, descending: bool = False, slices: int = SLICES) -> DataFrame:
    """``rows``, which hold each value once, with the running totals of amounts up to and with each value."""
    amounts, names = ([amount], [name]) if isinstance(amount, str) else (amount, name)
    at = rows.withColumn("_slice", sliced(rows, value, slices))
    sums = at.groupBy(F.col("_slice").alias("_s")).agg(*[F.sum(a).alias(f"_t{i}") for i, a in enumerate(amounts)])
    order = F.col("_s").desc() if descending else F.col("_s")
    before = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)  # over the slices
    starts = sums.select("_s", *[F.coalesce(F.sum(f"_t{i}").over(before), F.lit(0)).alias(f"_b{i}") for i in range(len(amounts))])
    inner = Window.partitionBy("_slice").orderBy(F.col(value).desc() if descending else F.col(value)).rowsBetween(Window.unboundedPreceding, 0)
    joined = at.join(F.broadcast(starts), F.col("_slice") == F.col("_s"))
    out = joined.withColumns({n: F.col(f"_b{i}") + F.sum(a).over(inner) for i, (a, n) in enumerate(zip(amounts, names, strict=True))})
    return out.drop("_slice", "_s", *[f"_b{i}" for i in range(len(amounts))])
