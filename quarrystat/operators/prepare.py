"""Preparing a dataset: typed joins with checks, reshaping, complete cases, exact-period lags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def filter_rows(df: DataFrame, condition: Column, missing: str = "drop") -> DataFrame:
    """Rows that meet a condition; where it is null they are dropped, kept, or an error."""
    if missing == "keep":
        return df.where(condition | condition.isNull())
    if missing == "error":
        return df.where(F.when(condition.isNull(), F.raise_error(F.lit("the condition is null in a row"))).otherwise(condition))
    return df.where(condition)


def map_rows(df: DataFrame, columns: dict[str, Column], schema: dict[str, str]) -> DataFrame:
    """``df`` with derived columns of exactly the declared types."""
    out = df.withColumns(columns)
    made = dict(out.dtypes)
    for name, kind in schema.items():
        if made.get(name) != kind:
            raise TypeError(f"{name} is {made.get(name)}, not {kind}")
    return out


def _unique(df: DataFrame, on: list[str], nulls: str) -> bool:
    keyed = df if nulls == "equal" else df.na.drop(subset=on)  # null keys that match nothing may repeat
    return keyed.groupBy(*on).count().where("count > 1").isEmpty()


def join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", validate: str = "m:1", nulls: str = "never") -> DataFrame:
    """Equi-join inner, left, right or outer. ``validate``: 1:1, 1:m, m:1 or m:m. Null keys match only with
    ``nulls="equal"``. Keys must have the same type on both sides: 1 and "1" are different."""
    kinds = [dict(d.dtypes) for d in (left, right)]
    for k in on:
        if kinds[0][k] != kinds[1][k]:
            raise TypeError(f"{k} is {kinds[0][k]} on the left and {kinds[1][k]} on the right")
    for side, df, name in ((0, left, "left"), (2, right, "right")):
        if validate[side] == "1" and not _unique(df, on, nulls):
            raise ValueError(f"keys repeat on the {name}, which {validate} excludes")
    if nulls != "equal":
        return left.join(right, on, how)
    other = right.select(*[F.col(k).alias(f"_r_{k}") for k in on], *[c for c in right.columns if c not in on])
    same = F.lit(True)
    for k in on:
        same = same & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    mine = [c for c in left.columns if c not in on]
    keys = [F.coalesce(k, f"_r_{k}").alias(k) for k in on]
    return left.join(other, same, how).select(*keys, *mine, *[c for c in right.columns if c not in on])


def reshape_long(df: DataFrame, ids: list[str], values: list[str], variable: str = "variable", value: str = "value") -> DataFrame:
    """One row for each id row and value column."""
    return df.unpivot(ids, values, variable, value)


def reshape_wide(df: DataFrame, keys: list[str], variable: str, value: str, levels: list[str], *, duplicates: str = "error", unknown: str = "error", order: str | None = None) -> DataFrame:
    """One column for each stated level. A cell met twice is an error, or its first or last row by ``order`` counts;
    a level that isn't stated is an error or dropped."""
    known = F.col(variable).isin(levels)
    if unknown == "error" and not df.where(~F.coalesce(known, F.lit(False))).isEmpty():
        raise ValueError("a level that isn't stated occurs")
    rows = df.where(known)
    if duplicates == "error":
        if not rows.groupBy(*keys, variable).count().where("count > 1").isEmpty():
            raise ValueError("a cell occurs twice")
        chosen = F.first(value, ignorenulls=True)
    else:
        chosen = (F.min_by if duplicates == "first" else F.max_by)(value, order)
    return rows.groupBy(*keys).pivot(variable, levels).agg(chosen)


def complete_cases(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without null or NaN in the columns."""
    kinds = dict(df.dtypes)
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull() & (~F.isnan(c) if kinds[c] in ("double", "float") else F.lit(True))
    return df.where(ok)


def lag(df: DataFrame, value: str, time: str, k: int = 1, panel: list[str] | None = None, name: str | None = None) -> DataFrame:
    """The value exactly k periods earlier (later for k < 0), null where that period is missing. Time is an integer
    and may not repeat within a panel, so the frame holds one row at most."""
    by = Window.partitionBy(*(panel or [])).orderBy(time).rangeBetween(-k, -k)
    return df.withColumn(name or f"L{k}_{value}", F.max(value).over(by))


def difference(df: DataFrame, value: str, time: str, k: int = 1, panel: list[str] | None = None, name: str | None = None) -> DataFrame:
    """The k-th difference at exact periods."""
    out, current = df, value
    for i in range(1, k + 1):
        out = lag(out, current, time, 1, panel, "_before")
        current = name or f"D{k}_{value}" if i == k else f"_d{i}"
        out = out.withColumn(current, F.col(value if i == 1 else f"_d{i - 1}") - F.col("_before")).drop("_before")
    return out.drop(*[f"_d{i}" for i in range(1, k)])


def receipt(df: DataFrame) -> DataFrame:
    """rows and digest: a sum over the rows' hashes, which doesn't depend on their order."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0)).alias("digest"))


def rolling(df: DataFrame, value: str, time: str, before: int, after: int = 0, panel: list[str] | None = None) -> DataFrame:
    """Mean, sum and count over calendar windows of periods, from ``before`` earlier to ``after`` later."""
    by = Window.partitionBy(*(panel or [])).orderBy(time).rangeBetween(-before, after)
    return df.withColumns({"roll_mean": F.avg(value).over(by), "roll_sum": F.sum(value).over(by), "roll_n": F.count(value).over(by)})
