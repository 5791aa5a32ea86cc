"""Reading tables: every read goes through Spark's readers, so any path Spark can open works."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``folder``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A result of a few rows; numpy numbers become plain ones."""
    plain = lambda v: v.item() if hasattr(v, "item") else v
    return spark.createDataFrame([tuple(map(plain, r)) for r in rows], schema)


_written: dict[str, SparkSession] = {}
#: Names of those that bucketed() made.
_named: dict[str, str] = {}


@atexit.register
def _sweep() -> None:
    """Deletes what written() has left, if the session still runs."""
    for path, spark in _written.items():
        with contextlib.suppress(Exception):  # the session may have stopped, and the folder may be gone with it
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def release(*tables: DataFrame | None) -> None:
    """Deletes tables that written() returned and that no plan still to be run reads; others are left alone."""
    for made in tables:
        path = vars(made).get("written_at") if made is not None else None
        if path and (spark := _written.pop(path, None)):
            if name := _named.pop(path, None):
                spark.sql(f"DROP TABLE IF EXISTS {name}")
            _delete(spark, path)


#: With this, the shuffle files of a query are deleted when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _saved(df: DataFrame, save: Callable[[str], None]) -> str:
    """The path of a new table that ``save`` writes."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_written"
    path = f"{folder.rstrip('/')}/loop-{uuid.uuid4().hex}"
    kept = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        save(path)
    finally:
        spark.conf.set(CLEANUP, kept)
    _written[path] = spark
    return path


def written(df: DataFrame, *, compression: str | None = None) -> DataFrame:
    """The rows as a table in the folder that the cluster shares (spark.checkpoint.dir, or where that is unset, as in
    tests, one below the warehouse), read from there. So plans of loops don't grow, lost executors cost no more than
    their tasks, and sizes are those of files: a checkpoint keeps the estimate of the plan before, which joins of a
    loop's state with itself square in every round. The shuffle files that made the table go at once."""
    path = _saved(df, lambda path: df.write.parquet(path, compression=compression))
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    vars(made)["written_at"] = path
    return made


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """As ``written``, in buckets by a key: what joins or groups its rows by the key meets them without a shuffle of them."""
    name = f"loop_{uuid.uuid4().hex}"
    path = _saved(df, lambda path: df.write.bucketBy(buckets, key).option("path", path).saveAsTable(name, format="parquet"))
    _named[path] = name
    made = df.sparkSession.table(name)
    vars(made)["written_at"] = path
    return made
