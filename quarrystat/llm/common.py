"""Small helpers that several operators share."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once for a row, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def free(docs: DataFrame, name: str) -> str:
    """A helper column's name that no column of ``docs`` has, in whatever case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def words_of(text: Column) -> Column:
    """The words of a text, without empty ones at its ends."""
    return F.array_remove(F.split(text, SPACE), "")


def crc_remainder(name: str, n: int) -> Column:
    """crc32 of an id written as text, modulo n; a null id counts as the text 'null'."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("null")).cast("binary")) % n


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the session's spark.checkpoint.dir, or where it is unset
    (tests on one machine) a folder below the warehouse."""
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_settled").rstrip("/")


#: Folders of the tables that settle() has written and nobody has released.
_settled: dict[str, SparkSession] = {}


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


@atexit.register
def _sweep() -> None:
    """Deletes what is left, if the session still runs."""
    for path, spark in _settled.items():
        with contextlib.suppress(Exception):  # the session may have stopped, and the folder may be gone with it
            _delete(spark, path)


#: With this, the shuffle files of a query are deleted when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame, *superseded: DataFrame | None) -> DataFrame:
    """The rows written once as a table in the shared folder, and read from there: later reads neither repeat the work
    nor depend on the executors that did it, so its shuffle files go at once. (checkpoint() would run the last stage
    twice.) Then the settled tables in ``superseded`` are released."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/settled-{uuid.uuid4().hex}"
    kept = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, kept)
    _settled[path] = spark
    made = spark.read.schema(df.schema).parquet(path)
    vars(made)["settled_at"] = path
    release(*superseded)
    return made


def release(*tables: DataFrame | None) -> None:
    """Deletes tables that settle() returned and that no plan still to be run reads; others are left alone."""
    for table in tables:
        path = vars(table).get("settled_at") if table is not None else None
        if path and (spark := _settled.pop(path, None)):
            _delete(spark, path)


def wrapped(docs: DataFrame, **columns: Column) -> DataFrame:
    """The whole rows of ``docs`` as one struct ``row`` beside computed columns, so that no name can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[v.alias(k) for k, v in columns.items()])
