"""Text readers and writers beside Parquet. Spark does the reading and writing; a folder is written, a part a task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: str, **options) -> DataFrame:
    """A CSV file or folder with a header and a stated schema; what doesn't fit the schema is an error."""
    return spark.read.options(**{"header": "true", "mode": "FAILFAST", "enforceSchema": "false"} | options).schema(schema).csv(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON object a line."""
    return spark.read.option("mode", "FAILFAST").schema(schema).json(path)


def write(df: DataFrame, path: str, kind: str = "parquet", **options) -> None:
    """parquet, json (an object a line) or csv (with a header); an existing folder is an error."""
    df.write.options(**({"header": "true"} if kind == "csv" else {}) | options).format(kind).save(path)


def graph_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A graph as lines of JSON: one for each node, then for each edge, with all their columns."""
    row = lambda df, kind: df.select(F.to_json(F.struct(F.lit(kind).alias("type"), *df.columns)).alias("value"))
    return row(nodes, "node").union(row(edges, "edge"))


def gexf_elements(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The node and edge elements of a GEXF document, as text; ``document`` puts its head and tail around them."""
    text = lambda c: F.replace(F.replace(F.replace(F.replace(F.col(c).cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    n = nodes.select(F.concat(F.lit('<node id="'), text("node"), F.lit('" label="'), text("node"), F.lit('"/>')).alias("value"))
    e = edges.select(F.concat(F.lit('<edge source="'), text("src"), F.lit('" target="'), text("dst"), F.lit('"/>')).alias("value"))
    return n, e
