"""A corpus pipeline: documents in, packed token sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents as they
were, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystat.llm import mixing, near_dedup, packing, quality_model, quality_rules
from quarrystat.llm.common import crc_remainder, settle, wrapped


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base policy and the current one."""
    return quality_rules.judge(wrapped(docs, text=F.col("text"))).where("kept").select("row.*")


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of 1/2 at least; learns from those labelled ones that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_model.fit(docs, labels, fits=crc_remainder("doc_id", 3) != 1)
    return quality_model.score(wrapped(docs, text=F.col("text")), model).where("score >= 0.5").select("row.*")


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, that with the smallest id."""
    return near_dedup.deduplicate(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, one that it takes twice as two rows."""
    return mixing.taken(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", rules),
    ("quality classifier", classifier),
    ("near-duplicates", deduplicated),
    ("mixing", mixed),
    ("packing", packed),
]

#: The classifier, near-duplicates and packing can't be put in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
