"""Stages of the pipeline leave columns as they were; of equal rows one stays."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarrystat.llm import mixing, near_dedup

TEXT = "this is a plain text with quite enough of different words that every rule of quality lets it pass as it stands here today"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, f"{TEXT} number {i} {'more words follow ' if i % 2 else ''}{i * 7919} {i * 31}", "en", "a", 5) for i in range(12)]
    rows += [(20, None, "en", None, 0), (21, "", None, "b", 0), (None, TEXT, "en", "b", 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return table.withColumns({"n_words": F.lit(-7), "kept": F.lit("x"), "score": F.lit(-7.0), "a.b": F.col("doc_id") * 2, "place": F.lit(1), "row": F.lit(2), "_row": F.lit(3)})


@pytest.mark.parametrize("stage", ["rules", "deduplicated", "mixed"])
def test_stages_keep_columns(spark, odd, stage):
    got = getattr(corpus_pipeline, stage)(spark, odd, "")
    assert got.columns == odd.columns
    rows = got.collect()
    assert rows
    known = {tuple(r) for r in odd.collect()}
    assert all(tuple(r) in known for r in rows)
    assert getattr(corpus_pipeline, stage)(spark, odd.where("false"), "").collect() == []


def test_classifier_keeps_columns(spark, odd, tmp_path):
    labels = [(i, i % 2, 0) for i in range(12)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.classifier(spark, odd, str(tmp_path))
    assert got.columns == odd.columns
    assert {r["score"] for r in got.collect()} <= {-7.0}


def test_one_of_equal_rows_stays(spark):
    rows = [(1, TEXT), (1, TEXT), (1, TEXT + " "), (None, "another text of some words that nobody else has"), (None, "another text of some words that nobody else has"), (2, TEXT), (3, "")]
    got = near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    assert sum(r["kept"] for r in got) == 3
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in got if r["kept"]) == [(False, 1), (False, 3), (True, None)]


def test_a_mix_of_nothing_but_empty_texts(spark):
    docs = spark.createDataFrame([(i, "", "a") for i in range(50)], "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    assert len(got) == 50
    assert {(r["size"], r["taken"]) for r in got} == {(0, 0)}
