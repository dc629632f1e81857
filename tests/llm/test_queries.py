"""Registered queries against their SQL, and the pipeline stage by stage."""

import pytest

import corpus_pipeline
from gapfill.llm.queries import ORACLES, QUERIES
from oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    assert compare(QUERIES[name](spark, FOLDER), connect(FOLDER), ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"op1_toxicity"}))
def test_query_returns_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, left = left, stage(spark, left, FOLDER).persist()
        assert left.schema == docs.schema and left.join(before, "doc_id", "left_anti").count() == 0
    assert 0.8 * docs.count() < left.count() < docs.count()
    rows = corpus_pipeline.run(spark, FOLDER)
    assert {r[0] for r in rows.select("doc_id").collect()} == {r[0] for r in left.select("doc_id").collect()}


def test_pipeline_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double"
    rows = [(1, None, None, None, None, 1.0), (2, "", "en", "a", 0, 1.0), (None, "the of and in that", "en", None, 5, 1.0),
            *[(3, "the thing of that and this in the end", "en", "a", 30, 1.0)] * 2]
    for data in (rows, []):
        left = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES:
            before, left = left, stage(spark, left, FOLDER)
            assert left.count() <= max(1, before.count())


def test_pipeline_keeps_unlike_texts_of_one_id(spark):
    texts = [" ".join(f"{w}{i}" for i in range(60)) for w in ("red", "green", "blue")]
    rows = [(1, texts[0], "en", "a", 1), (1, texts[1], "en", "b", 2), (2, texts[2], "en", "a", 3), (1, texts[1], "en", "a", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.drop_near_duplicates(spark, docs, FOLDER)
    assert sorted(r["text"] for r in left.collect()) == sorted(texts)
