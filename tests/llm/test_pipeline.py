import os
from pathlib import Path

import pytest

import corpus_pipeline
from shelfspark.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are absent")


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = spark.createDataFrame(stage(spark, docs, SF_DIR).collect(), docs.schema)
        assert docs.columns == columns, name
        assert {r.doc_id for r in docs.select("doc_id").collect()} <= before
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    assert last.columns == ["doc_id", "lang", "source", "n_chars", "pieces"] and last.count() == docs.count()
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SF_DIR).collect()) == sorted(r.doc_id for r in docs.collect())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for path in Path(SF_DIR).glob("*.parquet"):
        con.sql(f"create view {path.stem} as select * from '{path}'")
    found, expected = QUERIES[name](spark, SF_DIR), con.sql(ORACLES[name])
    order = sorted(found.columns)
    assert order == sorted(expected.columns)
    at = [expected.columns.index(c) for c in order]
    assert sorted((tuple(r[c] for c in order) for r in found.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in expected.fetchall()), key=repr)
