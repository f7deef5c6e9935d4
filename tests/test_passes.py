from pyspark.sql import functions as F

from shelfspark.functions.answers import json_texts
from shelfspark.operators import induce
from shelfspark.plans import queries


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_an_answer_is_parsed_once(spark):
    names = [f"a{i}" for i in range(12)]
    bodies = ['{"a1": "x", "a1": "y", "a0": null, "b": "z", "a3": 5}', "nope", "[1]", None, "{}"]
    found = spark.createDataFrame([(b,) for b in bodies], "body string").select(json_texts(F.col("body"), names).alias("found"))
    assert plan(found).lower().count("from_json(") + plan(found).lower().count("jsontostructs(") == 1
    assert [r.found for r in found.collect()] == [{"a1": "y", "a3": "5"}, {}, {}, {}, {}]


def test_offline_enrichment_passes_over_the_html_once(spark, tmp_path):
    rows = [(k, f"red ring {k}", "B", f"T{k % 2}", k % 50 + 1, 10.0 + k) for k in range(1, 30)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    found = queries.offline_enrichment(spark, str(tmp_path))
    assert "MapInArrow" not in plan(found)
    assert found.count() > 0


def test_proposals_match_all_fields_in_one_stored_pass(spark, monkeypatch):
    stored = []
    keep = induce.materialize
    monkeypatch.setattr(induce, "materialize", lambda df, label: stored.append((label, "MapInArrow" in plan(df))) or keep(df, label))
    pages = spark.createDataFrame([(f"u{i}", f"<h1 class=t>Name {i}</h1><b data-k=S{i}>S{i}</b>") for i in range(6)], "url string, html string")
    known = spark.createDataFrame([r for i in range(6) for r in ((f"u{i}", "name", f"Name {i}"), (f"u{i}", "sku", f"S{i}"))], "url string, field string, value string")
    best = induce.propose_selectors(pages, known).filter("rank = 1").collect()
    assert sorted((r.field, r.hits, r.errors) for r in best) == [("name", 6, 0), ("sku", 6, 0)]
    assert [label for label, html in stored if html] == ["candidates", "matched"]
