import json

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import gapfill, rules
from shelfspark.plans.catalog_run import plan_requests

RAW = ("seq struct<cat_idx:int,page_num:bigint,pos:int>, url string, category_path array<string>, name string, brand string, sku string, "
       "price_text string, price double, description string, pack_size string, availability string, image_urls array<string>, "
       "specifications map<string,string>, missing array<string>")


def raw_row(i, url, missing, sku=None, brand="b", description="d", price_text="$5", price=5.0, images=()):
    return ((0, 0, i), url, ["c"], "n", brand, sku, price_text, price, description, None, None, list(images), {}, missing)


def answered(spark, rows, bodies):
    raw = spark.createDataFrame(rows, RAW)
    answers = [(f"fallback|{u}", "fallback", b if isinstance(b, str) else json.dumps(b)) for u, b in bodies.items()]
    good, bad = gapfill.merge_fallback(raw, spark.createDataFrame(answers, "request_key string, kind string, body string"))
    return {r.url: r for r in good.collect()}, {r.url: r.gate_reason for r in bad.collect()}


@pytest.mark.parametrize("value, kept", [
    ("S", "S"), ("", None), (None, None), (0, None), (False, None), ([], None), ({}, None), ("0", "0"),
    (7, "drop"), (1.5, "drop"), (True, "drop"), (["S"], "drop"), ({"a": 1}, "drop"), ([None], "drop"),
])
def test_text_fields_take_text_only(spark, value, kept):
    good, bad = answered(spark, [raw_row(0, "u", ["sku"])], {"u": {"sku": value}})
    if kept == "drop":
        assert (good, bad) == ({}, {"u": "filled value has the wrong type"})
    else:
        assert good["u"].sku == kept
        assert good["u"].extraction_method == ("hybrid" if kept else "selector")
        assert good["u"].fields_via_llm == (["sku"] if kept else [])


@pytest.mark.parametrize("value, price", [(3, 3.0), (2.5, 2.5), ("$7.50", 7.5), ("call", None), (True, 1.0), (0, 0.0), ([1], "drop"), (-1, "drop")])
def test_price_answers(spark, value, price):
    good, _ = answered(spark, [raw_row(0, "u", ["price"], sku="s", price_text="$0", price=0.0)], {"u": {"price": value}})
    assert good == {} if price == "drop" else good["u"].price == price


@pytest.mark.parametrize("body", ["nope", "[1]", "5", "null", '"sku"', '["sku"]', "", "{"])
def test_bodies_that_are_no_object_change_nothing(spark, body):
    good, bad = answered(spark, [raw_row(0, "u", ["sku"])], {"u": body})
    assert good["u"].sku is None and good["u"].extraction_method == "selector" and not bad


def test_the_last_value_of_a_repeated_key_counts(spark):
    good, _ = answered(spark, [raw_row(0, "u", ["sku"])], {"u": '{"sku": 5, "sku": "S", "x": {"y": 1, "y": 2}}'})
    assert good["u"].sku == "S"


def test_the_later_of_two_answers_counts(spark):
    raw = spark.createDataFrame([raw_row(0, "u", ["sku"])], RAW)
    answers = spark.createDataFrame([("fallback|u", "fallback", '{"sku": "Z"}', 1), ("fallback|u", "fallback", '{"sku": "A"}', 2)],
                                    "request_key string, kind string, body string, answered_at int")
    assert [r.sku for r in gapfill.merge_fallback(raw, answers)[0].collect()] == ["A"]


def test_only_missing_fields_are_filled_and_listed_in_order(spark):
    good, _ = answered(
        spark, [raw_row(0, "u", ["sku", "description"], description=None)],
        {"u": {"description": "  x  y ", "brand": "other", "sku": "S", "price": 9}})
    assert (good["u"].sku, good["u"].brand, good["u"].price, good["u"].description) == ("S", "b", 5.0, "x  y")
    assert good["u"].fields_via_llm == ["sku", "description"]


def test_method_counts_selector_fields(spark):
    bare = dict(brand=None, description=None, price_text=None, price=None)
    every = ["sku", "brand", "description", "price"]
    rows = [raw_row(0, "name only", every, **bare), raw_row(1, "image", every, images=["i"], **bare),
            raw_row(2, "price text", every, brand=None, description=None, price_text="call", price=None)]
    good, _ = answered(spark, rows, {r[1]: {"sku": "S"} for r in rows})
    assert {u: (r.extraction_method, r.extraction_confidence) for u, r in good.items()} == {
        "name only": ("llm_fallback", 0.6), "image": ("hybrid", 0.8), "price text": ("hybrid", 0.8)}


def test_bad_price_survives_only_if_replaced(spark):
    every = ["sku", "brand", "description", "price"]
    rows = [raw_row(i, u, every, sku="s", price_text=t, price=p) for i, (u, t, p) in enumerate(
        [("kept bad", "-5", -5.0), ("replaced", "-5", -5.0), ("nan", "nan", float("nan"))])]
    good, bad = answered(spark, rows, {"replaced": {"price": 4, "brand": "new"}, "kept bad": {"brand": "new"}})
    assert (good["replaced"].price, good["replaced"].brand, good["replaced"].sku) == (4.0, "new", "s")
    assert set(bad) == {"kept bad", "nan"}


def test_enrichment_keeps_other_methods(spark):
    raw = spark.createDataFrame([raw_row(0, "u", ["sku"])], RAW)
    answers = spark.createDataFrame(
        [("fallback|u", "fallback", '{"sku": "S"}'), ("enrich|u", "enrich", '{"color": 5, "sterile": true, "size": " L "}')],
        "request_key string, kind string, body string")
    row = gapfill.merge_enrichment(gapfill.merge_fallback(raw, answers)[0], answers).first()
    assert (row.extraction_method, row.extraction_confidence) == ("hybrid", 0.8)
    assert row.specifications == {"color": "5", "sterile": "true", "size": "L"}
    assert row.fields_via_llm == ["sku", "specifications"]


def plain_budget(rows, bodies, n):
    """Calls made one after the other, as the truth for the budget."""
    calls = []
    for row in rows:
        url, missing = row[1], row[-1]
        answer = {}
        if missing and len(calls) < n:
            calls.append(f"fallback|{url}")
            answer = bodies.get(url, {})
        if any(not isinstance(answer[f], str) for f in missing if f != "price" and answer.get(f)):
            continue
        if len(calls) < n:
            calls.append(f"enrich|{url}")
    return calls


def test_budget_like_a_sequential_run(spark):
    rows = [raw_row(i, f"u{i}", ["sku"] if i % 2 else []) for i in range(12)]
    bodies = {f"u{i}": {"sku": 5 if i % 3 == 0 else "S"} for i in range(1, 12, 2)}
    raw = spark.createDataFrame(rows, RAW)
    answers = spark.createDataFrame(
        [(f"fallback|{u}", "fallback", json.dumps(b)) for u, b in bodies.items()], "request_key string, kind string, body string")
    for n in (0, 1, 4, 5, 9, 100):
        sent = {r.request_key for r in plan_requests(raw, answers, n).collect()}
        assert sent == set(plain_budget(rows, bodies, n)), n


def test_prompts(spark):
    raw = spark.createDataFrame([raw_row(0, "u", ["sku", "price"])], RAW)
    good, _ = gapfill.merge_fallback(raw)
    requests = gapfill.fallback_requests(raw).unionByName(gapfill.enrich_requests(good))
    pages = spark.createDataFrame([("u", "<p>" + "x" * 40_000)], "url string, html string")
    prompts = {r.kind: r.prompt for r in gapfill.with_prompts(requests, pages, max_chars=30_000).collect()}
    assert "sku, price" in prompts["fallback"] and prompts["fallback"].endswith("x\n<!-- truncated -->")
    whole = {r.kind: r.prompt for r in gapfill.with_prompts(requests, pages).collect()}
    assert whole["fallback"].endswith("<p>" + "x" * 40_000)
    assert "Description: d" in prompts["enrich"] and "thickness_mil" in prompts["enrich"]


def test_rules(spark):
    text = "Sterile walnut stool, off-white. 100/box, 5.5 mil, powder-free, non absorbable."
    row = spark.range(1).select(rules.rule_attributes(F.lit(text), {"material": rules.words("oak", "walnut"), **rules.VALUE_RULES}).alias("a")).first().a
    assert row == {"material": "walnut", "pack_size": "100/box", "thickness_mil": "5.5", "powder_free": "true", "sterile": "true", "absorbable": "false"}
    raw = spark.createDataFrame([raw_row(0, "u", [], sku="s", description="non-sterile stool, 6 / case")], RAW)
    good, _ = gapfill.merge_fallback(raw)
    enriched = gapfill.merge_enrichment(good, rules.rule_responses(gapfill.enrich_requests(good))).first()
    assert enriched.specifications == {"pack_size": "6 / case", "sterile": "false"}
