import csv
import glob
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from shelfspark.functions.products import not_in
from shelfspark.operators import validate
from shelfspark.plans.scratch import materialize
from shelfspark.schemas import PRODUCTS
from shelfspark.sources import pages as page_tables
from shelfspark.sources import products as files
from shelfspark.sources import state

LINE = {
    "name": "Ünï \"q\"", "url": "https://h/1", "category_path": ["A", "B, C"], "brand": None, "sku": "S", "price": 24.5, "currency": "USD",
    "pack_size": None, "availability": "in_stock", "description": "two\nlines", "specifications": {"k": "v", "a": "ü"}, "image_urls": [],
    "alternative_skus": [], "extracted_at": "2026-01-01T00:00:00.000000Z", "extraction_method": "hybrid", "extraction_confidence": 0.85,
    "fields_via_llm": ["specifications"],
}


def write_lines(path, *lines):
    path.mkdir()
    (path / "part.json").write_text("\n".join(l if isinstance(l, str) else json.dumps(l) for l in lines) + "\n", encoding="utf-8")
    return str(path)


def test_jsonl_roundtrip_and_append(spark, tmp_path):
    src = write_lines(tmp_path / "in", LINE, "", LINE | {"sku": "T", "price": "$7.25 USD"})
    rows = files.read_products(spark, src)
    assert rows.schema.fieldNames() == PRODUCTS.fieldNames()
    out = str(tmp_path / "out")
    files.write_jsonl(rows, out)
    files.write_jsonl(rows.withColumn("price", F.lit(float("inf"))), out)
    assert files.read_products(spark, out).count() == 4
    written = [json.loads(l) for f in glob.glob(out + "/part*") for l in open(f, encoding="utf-8")]
    assert LINE in written
    assert sorted((w["sku"], w["price"] or 0) for w in written) == [("S", 0), ("S", 24.5), ("T", 0), ("T", 7.25)]
    assert all(list(w) == PRODUCTS.fieldNames() for w in written)


def test_strict_read_fills_defaults_and_fails_on_bad_lines(spark, tmp_path):
    short = write_lines(tmp_path / "short", {"name": " n ", "url": "u"})
    row = files.read_products(spark, short).first()
    assert (row["name"], row.currency, row.category_path, row.extraction_method, row.extraction_confidence) == ("n", "USD", [], "selector", 1.0)
    for i, bad in enumerate(("{nope", LINE | {"name": " "}, LINE | {"price": -1}, LINE | {"extraction_method": "magic"}, LINE | {"extraction_confidence": 2})):
        with pytest.raises(Exception, match="part.json|name is empty|negative|method|confidence"):
            files.read_products(spark, write_lines(tmp_path / f"bad{i}", LINE, bad)).collect()
    assert files.read_products(spark, str(tmp_path / "absent")).count() == 0


def test_csv_export(spark, tmp_path):
    src = write_lines(tmp_path / "in", LINE, "", "{broken", LINE | {"price": 10000000.0, "sku": " x, ", "brand": "a\rb", "description": None})
    out = str(tmp_path / "csv")
    assert files.export_csv(spark, src, out) == 2
    assert files.export_csv(spark, src, out) == 2
    name = glob.glob(out + "/part*.csv")[0]
    with open(name, encoding="utf-8", newline="") as f:
        text = f.read()
    rows = list(csv.DictReader(text.splitlines(keepends=True)))
    assert list(rows[0]) == ["name", "brand", "sku", "price", "currency", "pack_size", "availability", "category_path", "url", "description",
                             "image_urls", "specifications", "extraction_method", "extraction_confidence", "fields_via_llm", "extracted_at"]
    assert text.startswith("name,brand,")
    assert rows[0]["name"] == LINE["name"] and rows[0]["description"] == "two\nlines" and rows[0]["brand"] == ""
    assert rows[0]["category_path"] == '["A", "B, C"]' and rows[0]["specifications"] == '{"k": "v", "a": "ü"}'
    assert rows[0]["extracted_at"] == LINE["extracted_at"] and rows[0]["image_urls"] == "[]"
    assert (rows[1]["price"], rows[1]["sku"], rows[1]["brand"], rows[1]["description"]) == ("10000000.0", " x, ", "a\rb", "")
    assert files.export_csv(spark, str(tmp_path / "absent"), str(tmp_path / "none")) == 0
    assert not glob.glob(str(tmp_path / "none"))


def test_seen_table(spark, tmp_path):
    path = str(tmp_path / "seen")
    assert state.load_seen(spark, path).count() == 0
    frame = lambda *urls: spark.createDataFrame([(u,) for u in urls], "url string")
    state.save_seen(frame("b", "a", "b"), path)
    state.save_seen(frame("a", "c"), path)
    assert sorted(r.url for r in state.load_seen(spark, path).collect()) == ["a", "b", "c"]


def test_known_keys_are_never_shuffled(spark, tmp_path):
    path, keys = str(tmp_path / "seen"), str(tmp_path / "keys")
    state.save_seen(spark.range(5000).selectExpr("concat('http://h/', id) as url"), path, buckets=7)
    state.save_seen(spark.createDataFrame([("x",), (None,), ("x",), ("http://h/1",)], "url string"), path, buckets=99)
    seen = state.load_seen(spark, path)
    assert seen.count() == 5001 and [p.name for p in (tmp_path / "seen").iterdir()] == ["buckets-7"]
    arrivals = [(f"http://h/{i}", (0, 0, i)) for i in range(4990, 5010)]
    products = [(f"http://h/{i}", f"SKU{i % 8}", "n", (0, 0, i)) for i in range(20)]
    arrivals = materialize(spark.createDataFrame(arrivals, "url string, seq struct<a: int, b: int, c: int>"), "arrivals")
    state.save_keys(spark.createDataFrame([("SKU1", True), ("SKU2", False)], "dedup_key string, valid boolean"), keys)
    products = materialize(spark.createDataFrame(products, "url string, sku string, name string, seq struct<a: int, b: int, c: int>"), "products")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        fresh = not_in(arrivals, seen, "url")
        firsts = validate.first_arrivals(validate.with_key(products), state.load_keys(spark, keys))
        for frame, stored in ((fresh, "url"), (firsts, "dedup_key")):
            plan = frame._jdf.queryExecution().executedPlan().toString()
            above, table = plan.split("Bucketed: true")[0].rsplit("\n", 1)
            # The table's own branch: what stands over its scan down from the join has no exchange.
            branch = above.split("SortMergeJoin")[1].split("+- ")[-3:]
            assert plan.count("Exchange hashpartitioning") == 1 and not any("Exchange" in step for step in branch), plan
        assert sorted(r.url for r in fresh.collect()) == [f"http://h/{i}" for i in range(5000, 5010)]
        assert sorted(r.dedup_key for r in firsts.collect()) == ["SKU0", *[f"SKU{i}" for i in range(2, 8)]]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    (tmp_path / "seen" / "buckets-7" / "part-99999-bad_00003.c000.parquet").write_bytes(b"no parquet at all")
    assert state.load_seen(spark, path).count() == 5001


def test_repair_report_is_written_only_with_suggestions(spark, tmp_path):
    report = spark.createDataFrame([("sku", 5, [])], "field string, failures bigint, suggested array<string>")
    assert not state.write_repair_report(report, str(tmp_path / "r"))
    report = spark.createDataFrame([("sku", 5, [".x"])], "field string, failures bigint, suggested array<string>")
    assert state.write_repair_report(report, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).first().suggested == [".x"]
    assert state.load_responses(spark, str(tmp_path / "none")).count() == 0


def test_pages_and_archive(spark, tmp_path):
    site = tmp_path / "site" / "deep"
    site.mkdir(parents=True)
    (site / "a.html").write_text("<h1>a</h1>\n<p>b")
    row = page_tables.read_pages(spark, str(tmp_path / "site"), "html").first()
    assert row.url.endswith("/deep/a.html") and row.html == "<h1>a</h1>\n<p>b" and row.final_url == row.url and row.status is None
    pages = spark.createDataFrame([("https://h/1", "x", 200), ("https://h/2", "y", 503)], "url string, html string, status int")
    assert [r.url for r in page_tables.status_ok(page_tables.as_pages(pages)).collect()] == ["https://h/1"]
    archive = str(tmp_path / "archive")
    page_tables.write_archive(page_tables.as_pages(pages), archive)
    keys = {r.url: r.archive_key for r in page_tables.read_archive(spark, archive).collect()}
    assert [r.html for r in page_tables.read_archive(spark, archive, "https://h/2").collect()] == ["y"]
    assert keys == {u: hashlib.sha1(u.encode()).hexdigest()[:16] for u in ("https://h/1", "https://h/2")}
