import pytest

from shelfspark.operators import classify, repair

TITLE, PRICE = '<h1 class="page-title">t</h1>', '<i itemprop="price">1</i>'
CARDS = '<ul class="product-items"><li class="product-item"><li itemtype="x/Product">'


@pytest.mark.parametrize("url, html, expected", [
    ("http://h/p", TITLE + PRICE, "product_detail"),
    ("http://h/p", TITLE + '<i itemprop="sku">', "product_detail"),
    ("http://h/p", '<h1 itemprop="name">t</h1>' + PRICE, "product_detail"),
    ("http://h/p", PRICE, "other"),
    ("http://h/p", TITLE, "other"),
    ("http://h/p", "<h1>t</h1>" + PRICE, "other"),
    ("http://h/p", CARDS, "category_listing"),
    ("http://h/p", '<ul class="products list"><li class="product-item">', "other"),
    ("http://h/p", '<ul class="products list"><li class="product-item" itemtype="Product">', "other"),
    ("http://h/p", '<li class="product-item"><li class="product-item">', "other"),
    ("http://h/p", CARDS + TITLE + PRICE, "product_detail"),
    ("http://h/CATALOG/x/", "", "category_listing"),
    ("http://h/catalog/x.html", "", "other"),
    ("http://h/catalog/x.html//", "", "other"),
    ("http://h/catalog/x", TITLE + PRICE, "product_detail"),
    ("http://h/catalog", "", "other"),
    ("http://h/p", None, "other"),
])
def test_page_type(spark, url, html, expected):
    pages = spark.createDataFrame([(url, html)], "url string, html string")
    assert classify.classify_pages(pages).first().page_type == expected


def test_answers_decide_undecided_pages_only(spark):
    pages = spark.createDataFrame([("a", ""), ("b", ""), ("c", ""), ("d", CARDS), ("e", "")], "url string, html string")
    bodies = {"a": '{"page_type": "product_detail"}', "b": '{"page_type": "shop"}', "c": '["product_detail"]', "d": '{"page_type": "other"}'}
    answers = spark.createDataFrame([(f"classify|{u}", "classify", b) for u, b in bodies.items()], "request_key string, kind string, body string")
    typed = classify.classify_pages(pages, answers)
    assert {r.url: r.page_type for r in typed.collect()} == {
        "a": "product_detail", "b": "other", "c": "other", "d": "category_listing", "e": "other"}
    assert {tuple(r) for r in classify.page_type_counts(typed).collect()} == {("product_detail", 1), ("other", 3), ("category_listing", 1)}
    asked = {r.url: r.prompt for r in classify.classify_requests(pages.union(spark.createDataFrame([("f", "<p>x" * 20_000)], pages.schema))).collect()}
    assert set(asked) == {"a", "b", "c", "e", "f"}
    assert asked["f"].endswith("<p>x" * 20_000)
    cut = {r.url: r.prompt for r in classify.classify_requests(spark.createDataFrame([("f", "<p>x" * 20_000)], pages.schema), max_chars=30_000).collect()}
    assert cut["f"].endswith("<!-- truncated -->")


def events(spark, counts):
    rows = [((0, i, 0), f"{f}{i}", [f]) for f, n in counts.items() for i in range(n)]
    raw = spark.createDataFrame(rows, "seq struct<cat_idx:int,page_num:bigint,pos:int>, url string, missing array<string>")
    return repair.miss_events(raw)


def test_threshold_and_crossing_page(spark):
    misses = events(spark, {"sku": 4, "brand": 5, "price": 9})
    assert {r.field: r.failures for r in repair.fields_to_repair(misses).collect()} == {"brand": 5, "price": 9}
    requests = {r.field: r for r in repair.repair_requests(misses).collect()}
    assert {f: r.url for f, r in requests.items()} == {"brand": "brand4", "price": "price4"}
    assert requests["price"].broken_selector == ".price-box .price, .price"
    suggested = spark.createDataFrame([("brand", [".b"]), ("price", [])], "field string, suggested array<string>")
    assert [r.field for r in repair.repair_requests(misses, suggested).collect()] == ["price"]
    assert {r.field for r in repair.fields_to_repair(misses, threshold=4).collect()} == {"sku", "brand", "price"}


def test_any_threshold(spark):
    misses = events(spark, {"sku": 1200, "brand": 999})
    assert [r.url for r in repair.crossing_pages(misses, 1000).collect()] == ["sku999"]
    with pytest.raises(ValueError):
        repair.crossing_pages(misses, 0)


def test_report(spark):
    misses = events(spark, {"sku": 4, "brand": 5, "price": 6, "description": 7})
    bodies = {"sku": '{"selectors": [".s"]}', "brand": '{"selectors": [1, ".a", null, ".b", ".c", ".d"]}', "price": '{"selectors": "x"}'}
    answers = spark.createDataFrame([(f"repair|{f}", "repair", b) for f, b in bodies.items()], "request_key string, kind string, body string")
    report = {r.field: (r.failures, r.suggested) for r in repair.repair_report(misses, answers).collect()}
    assert report == {"sku": (4, []), "brand": (5, [".a", ".b", ".c", ".d"]), "price": (6, []), "description": (7, [])}
    three = {r.field: r.suggested for r in repair.repair_report(misses, answers, max_suggestions=3).collect()}
    assert three["brand"] == [".a", ".b", ".c"]


def test_prompts(spark):
    misses = events(spark, {"sku": 5})
    pages = spark.createDataFrame([("sku4", "<p>page</p>")], "url string, html string")
    prompt = repair.with_repair_prompts(repair.repair_requests(misses), pages).first().prompt
    assert "form[data-sku]" in prompt and prompt.endswith("<p>page</p>")
