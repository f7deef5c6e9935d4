import pytest
from pages import ONE_SPEC, PAGE_A, SELECTORS_A, SELECTORS_B, page_b

from shelfspark.operators import extract, gapfill

SEQ = "seq struct<cat_idx:int,page_num:bigint,pos:int>"


def raw_rows(spark, pages, selectors):
    df = spark.createDataFrame([((0, 0, i), u, h) for i, (u, h) in enumerate(pages)], f"{SEQ}, url string, html string")
    return extract.extract_raw(df, selectors)


def products(spark, pages, selectors, responses=None):
    raw = raw_rows(spark, pages, selectors)
    answers = None
    if responses is not None:
        answers = spark.createDataFrame(responses, "request_key string, kind string, body string")
    good, _ = gapfill.merge_fallback(raw, answers)
    return {r.url: r for r in gapfill.merge_enrichment(good, answers).collect()}


def test_page_a(spark):
    row = products(spark, [("https://example.com/shop/x.html", PAGE_A)], SELECTORS_A)["https://example.com/shop/x.html"]
    assert row["name"] == "Bar clamp 300 mm"
    assert (row.brand, row.sku, row.price, row.availability, row.pack_size) == ("Torvald", "BC-0300", 1018.5, "backorder", "2 pieces")
    assert row.description == "Cast iron jaws.Opens with one hand."
    assert row.image_urls == ["https://example.com/img/front.webp", "https://example.com/shop/side.webp"]
    assert row.specifications == {"Jaw": "85 mm", "Steel": "C45"}
    assert row.category_path == ["Workshop", "Clamps"]
    assert (row.extraction_method, row.extraction_confidence, row.fields_via_llm, row.currency) == ("selector", 1.0, [], "USD")


def test_no_name_no_row(spark):
    pages = [("u", "<html><body><p>Nothing</p></body></html>"), ("v", None)]
    assert products(spark, pages, SELECTORS_A) == {}
    fields = extract.raw_fields(extract.match_selectors(
        spark.createDataFrame(pages, "url string, html string"), extract.detail_fields(SELECTORS_A)))
    assert {r.url for r in extract.unextractable(fields).collect()} == {"u", "v"}


def enrich(url, body):
    return [(f"enrich|{url}", "enrich", body)]


def test_enrichment_promotes_to_hybrid(spark):
    answer = '{"material": "nylon", "color": "blue", "color": "red", "pack_size": "12/box", "weight": "1"}'
    row = products(spark, [("p1", page_b())], SELECTORS_B, enrich("p1", answer))["p1"]
    assert row.sku == "SC-7"
    assert row.specifications == {"material": "nylon", "color": "red", "pack_size": "12/box"}
    assert (row.extraction_method, row.extraction_confidence, row.fields_via_llm) == ("hybrid", 0.85, ["specifications"])


def test_enrichment_does_not_overwrite(spark):
    row = products(spark, [("p2", page_b(ONE_SPEC))], SELECTORS_B, enrich("p2", '{"material": "nylon", "color": "red"}'))["p2"]
    assert row.specifications == {"material": "steel", "color": "red"}


def test_two_answers_give_one_product(spark):
    twice = enrich("p4", '{"color": "a"}') + enrich("p4", '{"color": "b"}')
    row = spark.createDataFrame(twice, "request_key string, kind string, body string")
    built, _ = gapfill.merge_fallback(raw_rows(spark, [("p4", page_b())], SELECTORS_B), row)
    assert [r.specifications for r in gapfill.merge_enrichment(built, row).collect()] == [{"color": "b"}]


@pytest.mark.parametrize("answers", [None, [], enrich("p3", "{}"), enrich("p3", "nope"), enrich("p3", "[1]"),
                                     enrich("p3", '{"Material": "x", "color": " ", "form": null}')])
def test_no_or_empty_answer_leaves_selector_result(spark, answers):
    row = products(spark, [("p3", page_b())], SELECTORS_B, answers)["p3"]
    assert (row.extraction_method, row.specifications, row.fields_via_llm) == ("selector", {}, [])


def one_field(spark, html, column, max_images=None, **selectors):
    chosen = SELECTORS_A | {"name": "h1"} | selectors
    page = f"<h1>n</h1>{html}"
    df = spark.createDataFrame([((0, 0, 0), "https://h.com/a/b", page)], f"{SEQ}, url string, html string")
    return extract.extract_raw(df, chosen, max_images=max_images).first()[column]


@pytest.mark.parametrize("html, expected", [
    ('<i itemprop="availability" href="x/InStock">', "in_stock"),
    ('<i itemprop="availability" href="x/OutOfStock">', "out_of_stock"),
    ('<i itemprop="availability" href="x/BackOrder">', "backorder"),
    ('<i itemprop="availability" href="x/Backorder">', "backorder"),
    ('<i itemprop="availability" href="x/PreOrder">', None),
    ('<i itemprop="availability" href="x/PreOrder"></i><i itemprop="availability" href="InStock">', "in_stock"),
    ('<i class="stock available">', "in_stock"),
    ('<i class="stock unavailable">', "out_of_stock"),
    ('<i itemprop="availability" class="x available">', "in_stock"),
    ('<i itemprop="availability">InStock</i>', None),
    ('<i class="stock unavailable"></i><i itemprop="availability" href="InStock">', "in_stock"),
])
def test_availability(spark, html, expected):
    found = one_field(spark, html, "availability", availability="[itemprop='availability'], .stock.available, .stock.unavailable")
    assert found == expected


def test_images(spark):
    html = ('<div class="photos"><img src="" data-src="/d.png"><img src="c.png"><img src="data:x"><img src="c.png">'
            '<img data-lazy-src="//z.com/l.png"><img>' + "".join(f'<img src="{i}.png">' for i in range(12)) + "</div>")
    found = one_field(spark, html, "image_urls")
    assert found[:3] == ["https://h.com/d.png", "https://h.com/a/c.png", "https://z.com/l.png"]
    assert len(found) == 15 and found[-1] == "https://h.com/a/11.png"
    assert one_field(spark, html, "image_urls", max_images=10) == found[:10]


def test_specs(spark):
    html = ('<table class="facts"><tr><th>Material<td>a<tr><td>one</td></tr><tr><td>k</td><td> </td></tr>'
            "<tr><th>material</th><td>b</td></tr><tr><th>Material</th><td>c</td></tr></table>")
    assert one_field(spark, html, "specifications") == {"Material": "c", "material": "b"}


def test_first_text_follows_selector_order_and_first_nodes_only(spark):
    html = '<b class="y">two</b><b class="x"> </b><b class="x">late</b><b class="z">three</b>'
    assert one_field(spark, html, "brand", brand=".x, .z, .y") == "three"
    assert one_field(spark, '<form data-sku=" "><b>T</b></form>', "sku", sku="form[data-sku]") == "T"
    assert one_field(spark, '<form data-sku=" S "><b>T</b></form>', "sku", sku="form[data-sku]") == "S"


def test_breadcrumbs_first_alternative_with_a_kept_text(spark):
    html = '<ol class="a"><li>HOME</li><li> </li></ol><ol class="b"><li>x</li><li>Home</li><li>y</li></ol>'
    assert one_field(spark, html, "category_path", breadcrumbs=".a li, .b li") == ["x", "y"]


def test_given_category_path_wins_unless_empty(spark):
    df = spark.createDataFrame([("u", PAGE_A, ["Given"]), ("v", PAGE_A, [])], "url string, html string, category_path array<string>")
    rows = {r.url: r.category_path for r in extract.extract_raw(df, SELECTORS_A).collect()}
    assert rows == {"u": ["Given"], "v": ["Workshop", "Clamps"]}


def test_style_text_in_description_is_removed(spark):
    html = '<div class="body"><h2>Description</h2><style>#html-body [data-x=A]{a:b}</style><p>Soft  sponge</p></div>'
    assert one_field(spark, html, "description") == "Soft sponge"


def test_missing_and_bad_prices(spark):
    def missing(price):
        return one_field(spark, f'<p class="maker">b</p><span class="code">s</span><p class="body">d</p>'
                                f'<aside><b class="cost">{price}</b></aside>', "missing")
    assert missing("$5") == []
    assert missing("$0") == ["price"]
    assert missing("call us") == ["price"]
    assert missing("-5") == missing("nan") == ["sku", "brand", "description", "price"]
