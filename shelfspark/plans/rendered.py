"""A shop rendered from the `part` table: detail pages, listing pages, answers.

Every part becomes a product page whose gaps, duplicates and formats follow rules on p_partkey (k).
The expected products follow from the same rules without any HTML (see `oracles`).
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import materialize

SHOP = "https://shop.example.com"
KEYS_PER_PAGE = 144     # a listing page holds the parts of its type with k in one block of this size

# Rules in SQL that Spark and DuckDB read alike; k is p_partkey.
RULES = {
    "page_num": f"cast(floor(p_partkey / {KEYS_PER_PAGE}) as bigint)",
    "slug": "replace(p_name, ' ', '-') || '-' || cast(p_partkey as varchar(20))",
    "bare": "p_partkey % 37 = 5",
    "no_name": "p_partkey % 97 = 0",
    "ftp": "p_partkey % 53 = 0",
    "sku": "case when p_partkey % 37 = 5 or p_partkey % 11 = 0 then null "
           "when p_partkey % 20 = 19 or p_partkey % 53 = 1 then 'SKU-' || cast(p_partkey - 1 as varchar(20)) "
           "else 'SKU-' || cast(p_partkey as varchar(20)) end",
    "brand": "case when p_partkey % 37 = 5 or p_partkey % 13 = 0 then null else p_brand end",
    "description": "case when p_partkey % 37 = 5 or p_partkey % 17 = 0 then null "
                   "else p_type || ' ' || p_name || ', size ' || cast(p_size as varchar(20)) || ' & up' end",
    "pack_size": "case when p_partkey % 37 = 5 or p_partkey % 4 <> 0 then null "
                 "else cast(p_partkey % 10 + 1 as varchar(20)) || ' / box' end",
    "drifted": "(page_num + cat_idx) % 7 = 3",
}


@dataclass(frozen=True)
class Shop:
    """Category table (cat_idx, name, slug, url) and the number of the last listing page."""

    categories: DataFrame
    last_page: int


def read_shop(part: DataFrame) -> Shop:
    # The window runs over categories, not over parts.
    kinds = part.groupBy(F.col("p_type").alias("name")).agg(F.max("p_partkey").alias("k"))
    table = materialize(kinds.select(
        (F.row_number().over(Window.orderBy("name")) - 1).alias("cat_idx"), "name", F.lower("name").alias("slug"),
        F.concat(F.lit(f"{SHOP}/catalog/"), F.lower("name")).alias("url"), "k"), "categories")
    last = table.agg(F.max("k").alias("k")).first().k or 0
    return Shop(table.drop("k"), last // KEYS_PER_PAGE)


def categories(spark: SparkSession, shop: Shop) -> DataFrame:
    return shop.categories


def with_rules(part: DataFrame, shop: Shop) -> DataFrame:
    """part plus cat_idx, page_num, url and the rule columns."""
    index = shop.categories.select(F.col("name").alias("p_type"), "cat_idx")
    placed = part.join(index, "p_type").selectExpr("*", f"{RULES['page_num']} as page_num")
    rules = [f"{rule} as {name}" for name, rule in RULES.items() if name != "page_num"]
    return placed.selectExpr("*", *rules).selectExpr(
        "*", "case when ftp then 'ftp' else 'https' end || '://shop.example.com/product/' || slug as url")


# Price as the page shows it; null where it shows none. `k` is p_partkey.
PRICE_TEXT = """case when bare then null
    when p_partkey % 103 = 0 then '$0.00'
    when p_partkey % 101 = 0 then '-5.00'
    when p_partkey % 6 = 0 then '$' || format_number(p_retailprice * 10, 2)
    when p_partkey % 6 = 1 then format_string('%.2f', p_retailprice) || ' USD'
    when p_partkey % 6 = 2 then '  ' || format_string('%.2f', p_retailprice) || '\n '
    when p_partkey % 6 = 3 then 'From $' || format_string('%.2f', p_retailprice)
    when p_partkey % 6 = 5 then '$' || format_string('%.2f', p_retailprice) || ' - $' || format_number(p_retailprice + 100, 2) end"""


def price_text() -> Column:
    return F.expr(PRICE_TEXT)


def _choose(condition: str, yes: str, no: str) -> str:
    return f"case when {condition} then {yes} else {no} end"


def _tag(text: str, before: str, after: str) -> str:
    """Markup around a text; nothing where the text is null."""
    return f"coalesce('{before}' || {text} || '{after}', '')"


_ODD, _EVEN = "p_partkey % 2 = 1", "p_partkey % 2 = 0"
_PROSE = """case when description is not null then
    p_type || ' \t' || p_name || ',\n   size ' || string(p_size) || '  &amp; up' end"""
_SHOT = """'<img src="https://img.example.com/' || p_partkey || '-' || i || '.jpg">'"""

# The parts of a detail page, each an SQL text.
_DETAIL = {
    "head": """'<!DOCTYPE html><html><head><title>Shop</title><script>var a="</h1><h1>";</script></head><body>'
        || '<nav class="breadcrumbs"><ul><li><a href="/">Home</a><li>Catalog<li>' || p_type
        || '</ul></nav><!-- <h1>no</h1> --><main>'""",
    "name": _choose("no_name", "''", """'<h1 class="page-title"><span> ' || p_name || ' ' || p_partkey || '</span></h1>'"""),
    "brand": _choose(
        _ODD, _tag("brand", '<p class="manufacturer-name">', "</p>"),
        _tag("brand", '<a href="/shop-by-manufacturer/x"><span>', "</span></a>")),
    "sku": _choose(
        "p_partkey % 3 = 0", _tag("sku", '<form data-sku=""><b>', "</b></form>"),
        _tag("sku", '<form data-sku="', '"><input type="hidden"></form>')),
    "price": _choose(
        _EVEN, _tag(PRICE_TEXT, '<div class="price-box"><span class="price" itemprop="price">', "</span></div>"),
        _tag(PRICE_TEXT, '<span class="price" itemprop="price">', "</span>")),
    "description": _choose(
        _EVEN,
        _tag(_PROSE, '<div id="description"><h2>Description</h2><style>#html-body [data-pb-style=A1]{display:flex}</style><p>', "</p></div>"),
        _tag(_PROSE, '<div itemprop="description">Description ', "</div>")),
    "pack_size": _tag("pack_size", '<p class="product-info-pack-size">', ""),
}
# The parts that a bare page lacks.
_FULL = {
    "stock": """element_at(array(
        '<link itemprop="availability" href="http://schema.org/InStock">',
        '<link itemprop="availability" href="http://schema.org/OutOfStock"/>',
        '<div class="stock available">x</div><link itemprop="availability" href="https://schema.org/BackOrder">',
        '<div class="stock available"><span>Add to cart</span></div>',
        '<div itemprop="availability">InStock</div>'), int(p_partkey % 5 + 1))""",
    "images": f"""'<div class="product media">' || array_join(transform(
        slice(sequence(1, 12), 1, int(case when p_partkey % 50 = 0 then 12 else p_partkey % 4 end)), i -> {_SHOT}), '')
        || case when p_partkey % 50 = 0 or p_partkey % 4 > 0 then {_SHOT.replace('|| i ||', "|| '1' ||")} else '' end
        || '</div><div class="gallery">' || {_choose(_ODD, """'<img itemprop="image" src="" data-src="/media/'""", """'<img data-src="/media/'""")}
        || p_partkey || '.png"><img src="data:image/gif;base64,R0"></div>'""",
    "specs": """'<table class="additional-attributes"><tr><th>Material<td>' || split(p_name, ' ')[1]
        || '<tr><th>Color</th><td>' || split(p_name, ' ')[0]
        || '</td><td>extra</td></tr><tr><td>single</td></tr><tr><th>Empty</th><td> </td></tr>'
        || case when p_partkey % 9 = 0 then '<tr><th>Material</th><td>' || split(p_name, ' ')[0] || '</td></tr>' else '' end
        || '</table>'""",
}


def detail_html() -> Column:
    full = " || ".join(f"({part})" for part in _FULL.values())
    parts = [*_DETAIL.values(), _choose("bare", "''", full), "'</main></body></html>'"]
    return F.expr(" || ".join(f"({part})" for part in parts))


def detail_pages(part: DataFrame, shop: Shop) -> DataFrame:
    """One page per part: seq, url, category_path, html."""
    return with_rules(part, shop).select(
        F.expr(f"named_struct('cat_idx', cat_idx, 'page_num', page_num, 'pos', int(p_partkey % {KEYS_PER_PAGE}))").alias("seq"),
        "url", F.array("p_type").alias("category_path"), detail_html().alias("html"))


def listing_pages(part: DataFrame, shop: Shop) -> DataFrame:
    """One page per category and block of keys: url, html. Some show no usable cards, some close a cycle."""
    card = f"""'<li class="item product product-item ais-Hits-item"><a class="result" href="/product/' || slug || '"><span>' || p_name
        || '</span></a><link itemprop="url" content="{SHOP}/product/' || slug || '"></li>'"""
    cards = (
        with_rules(part, shop).filter("not ftp").groupBy("cat_idx", "page_num")
        .agg(F.expr(f"array_join(array_sort(collect_list(named_struct('k', p_partkey, 'card', {card}))).card, '')").alias("cards"))
    )
    grid = categories(part.sparkSession, shop).selectExpr(
        "cat_idx", "url", f"explode(sequence(0L, {shop.last_page}L)) as page_num").selectExpr(
        "*", f"string(case when page_num < {shop.last_page} then page_num + 2 when cat_idx % 2 = 0 then 2 end) as following")
    html = f"""'<html><body><ol class="products list items product-items">'
        || coalesce(case when {RULES['drifted']} then replace(replace(cards, 'class="result"', 'class="tile"'), 'itemprop="url"', '')
                    else cards end, '')
        || '<a class="result" href="/catalog/other">c</a><a class="result" href="/product/cartridge-9">d</a><a class="result" href="#top">t</a></ol>'
        || coalesce(case when cat_idx % 3 = 1
             then '<a class="ais-Pagination-link" aria-label="Next Page" href="' || url || '?page=' || following || '">&gt;</a>'
             else '<li class="ais-Pagination-item--nextPage"><a href="?page=' || following || '">&gt;</a></li>' end, '')
        || '</body></html>'"""
    page_url = "case when page_num = 0 then url else url || '?page=' || (page_num + 1) end"
    return grid.join(cards, ["cat_idx", "page_num"], "left").selectExpr(f"{page_url} as url", f"{html} as html")


_FALLBACK_ANSWERS = """array('{"sku": "first", "sku": "R-' || p_partkey || '", "brand": "Acme", "description": " Filled  text ", "price": "$7.50"}',
    'nope', '[1]', '{"brand": true, "price": 3}', '{"sku": null, "brand": "", "price": 0, "description": "D"}', '{"sku": 12345}')"""
_ENRICH_ANSWERS = """array('{"color": "none", "material": "vinyl", "color": " red ", "unknown": "x", "powder_free": true, "size": 5}',
    'nope', '[1]', '{"sterile": false}', '{"material": null, "color": " "}', '{"Material": "zzz", "form": "sponge"}')"""


def responses(part: DataFrame, shop: Shop) -> DataFrame:
    """Answers of every shape, chosen by k % 7; none where it is 6."""
    nth = "int(p_partkey % 7 + 1)"
    return with_rules(part, shop).filter("p_partkey % 7 <> 6").selectExpr("url", f"""inline(array(
        named_struct('kind', 'fallback', 'body', element_at({_FALLBACK_ANSWERS}, {nth})),
        named_struct('kind', 'enrich', 'body', element_at({_ENRICH_ANSWERS}, {nth}))))""").selectExpr(
        "kind || '|' || url as request_key", "kind", "body")
