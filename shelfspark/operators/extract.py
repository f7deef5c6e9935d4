"""Detail extraction: matched nodes -> raw product fields, all as built-in expressions without a shuffle."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import CRITICAL_FIELDS, DETAIL_SELECTORS
from ..functions.products import compute_once, missing_critical, valid_price
from ..functions.text import clean_description, parse_price, strip
from ..functions.urls import resolve_all_sql, split_url
from .match import detail_fields, match_selectors

RAW_FIELDS = (
    "name", "brand", "sku", "price_text", "description", "pack_size",
    "availability", "image_urls", "specifications", "category_path",
)


def first_text(hits: str) -> Column:
    """First non-empty text over the first nodes of the alternatives, left to right."""
    return F.expr(f"get(filter({hits}, h -> h.text <> ''), 0).text")


def first_attr(hits: str, attr: str) -> Column:
    """First non-empty attribute in the same order, stripped after the choice."""
    return strip(F.expr(f"get(filter({hits}, h -> h.{attr} <> ''), 0).{attr}"))


def sku(hits: str) -> Column:
    return F.coalesce(F.nullif(first_attr(hits, "data_sku"), F.lit("")), first_text(hits))


def availability(hits: str) -> Column:
    """First node that carries a stock signal in its href, else in its class; text is not trusted."""
    return F.expr(f"""get(array_compact(transform({hits}, h -> case
        when contains(h.href, 'InStock') then 'in_stock'
        when contains(h.href, 'OutOfStock') then 'out_of_stock'
        when contains(h.href, 'BackOrder') or contains(h.href, 'Backorder') then 'backorder'
        when contains(h.class, 'stock available') or rlike(h.class, r'(^|\\s)available(\\s|$)') then 'in_stock'
        when contains(h.class, 'stock unavailable') then 'out_of_stock' end)), 0)""")


def image_urls(hits: str, base: str, base_url: str, limit: int | None = None) -> Column:
    """Resolved http(s) image URLs, repeats dropped; with a `limit` only the first ones."""
    refs = f"""array_compact(transform({hits}, h ->
        coalesce(nullif(h.src, ''), nullif(h.data_src, ''), nullif(h.data_lazy_src, ''))))"""
    resolved = resolve_all_sql(base, base_url, refs)
    found = f"array_distinct(filter({resolved}, u -> startswith(u, 'http')))"
    return F.expr(found if limit is None else f"slice({found}, 1, {limit})")


def spec_map(hits: str) -> Column:
    """First two cells of each row as key and value; a later value of the same key wins, first position kept."""
    rows = f"filter({hits}, h -> size(h.cells) >= 2 and h.cells[0] <> '' and h.cells[1] <> '')"
    return F.expr(f"""transform(array({rows}), rows -> map_from_entries(transform(
        array_distinct(transform(rows, h -> h.cells[0])),
        k -> struct(k, element_at(filter(rows, h -> h.cells[0] = k), -1).cells[1]))))[0]""")


def breadcrumbs(hits: str) -> Column:
    """Texts of the first alternative that keeps any; empty and 'home' entries do not count."""
    return F.expr(f"""transform(array(filter({hits}, h -> h.text <> '' and lower(h.text) <> 'home')), kept ->
        transform(filter(kept, h -> h.alt = get(kept, 0).alt), h -> h.text))[0]""")


def raw_fields(matched: DataFrame, max_images: int | None = None) -> DataFrame:
    """Replace the hit columns of `detail_fields` by raw field values.

    `category_path` is kept where given and not empty; otherwise it is the breadcrumb path.
    """
    hit_columns = {f.name for f in detail_fields()}
    carried = [c for c in matched.columns if c not in hit_columns and c != "category_path"]
    path = breadcrumbs("breadcrumbs")
    if "category_path" in matched.columns:
        path = F.when(F.size("category_path") > 0, F.col("category_path")).otherwise(path)
    based = matched.withColumn("_base", split_url("url"))
    return compute_once(based, [
        first_text("name").alias("name"),
        first_text("brand").alias("brand"),
        sku("sku").alias("sku"),
        first_text("price").alias("price_text"),
        clean_description(first_text("description")).alias("description"),
        first_text("pack_size").alias("pack_size"),
        availability("availability").alias("availability"),
        image_urls("images", "_base", "url", max_images).alias("image_urls"),
        spec_map("specifications_rows").alias("specifications"),
        path.alias("category_path"),
    ], carried)


def extractable(raw: DataFrame) -> DataFrame:
    """Rows with a product name; the others are no product pages."""
    return raw.filter("name is not null and url is not null")


def unextractable(raw: DataFrame) -> DataFrame:
    """Pages without a product name: not emitted and not marked as seen, so a later run tries them again."""
    return raw.filter("name is null").select("url")


def with_gaps(raw: DataFrame) -> DataFrame:
    """Add `price` and `missing`: the critical fields to ask for. An invalid price makes all four count as missing."""
    price = F.col("price")
    gaps = missing_critical(F.col("sku"), F.col("brand"), F.col("description"), price)
    every = F.array(*[F.lit(f) for f in CRITICAL_FIELDS])
    priced = compute_once(raw, [parse_price(F.col("price_text")).alias("price")], ["*"])
    return priced.withColumn("missing", F.when(valid_price(price), gaps).otherwise(every))


def extract_raw(pages: DataFrame, selectors: dict = DETAIL_SELECTORS, max_images: int | None = None) -> DataFrame:
    """pages(url, html, ...) -> raw product fields with `missing`, one row per page with a product name."""
    return with_gaps(extractable(raw_fields(match_selectors(pages, detail_fields(selectors)), max_images)))
