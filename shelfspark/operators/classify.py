"""Page types from URL and page structure, with an optional answer table for the undecided."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import PAGE_TYPES
from ..functions.answers import json_members, one_answer
from ..functions.text import truncate_text
from ..plans.scratch import materialize
from .match import match_selectors, page_type_fields


def dom_page_type(matched: DataFrame) -> Column:
    """Detail if a detail signal and a product title exist; else listing if a container holds two cards."""
    has = lambda name: F.size(matched[name]) > 0
    return (
        F.when(has("detail_signal") & has("detail_title"), "product_detail")
        .when(has("listing_signal") & (F.size(matched["listing_cards"]) >= 2), "category_listing")
        .otherwise("other")
    )


def url_page_type(url: Column, dom_type: Column) -> Column:
    """Catalog URLs that do not end in .html are listings unless the page says otherwise."""
    lowered = F.lower(url)
    catalog = lowered.contains("/catalog/") & ~F.regexp_replace(lowered, "/+$", "").endswith(".html")
    return F.when((dom_type == "other") & catalog, "category_listing").otherwise(dom_type)


def classify_pages(pages: DataFrame, responses: DataFrame | None = None) -> DataFrame:
    """pages(url, html, ...) -> the other columns plus `page_type`.

    `responses` of kind 'classify' decide pages that are still 'other'; unknown labels leave them so.
    """
    typed = with_page_type(match_selectors(pages, page_type_fields()))
    return typed if responses is None else decide(typed, responses)


def with_page_type(matched: DataFrame) -> DataFrame:
    """Replace the hit columns of `page_type_fields` by `page_type`."""
    typed = matched.withColumn("page_type", url_page_type(F.col("url"), dom_page_type(matched)))
    return typed.drop(*[f.name for f in page_type_fields()])


def decide(typed: DataFrame, responses: DataFrame) -> DataFrame:
    """Rows with `page_type`, the undecided ones by the answer to their request."""
    kept = [c for c in typed.columns if c != "page_type"]
    label = F.try_variant_get(json_members(F.col("body"), ["page_type"]), "$.page_type", "string")
    answers = one_answer(responses.filter("kind = 'classify'")).select("request_key", label.alias("_label"))
    guess = F.when(F.col("_label").isin(*PAGE_TYPES), F.col("_label")).otherwise("other")
    return (
        typed.withColumn("request_key", F.concat(F.lit("classify|"), F.col("url")))
        .join(answers, "request_key", "left")
        .select(*kept, F.when(F.col("page_type") == "other", guess).otherwise(F.col("page_type")).alias("page_type"))
    )


def classify_requests(pages: DataFrame, typed: DataFrame | None = None, max_chars: int | None = None) -> DataFrame:
    """Requests for pages that rules leave undecided, with their HTML, cut after `max_chars`.

    `typed` are pages with their type, such as `match_site` stores; without it the pages are matched here. The
    undecided URLs are stored first, so that a small set goes to the page scan and no other page leaves it.
    """
    typed = classify_pages(pages.select("url", "html")) if typed is None else typed
    open_ = materialize(typed.filter("page_type = 'other'").select("url").distinct(), "undecided")
    asked = pages.select("url", truncate_text(F.col("html"), max_chars).alias("_excerpt")).join(open_, "url", "left_semi")
    question = 'Is this page a category_listing, a product_detail or other? Answer {"page_type": "..."}.\n\n'
    return asked.select(
        F.concat(F.lit("classify|"), F.col("url")).alias("request_key"), F.lit("classify").alias("kind"), "url",
        F.concat(F.lit(question), F.coalesce("_excerpt", F.lit(""))).alias("prompt"))


def page_type_counts(typed: DataFrame) -> DataFrame:
    return typed.groupBy("page_type").agg(F.count(F.lit(1)).alias("n_pages"))
