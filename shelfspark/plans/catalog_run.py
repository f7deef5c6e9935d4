"""The whole run as one plan: pages and categories in, products and run state out."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import DETAIL_SELECTORS, LISTING_SELECTORS
from ..functions.answers import one_answer
from ..operators import extract, gapfill, navigate, validate
from ..operators.classify import with_page_type
from ..operators.match import detail_fields, listing_fields, match_selectors, page_type_fields
from ..sources.pages import latest_pages, version_order
from ..sources.products import export_csv, read_products, write_jsonl
from ..sources.state import load_seen, save_keys, save_seen
from .scratch import materialize

_LISTING_HITS = ("product_link", "next_page")


@dataclass
class CatalogRun:
    """Frames of one run; `validated` holds every product row with its verdict."""

    frontier: DataFrame
    misses: DataFrame
    unextractable: DataFrame
    gate_rejects: DataFrame
    requests_sent: DataFrame
    validated: DataFrame

    def products(self) -> DataFrame:
        return validate.accepted(self.validated)


def match_site(pages: DataFrame, detail=DETAIL_SELECTORS, listing=LISTING_SELECTORS) -> DataFrame:
    """One pass over the HTML with all selector sets, stored without the HTML: url, hits, page_type; one row per URL.

    Every later step reads this table, so each page is parsed once however many steps look at it. Of a URL that occurs more
    than once the latest page counts (see `version_order`); only hits of such URLs are shuffled to find it. Pages without a
    URL all stay.
    """
    fields = detail_fields(detail) + listing_fields(listing) + page_type_fields()
    matched = match_selectors(pages.select("url", "html", version_order(pages).alias("_version")), fields)
    stored = materialize(with_page_type(matched), "matched")
    unique = latest_pages(stored, F.col("_version"))
    return (stored if unique is stored else materialize(unique, "matched")).drop("_version")


def run_catalog(
    matched: DataFrame,
    categories: DataFrame,
    run_ts,
    cap: int | None = None,
    seen: DataFrame | None = None,
    responses: DataFrame | None = None,
    max_calls: int | None = None,
    prior: DataFrame | None = None,
    max_images: int | None = None,
) -> CatalogRun:
    """`matched` from `match_site`. Without responses only selectors speak, and `requests_sent` is what to ask first.

    `cap` bounds the products of a category, `max_calls` the requests (and the answers used), `max_images` the images of
    a product; None, the default, bounds nothing.
    """
    edges = materialize(navigate.product_links(matched), "edges")
    walked = navigate.walk_pagination(categories, edges, cap)
    urls = navigate.unseen(navigate.frontier(walked, edges, cap), seen)
    urls = urls if seen is None else materialize(urls, "frontier")
    detail = matched.drop(*_LISTING_HITS, "page_type")
    fields = extract.raw_fields(navigate.attach_pages(urls, detail), max_images)
    raw = materialize(extract.with_gaps(extract.extractable(fields)), "raw")
    sent = plan_requests(raw, responses, max_calls)
    if responses is not None:
        responses = one_answer(responses).join(sent.select("request_key"), "request_key", "left_semi")
    judged = materialize(gapfill.judge_fallback(raw, responses), "judged")
    built, rejects = gapfill.split_judged(judged)
    products = materialize(gapfill.stamp(gapfill.merge_enrichment(built, responses), run_ts), "products")
    return CatalogRun(
        frontier=urls,
        misses=navigate.fetch_misses(urls, detail),
        unextractable=extract.unextractable(fields),
        gate_rejects=rejects,
        requests_sent=sent,
        validated=validate.validate_products(validate.require_unique_seq(products), prior),
    )


def plan_requests(raw: DataFrame, responses: DataFrame | None = None, max_calls: int | None = None) -> DataFrame:
    """Requests of a run that fit the call budget (None: all), in the order they would be made. Stored.

    A row's enrichment is asked only if the row survives its fallback answer. Answers beyond the
    budget do not matter here: once it is spent no later request is sent either.
    """
    survivors, _ = gapfill.merge_fallback(raw, responses)
    wanted = materialize(gapfill.fallback_requests(raw).unionByName(gapfill.enrich_requests(survivors)), "wanted")
    sent, _ = gapfill.budget_requests(wanted, max_calls)
    return sent if max_calls is None else materialize(sent, "requests")


def store_run(run: CatalogRun, jsonl_path: str, seen_path: str, keys_path: str | None = None) -> None:
    """Append accepted products, then mark every URL that reached validation; with `keys_path` the accepted keys as well."""
    validated = materialize(run.validated, "validated")     # read by both sinks
    write_jsonl(validate.accepted(validated), jsonl_path)
    if keys_path:
        save_keys(validated, keys_path)
    save_seen(validate.urls_to_mark(validated), seen_path)


def export_catalog(spark: SparkSession, jsonl_path: str, csv_path: str) -> int:
    """Products as stored -> CSV; the number of rows."""
    return export_csv(spark, jsonl_path, csv_path)


def catalog_status(spark: SparkSession, seen_path: str, jsonl_path: str) -> tuple[DataFrame, DataFrame]:
    """(one row with the sizes of checkpoint and product store, product counts by method)."""
    products = read_products(spark, jsonl_path)
    return validate.pipeline_status(load_seen(spark, seen_path), products), validate.count_by_method(products)
