"""Selector failures: miss events, thresholds, repair requests and suggestions for review."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import DETAIL_SELECTORS, REPAIR_THRESHOLD
from ..functions.answers import json_members, one_answer
from ..functions.running import nth_in_order
from ..functions.text import truncate_text
from ..plans.scratch import materialize


def miss_events(raw: DataFrame) -> DataFrame:
    """One row per page and missing critical field: field, seq, url."""
    return raw.select(F.explode("missing").alias("field"), "seq", "url")


def miss_counts(events: DataFrame) -> DataFrame:
    """Total misses per field (not consecutive ones)."""
    return events.groupBy("field").agg(F.count(F.lit(1)).alias("failures"))


def fields_to_repair(events: DataFrame, suggested: DataFrame | None = None, threshold: int = REPAIR_THRESHOLD) -> DataFrame:
    """Fields with at least `threshold` misses and no suggestion yet."""
    due = miss_counts(events).filter(F.col("failures") >= threshold)
    return due if suggested is None else due.join(open_suggestions(suggested), "field", "left_anti")


def open_suggestions(suggested: DataFrame) -> DataFrame:
    """Fields that have at least one suggestion; an empty list leaves a field open."""
    return suggested.filter(F.size("suggested") > 0).select("field")


def crossing_pages(events: DataFrame, threshold: int = REPAIR_THRESHOLD) -> DataFrame:
    """Per field, the page whose miss reached the threshold, whatever that is.

    There are only a few fields, so each holds a large share of the events: they are counted per page, and only the
    misses of the page in which the threshold falls are ranked.
    """
    if threshold < 1:
        raise ValueError("threshold must be positive")
    keys = events.select(*events.columns, F.col("seq.cat_idx").alias("_outer"), F.col("seq.page_num").alias("_inner"), F.col("seq.pos").alias("_order"))
    return nth_in_order(keys, ["field"], threshold).select(*events.columns)


def repair_requests(
    events: DataFrame,
    suggested: DataFrame | None = None,
    threshold: int = REPAIR_THRESHOLD,
    selectors: dict = DETAIL_SELECTORS,
) -> DataFrame:
    """field, failures, broken_selector, url of the page to look at; one row per field at most."""
    broken = F.create_map(*[F.lit(x) for pair in selectors.items() for x in pair])
    due = fields_to_repair(events, suggested, threshold)
    return due.join(crossing_pages(events, threshold), "field").select(
        F.concat(F.lit("repair|"), F.col("field")).alias("request_key"), F.lit("repair").alias("kind"),
        "field", "failures", F.try_element_at(broken, F.col("field")).alias("broken_selector"), "seq", "url",
    )


def with_repair_prompts(requests: DataFrame, pages: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Add the prompt with the page's HTML, cut after `max_chars`; there is at most one request per field.

    The few requests are stored first, so that they go to the page scan and no other page leaves it.
    """
    requests = materialize(requests, "repairs")
    html = pages.select("url", "html").join(requests.select("url"), "url", "left_semi")
    html = html.select("url", truncate_text(F.col("html"), max_chars).alias("_html"))
    prompt = F.concat(
        F.lit("The CSS selector for the field "), F.col("field"), F.lit(" finds nothing any more: "),
        F.col("broken_selector"),
        F.lit('\nPropose up to 3 selectors for it. Answer {"selectors": ["..."]}.\n\n'), F.coalesce("_html", F.lit("")),
    )
    return requests.join(html, "url", "left").withColumn("prompt", prompt).drop("_html")


def parse_suggestions(body: Column, limit: int | None = None) -> Column:
    """The text entries of the member `selectors`, with a `limit` the first ones; anything else gives an empty list."""
    listed = F.try_variant_get(json_members(body, ["selectors"]), "$.selectors", "array<variant>")
    texts = F.filter(listed, lambda v: F.schema_of_variant(v) == "STRING")
    found = F.transform(texts, lambda v: F.try_variant_get(v, "$", "string"))
    return F.coalesce(found if limit is None else F.slice(found, 1, limit), F.array().cast("array<string>"))


def repair_report(
    events: DataFrame, responses: DataFrame, threshold: int = REPAIR_THRESHOLD, max_suggestions: int | None = None,
) -> DataFrame:
    """field, failures, suggested: all counted fields, with suggestions where an answer has any.

    For review by a person; nothing is applied.
    """
    answers = one_answer(responses.filter("kind = 'repair'")).select(
        F.regexp_replace("request_key", r"^repair\|", "").alias("field"),
        parse_suggestions(F.col("body"), max_suggestions).alias("suggested"))
    due = fields_to_repair(events, None, threshold).select("field").join(answers, "field")
    return miss_counts(events).join(due, "field", "left").select(
        "field", "failures", F.coalesce("suggested", F.array().cast("array<string>")).alias("suggested"))
