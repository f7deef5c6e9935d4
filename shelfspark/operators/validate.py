"""First-wins deduplication, verdicts and run counters."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import REASON_DUPLICATE, REASON_INCOMPLETE, REASON_INVALID
from ..functions.products import dedup_key, is_complete, not_in
from ..plans.scratch import materialize

VERDICTS = ("ok", "incomplete", "duplicate", "invalid")


def with_key(products: DataFrame) -> DataFrame:
    return products.withColumn("dedup_key", dedup_key(F.col("sku"), F.col("url")))


def first_arrivals(keyed: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """(dedup_key, seq) of the first complete row of each key.

    min(seq) combines before the shuffle, so a key that holds a third of the rows costs one row per task.
    `prior(dedup_key)`: keys accepted by earlier runs; their rows are never first. The first arrivals are stored before they
    meet it, so that a prior table in buckets is not shuffled.
    """
    complete = keyed.filter(is_complete(F.col("name"), F.col("url")))
    firsts = complete.groupBy("dedup_key").agg(F.min("seq").alias("seq"))
    if prior is not None:
        firsts = not_in(materialize(firsts, "firsts"), prior, "dedup_key")
    return firsts


def dedup_first(products: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """Complete rows, the earliest per key."""
    keyed = with_key(products)
    return keyed.join(first_arrivals(keyed, prior).select("seq"), "seq", "left_semi").drop("dedup_key")


def require_unique_seq(products: DataFrame) -> DataFrame:
    """`products` as they are; raises ValueError if two rows share a `seq`, on which every "first wins" rests."""
    twice = products.groupBy("seq").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if not twice.isEmpty():
        raise ValueError("two products share a seq: a page or an answer occurs more than once")
    return products


def validate_products(products: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """Add `verdict`, `valid` and `reason`; tested in order: incomplete, duplicate, bad scheme.

    `seq` must be unique. It is the join key here because it spreads evenly, which the dedup key
    does not. A row with a bad scheme still claims its key. `products` is read twice, so pass a
    stored table.
    """
    keyed = with_key(products)
    firsts = first_arrivals(keyed, prior).select("seq", F.lit(True).alias("_first"))
    return (
        keyed.join(firsts, "seq", "left")
        .withColumn("verdict", verdict(is_complete(F.col("name"), F.col("url")), F.col("_first").isNotNull()))
        .withColumn("valid", F.col("verdict") == "ok")
        .withColumn("reason", reason(F.col("verdict"), F.col("dedup_key")))
        .select(*products.columns, "dedup_key", "verdict", "valid", "reason")
    )


def verdict(complete: Column, first: Column, url: str = "url") -> Column:
    return (
        F.when(~complete, "incomplete").when(~first, "duplicate")
        .when(~F.col(url).rlike("^https?://"), "invalid").otherwise("ok")
    )


def reason(verdict: Column, key: Column) -> Column:
    return (
        F.when(verdict == "incomplete", REASON_INCOMPLETE)
        .when(verdict == "duplicate", F.concat(F.lit(REASON_DUPLICATE), key))
        .when(verdict == "invalid", REASON_INVALID)
        .otherwise("ok")
    )


def accepted(validated: DataFrame) -> DataFrame:
    return validated.filter("valid").drop("dedup_key", "verdict", "valid", "reason")


def urls_to_mark(validated: DataFrame) -> DataFrame:
    """Every URL that reached validation is done, accepted or not."""
    return validated.select("url")


def validation_summary(validated: DataFrame) -> DataFrame:
    """One row of run counters; the rate is 0.0 when nothing was seen."""
    count = lambda verdict: F.count_if(F.col("verdict") == verdict)
    return validated.agg(
        F.count(F.lit(1)).alias("total_seen"),
        count("ok").alias("accepted"),
        count("duplicate").alias("rejected_duplicate"),
        count("incomplete").alias("rejected_incomplete"),
        count("invalid").alias("rejected_invalid"),
        F.coalesce(F.try_divide(count("ok").cast("double"), F.count(F.lit(1))), F.lit(0.0)).alias("acceptance_rate"),
    )


def count_by_method(products: DataFrame) -> DataFrame:
    return products.groupBy("extraction_method").agg(F.count(F.lit(1)).alias("n_products"))


def one_row(*aggregates: DataFrame) -> DataFrame:
    """Put one-row aggregates side by side: union them with gaps, then take the one value of each column."""
    stacked = aggregates[0]
    for other in aggregates[1:]:
        stacked = stacked.unionByName(other, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def pipeline_status(seen: DataFrame, products: DataFrame) -> DataFrame:
    """One row: how many URLs are checkpointed, how many products are stored."""
    return one_row(
        seen.agg(F.count(F.lit(1)).alias("urls_processed")),
        products.agg(F.count(F.lit(1)).alias("n_products")),
    )


def run_summary(validated: DataFrame, requests_sent: DataFrame, seen: DataFrame, csv_rows: int) -> DataFrame:
    """One row: validation counters, calls made, checkpoint size, exported rows."""
    return one_row(
        validation_summary(validated),
        requests_sent.agg(F.count(F.lit(1)).alias("llm_calls")),
        seen.agg(F.count(F.lit(1)).alias("checkpoints")),
    ).withColumn("csv_rows", F.lit(csv_rows).cast("bigint"))
