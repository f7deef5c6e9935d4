"""Run state: URLs already processed, responses, repair reports."""

from pyspark.sql import DataFrame, SparkSession

from ..operators.validate import with_key
from ..schemas import RESPONSES
from .buckets import BUCKETS, add_keys, read_keys
from .paths import has_data
from .products import read_products


def load_seen(spark: SparkSession, path: str) -> DataFrame:
    """seen(url): URLs of earlier runs; no table means none, and corrupt files are left out (their URLs run again)."""
    return read_keys(spark, path, "url")


def save_seen(urls: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Append the URLs that are not in the table yet; earlier files are neither rewritten nor shuffled."""
    add_keys(urls, path, "url", buckets)


def load_keys(spark: SparkSession, path: str) -> DataFrame:
    """(dedup_key) that `save_keys` stored, for `validate_products(prior=...)`."""
    return read_keys(spark, path, "dedup_key")


def save_keys(validated: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Append the keys of accepted products that are not in the table yet."""
    add_keys(validated.filter("valid"), path, "dedup_key", buckets)


def load_responses(spark: SparkSession, path: str) -> DataFrame:
    """responses(request_key, kind, body) as JSON lines; none without a file."""
    if not has_data(spark, path):
        return spark.createDataFrame([], RESPONSES)
    return spark.read.schema(RESPONSES).json(path)


def write_requests(requests: DataFrame, path: str) -> None:
    """Requests as JSON lines, with their prompts where they have them: what the model or person is to answer."""
    kept = [c for c in ("request_key", "kind", "url", "field", "fields", "prompt") if c in requests.columns]
    requests.select(*kept).write.mode("errorifexists").json(path)


def load_prior_keys(spark: SparkSession, jsonl_path: str) -> DataFrame:
    """(dedup_key) of all products stored by earlier runs, read from the products; `load_keys` reads a table kept for it."""
    return with_key(read_products(spark, jsonl_path)).select("dedup_key").distinct()


def write_repair_report(report: DataFrame, path: str) -> bool:
    """Write field, failures, suggested as JSON; only if some field has suggestions."""
    if report.filter("size(suggested) > 0").isEmpty():
        return False
    report.write.mode("overwrite").json(path)
    return True
