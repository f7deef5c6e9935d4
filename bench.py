"""Time the headline queries on whole tables, the median of up to three runs each; prints one JSON line."""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from shelfspark.plans.queries import QUERIES, store_fixture  # noqa: E402
from shelfspark.plans.session import local_session  # noqa: E402

HEADLINE = (
    "extract_catalog", "page_titles", "nav_links", "resolve_links", "clean_text", "parse_prices",
    "merge_fallback", "merge_enrichment", "budget_requests", "validate_catalog", "validation_summary", "frontier_capped",
    "frontier_full", "catalog_products", "catalog_products_full", "catalog_products_answered", "recrawled_catalog", "page_types",
    "repair_requests", "csv_export", "archive_keys", "changed_pages", "field_coverage", "drift_report",
    "health_windows", "nearest_products", "stream_catalog",
)


RUNS, ENOUGH = 3, 15.0      # times that a query runs at most, and the seconds after which it does not run again


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def median_run(spark, name: str, sf_dir: str) -> float:
    """The median of the runs; of an even number the lower one."""
    taken = []
    while len(taken) < RUNS and sum(taken) < ENOUGH:
        taken.append(run(spark, name, sf_dir))
    return round(sorted(taken)[(len(taken) - 1) // 2], 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    # Before the clock runs: the pages that the queries read are stored, code is compiled, Python workers are up.
    store_fixture(spark, sf_dir)
    run(spark, "catalog_products_answered", sf_dir)
    seconds = {name: median_run(spark, name, sf_dir) for name in names}
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
