import pytest
import random

from pyspark.sql import functions as F

from shelfspark.operators import validate
from shelfspark.plans.scratch import materialize

ROW = "seq struct<cat_idx:int,page_num:bigint,pos:int>, name string, url string, sku string, extraction_method string"


def plain_verdicts(rows, prior=()):
    keys, out = set(prior), []
    for name, url, sku in rows:
        key = sku or url
        if not name or not url:
            out.append("incomplete: missing name or url")
        elif key in keys:
            out.append(f"duplicate: {key}")
        else:
            keys.add(key)
            out.append("ok" if url.startswith(("http://", "https://")) else "invalid url scheme")
    return out


def frame(spark, rows):
    numbered = [((i // 100, i // 10 % 10, i % 10), n, u, s, "selector") for i, (n, u, s) in enumerate(rows)]
    random.Random(1).shuffle(numbered)
    return spark.createDataFrame(numbered, ROW)


def reasons(df):
    return [r.reason for r in df.orderBy("seq").collect()]


def test_verdicts_like_a_sequential_run(spark):
    rows = [("n", "ftp://a", "K"), ("n", "http://b", "K"), ("n", "http://c", None), ("n", "http://d", "http://c"), ("", "http://e", "E"),
            ("n", "http://f", "E"), (None, "http://g", None), ("n", None, "S"), ("n", "http://c", ""), ("n", "https://h", ""), ("n", "HTTP://i", None)]
    df = frame(spark, rows)
    assert reasons(validate.validate_products(df)) == plain_verdicts(rows)
    prior = spark.createDataFrame([("E",), ("https://h",)], "dedup_key string")
    assert reasons(validate.validate_products(df, prior)) == plain_verdicts(rows, {"E", "https://h"})


def test_hot_key_and_invariants(spark):
    rng = random.Random(3)
    rows = [("n", f"http://x/{i}", "HOT" if i % 3 == 0 else f"S{rng.randint(0, 200)}") for i in range(900)]
    judged = materialize(validate.validate_products(frame(spark, rows)), "judged")
    assert reasons(judged) == plain_verdicts(rows)
    summary = validate.validation_summary(judged).first()
    assert summary.total_seen == 900 == summary.accepted + summary.rejected_duplicate + summary.rejected_incomplete + summary.rejected_invalid
    kept = validate.accepted(judged)
    assert kept.count() == kept.select("sku").distinct().count() == validate.dedup_first(frame(spark, rows)).count()


def test_first_arrivals_combine_before_the_shuffle(spark):
    plan = validate.first_arrivals(validate.with_key(frame(spark, [("n", "u", "s")])))._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan


def test_summary_of_nothing(spark):
    summary = validate.validation_summary(validate.validate_products(spark.createDataFrame([], ROW))).first()
    assert (summary.total_seen, summary.acceptance_rate) == (0, 0.0)


def test_status_and_counts(spark):
    products = frame(spark, [("n", "http://a", "1"), ("n", "http://b", "2")]).withColumn(
        "extraction_method", F.when(F.col("sku") == "1", "hybrid").otherwise("selector"))
    assert {tuple(r) for r in validate.count_by_method(products).collect()} == {("hybrid", 1), ("selector", 1)}
    row = validate.pipeline_status(spark.createDataFrame([("x",)], "url string"), products).first()
    assert (row.urls_processed, row.n_products) == (1, 2)


def test_a_repeated_seq_is_refused(spark):
    rows = spark.createDataFrame([((0, 0, 1),), ((0, 0, 1),)], "seq struct<cat_idx:int,page_num:bigint,pos:int>")
    with pytest.raises(ValueError):
        validate.require_unique_seq(rows)
    assert validate.require_unique_seq(rows.distinct()).count() == 1
