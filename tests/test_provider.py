import sys
import time

import pytest
from pages import SELECTORS_B, page_b
from pyspark import cloudpickle

from shelfspark.operators import gapfill, provider
from shelfspark.operators.extract import extract_raw

cloudpickle.register_pickle_by_value(sys.modules[__name__])     # as callables of a user's own module must be


def requests(spark, n=20):
    rows = [(f"enrich|{i}", "enrich", f"name {i}") for i in range(n)]
    return spark.createDataFrame(rows, "request_key string, kind string, name string")


def moody():
    def ask(request):
        i = int(request["name"].split()[-1])
        if i % 5 == 0:
            raise ValueError(f"no {i}")
        return 7 if i % 7 == 0 else None if i == 3 else f'{{"color": "{i}"}}'

    return ask


def test_failures_are_rows_and_a_second_run_goes_on(spark, tmp_path):
    path = str(tmp_path / "answers")
    first = provider.answer_requests(requests(spark), moody, path, tasks=3, slices=2)
    attempts = provider.load_attempts(spark, path).collect()
    assert len(attempts) == 20 and {r.request_key: r.error for r in attempts}["enrich|5"] == "ValueError: no 5"
    assert {r.request_key: r.error for r in attempts}["enrich|7"].startswith("TypeError")
    bad = {f"enrich|{i}" for i in range(20) if i % 5 == 0 or i % 7 == 0}
    assert {r.request_key for r in first.collect()} == {f"enrich|{i}" for i in range(20)} - bad - {"enrich|3"}
    asked = provider.open_requests(requests(spark), provider.load_attempts(spark, path))
    assert {r.request_key for r in asked.collect()} == bad
    provider.answer_requests(requests(spark), moody, path)
    assert provider.load_attempts(spark, path).count() == 20 + len(bad)
    # After two failures nobody is asked again; without a bound everybody still open is.
    provider.answer_requests(requests(spark), moody, path, most=2)
    assert provider.load_attempts(spark, path).count() == 20 + len(bad)
    done = provider.answer_requests(requests(spark), lambda: lambda request: "{}", path)
    assert done.count() == 19 and provider.open_requests(requests(spark), provider.load_attempts(spark, path)).isEmpty()


def test_a_slow_provider_leaves_the_rest_open(spark, tmp_path):
    def slow():
        def ask(request):
            time.sleep(0.2)
            return "{}"

        return ask

    path = str(tmp_path / "answers")
    some = provider.answer_requests(requests(spark), slow, path, tasks=1, seconds=0.7).count()
    assert 0 < some < 20
    assert provider.answer_requests(requests(spark), lambda: lambda request: "{}", path).count() == 20


def test_a_provider_that_cannot_start_fails_the_job_and_keeps_earlier_slices(spark, tmp_path):
    path = str(tmp_path / "answers")
    provider.answer_requests(requests(spark, 8), moody, path)
    with pytest.raises(Exception, match="no connection"):
        provider.answer_requests(requests(spark), lambda: (_ for _ in ()).throw(OSError("no connection")), path)
    assert provider.load_attempts(spark, path).count() == 8
    assert provider.answer_requests(requests(spark, 0), moody, str(tmp_path / "none")).collect() == []


def test_answers_feed_a_run(spark, tmp_path):
    raw = extract_raw(spark.createDataFrame([((0, 0, 0), "http://h/1", page_b())], "seq struct<cat_idx: int, page_num: long, pos: int>, url string, html string"), SELECTORS_B)
    products, _ = gapfill.merge_fallback(raw)
    asked = gapfill.enrich_requests(products)
    answers = provider.answer_requests(asked, lambda: lambda request: f'{{"form": "{request["name"].split()[-1]}"}}', str(tmp_path / "answers"))
    assert gapfill.merge_enrichment(products, answers).first().specifications["form"] == "clamp"
