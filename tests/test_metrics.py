import math
import random

from pyspark.sql import functions as F

from shelfspark.operators import metrics
from shelfspark.operators.validate import validate_products

ROW = "seq struct<cat_idx:int,page_num:bigint,pos:int>, name string, url string, sku string, price double, brand string, image_urls array<string>, specifications map<string,string>, extraction_method string"


def frame(spark, n=20):
    rows = [((0, 0, i), f"n{i}", f"http://h/{i}", f"S{i % 15}", float(i) if i % 4 else None, f"B{i % 3}" if i % 5 else None,
             ["x"] * (i % 3), {"k": "v"} if i % 2 else {}, "hybrid" if i % 4 == 0 else "selector") for i in range(n)]
    return spark.createDataFrame(rows, ROW)


def test_coverage(spark):
    fields = ("name", "price", "brand", "image_urls", "specifications")
    found = {r.field: round(r.coverage, 3) for r in metrics.field_coverage(frame(spark), fields).collect()}
    assert found == {"name": 1.0, "price": 0.75, "brand": 0.8, "image_urls": 0.65, "specifications": 0.5}


def test_reject_rate_and_trend(spark):
    judged = validate_products(frame(spark))
    row = metrics.reject_rate(judged, spark.createDataFrame([("x",)] * 5, "url string")).first()
    assert (row.rows_seen, row.gate_rejects_per_1000, row.verdict_rejects_per_1000) == (25, 200.0, 200.0)
    runs = judged.withColumn("run_id", F.lit(1)).unionByName(judged.withColumn("run_id", F.lit(2)).filter("verdict = 'ok'"))
    trend = {r.run_id: (r.duplicate_rate, r.change) for r in metrics.dup_rate_trend(runs).collect()}
    assert trend == {1: (0.25, None), 2: (0.0, -0.25)}
    rates = metrics.fallback_rate(frame(spark).withColumn("run_id", F.lit(1))).first()
    assert (rates.hybrid_rate, rates.llm_fallback_rate) == (0.25, 0.0)


def test_drift(spark):
    report = {r.metric: (r.current, r.prior) for r in metrics.drift_report(frame(spark), frame(spark).filter("price < 10")).collect()}
    assert report["price_p50"][1] == 5.0
    assert report["brand_none"][0] == 0.2
    assert abs(sum(v[0] for k, v in report.items() if k.startswith("images_")) - 1) < 1e-9
    assert {m for m in report if m.startswith("price")} == {"price_p10", "price_p25", "price_p50", "price_p75", "price_p90"}


def test_price_quantiles_are_exact(spark):
    rng = random.Random(3)
    prices = [round(rng.lognormvariate(3, 2), 2) for _ in range(5000)] + [5.0] * 2000 + [0.0, None]
    found = metrics.price_drift(*[spark.createDataFrame([(p,) for p in part], "price double") for part in (prices, prices[:7])])
    for i, part in enumerate((prices, prices[:7])):
        known = sorted(p for p in part if p is not None)
        expected = {f"price_p{round(q * 100):02d}": known[math.ceil(q * len(known)) - 1] for q in (0.1, 0.25, 0.5, 0.75, 0.9)}
        assert {r.metric: r[1 + i] for r in found.collect()} == expected


def test_audit_sample_repeats(spark):
    df = frame(spark)
    a = [r.url for r in metrics.audit_sample(df, 5, "7").collect()]
    assert a == [r.url for r in metrics.audit_sample(df.repartition(7), 5, "7").collect()] and len(set(a)) == 5
    assert a != [r.url for r in metrics.audit_sample(df, 5, "8").collect()]


def test_compare_selectors_and_changed_pages(spark):
    pages = spark.createDataFrame([("a", "<h1>x</h1>"), ("b", "<h2>y</h2>"), ("c", "<h1> </h1>")], "url string, html string")
    rows = {r.field: (r.n_pages, r.current_hits, r.candidate_hits) for r in metrics.compare_selectors(pages, {"t": "h1"}, {"t": "h1, h2"}).collect()}
    assert rows == {"t": (3, 1, 2)}
    earlier = spark.createDataFrame([("a", "<h1>x</h1>"), ("b", "old")], "url string, html string")
    known = earlier.select("url", F.sha2("html", 256).alias("html_hash"))
    assert {r.url for r in metrics.changed_pages(pages, known).collect()} == {"b", "c"}
    empty = spark.createDataFrame([("n", None), (None, "x"), ("m", None)], pages.schema)
    assert {r.url for r in metrics.changed_pages(empty, known).collect()} == {"n", None, "m"}
    assert [r.url for r in metrics.changed_pages(empty, metrics.page_hashes(empty.filter("url is null or url = 'n'"))).collect()] == ["m"]


def test_nearest(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [3.0, 3.0]), (4, [0.0, 0.0])], "id int, embedding array<float>")
    rows = metrics.nearest_products(df, [2.0, 0.0], 3).collect()
    assert [r.id for r in rows] == [1, 3, 2] and rows[0].score == 1.0


def chart(rates):
    """The control chart of one category, run by run."""
    mean, runs, out = None, 0, []
    for rate, n in rates:
        upper = None if mean is None else mean + metrics.WIDTH * math.sqrt((mean * (1 - mean) + 1 / n) / n)
        spike = runs >= metrics.WARM_UP and rate > upper
        out.append((mean, upper, spike))
        if not spike:
            mean, runs = rate if runs == 0 else mean + metrics.SMOOTHING * (rate - mean), runs + 1
    return out


def test_a_spike_is_flagged_in_its_run_only_and_state_carries_over(spark):
    rng = random.Random(3)
    rows = []
    for category, base, n in (("a", 0.1, 4000), ("b", 0.02, 900), ("c", 0.0, 50)):
        for run in range(30):
            share = 0.25 if category == "a" and run == 17 else base
            rows.append((category, run, n, sum(rng.random() < share for _ in range(n)) / n))
    rates = spark.createDataFrame(rows, "category string, run_id long, rows_seen long, duplicate_rate double")
    found, state = metrics.rate_spikes(rates, "category")
    assert [(r.category, r.run_id) for r in found.filter("spike").collect()] == [("a", 17)]
    for category in "abc":
        own = [(r, n) for c, _, n, r in rows if c == category]
        got = found.filter(found.category == category).orderBy("run_id").collect()
        assert [(r.expected, r.upper, bool(r.spike)) for r in got] == [(a, b, bool(c)) for a, b, c in chart(own)]
    # In three calls the same as in one; a category may be absent from a call, and null rates are no runs.
    parts, state = [], None
    for low, high in ((0, 4), (4, 18), (18, 30)):
        some = rates.filter(f"run_id >= {low} and run_id < {high} and not (category = 'c' and run_id >= 4 and run_id < 18)")
        part, state = metrics.rate_spikes(some.unionByName(spark.createDataFrame([("b", 99 + low, 5, None)], rates.schema)), "category", state)
        parts += part.filter("category <> 'c'").collect()
    assert sorted(map(tuple, parts)) == sorted(map(tuple, found.filter("category <> 'c'").collect()))
    assert metrics.rate_spikes(rates.limit(0), "category")[0].collect() == []


def test_run_summaries_merge(spark):
    rng = random.Random(5)
    rows = [(run, rng.choice("xyz"), rng.choice([None, rng.lognormvariate(2, 1)]), rng.choice([None, f"b{rng.randrange(30 + 20 * run)}"])) for run in (1, 2) for _ in range(20_000)]
    products = spark.createDataFrame(rows, "run_id int, category string, price double, brand string")
    summaries = metrics.summarise_run(products, ["run_id", "category"])
    found = {r.metric: r for r in metrics.compare_summaries(summaries.filter("run_id = 2"), summaries.filter("run_id = 1")).collect()}
    assert (found["rows"].current, found["rows"].prior) == (20_000, 20_000)
    assert (found["brands"].current, found["brands"].prior, found["common_brands"].current) == (70, 50, 50)
    for run, side in ((2, "current"), (1, "prior")):
        prices = sorted(p for r, _, p, _ in rows if r == run and p is not None)
        for q in metrics.QUANTILES:
            value = found[f"price_p{round(q * 100):02d}"][side]
            assert abs(sum(p <= value for p in prices) / len(prices) - q) < 0.01
    none = products.filter("run_id = 1").withColumn("price", F.lit(None).cast("double"))
    found = {r.metric: r.current for r in metrics.compare_summaries(metrics.summarise_run(none, ["category"]), summaries.filter("run_id = 3")).collect()}
    assert found["rows"] == 20_000 and found["price_p50"] is None
