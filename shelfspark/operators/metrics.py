"""Data-quality metrics over products and runs."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.running import rows_before
from ..plans.scratch import materialize
from ..schemas import PRODUCTS
from ..sources.page_state import with_page_hash
from .match import Field, match_selectors
from .validate import validation_summary

COVERED = tuple(n for n in PRODUCTS.fieldNames() if n not in ("extracted_at",))


def _filled(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType.typeName()
    if kind in ("array", "map"):
        return F.coalesce(F.size(df[name]) > 0, F.lit(False))
    if kind == "string":
        return F.coalesce(df[name] != "", F.lit(False))
    return df[name].isNotNull()


def field_coverage(products: DataFrame, fields=COVERED) -> DataFrame:
    """field, coverage: share of rows with a value, all fields in one pass."""
    shares = products.agg(*[F.avg(_filled(products, f).cast("double")).alias(f) for f in fields])
    return shares.unpivot([], list(fields), "field", "coverage")


def reject_rate(validated: DataFrame, gate_rejects: DataFrame) -> DataFrame:
    """Rejected rows per thousand: by the schema gate, and by validation."""
    counts = validated.select((~F.col("valid")).cast("int").alias("_v"), F.lit(0).alias("_g")).unionAll(
        gate_rejects.select(F.lit(0).alias("_v"), F.lit(1).alias("_g")))
    per_thousand = lambda c: F.coalesce(F.try_divide(F.sum(c) * F.lit(1000.0), F.count(F.lit(1))), F.lit(0.0))
    return counts.agg(
        F.count(F.lit(1)).alias("rows_seen"),
        per_thousand("_g").alias("gate_rejects_per_1000"),
        per_thousand("_v").alias("verdict_rejects_per_1000"),
    )


def fallback_rate(products: DataFrame, by: str = "run_id") -> DataFrame:
    """Share of products per run that needed an answer, and that rest on answers alone."""
    method = F.col("extraction_method")
    return products.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_products"),
        F.avg((method == "hybrid").cast("double")).alias("hybrid_rate"),
        F.avg((method == "llm_fallback").cast("double")).alias("llm_fallback_rate"),
    )


def dup_rate_trend(validated: DataFrame, by: str = "run_id") -> DataFrame:
    """Duplicate share per run and its change against the run before. The window runs over runs, not rows."""
    rates = validated.groupBy(by).agg(
        F.count(F.lit(1)).alias("rows_seen"),
        F.avg((F.col("verdict") == "duplicate").cast("double")).alias("duplicate_rate"),
    )
    before = F.lag("duplicate_rate").over(Window.orderBy(by))
    return rates.withColumn("change", F.col("duplicate_rate") - before)


def price_quantiles(products: DataFrame, quantiles, name: str) -> DataFrame:
    """i, `name`: for each quantile the smallest price that so large a share of prices does not exceed. Exact at any size.

    Prices are counted, then ranked through totals of price blocks: 64 to each power of two, so a few thousand.
    """
    counts = products.filter("price is not null").groupBy("price").agg(F.count(F.lit(1)).alias("n"))
    block = F.signum("price") * F.floor(F.log2(F.abs("price") + 1) * 64)
    ranked = rows_before(counts.withColumn("_block", block), [], "_block", "price")
    total = counts.agg(F.sum("n").alias("total"))
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(q)).alias("q")) for i, q in enumerate(quantiles)])
    reached = ranked.select("price", (F.col("before") + F.col("n")).alias("upto"), F.inline(wanted))
    return reached.filter(F.col("upto") >= F.ceil(F.col("q") * total.scalar())).groupBy("i").agg(F.min("price").alias(name))


def price_drift(current: DataFrame, prior: DataFrame, quantiles=(0.1, 0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """metric, current, prior for price quantiles."""
    labels = F.array(*[F.lit(f"price_p{round(q * 100):02d}") for q in quantiles])
    both = price_quantiles(current, quantiles, "current").join(price_quantiles(prior, quantiles, "prior"), "i", "full")
    return both.select(F.element_at(labels, F.col("i") + 1).alias("metric"), "current", "prior")


def count_drift(current: DataFrame, prior: DataFrame, value: Column, prefix: str) -> DataFrame:
    """metric, current, prior: share of rows per value, for values seen in either run."""

    def shares(df, name):
        counts = df.groupBy(value.cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
        total = counts.agg(F.sum("n").alias("total"))
        # `total` is a global aggregate of exactly one row; read it as a scalar.
        return counts.withColumn(name, F.col("n") / total.scalar()).select("value", name)

    both = shares(current, "current").join(shares(prior, "prior"), "value", "full")
    zero = F.lit(0.0)
    return both.select(
        F.concat(F.lit(prefix), F.coalesce("value", F.lit("none"))).alias("metric"),
        F.coalesce("current", zero).alias("current"), F.coalesce("prior", zero).alias("prior"))


def drift_report(current: DataFrame, prior: DataFrame) -> DataFrame:
    """Price quantiles, image counts and brand shares of two runs side by side."""
    brand = F.coalesce(F.col("brand"), F.lit("none"))
    report = price_drift(current, prior)
    report = report.unionByName(count_drift(current, prior, F.size("image_urls"), "images_"))
    return report.unionByName(count_drift(current, prior, brand, "brand_")).withColumn(
        "change", F.col("current") - F.col("prior"))


def audit_sample(products: DataFrame, n: int, seed: str = "0") -> DataFrame:
    """`n` rows for review, the same ones on every call with the same seed: smallest keyed hashes first."""
    return products.orderBy(F.md5(F.concat(F.col("url"), F.lit("|" + seed))), "url").limit(n)


def health_windows(
    log: DataFrame,
    ts: str = "ts",
    every: str = "1 hour",
    ok: Column | None = None,
    latency: Column | None = None,
    by: tuple[str, ...] = (),
    watermark: str | None = None,
    alert_below: float = 0.9,
) -> DataFrame:
    """Per time window: rows, success rate, mean and greatest latency, and an alert flag. Batch or stream."""
    ok = F.col("status") == 200 if ok is None else ok
    latency = F.col("duration_ms") if latency is None else latency
    timed = log.withWatermark(ts, watermark) if watermark else log
    rate = F.avg(F.coalesce(ok, F.lit(False)).cast("double"))
    return (
        timed.groupBy(F.window(ts, every), *by)
        .agg(F.count(F.lit(1)).alias("n_pages"), rate.alias("ok_rate"),
             F.avg(latency).alias("avg_latency"), F.max(latency).alias("max_latency"))
        .select(F.col("window.start").alias("window_start"), *by, "n_pages", "ok_rate", "avg_latency", "max_latency",
                (F.col("ok_rate") < alert_below).alias("alert"))
    )


def changed_pages(pages: DataFrame, earlier: DataFrame) -> DataFrame:
    """Pages that are new or whose content differs from `earlier(url, html_hash)`; only these need a new pass.

    Only URLs and hashes are compared and shuffled. The changed ones are stored, and a second scan keeps
    their pages; a small set goes to the scan, so that unchanged HTML never moves. Pages that carry an `html_hash`, as
    archived ones do, are not hashed, and their HTML is read in the second scan only.
    """
    keys = ["url", "html_hash"]
    hashed = with_page_hash(pages)
    known = earlier.select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = F.col("url").eqNullSafe(F.col("_url")) & F.col("html_hash").eqNullSafe(F.col("_html_hash"))
    changed = materialize(hashed.select(*keys).join(known, same, "left_anti").distinct().toDF("_url", "_html_hash"), "changed")
    return hashed.join(changed, same, "left_semi")


def page_hashes(pages: DataFrame) -> DataFrame:
    """url, html_hash of pages: what a later run passes to `changed_pages`."""
    return with_page_hash(pages).select("url", "html_hash")


def compare_selectors(pages: DataFrame, current: dict, candidate: dict) -> DataFrame:
    """field, pages, hits with the current and the candidate selectors, and the difference in hit rate.

    Both sets are matched in the same pass.
    """
    names = [n for n in current if n in candidate]
    fields = [Field(f"a{i}", current[n], text=True, first=True) for i, n in enumerate(names)]
    fields += [Field(f"b{i}", candidate[n], text=True, first=True) for i, n in enumerate(names)]
    matched = match_selectors(pages.select("html"), fields)
    hit = lambda c: F.count_if(F.exists(F.col(c), lambda h: h["text"] != ""))
    counts = matched.agg(F.count(F.lit(1)).alias("n_pages"), *[hit(f.name).alias(f.name) for f in fields])
    rows = F.array(*[
        F.struct(F.lit(n).alias("field"), F.col(f"a{i}").alias("current_hits"), F.col(f"b{i}").alias("candidate_hits"))
        for i, n in enumerate(names)
    ])
    gain = F.try_divide(F.col("candidate_hits") - F.col("current_hits"), F.col("n_pages"))
    return counts.select("n_pages", F.inline(rows)).withColumn("hit_rate_change", F.coalesce(gain, F.lit(0.0)))


def nearest_products(vectors: DataFrame, query: list[float], k: int, vector: str = "embedding") -> DataFrame:
    """The `k` rows most alike to `query` by cosine, best first (a per-task top-k, no global sort)."""
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = lambda a, b: F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda acc, x: acc + x)
    v = F.col(vector)
    score = F.try_divide(dot(v, q), F.sqrt(dot(v, v)) * F.sqrt(dot(q, q)))
    return vectors.withColumn("score", score).orderBy(F.desc("score"), *[c for c in vectors.columns if c != vector]).limit(k)


# --- alarms and summaries over runs ----------------------------------------------------------

#: Weight of the newest run in the expected rate; width of the limit in standard errors; runs before the first alarm.
SMOOTHING, WIDTH, WARM_UP = 0.2, 4.0, 5


def rate_spikes(rates: DataFrame, by: str, state: DataFrame | None = None, order: str = "run_id", rate: str = "duplicate_rate", rows: str = "rows_seen") -> tuple[DataFrame, DataFrame]:
    """(`rates` with expected, upper, spike; state to carry on from): a control chart per `by`, in `order`.

    `rates` has one row per `by` and run. The expected rate is an exponential mean of earlier runs without a spike, and a run is
    a spike if its rate is above `upper`: WIDTH standard errors of that mean at the run's size beyond it. A spike leaves the
    mean as it was, so it raises no later limit. `state` (`by`, mean, runs) is what an earlier call returned, and its values
    stand in where `rates` begin. Null rates count as no run. The fold of a `by` holds its runs, not their rows.
    """
    steps = F.array_sort(F.collect_list(F.struct(F.col(order).alias("order"), F.col(rate).alias("rate"), F.col(rows).cast("double").alias("n"))))
    runs = rates.filter(F.col(rate).isNotNull() & (F.col(rows) > 0)).groupBy(by).agg(steps.alias("steps"))
    if state is None:
        runs = runs.select(by, "steps", F.lit(None).cast("double").alias("mean"), F.lit(0).alias("runs"))
    else:
        runs = runs.join(state.select(by, "mean", "runs"), by, "full").select(
            by, F.coalesce("steps", F.array().cast(runs.schema["steps"].dataType)).alias("steps"), "mean", F.coalesce("runs", F.lit(0)).alias("runs"))
    folded = F.expr(f"""aggregate(steps, struct(mean, runs, cast(array() as
        array<struct<order: {dict(rates.dtypes)[order]}, expected: double, upper: double, spike: boolean>>) as found),
        (s, x) -> transform(array(s.mean + {WIDTH}D * sqrt((s.mean * (1 - s.mean) + 1 / x.n) / x.n)), upper -> transform(
            array(s.runs >= {WARM_UP} and x.rate > upper), spike -> struct(
            case when s.runs = 0 then x.rate when spike then s.mean else s.mean + {SMOOTHING}D * (x.rate - s.mean) end as mean,
            s.runs + int(not spike) as runs,
            concat(s.found, array(struct(x.order as order, s.mean as expected, upper, spike as spike))) as found))[0])[0])""")
    done = runs.select(by, folded.alias("end"))
    found = done.select(by, F.inline("end.found")).withColumnRenamed("order", order)
    return rates.join(found, [by, order]), done.select(by, "end.mean", "end.runs")


#: Size of the price sketch: the rank of a quantile is off by about 0.3 percent at most.
SKETCH = 1024
QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)


def summarise_run(products: DataFrame, by: list[str]) -> DataFrame:
    """`by`, n_rows, prices and brands (sketches): a few kilobytes per group, which later comparisons merge instead of reading the runs again."""
    return products.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("price").alias("n_prices"),
        F.kll_sketch_agg_double("price", SKETCH).alias("prices"), F.theta_sketch_agg("brand").alias("brands"))


def merged_summary(summaries: DataFrame, by: list[str] = ()) -> DataFrame:
    """Summaries of parts as one summary per `by`."""
    return summaries.groupBy(*by).agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_prices").alias("n_prices"),
        F.kll_merge_agg_double("prices").alias("prices"), F.theta_union_agg("brands").alias("brands"))


def compare_summaries(current: DataFrame, prior: DataFrame) -> DataFrame:
    """metric, current, prior from two sets of summaries: rows, price quantiles, distinct brands, and brands found in both (in either column).

    Brand numbers are exact up to 4,096 brands and estimates beyond; quantiles are off by SKETCH's error in rank. Without any
    price there are no quantiles. `drift_report` is the exact comparison, which reads both runs.
    """
    labels = F.array(*[F.lit(f"price_p{round(q * 100):02d}") for q in QUANTILES])

    def values(summaries, name):
        one = merged_summary(summaries).withColumn("side", F.lit(name))
        ranks = F.array(*[F.lit(q) for q in QUANTILES])
        prices = F.when(F.col("n_prices") > 0, F.kll_sketch_get_quantile_double("prices", ranks))
        return one.select("side", "brands", F.map_concat(
            F.create_map(F.lit("rows"), F.col("n_rows").cast("double"), F.lit("brands"), F.theta_sketch_estimate("brands").cast("double")),
            F.coalesce(F.map_from_arrays(labels, prices), F.create_map().cast("map<string,double>"))).alias("found"))

    both = values(current, "current").unionByName(values(prior, "prior"))
    of = lambda column, side: F.max_by(column, F.when(F.col("side") == side, 1))
    sides = both.agg(of("found", "current").alias("current"), of("found", "prior").alias("prior"), of("brands", "current").alias("a"), of("brands", "prior").alias("b"))
    common = F.theta_sketch_estimate(F.theta_intersection("a", "b")).cast("double")
    listed = F.concat(F.array(F.lit("rows"), F.lit("brands")), labels)
    rows = F.transform(listed, lambda m: F.struct(m.alias("metric"), F.try_element_at("current", m).alias("current"), F.try_element_at("prior", m).alias("prior")))
    return sides.select(F.inline(F.concat(rows, F.array(F.struct(F.lit("common_brands").alias("metric"), common.alias("current"), common.alias("prior"))))))
