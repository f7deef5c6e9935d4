from datetime import datetime, timedelta

from pages import SELECTORS_B, page_b
from pyspark.sql import functions as F

from shelfspark.operators import gapfill, metrics, validate
from shelfspark.operators.extract import extract_raw
from shelfspark.streaming import catalog as stream
from shelfspark.streaming.catalog import ARRIVALS, judged_rows, rejected_rows, stream_catalog, stream_products, to_refetch
from shelfspark.streaming.health import stream_health

TS = "2026-01-01 00:00:00"


def arrivals(spark, rows):
    pages = [((0, 0, i), url, ["c"], page_b().replace("SC-7", sku) if sku is not None else "<p>no product") for i, url, sku in rows]
    return spark.createDataFrame(pages, ARRIVALS)


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    first = [(0, "http://h/1", "A"), (1, "ftp://h/2", "B"), (2, "http://h/3", "A"), (3, "http://h/4", "")]
    second = [(4, "http://h/5", "B"), (5, "http://h/1", "C"), (6, "http://h/6", None), (7, "http://h/7", "D"), (8, "http://h/7", "E")]
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in (first, second):
        arrivals(spark, rows).coalesce(1).write.mode("append").parquet(src)
        stream_catalog(spark, src, out, TS, SELECTORS_B)
    # A visit repeated after its URL was judged is left out.
    visits = [r for r in first + second if r[0] not in (5, 8)]
    built, _ = gapfill.merge_fallback(extract_raw(arrivals(spark, visits), SELECTORS_B))
    batch = validate.validate_products(built)
    judged = {(r.url, r.verdict) for r in judged_rows(spark, out).collect()}
    assert judged == {(r.url, r.verdict) for r in batch.collect()}
    assert judged == {("http://h/1", "ok"), ("ftp://h/2", "invalid"), ("http://h/3", "duplicate"), ("http://h/4", "ok"),
                      ("http://h/5", "duplicate"), ("http://h/7", "ok")}
    kept = stream_products(spark, out)
    assert {(r.url, r.sku) for r in kept.collect()} == {(r.url, r.sku) for r in validate.accepted(batch).collect()}
    assert [r.url for r in to_refetch(spark, out).collect()] == ["http://h/6"]
    # Nothing new: nothing happens.
    stream_catalog(spark, src, out, TS, SELECTORS_B)
    assert judged_rows(spark, out).count() == 6


def test_a_batch_reads_no_history(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    arrivals(spark, [(i, f"http://h/{i}", f"S{i}") for i in range(40)]).coalesce(1).write.parquet(src)
    stream_catalog(spark, src, out, TS, SELECTORS_B)
    # What earlier batches wrote is out of the way, and the next one still knows it.
    for name in ("staged", "judged", "products"):
        (tmp_path / "out" / name).rename(tmp_path / f"old-{name}")
    later = [(50, "http://h/3", "new"), (51, "http://h/new", "S4"), (52, "http://h/newer", "S52")]
    arrivals(spark, later).coalesce(1).write.mode("append").parquet(src)
    query = stream_catalog(spark, src, out, TS, SELECTORS_B)
    assert {(r.url, r.verdict) for r in judged_rows(spark, out).collect()} == {("http://h/new", "duplicate"), ("http://h/newer", "ok")}
    stored = [op["numRowsTotal"] for op in query.recentProgress[-1]["stateOperators"]]
    assert len(stored) == 2 and min(stored) >= 40


def test_pages_without_a_url_are_gated(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    arrivals(spark, [(0, None, "A"), (1, None, "B"), (2, "http://h/1", "A"), (3, None, None)]).coalesce(1).write.parquet(src)
    stream_catalog(spark, src, out, TS, SELECTORS_B)
    assert [(r.url, r.verdict) for r in judged_rows(spark, out).collect()] == [("http://h/1", "ok")]
    reasons = sorted(r.gate_reason for r in rejected_rows(spark, out).collect())
    assert reasons == ["name is empty", "url is missing", "url is missing"]


def test_a_retried_batch_replaces_its_output(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    arrivals(spark, [(0, "http://h/1", "A"), (1, "http://h/2", "A")]).coalesce(1).write.parquet(src)
    stream_catalog(spark, src, out, TS, SELECTORS_B)
    # Lose the commit of the batch, as a crash right after the output was written would.
    for name in ("0", ".0.crc"):
        (tmp_path / "out" / "checkpoint" / "commits" / name).unlink(missing_ok=True)
    stream_catalog(spark, src, out, TS, SELECTORS_B)
    assert sorted(r.verdict for r in judged_rows(spark, out).collect()) == ["duplicate", "ok"]
    assert stream_products(spark, out).count() == 1


def test_one_file_per_batch(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    arrivals(spark, [(i, f"http://h/{i}", "S") for i in range(6)]).repartition(3).write.parquet(src)
    stream_catalog(spark, src, out, TS, SELECTORS_B, files_per_batch=1)
    verdicts = [r.verdict for r in judged_rows(spark, out).collect()]
    assert sorted(verdicts) == ["duplicate"] * 5 + ["ok"]


def test_health_stream_matches_closed_batch_windows(spark, tmp_path):
    start = datetime(2026, 1, 1)
    rows = [(start + timedelta(minutes=7 * i), 200 if i % 4 else 500, 10 * i) for i in range(60)]
    log = spark.createDataFrame(rows, "ts timestamp, status int, duration_ms int")
    log.coalesce(1).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "log"))
    stream_health(stream, str(tmp_path / "out"), late="30 minutes")
    closed = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out" / "windows")).collect()}
    batch = {tuple(r) for r in metrics.health_windows(log).collect()}
    end = max(r[0] for r in rows) - timedelta(minutes=30)
    assert closed == {w for w in batch if w[0] + timedelta(hours=1) <= end}
    assert any(w[-1] for w in closed)
