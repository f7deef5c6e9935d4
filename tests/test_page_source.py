from pyspark.sql import functions as F

from shelfspark.sources.page_source import register_page_source
from shelfspark.sources.pages import read_pages

SHAPE = "url string, html string, status int, page_id long"


def folder(spark, tmp_path, n=60, files=3):
    path = str(tmp_path / "pages")
    rows = [(f"http://h/{i:03}", f"<p>é {i}" if i % 7 else None, 200 if i % 5 else None, i) for i in range(n)]
    spark.createDataFrame(rows, SHAPE).repartitionByRange(files, "url").write.mode("append").parquet(path)
    return path


def rows(df):
    return sorted((tuple(r) for r in df.select("url", "html", "status", "page_id").collect()), key=repr)


def test_same_rows_as_read_pages(spark, tmp_path):
    path = folder(spark, tmp_path)
    register_page_source(spark)
    pages = spark.read.format("shelf_pages").load(path)
    assert pages.schema.simpleString() == spark.read.parquet(path).schema.simpleString()
    assert rows(pages) == rows(read_pages(spark, path)) and len(rows(pages)) == 60
    assert rows(spark.read.format("shelf_pages").load("file://" + path)) == rows(pages)
    wider = spark.read.format("shelf_pages").schema(SHAPE + ", fetched_at long").load(path)
    assert rows(wider) == rows(pages) and wider.filter("fetched_at is not null").isEmpty()


def test_filters_are_pushed(spark, tmp_path):
    path = folder(spark, tmp_path)
    register_page_source(spark)
    pages = spark.read.format("shelf_pages").load(path)
    one = pages.filter("url = 'http://h/007'")
    # The source has taken the comparison: no filter of Spark's own holds it.
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan shelf_pages" in plan and "http://h/007" not in plan
    assert [r.page_id for r in one.collect()] == [7]
    some = pages.filter(F.col("page_id").isin(3, 59, 100) & (F.length("url") > 2))
    assert sorted(r.page_id for r in some.collect()) == [3, 59]
    assert pages.filter("url = 'none'").collect() == [] and pages.filter("status is null").count() == 12


def test_stream_takes_each_file_once(spark, tmp_path):
    path, out = folder(spark, tmp_path), str(tmp_path / "out")
    register_page_source(spark)

    def run():
        stream = spark.readStream.format("shelf_pages").schema(SHAPE).load(path)
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(out).awaitTermination()

    run()
    assert rows(spark.read.parquet(out)) == rows(read_pages(spark, path))
    more = spark.createDataFrame([("http://h/new", None, 404, 1000)], SHAPE)
    more.coalesce(1).write.mode("append").parquet(path)
    run()
    run()
    assert rows(spark.read.parquet(out)) == rows(read_pages(spark, path)) and spark.read.parquet(out).count() == 61
