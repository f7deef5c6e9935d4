"""Page tables: fetched pages in, raw page archive out."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.scratch import materialize_counted
from ..schemas import PAGES
from .packing import TARGET, pack, read_packed
from .page_state import with_page_hash

_KEY_FILTER = {"parquet.bloom.filter.enabled#archive_key": "true"}


def as_pages(df: DataFrame) -> DataFrame:
    """Any table with url and html in page shape; absent columns are null, `final_url` falls back to `url`."""
    types = {f.name: f.dataType for f in PAGES.fields}
    columns = [
        (F.col(name) if name in df.columns else F.lit(None)).cast(kind).alias(name) for name, kind in types.items()
    ]
    extra = [c for c in df.columns if c not in types]
    return df.select(*extra, *columns).withColumn("final_url", F.coalesce("final_url", "url"))


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Pages as parquet, orc or json tables, or as a folder of .html files ('html': url is the file's path).

    A URL may occur more than once, see `latest_pages`. A status column is carried, never filtered: error pages reach extraction.
    """
    if fmt == "html":
        files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.html")
        return as_pages(files.select(F.col("_metadata.file_path").alias("url"), F.col("value").alias("html")))
    reader = spark.read.format(fmt)
    return as_pages((reader.schema(PAGES) if fmt == "json" else reader).load(path))


def version_order(pages: DataFrame, html: str = "html") -> Column:
    """What ranks the rows of one URL: `fetched_at` where that column exists, then a hash of the page."""
    parts = [F.col("fetched_at")] if "fetched_at" in pages.columns else []
    return F.struct(*parts, F.xxhash64(html).alias("hash"))


def latest_pages(pages: DataFrame, order: Column | None = None) -> DataFrame:
    """One row per URL, the greatest by `order` (default `version_order`); equal rows count once. Every row without a URL stays.

    URLs are counted first, without any other column. Where none occurs twice, `pages` come back as they are; else only
    the rows of repeated URLs are ranked. `pages` are read up to three times, so pass a stored table.
    """
    counted = pages.filter("url is not null").groupBy("url").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("url")
    repeated, n = materialize_counted(counted, "repeated")
    if not n:
        return pages
    ranked = pages.join(repeated, "url", "left_semi").withColumn("_order", version_order(pages) if order is None else order)
    newest = Window.partitionBy("url").orderBy(F.desc("_order"))
    latest = ranked.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1").select(*pages.columns)
    return pages.join(repeated, "url", "left_anti").select(*pages.columns).unionByName(latest)


def status_ok(pages: DataFrame) -> DataFrame:
    """Optional filter: pages fetched with a success status."""
    return pages.filter(F.col("status").between(200, 299))


def with_archive_key(pages: DataFrame) -> DataFrame:
    """Add `archive_key`: the first 16 hex digits of the URL's SHA-1, the archived page's file name stem."""
    return pages.withColumn("archive_key", F.substring(F.sha1("url"), 1, 16))


def write_archive(pages: DataFrame, path: str) -> None:
    """Append raw pages with their key and hash. Nothing is shuffled; a bloom filter per file serves lookups by key."""
    with_page_hash(with_archive_key(pages)).write.mode("append").options(**_KEY_FILTER).parquet(path)


def pack_archive(spark: SparkSession, path: str, target: int = TARGET) -> int:
    """Pack the small files of many appends (see `packing`); `packing.remove_replaced` deletes them later."""
    return pack(spark, path, target, **_KEY_FILTER)


def read_archive(spark: SparkSession, path: str, url: str | None = None, latest: bool = False) -> DataFrame:
    """Archived pages; with `url` only that page, skipping files that cannot hold its key; `latest`: one row per URL."""
    archive = read_packed(spark, path)
    if url is not None:
        archive = _of_url(archive, url)
    return latest_pages(archive) if latest else archive


def _of_url(archive: DataFrame, url: str) -> DataFrame:
    return archive.filter((F.col("archive_key") == F.substring(F.sha1(F.lit(url)), 1, 16)) & (F.col("url") == url))
