"""What every URL held when it was last seen, in hash buckets: a merge rewrites the buckets its URLs fall into and no others.

A version of the state is a file `versions/N` that names the folder of every bucket. It is written last and once, so readers see
the state before or after a merge, and of two merges at the same time one fails. Hashes come with the pages (`with_page_hash`,
which the archive writer applies), so neither a merge nor the pick of changed pages reads HTML.
"""

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.scratch import materialize
from .paths import children, content, create_once, delete

BUCKETS = 64
STATE = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("html_hash", T.StringType()),
    T.StructField("first_seen", T.StringType()),
    T.StructField("changed_at", T.StringType()),
    T.StructField("seen_at", T.StringType()),
    T.StructField("version", T.LongType()),         # the merge that last changed the row
])


def with_page_hash(pages: DataFrame) -> DataFrame:
    """Add `html_hash`, the SHA-256 of the page; a column of that name is taken as it is."""
    return pages if "html_hash" in pages.columns else pages.withColumn("html_hash", F.sha2("html", 256))


def _current(spark: SparkSession, path: str) -> tuple[int, int | None, dict[str, str]]:
    """(version, number of buckets, folder of each bucket that has one)."""
    versions = [int(n) for n in children(spark, f"{path}/versions") if n.isdigit()]
    if not versions:
        return 0, None, {}
    found = json.loads(content(spark, f"{path}/versions/{max(versions)}"))
    return max(versions), found["buckets"], found["folders"]


def load_page_state(spark: SparkSession, path: str, buckets: list[int] | None = None) -> DataFrame:
    """The latest state, of all buckets or the given ones; empty where there is none."""
    path = path.rstrip("/")
    _, _, folders = _current(spark, path)
    chosen = [f"{path}/{f}" for b, f in folders.items() if buckets is None or int(b) in buckets]
    return spark.read.schema(STATE).parquet(*chosen) if chosen else spark.createDataFrame([], STATE)


def merge_page_state(pages: DataFrame, path: str, seen_at: str, buckets: int = BUCKETS) -> DataFrame:
    """Merge the pages of a crawl into the state at `path`; returns the rows that are new or changed: (url, html_hash, ...).

    `pages` has url and html_hash (else the HTML is hashed here). Of a URL that occurs more than once the latest `fetched_at` counts,
    where that column exists, then the greatest hash. Rows without a URL take no part. A page that comes back without
    HTML has the hash null, which differs from any other. URLs that were not fetched keep their rows. A merge that is run again
    changes nothing but `seen_at`. `buckets` counts for a new state only: as many as tasks should share all of it.
    """
    spark, path = pages.sparkSession, path.rstrip("/")
    version, made_with, folders = _current(spark, path)
    buckets = made_with or buckets
    order = [c for c in ("fetched_at",) if c in pages.columns]
    newest = with_page_hash(pages).filter("url is not null").groupBy("url").agg(F.max(F.struct(*order, "html_hash")).alias("_new"))
    bucket = F.pmod(F.xxhash64("url"), F.lit(buckets)).cast("int")
    newest = materialize(newest.select("url", F.col("_new.html_hash").alias("_hash"), F.lit(True).alias("_met")), "newest")
    touched = [r[0] for r in newest.select(bucket).distinct().collect()]            # at most `buckets`
    earlier = load_page_state(spark, path, touched) if touched else spark.createDataFrame([], STATE)
    both = earlier.withColumn("_known", F.lit(True)).join(newest, "url", "full")
    met = F.col("_met").isNotNull()
    changed = met & (F.col("_known").isNull() | ~F.col("_hash").eqNullSafe(F.col("html_hash")))
    now = F.lit(seen_at)
    merged = both.select(
        "url", F.when(met, F.col("_hash")).otherwise(F.col("html_hash")).alias("html_hash"), F.coalesce("first_seen", now).alias("first_seen"),
        F.when(changed, now).otherwise(F.col("changed_at")).alias("changed_at"), F.when(met, now).otherwise(F.col("seen_at")).alias("seen_at"),
        F.when(changed, F.lit(version + 1)).otherwise(F.col("version")).cast("long").alias("version"))
    if not touched:
        return merged
    folder = f"data-{uuid.uuid4().hex}"
    placed = merged.withColumn("bucket", bucket)
    placed.repartition(len(touched), "bucket").write.partitionBy("bucket").parquet(f"{path}/{folder}")
    folders = folders | {str(b): f"{folder}/bucket={b}" for b in touched}
    create_once(spark, f"{path}/versions/{version + 1}", json.dumps({"buckets": buckets, "folders": folders}))
    return load_page_state(spark, path, touched).filter(F.col("version") == version + 1)


def drop_old_versions(spark: SparkSession, path: str) -> int:
    """Delete bucket folders that the latest version does not name, those of killed merges too; returns how many.

    Call it when no merge runs and no reader of an older version is left.
    """
    path, dropped = path.rstrip("/"), 0
    version, _, folders = _current(spark, path)
    named = set(folders.values())
    for data in [n for n in children(spark, path) if n.startswith("data-")]:
        own = [f"{data}/{n}" for n in children(spark, f"{path}/{data}") if n.startswith("bucket=")]
        old = [f for f in own if f not in named]
        for name in old if len(old) < len(own) else [data]:
            delete(spark, f"{path}/{name}")
        dropped += len(old)
    for number in [n for n in children(spark, f"{path}/versions") if n.isdigit() and int(n) < version]:
        delete(spark, f"{path}/versions/{number}")
    return dropped
