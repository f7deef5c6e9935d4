"""Key tables in hash buckets: looked up and appended to without moving what is stored.

A table is a folder `buckets-N` of parquet files, N fixed when it is made. Joined on its key, it is read bucket by bucket, so
only the other side is shuffled, however long the history is. Spark keeps bucket layouts in its catalog, so reading a folder
registers an external table there, named after the path; dropping it leaves the files.
"""

import hashlib

from pyspark.sql import DataFrame, SparkSession

from .paths import children, has_data

BUCKETS = 64


def _layout(spark: SparkSession, path: str) -> int | None:
    sizes = [int(n.removeprefix("buckets-")) for n in children(spark, path) if n.startswith("buckets-")]
    return max(sizes, default=None)


def _table(spark: SparkSession, path: str, key: str, buckets: int) -> str:
    folder = f"{path.rstrip('/')}/buckets-{buckets}"
    name = f"keys_{hashlib.md5(folder.encode()).hexdigest()[:16]}"
    at = folder.replace("'", "\\'")
    spark.sql(f"""create table if not exists {name} (`{key}` string) using parquet options (path '{at}', ignoreCorruptFiles 'true')
        clustered by (`{key}`) sorted by (`{key}`) into {buckets} buckets""")
    spark.catalog.refreshTable(name)
    return name


def read_keys(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(key string) of the table at `path`; empty where there is none. Files that are no parquet are left out."""
    buckets = _layout(spark, path)
    if buckets is None:
        return spark.createDataFrame([], f"`{key}` string")
    return spark.table(_table(spark, path, key, buckets))


def add_keys(rows: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> None:
    """Append the keys of `rows` that the table lacks; earlier files stay as they are, null is no key.

    `buckets` counts for a new table only: as many as tasks should share the whole history. A job that is run again adds
    nothing twice.
    """
    spark = rows.sparkSession
    buckets = _layout(spark, path) or buckets
    new = rows.select(key).filter(f"`{key}` is not null").distinct()
    # Partitioned like the table, so the table is not; one task writes one file of one bucket.
    new = new.repartition(buckets, key)
    name = _table(spark, path, key, buckets)
    if has_data(spark, f"{path.rstrip('/')}/buckets-{buckets}"):
        new = new.join(spark.table(name), key, "left_anti")
    new.write.insertInto(name)
    spark.catalog.refreshTable(name)
