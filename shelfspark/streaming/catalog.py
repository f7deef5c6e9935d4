"""Pages arriving as files -> validated products, incrementally and exactly once."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import DETAIL_SELECTORS
from ..functions.products import is_complete, not_in
from ..operators import extract, gapfill, validate
from ..operators.match import detail_fields, match_selectors
from ..schemas import PRODUCTS, SEQ
from ..sources.packing import TARGET, exists, pack, read_packed
from ..sources.paths import children
from ..sources.products import read_products, write_jsonl
from . import known

ARRIVALS = T.StructType([
    T.StructField("seq", SEQ),
    T.StructField("url", T.StringType()),
    T.StructField("category_path", T.ArrayType(T.StringType())),
    T.StructField("html", T.StringType()),
])
_JUDGED = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("dedup_key", T.StringType()),
    T.StructField("verdict", T.StringType()),
    T.StructField("batch_id", T.LongType()),
])
_DROPPED = T.StructType([T.StructField("url", T.StringType()), T.StructField("gate_reason", T.StringType()), T.StructField("batch_id", T.LongType())])
_UNEXTRACTABLE = T.StructType([T.StructField("url", T.StringType()), T.StructField("batch_id", T.LongType())])
_PRODUCT = T.StructType([f for f in PRODUCTS.fields if f.name != "extracted_at"])
#: Known URLs and keys live in the state store: changes are uploaded per batch, lookups go by key.
_STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def _table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return read_packed(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)


def judged_rows(spark: SparkSession, out_dir: str) -> DataFrame:
    """Every row that reached validation so far: url, dedup_key, verdict, batch_id."""
    return _table(spark, f"{out_dir}/judged", _JUDGED)


def rejected_rows(spark: SparkSession, out_dir: str) -> DataFrame:
    """Every row that the schema gate dropped: url, gate_reason, batch_id."""
    return _table(spark, f"{out_dir}/gate_rejects", _DROPPED)


def to_refetch(spark: SparkSession, out_dir: str) -> DataFrame:
    """(url) of pages without a product name that no later page replaced: fetch them again and add them to the arrivals."""
    failed = _table(spark, f"{out_dir}/unextractable", _UNEXTRACTABLE).select("url").distinct()
    return not_in(failed, judged_rows(spark, out_dir), "url")


def stream_products(spark: SparkSession, out_dir: str) -> DataFrame:
    """Accepted products of all batches."""
    return read_products(spark, f"{out_dir}/products")


def pack_stream(spark: SparkSession, out_dir: str, target: int = TARGET) -> int:
    """Pack the small files of all batches but the last one, which may be run again; returns how many were replaced.

    Call it between runs. `packing.remove_replaced` of each folder deletes the replaced files later.
    """
    total = 0
    for name, fmt in (("judged", "parquet"), ("gate_rejects", "parquet"), ("unextractable", "parquet"), ("products", "text")):
        batches = [int(n.removeprefix("batch_id=")) for n in children(spark, f"{out_dir}/{name}") if n.startswith("batch_id=")]
        if batches:
            total += pack(spark, f"{out_dir}/{name}", target, fmt, keep=f"batch_id={max(batches)}")
    return total


def _visits(fields: DataFrame) -> DataFrame:
    """Raw fields -> one row per page for the keyed state (see `known.ROW`), all without a shuffle."""
    judged = validate.with_key(gapfill.judge_fallback(extract.with_gaps(fields)))
    status = F.when(F.col("name").isNull() & F.col("url").isNotNull(), known.UNEXTRACTABLE).when(F.col("gate_reason").isNotNull(), known.GATED)
    place = F.concat(*[F.lpad((F.coalesce(F.col(f"seq.{part}").cast("long"), F.lit(-1)) + 1).cast("string"), 19, "0") for part in SEQ.names])
    return judged.select(
        "url", place.alias("place"), status.otherwise(known.BUILT).alias("status"), "gate_reason", "dedup_key",
        is_complete(F.col("name"), F.col("url")).alias("complete"),
        F.to_json(F.struct(*_PRODUCT.names), {"ignoreNullFields": "false"}).alias("payload"))


def _with_state(visits: DataFrame) -> DataFrame:
    """`visits` behind both processors. Rows that claim nothing have a key of their own, so they spread."""
    alone = F.concat(F.lit("\0"), F.coalesce("url", F.xxhash64("place", "payload").cast("string")))
    visits = visits.withColumn("visit", F.coalesce("url", alone))
    firsts = visits.withColumn("bucket", known.bucket("visit")).groupBy("bucket").transformWithStateInPandas(
        known.FirstVisit(), known.ROW, "Append", "None")
    claim = F.when((F.col("status") == known.BUILT) & F.col("complete"), F.col("dedup_key")).otherwise(alone)
    return firsts.withColumn("bucket", known.bucket(claim)).groupBy("bucket").transformWithStateInPandas(
        known.FirstKey(), f"{known.ROW}, first boolean", "Append", "None")


def stream_catalog(
    spark: SparkSession,
    pages_dir: str,
    out_dir: str,
    run_ts,
    selectors: dict = DETAIL_SELECTORS,
    files_per_batch: int | None = None,
):
    """Process all page files not processed yet, then stop; returns the finished query.

    `pages_dir` holds parquet files of ARRIVALS rows. Arrival order is (batch, seq): keys and URLs of earlier batches
    win, and are looked up key by key in the state store, so no batch reads what earlier ones wrote. Every batch overwrites
    its own folders, so one that is retried after a crash replaces its output instead of doubling it. Pages without a
    product and rows that the gate drops are written per batch too; the former may arrive again (see `to_refetch`).
    The number of state partitions is `spark.sql.shuffle.partitions` of the first run.
    """
    reader = spark.readStream.schema(ARRIVALS)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    fields = extract.raw_fields(match_selectors(reader.parquet(pages_dir), detail_fields(selectors)))

    def process(batch: DataFrame, batch_id: int) -> None:
        def store(rows: DataFrame, name: str) -> DataFrame:
            path = f"{out_dir}/{name}/batch_id={batch_id}"
            rows.write.mode("overwrite").parquet(path)
            return batch.sparkSession.read.schema(rows.schema).parquet(path)

        staged = store(batch, "staged")                 # the only pass over the HTML and the state
        of = lambda status: staged.filter(F.col("status") == status)
        store(of(known.UNEXTRACTABLE).select("url"), "unextractable")
        store(of(known.GATED).select("url", "gate_reason"), "gate_rejects")
        built = of(known.BUILT).select("dedup_key", "complete", "first", F.from_json("payload", _PRODUCT).alias("product"))
        judged = gapfill.stamp(built.select("dedup_key", "complete", "first", "product.*"), run_ts)
        judged = judged.withColumn("verdict", validate.verdict(F.col("complete"), F.col("first")))
        write_jsonl(judged.filter("verdict = 'ok'").select(PRODUCTS.names), f"{out_dir}/products/batch_id={batch_id}", mode="overwrite")
        store(judged.select("url", "dedup_key", "verdict"), "judged")

    before = {key: spark.conf.get(key, None) for key in _STATE_STORE}
    try:
        for key, value in _STATE_STORE.items():
            spark.conf.set(key, value)
        query = (
            _with_state(_visits(fields)).writeStream.foreachBatch(process)
            .option("checkpointLocation", f"{out_dir}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    query.awaitTermination()
    return query
