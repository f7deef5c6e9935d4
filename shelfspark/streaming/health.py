"""Crawl health as a stream: windowed status, latency and success rate with late data bounded by a watermark."""

from pyspark.sql import DataFrame

from ..operators.metrics import health_windows


def stream_health(log: DataFrame, out_dir: str, late: str = "1 hour", **options):
    """Append each time window once it can no longer change; processes what is there, then stops."""
    windows = health_windows(log, watermark=late, **options)
    query = (
        windows.writeStream.outputMode("append").format("parquet")
        .option("path", f"{out_dir}/windows").option("checkpointLocation", f"{out_dir}/checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query
