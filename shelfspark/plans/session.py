"""Session settings for local work; a cluster brings its own."""

import os

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, memory: str = "8g", name: str = "shelfspark") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SHELFSPARK_MEMORY", memory))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        # One shuffle partition per core is enough here; on a cluster keep partitions near 128 MB.
        .config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
