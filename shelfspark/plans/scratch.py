"""Stored intermediate tables in the cluster's shared checkpoint folder."""

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def scratch_root(spark: SparkSession) -> str:
    """The folder `spark.checkpoint.dir` names; a temporary one only in local mode where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.gettempdir() + "/shelfspark-scratch"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below one folder per application, which can be deleted when the application is over."""
    return f"{scratch_root(spark)}/shelfspark/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write `df` once as parquet and read it back.

    Cuts the lineage, survives lost executors, and gives the next plan real sizes. Use it where a
    result feeds several branches, above all behind the HTML pass.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_counted(df: DataFrame, label: str = "table") -> tuple[DataFrame, int]:
    """`materialize` plus the row count, which is taken while the rows are written."""
    written = Observation()
    stored = materialize(df.observe(written, F.count(F.lit(1)).alias("rows")), label)
    return stored, written.get["rows"]
