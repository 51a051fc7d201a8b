"""Intermediate tables in the shared folder that the session names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession) -> str:
    """Path of a table that is not there yet, in the folder in spark.checkpoint.dir. Where that is unset a local master gets a folder of its own; a cluster is an error, as executors share no local folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = folder or tempfile.mkdtemp(prefix="tables-")
    return f"{folder}/table-{uuid.uuid4().hex}"


def stored(df: DataFrame, *partition_by: str) -> DataFrame:
    """df written to the folder in spark.checkpoint.dir (one of our own only where that is unset) and read back: plans stay small and no executor owns the rows."""
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
