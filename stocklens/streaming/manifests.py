"""Extension: files that arrive in a folder of Parquet are parsed as they come, and the components table is merged by source priority."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.reconcile import dedup_priority
from ..plans.scan import KEYS
from ..sources import manifests


def follow(spark: SparkSession, files_path: str, table_path: str, checkpoint: str, files_per_batch: int = 100) -> StreamingQuery:
    """Starts a query that appends the components of each batch of files (project, path, text) under table_path, a folder per batch; a batch that is run again replaces its own folder. current() reads the merged table."""

    def add(batch: DataFrame, number: int) -> None:
        dedup_priority(manifests.components(batch), KEYS).write.mode("overwrite").parquet(f"{table_path}/batch={number}")

    stream = spark.readStream.schema("project string, path string, text string").option("maxFilesPerTrigger", files_per_batch).parquet(files_path)
    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, table_path: str) -> DataFrame:
    return dedup_priority(spark.read.parquet(table_path).drop("batch"), KEYS)
