"""Counts over components."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCOPES = ["Runtime", "Build", "Test", "Development", "Optional", "Provided"]


def scope_statistics(components: DataFrame) -> DataFrame:
    """One row: the count of each scope, the total, and the mean confidence (0 for no rows)."""
    counts = [F.count_if(F.col("scope") == s).alias(f"{s.lower()}_count") for s in SCOPES]
    return components.agg(*counts, F.count(F.lit(1)).alias("total"), F.round(F.coalesce(F.avg("scope_confidence"), F.lit(0.0)), 6).alias("average_confidence"))


def scope_percentages(components: DataFrame) -> DataFrame:
    """scope, count, percentage of all rows (one decimal)."""
    counts = components.groupBy("scope").agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy(F.lit(0)))  # over a row for each scope
    return counts.select("scope", "count", F.round(100.0 * F.col("count") / total, 1).alias("percentage"))


def direct_counts(components: DataFrame) -> DataFrame:
    """One row: total, direct (dev rows apart), transitive, dev."""
    return components.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("is_direct") & ~F.col("is_dev")).alias("direct"),
        F.count_if(~F.col("is_direct")).alias("transitive"),
        F.count_if(F.col("is_dev")).alias("dev"),
    )


def ecosystem_counts(components: DataFrame, mode: str = "markdown", within=()) -> DataFrame:
    """Per ecosystem: total, direct, transitive; with columns in within also those, and dev. In mode 'stdout' direct dev rows count as direct, in 'markdown' they don't."""
    direct = F.col("is_direct") if mode == "stdout" else F.col("is_direct") & ~F.col("is_dev")
    dev = [F.count_if("is_dev").alias("dev")] if within else []
    return components.groupBy(*within, "ecosystem").agg(F.count(F.lit(1)).alias("total"), F.count_if(direct).alias("direct"), F.count_if(~F.col("is_direct")).alias("transitive"), *dev)


def ecosystems(components: DataFrame) -> DataFrame:
    return components.agg(F.array_sort(F.collect_set("ecosystem")).alias("ecosystems"))


def distinct_packages(packages: DataFrame) -> DataFrame:
    return packages.agg(F.count_distinct("name", "version").alias("packages"))


def shared_dependencies(used: DataFrame) -> DataFrame:
    """Uses (package, name, version, is_dev) -> one row per (name, version): dev only if every use is, and the number of packages."""
    return used.groupBy("name", "version").agg(F.bool_and("is_dev").alias("is_dev"), F.count_distinct("package").alias("used_by"))
