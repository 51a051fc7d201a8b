"""Bounded samples of labelled documents for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold(doc_id: Column) -> Column:
    """crc32 of the id's text, modulo 3; null for a null id."""
    return (F.crc32(doc_id.cast("string").cast("binary")) % 3).cast("int")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id) == 1, F.lit(False))


def usable_labels(labels: DataFrame, label: str) -> DataFrame:
    """doc_id, y (0 or 1) of the labels that may be drawn: ids and labels not null, ids outside the held-out fold, each id once."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id")))
    return usable.groupBy("doc_id").agg(F.max(label).alias("y"))


def class_counts(labels: DataFrame, label: str) -> dict[int, int]:
    """How many usable labels each class has."""
    return {r.y: r["count"] for r in usable_labels(labels, label).groupBy("y").count().collect()}


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, per_class: int, characters: int) -> DataFrame:
    """doc_id, text, y (0 or 1) of at most per_class labelled documents of each class outside the held-out fold, and at most 2 * characters in all of a class.

    Documents are drawn by the hash of the id, until those before hold `characters`; longer ones than that are passed over. Null ids and
    labels are left out; of rows that share an id one is used. The drawn ids go to every task: their number is bounded by per_class.
    """
    usable = usable_labels(labels, label)
    draws = [usable.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    ids = draws[0].unionByName(draws[1])
    size = F.coalesce(F.length("text"), F.lit(0))
    sizes = docs.select("doc_id", size.alias("size")).join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.max("size").alias("size"))
    earlier = Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("size").over(earlier), F.lit(0))
    chosen = sizes.where(F.col("size") <= characters).withColumn("before", before).where(F.col("before") < characters).select("doc_id", "y", "size")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where(size == F.col("size"))
    return rows.groupBy("doc_id", "y").agg(F.max("text").alias("text")).select("doc_id", "text", "y")
