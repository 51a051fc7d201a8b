"""The corpus pipeline: toxicity, quality, near-duplicate and substring filters, then packing into length buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stocklens.llm import ngram_join, packing, rule_ensemble, substring_dedup, toxicity
from stocklens.llm.common import discard, materialize

#: Trained models and optimal buckets have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those scored toxic (0.7 or more); null texts score as empty ones."""
    return toxicity.reject_toxic(docs, toxicity.trained(docs, _labels(spark, sf_dir)))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs whose quality score is 0.5 or more; null texts score as empty ones."""
    return rule_ensemble.reject_poor(docs, rule_ensemble.trained(docs, _labels(spark, sf_dir)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, Jaccard 0.8): the smallest doc_id. Rows with null ids stay."""
    return ngram_join.keep_one(docs, n=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 words that also start in a document with a smaller id, and counts n_chars anew.

    A null text stays null and so does its n_chars. A null id counts as greater than all others; rows of one id cut nothing from each other.
    """
    return substring_dedup.remove_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, length in words, bucket, bucket_length, batch, place and padding of each document. Null texts have length 0; null and repeated ids are ordinary rows."""
    return packing.pack(materialize(docs.select("doc_id", packing.word_count("text").alias("length"))))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_poor),
    ("ngram_jaccard", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("packing", pack_documents),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; what a stage has read is deleted when its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir))
        discard(before)
    return docs
