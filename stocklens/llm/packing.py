"""Optimal length buckets: dynamic programming over the global length histogram, then token-budget batches in each bucket."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize


def word_count(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text if isinstance(text, Column) else F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def optimal_bounds(lengths: np.ndarray, counts: np.ndarray, n_buckets: int) -> list[int]:
    """Upper bounds of at most n_buckets buckets with the least total padding (each row is padded to its bucket's bound).

    The cost of a bucket (i, j] is lengths[j] * rows - tokens, which obeys the quadrangle inequality, so the best cut of each
    prefix moves one way only. Each layer is filled by divide and conquer, all ranges of one depth at a time.
    """
    order = np.argsort(lengths)
    x, n = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    rows, tokens = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * x)])
    m = len(x)
    best = np.concatenate([[0], x * rows[1:] - tokens[1:]])  # one bucket
    cuts = []
    for _ in range(1, min(n_buckets, m)):
        new, cut = best.copy(), np.zeros(m + 1, np.int64)
        lo, hi, a, b = (np.array([v]) for v in (1, m, 0, m - 1))
        while len(lo):
            j = (lo + hi) // 2
            size = np.minimum(b, j - 1) - a + 1
            start = np.cumsum(size) - size
            which = np.repeat(np.arange(len(j)), size)
            i = np.arange(len(which)) - start[which] + a[which]
            cost = best[i] + (x[j - 1] * rows[j] - tokens[j])[which] - x[j - 1][which] * rows[i] + tokens[i]
            least = np.minimum.reduceat(cost, start)
            hits = np.flatnonzero(cost == least[which])
            k = i[hits[np.searchsorted(hits, start)]]  # the first of equal ones
            new[j], cut[j] = least, k
            lo, hi, a, b = (np.concatenate(v) for v in ((lo, j + 1), (j - 1, hi), (a, k), (k, b)))
            some = lo <= hi
            lo, hi, a, b = lo[some], hi[some], a[some], b[some]
        cuts.append(cut)
        best = new
    bounds, j = [], m
    for cut in reversed(cuts):
        if j == 0:
            break
        bounds.append(int(x[j - 1]))
        j = int(cut[j])
    if j:
        bounds.append(int(x[j - 1]))
    return sorted(set(bounds))


def pack(rows: DataFrame, id_col: str = "doc_id", length_col: str = "length", n_buckets: int = 16, token_budget: int = 65_536, rows_per_chunk: int = 20_000) -> DataFrame:
    """Adds bucket, bucket_length, batch, place and padding to rows (id, length, other columns).

    A length is a count of whatever the budget counts: words here, ids of a tokenizer where the caller gives those. Every batch
    lies in one bucket and holds at most token_budget padded tokens, one row at least; only the last batch of a bucket may be
    short. A null length counts as 0; rows of length 0 pad to their bucket like others. Of equally good bounds the smallest cuts
    are taken. Null and repeated ids are ordinary rows: rows of one id and length stand next to each other in any order. Empty input
    gives no rows. Input columns with the names of the added ones are replaced. A bucket may hold any share of the rows: its rows are
    numbered in chunks of about rows_per_chunk, and each chunk starts where the counts of the earlier ones end.

    The histogram that reaches the driver has a row for each distinct length: at most the root of twice the table's tokens.
    """
    spark = rows.sparkSession
    made = ["bucket", "bucket_length", "batch", "place", "padding"]
    kept = [c for c in rows.columns if c not in {*made, length_col}]
    sized = rows.select(F.struct(*kept).alias("_row"), F.col(id_col).alias("_id"), F.coalesce(F.col(length_col), F.lit(0)).cast("long").alias("_length"))
    histogram = sized.groupBy("_length").agg(F.count(F.lit(1)).alias("n")).toPandas()
    lengths, counts = histogram["_length"].to_numpy(np.int64), histogram["n"].to_numpy(np.int64)
    bounds = optimal_bounds(lengths, counts, n_buckets) if len(histogram) else []
    held = np.bincount(np.searchsorted(bounds, lengths), counts, len(bounds)) if bounds else []
    info = [(b, int(top), max(1, token_budget // max(1, int(top))), max(1, -(-int(n) // rows_per_chunk))) for b, (top, n) in enumerate(zip(bounds, held, strict=True))]
    bucket = F.lit(None).cast("int")
    for b, bound in reversed(list(enumerate(bounds))):
        bucket = F.when(F.col("_length") <= bound, F.lit(b)).otherwise(bucket)
    table = spark.createDataFrame(info, "bucket int, bucket_length long, _capacity long, _chunks int")
    # Ids of so many rows of one length that fewer than 5,000 can be as common are dealt over the chunks by row.
    common = max(rows_per_chunk // 2, int(counts.sum()) // 5000)
    hot = F.broadcast(sized.groupBy("_id", "_length").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > common).select(F.xxhash64("_id", "_length").alias("_hash"), F.lit(True).alias("_hot")).distinct())
    dealt = sized.withColumn("bucket", bucket).join(F.broadcast(table), "bucket").withColumns({"_hash": F.xxhash64("_id", "_length"), "_at": F.monotonically_increasing_id()}).join(hot, "_hash", "left")
    dealt = dealt.withColumn("_chunk", F.pmod(F.when(F.col("_hot"), F.xxhash64("_at")).otherwise(F.col("_hash")), F.col("_chunks")).cast("int")).drop("_at", "_hot")
    dealt = materialize(dealt)  # the number of a row must not change between the counts and the places
    counted = dealt.groupBy("bucket", "_chunk").agg(F.count(F.lit(1)).alias("n"))
    # One row per chunk, so a ten-thousandth of the rows: a running sum in each bucket.
    earlier = Window.partitionBy("bucket").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = counted.select("bucket", "_chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).cast("long").alias("_base"))
    within = Window.partitionBy("bucket", "_chunk").orderBy(F.xxhash64("_id"), "_id", "_length")
    ranked = dealt.withColumn("_place", F.row_number().over(within)).join(bases, ["bucket", "_chunk"]).withColumn("_rank", F.col("_base") + F.col("_place") - 1)
    return ranked.select(*(F.col("_row")[c].alias(c) for c in kept), F.col("_length").alias(length_col), "bucket", "bucket_length", F.expr("_rank div _capacity").alias("batch"), F.expr("_rank % _capacity").alias("place"), (F.col("bucket_length") - F.col("_length")).alias("padding"))


def op5_packing(spark, sf_dir: str) -> DataFrame:
    """Lengths are words of the whole text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(materialize(docs.select("doc_id", word_count(F.col("text")).alias("length"))))
