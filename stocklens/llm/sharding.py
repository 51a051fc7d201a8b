"""Shards of near-equal bytes: sampled splitters, range partitioning, and exact running sizes inside the ranges.

A size-weighted sample of bounded expected size gives splitters at its quantiles. Records are dealt to the ranges between
them; a text whose copies overfill a range is subdivided by doc_id, and by row where they share that too. The sample decides only
where work is done: the shard of a record follows from its exact place in the total order (text digest, doc_id), so every run gives the
same shards; rows of one text and doc_id are alike, and any of them may take any of their places.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

LOWEST = -(2**63)
RANGES = 1 << 16  # at most
SAMPLED = 1 << 18  # rows of the sample, about and at most: what the driver holds, whatever the input's size


def record_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, key (60 bits of the text's MD5; -1 for a null text, whose text_crc32 is null), and a number of the row."""
    key = F.conv(F.substring(F.md5(F.col("text").cast("binary")), 1, 15), 16, 10).cast("long")
    return docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"), F.coalesce(key, F.lit(-1).cast("long")).alias("key"), F.monotonically_increasing_id().alias("at"))


def splitters(rows: DataFrame, n_ranges: int, samples_per_range: int, total: int, count: int, whole: int) -> pd.DataFrame:
    """Quantiles of a size-weighted key sample: sorted boundaries (key, doc_id, at). Keys of more than `whole` bytes that fill more than one range keep a boundary for each.

    Each record is drawn with probability proportional to the mean of its share of the bytes and of the rows, so about
    n_ranges * samples_per_range rows reach the driver.
    """
    want = n_ranges * samples_per_range
    chance = want * (F.col("size") / F.lit(float(max(total, 1))) + F.lit(1.0 / max(count, 1))) / 2
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", "key", "at", F.lit(17)), 11) / F.lit(float(2**53))
    drawn = rows.withColumn("chance", chance).where(draw < F.col("chance"))
    drawn = drawn.select("key", F.coalesce("doc_id", F.lit(LOWEST)).alias("doc_id"), "at", F.greatest("chance", F.lit(1.0)).alias("weight")).toPandas()
    drawn = drawn.sort_values(["key", "doc_id", "at"], kind="stable", ignore_index=True)
    weight = drawn["weight"].cumsum().to_numpy()
    if not len(drawn):
        return drawn[["key", "doc_id", "at"]]
    at = np.unique(np.searchsorted(weight, np.arange(1, n_ranges) * weight[-1] / n_ranges))
    found = drawn.loc[at, ["key", "doc_id", "at"]].astype("int64")
    # The first boundary of a key is the key itself, so that copies of a text stay together.
    again = found["key"].duplicated()
    found.loc[~again, ["doc_id", "at"]] = LOWEST
    # Only copies that will be cut where shards end may lie in several ranges.
    asked = found.loc[again, "key"].unique().tolist()
    large = {r.key for r in rows.where(F.col("key").isin(asked)).groupBy("key").agg(F.sum("size").alias("n")).where(F.col("n") > whole).collect()} if asked else set()
    return found[~again | found["key"].isin(large)].drop_duplicates(ignore_index=True)


def range_of(bounds: pd.DataFrame):
    """A column function (key, doc_id, at) -> number of the range, by binary search in the boundaries."""
    keys = bounds["key"].to_numpy(np.int64)
    hot = {int(k): (int(np.searchsorted(keys, k, "left")), part["doc_id"].to_numpy(np.int64), part["at"].to_numpy(np.int64)) for k, part in bounds.groupby("key") if len(part) > 1}

    @F.pandas_udf("int")
    def number(key: pd.Series, doc_id: pd.Series, at: pd.Series) -> pd.Series:
        k = key.to_numpy(np.int64)
        out = np.searchsorted(keys, k, "right")
        for h, (first, ids, places) in hot.items():
            mine = np.flatnonzero(k == h)
            for some in np.array_split(mine, -(-len(mine) // 1000)) if len(mine) else ():
                d, p = (c.to_numpy(np.int64)[some][:, None] for c in (doc_id, at))
                out[some] = first + ((ids < d) | ((ids == d) & (places <= p))).sum(axis=1)
        return pd.Series(out.astype(np.int32))

    return number("key", F.coalesce("doc_id", F.lit(LOWEST)), "at")


def shard_by_bytes(docs: DataFrame, n_shards: int = 24, ranges_per_shard: int = 16, samples_per_range: int = 64, whole_share: float = 1 / 64, rows_per_range: int = 1_000_000) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null under this law), one row per input row.

    Shards differ from an equal share by no more than one record or one kept-together group. Copies of a text share a shard
    while together they hold at most whole_share of a shard; larger groups are cut where shards end. Null texts have size 8
    and form one group; null doc_ids come first in a group; equal rows take neighbouring slots. Other columns are ignored.
    There are ranges_per_shard ranges for each shard, or more, up to RANGES, so that a range has about rows_per_range rows at most;
    samples of a range become fewer as ranges become more, so that the sample has about SAMPLED rows at most. Rows and sizes are exact in any case.
    """
    spark = docs.sparkSession
    rows = materialize(record_sizes(docs))
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    limit = int(total / n_shards * whole_share)
    n_ranges = max(n_shards * ranges_per_shard, min(RANGES, -(-count // rows_per_range)))
    bounds = splitters(rows, n_ranges, max(1, min(samples_per_range, SAMPLED // n_ranges)), total, count, limit)
    spread = bounds.loc[bounds["key"].duplicated(), "key"].unique().tolist()
    placed = rows.withColumn("range", range_of(bounds) if len(bounds) else F.lit(0))
    group = ["range", "key", "size", "text_crc32"]
    order = ["key", "size", "text_crc32", "doc_id", "at"]
    before = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0).cast("long"))).withColumn("row", F.row_number().over(Window.partitionBy("range").orderBy(*order)))
    same = Window.partitionBy(*group)
    placed = materialize(placed.withColumn("first", F.min("before").over(same)).withColumn("group_size", F.sum("size").over(same)))
    # As many rows as there are ranges.
    ranges = placed.groupBy("range").agg(F.sum("size").alias("bytes")).toPandas().sort_values("range")
    starts = (ranges["bytes"].cumsum() - ranges["bytes"]).tolist()
    offsets = spark.createDataFrame(list(zip(ranges["range"].tolist(), starts, strict=True)), "range int, start long")
    whole = (F.col("group_size") <= F.lit(limit)) & ~F.col("key").isin(spread)
    place = F.col("start") + F.when(whole, F.col("first")).otherwise(F.col("before"))
    shard = F.least(F.lit(n_shards - 1), F.expr(f"(place * {n_shards}L) div {max(total, 1)}L")).cast("int")
    sharded = placed.join(F.broadcast(offsets), "range").withColumn("place", place).withColumn("shard", shard)
    parts = sharded.groupBy("shard", "range").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("low")).toPandas().sort_values(["shard", "range"])
    parts["base"] = parts.groupby("shard")["n"].cumsum() - parts["n"]
    bases = spark.createDataFrame(list(zip(*(parts[c].tolist() for c in ("shard", "range", "low", "base")), strict=True)), "shard int, range int, low int, base long")
    # In one range the rows of a shard follow each other, so a slot is a difference of row numbers.
    return sharded.join(F.broadcast(bases), ["shard", "range"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("row") - F.col("low")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op9_shards(spark, sf_dir: str) -> DataFrame:
    return shard_by_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _nibble_crcs() -> list[int]:
    """CRC-32 of each half byte, by the rule of its polynomial."""
    out = []
    for c in range(16):
        for _ in range(4):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


SQL = f"""
with bytes as (select doc_id, text, coalesce(octet_length(encode(text)), 0) + 8 as size, string_split(hex(encode(text)), '') as x from documents),
halves as (
  select doc_id, text, size, case when text is not null then list_prepend(4294967295::bigint,
    list_transform(case when text = '' then [] else range(0, len(x)) end, lambda i: (strpos('0123456789ABCDEF', x[xor(i, 1) + 1]) - 1)::bigint)) end as h from bytes),
keyed as (
  select doc_id, size::bigint as size, xor(list_reduce(h, lambda c, n: xor(c >> 4, list_extract({_nibble_crcs()}, xor(c & 15, n) + 1))), 4294967295) as crc,
    case when text is null then -1 else ('0x' || substr(md5(text), 1, 15))::bigint end as key from halves),
placed as (
  select *, coalesce(sum(size) over (order by key, size, crc, doc_id rows between unbounded preceding and 1 preceding), 0) as before,
    sum(size) over (partition by key, size, crc) as together, sum(size) over () as total from keyed),
dealt as (
  select *, least(23, ((case when together <= floor(total / 24 / 64) then min(before) over (partition by key, size, crc) else before end) * 24 // total))::int as shard from placed)
select doc_id, size, crc as text_crc32, 'bytes' as law, shard, row_number() over (partition by shard order by key, size, crc, doc_id) - 1 as slot, null::int as grown_shard from dealt
"""
