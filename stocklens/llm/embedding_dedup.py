"""Near-duplicate vectors: iterative quantisation codes, multi-index Hamming tables, and exact cosine on what they retrieve.

Rotations are learned on a bounded sample, so that the signs of the rotated vectors are balanced bits. The code of a vector is
cut into substrings, one table each; vectors that agree in a substring meet in a bucket. Substrings grow with the logarithm of
the number of vectors, which holds the mean bucket at BUCKET vectors, and there are as many tables as a pair at the threshold
needs to meet with probability RECALL. One rotation gives few substrings, so several are learned from different starts. Only codes
go to the tables: a bucket keeps the vectors that have another within a Hamming radius, and those alone are fetched and compared by
cosine. Vectors of different lengths have rotations and tables of their own.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, discard, materialize

SAMPLE = 20_000  # vectors from which rotations are learned, at most
COMPONENTS = 8_000_000  # components of these vectors together, at most, which bounds what the driver holds
BUCKET = 256
RECALL = 0.995
PIECE = 1024  # vectors of a bucket that one task holds as one side
BROADCAST_BUCKETS = 100_000
LINKS = "cid long, links long, a long, b long"


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision; by the largest component first, so that no square over- or underflows."""
    vectors = vectors.astype(np.float64)
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def learn_rotations(sample: np.ndarray, count: int, rounds: int = 30, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """The mean, and `count` matrices whose signs (x - mean) @ matrix are balanced bits: principal axes, then rotations that turn the data to the corners of the cube."""
    rng = np.random.default_rng(seed)
    sample = unit_rows(sample)
    mean = sample.mean(axis=0)
    centred = sample - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    turned = centred @ axes
    found = []
    for _ in range(count):
        rotation = np.linalg.qr(rng.standard_normal((sample.shape[1],) * 2))[0]
        for _ in range(rounds):
            corners = np.sign(turned @ rotation)
            u, _, v = np.linalg.svd(corners.T @ turned)
            rotation = (u @ v).T
        found.append(axes @ rotation)
    return mean, np.stack(found)


def table_plan(n: int, dims: int, cosine: float) -> tuple[int, int, int]:
    """(bits of a substring, tables, rotations) for n vectors."""
    bits = min(dims, max(1, math.ceil(math.log2(max(n, 2) / BUCKET))))
    meet = (1 - math.acos(cosine) / math.pi) ** bits
    tables = max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - meet)))
    return bits, tables, -(-tables // (dims // bits))


def encode(vectors: np.ndarray, mean: np.ndarray, rotations: np.ndarray) -> np.ndarray:
    """Whole codes as packed bytes, a multiple of eight of them."""
    unit = unit_rows(vectors) - mean
    signs = np.concatenate([(unit @ r > 0) for r in rotations], axis=1)
    spare = -signs.shape[1] % 64
    return np.packbits(np.pad(signs, ((0, 0), (0, spare))), axis=1)


def substrings(codes: np.ndarray, dims: int, bits: int, tables: int) -> np.ndarray:
    """The key of each code (rows of bytes) in each table."""
    signs, per = np.unpackbits(codes, axis=1), dims // bits
    weights = 1 << np.arange(bits, dtype=np.int64)
    return np.stack([signs[:, a : a + bits] @ weights for a in ((t // per) * dims + (t % per) * bits for t in range(tables))], axis=1)


def near_codes(codes: np.ndarray, own: np.ndarray, same: bool, radius: int):
    """Pairs of rows within radius of each other, in blocks of rows: inside one piece, or between two where same is false."""
    words = codes.view(np.uint64)
    for at in range(0, len(words) - 1, 128):
        rows, columns = np.arange(at, min(at + 128, len(words))), np.arange(at + 1, len(words))
        distance = np.zeros((len(rows), len(columns)), np.int32)
        for word in range(words.shape[1]):
            distance += np.bitwise_count(words[rows, word][:, None] ^ words[columns, word][None, :])
        near = (distance <= radius) & (columns[None, :] > rows[:, None])
        if not same:
            near &= own[rows][:, None] != own[columns][None, :]
        a, b = np.nonzero(near)
        if len(a):
            yield rows[a], columns[b]


def _retrieve(radius: int):
    """The rows of a bucket's piece that have another within radius."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        codes = np.stack([np.frombuffer(c, np.uint8) for c in group["code"]])
        hit = np.zeros(len(group), bool)
        for a, b in near_codes(codes, group["own"].to_numpy(), bool(group["i"].iloc[0] == group["j"].iloc[0]), radius):
            hit[a] = hit[b] = True
        return group.loc[hit, ["table", "key", "i", "j", "own", "cid"]]

    return run


def _compare(cosine: float, radius: int, dims: int, bits: int):
    """Links inside one piece of a bucket or between two: counts per vector and a forest that joins them."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        table, same = int(group["table"].iloc[0]), bool(group["i"].iloc[0] == group["j"].iloc[0])
        unit = unit_rows(np.stack(group["vector"].to_list()))
        codes = np.stack([np.frombuffer(c, np.uint8) for c in group["code"]])
        keys = substrings(codes, dims, bits, table) if table else np.zeros((len(group), 0), np.int64)
        copies, cids = group["copies"].to_numpy(np.int64), group["cid"].to_numpy(np.int64)
        links = np.zeros(len(group), np.int64)
        parent = np.arange(len(group))

        def find(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a, b in near_codes(codes, group["own"].to_numpy(), same, radius):
            for at in range(0, len(a), 20_000):
                x, y = a[at : at + 20_000], b[at : at + 20_000]
                close = np.einsum("ij,ij->i", unit[x], unit[y]) >= cosine
                # A pair that meets in several tables counts in the first.
                close &= ~(keys[x] == keys[y]).any(axis=1)
                x, y = x[close], y[close]
                np.add.at(links, x, copies[y])
                np.add.at(links, y, copies[x])
                for p, q in zip(x.tolist(), y.tolist(), strict=True):
                    p, q = find(p), find(q)
                    if p != q:
                        parent[max(p, q)] = min(p, q)
        roots = np.array([find(x) for x in range(len(group))])
        hit = np.flatnonzero(links)
        return pd.DataFrame({"cid": cids[hit], "links": links[hit], "a": cids[hit], "b": cids[roots[hit]]})

    return run


def links_of(classes: DataFrame, n: int, dims: int, cosine: float) -> DataFrame:
    """(cid, links, a, b) of n classes (cid, copies, vector) whose vectors all have dims components."""
    bits, tables, count = table_plan(n, dims, cosine)
    size = min(SAMPLE, max(1, COMPONENTS // dims))
    drawn = classes.where(F.shiftrightunsigned(F.xxhash64("cid", F.lit(5)), 11) / F.lit(float(2**53)) < size / n) if n > size else classes
    sample = drawn.select("vector").toArrow().column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    mean, rotations = learn_rotations(sample, count)
    flips = math.acos(cosine) / math.pi
    radius = math.ceil(dims * count * flips + 5 * math.sqrt(dims * count * flips * (1 - flips)))

    def codes(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                held = part.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dims)
                made = encode(held, mean, rotations)
                keys = substrings(made, dims, bits, tables)
                yield pa.RecordBatch.from_arrays([part.column("cid"), pa.array([c.tobytes() for c in made], pa.binary()), pa.array(list(keys))], names=["cid", "code", "keys"])

    coded = materialize(classes.select("cid", "vector").mapInArrow(codes, "cid long, code binary, keys array<long>"))
    met = coded.select("cid", "code", F.posexplode("keys").alias("table", "key"))
    full = met.groupBy("table", "key").agg(F.ceil(F.count(F.lit(1)) / F.lit(PIECE)).cast("int").alias("pieces")).where("pieces > 1")
    few = F.broadcast if full.count() <= BROADCAST_BUCKETS else lambda df: df
    dealt = met.join(few(full), ["table", "key"], "left").withColumn("pieces", F.coalesce("pieces", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("cid"), F.col("pieces")).cast("int"))
    dealt = dealt.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).withColumns({"i": F.least("own", "k"), "j": F.greatest("own", "k")}).drop("pieces", "k")
    groups = ["table", "key", "i", "j"]
    retrieved = materialize(dealt.groupBy(*groups).applyInPandas(_retrieve(radius), "table int, key long, i int, j int, own int, cid long"))
    fetched = retrieved.join(coded.drop("keys"), "cid").join(classes, "cid")
    found = materialize(fetched.groupBy(*groups).applyInPandas(_compare(cosine, radius, dims, bits), LINKS))
    discard(coded, retrieved)
    return found


def near_vectors(rows: DataFrame, cosine: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per input row (vec_id long, embedding array<float or double>).

    Links are pairs of rows of one length with cosine >= `cosine` in double precision, as far as the tables retrieve them; none is below it.
    Equal vectors are one class, so copies always link. Vectors that are null, empty, zero, or hold null or non-finite components link
    with nothing; so do rows with a null vec_id, whose component_id is null. Rows that share a vec_id are judged row by row. Extra columns
    are ignored. There is a job for each length that two different vectors have.
    """
    spark = rows.sparkSession
    vector = F.col("embedding")
    if rows.schema["embedding"].dataType.simpleString() != "array<float>":
        vector = vector.cast("array<double>")
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = F.col("vec_id").isNotNull() & (F.size(vector) > 0) & ~odd & F.exists(vector, lambda x: x != 0)
    marked = rows.select("vec_id", F.when(F.coalesce(sound, F.lit(False)), vector).alias("vector"))
    marked = marked.select("vec_id", "vector", F.xxhash64("vector").alias("high"), F.xxhash64(F.lit(1), "vector").alias("low"))
    classes = marked.where("vector is not null").groupBy("high", "low").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()))
    lengths = classes.groupBy(F.size("vector").alias("dims")).count().where("count > 1").orderBy("dims").collect()
    parts = [links_of(classes.where(F.size("vector") == r.dims).select("cid", "copies", "vector"), r["count"], r.dims, cosine) for r in lengths]
    found = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], LINKS)
    counts = found.groupBy("cid").agg(F.sum("links").alias("links"))
    joined = components(found.select("a", "b")).select(F.col("v").alias("cid"), "component")
    named = classes.drop("vector").join(counts, "cid", "left").join(joined, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "component").select("high", "low", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id", F.lit(True).alias("sound"))
    out = marked.withColumn("sound", F.col("vector").isNotNull()).drop("vector").join(named, ["high", "low", "sound"], "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))


def op10_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


#: All pairs by brute force, so equality also means that no link was missed.
SQL = """
with recursive good as (
  select vec_id, embedding::double[] as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (
  select a.vec_id as x, b.vec_id as y from good a join good b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.9),
reach(vec_id, other) as (select vec_id, vec_id from embeddings union select r.vec_id, l.y from reach r join links l on l.x = r.other),
least as (select vec_id, min(other) as component_id from reach group by vec_id),
counted as (select x as vec_id, count(*) as n from links group by x)
select vec_id, coalesce(n, 0)::bigint as n_links, component_id, vec_id = component_id as kept from least left join counted using (vec_id)
"""
