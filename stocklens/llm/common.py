"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
import weakref

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Where none is set a local master gets one of its own; a cluster is an error, as executors share no local folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends here and no executor owns the rows."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more."""
    for table in tables:
        path = _PATHS.pop(table, None)
        if path is not None:
            sc = table.sparkSession.sparkContext
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def let(value: Column, body) -> Column:
    """Bind value once, so that body may use it inside lambdas without computing it again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _forest(batches):
    """Reduce the edges of a partition to a spanning forest whose edges point at the smallest vertex of each tree."""
    parent: dict[int, int] = {}

    def find(x):
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def drain():
        found = [(v, find(v)) for v in parent]
        return pd.DataFrame([x for x in found if x[0] != x[1]], columns=["b", "a"], dtype="int64")[["a", "b"]]

    for batch in batches:
        for a, b in zip(batch["a"].tolist(), batch["b"].tolist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > 1_000_000:
            yield drain()
            parent.clear()
    if parent:
        yield drain()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a long, b long): one row (v, component) per vertex, component its smallest vertex.

    Each round every vertex hooks onto its smallest neighbour, chains are shortened by pointer jumping, and the edges
    are contracted to the roots. Aggregates are partial and labels unique, so a hub vertex costs no more than its edges.
    """
    spark = edges.sparkSession
    label, current = None, materialize(_forest_of(edges))
    while not current.isEmpty():
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = materialize(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("p")))
        hook = first
        for _ in range(2):
            up = hook.select(F.col("v").alias("p"), F.col("p").alias("q"))
            hook = hook.join(up, "p", "left").select("v", F.coalesce("q", "p").alias("p"))
        hook = materialize(hook)
        at = lambda c: hook.select(F.col("v").alias(c), F.col("p").alias(f"{c}_p"))
        before, moved = (label, current), current.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("a_p", "a").alias("a"), F.coalesce("b_p", "b").alias("b"))
        if label is None:
            label = hook
        else:
            label = materialize(label.join(at("p"), "p", "left").select("v", F.coalesce("p_p", "p").alias("p")))
        current = materialize(_forest_of(moved))
        discard(first, *(t for t in (*before, hook) if t is not None and t is not label))
    if label is None:
        return spark.createDataFrame([], "v long, component long")
    return label.select("v", F.col("p").alias("component"))


def _forest_of(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).mapInPandas(_forest, "a long, b long").distinct()


def words_of(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text: bytes.split() cuts at exactly the six ASCII white-space bytes of WORD."""
    return text.split()


class WordHash(dict):
    """64-bit hashes of words, kept for reuse; emptied when it holds too many."""

    LIMIT = 100_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


MIX = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(values: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all runs of n consecutive word hashes."""
    count = len(values) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        h = values[:count].copy()
        for k in range(1, n):
            h = ((h ^ (h >> np.uint64(29))) * MIX) + values[k : count + k]
        h = (h ^ (h >> np.uint64(32))) * MIX
        return h ^ (h >> np.uint64(29))
