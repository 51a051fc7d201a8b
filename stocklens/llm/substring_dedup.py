"""Removal of repeated word windows: compressed FM-indexes per shard, searched backwards through wavelet matrices.

A window is `width` consecutive words. Each has a minimizer, the least hash among its word 8-grams, so equal windows have
equal minimizers. Runs of windows with one minimizer are cut out as segments and grouped by (minimizer, content), so that each
content is searched once, for all segments that hold it: those of later documents than its first go whole. Segments that differ but share a minimizer may still share windows:
their words go to shards, each shard builds an FM-index of its distinct segments, and every segment is searched in it
backwards, window by window. A failed search tells how far the next window may jump; what follows a found one is read back from the
index, which keeps neither text nor suffix order. Reported are the intervals where matching statistics reach a window
under a smaller doc_id; the statistics themselves are told as lower bounds, of one occurrence each.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MIX, WordHash, discard, gram_hashes, materialize, words_of

GRAM = 8
LAST = 2**63 - 1  # stands for a null doc_id, after all others
SHARD_WORDS = 150_000  # words indexed by one task
SAMPLE = 16  # words of a sequence for each place of the suffix order that an index keeps
BROADCAST_IDS = 1_000_000
INTERVALS = "array<struct<lo: int, hi: int>>"
_POWERS = np.ones(1, np.uint64), np.ones(1, np.uint64)
INVERSE = np.uint64(pow(int(MIX), -1, 2**64))


def powers(count: int):
    global _POWERS
    if len(_POWERS[0]) < count:
        with np.errstate(over="ignore"):
            _POWERS = tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(2 * count, base, np.uint64))]) for base in (MIX, INVERSE))
    return _POWERS


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    low, span = values, 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    return np.minimum(low[: len(values) - width + 1], low[width - span :]) if width > span else low


def segments_of(words: list[bytes], width: int, hashes: WordHash):
    """(minimizer, content hash, first word, number of words) of the segments of one text, as arrays."""
    n = len(words) - width + 1
    if n <= 0:
        return None
    gram = min(GRAM, width)
    values = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    least = sliding_min(gram_hashes(values, gram), width - gram + 1)
    start = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    stop = np.concatenate([start[1:], [n]]) + width - 1
    up, down = powers(len(words) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum(values * up[: len(words)])])
        content = (total[stop] - total[start]) * down[start]
    return least[start].view(np.int64), content.view(np.int64), start, stop - start


def segments(keyed: DataFrame, width: int) -> DataFrame:
    """Segments of keyed (d, th, text): m, h, d, th, start, len."""

    def run(batches):
        hashes = WordHash()
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                found = [segments_of(words_of(t.encode()), width, hashes) if t else None for t in part.column("text").to_pylist()]
                count = [len(f[0]) if f else 0 for f in found]
                some = [f for f in found if f]
                if not some:
                    continue
                m, h, start, length = (np.concatenate(c) for c in zip(*some, strict=True))
                row = pa.array(np.repeat(np.arange(len(found)), count))
                yield pa.RecordBatch.from_arrays([pa.array(m), pa.array(h), part.column("d").take(row), part.column("th").take(row), pa.array(start.astype(np.int32)), pa.array(length.astype(np.int32))], names=["m", "h", "d", "th", "start", "len"])

    return keyed.mapInArrow(run, "m long, h long, d long, th long, start int, len int")


class WaveletMatrix:
    """Ranks of symbols in a sequence: one bit vector a level, packed in 64-bit words beside running counts."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.levels, n = [], len(symbols)
        for bit in reversed(range(max(1, int(top).bit_length()))):
            ones = ((symbols >> bit) & 1).astype(bool)
            packed = np.zeros(((n >> 6) + 1) * 8, np.uint8)
            packed[: (n + 7) // 8] = np.packbits(ones, bitorder="little")
            blocks = packed.view(np.uint64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(blocks), dtype=np.int64)[:-1]])
            self.levels.append((bit, blocks, before, n - int(ones.sum())))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Positions that place is mapped to on the last level; a difference of two is a count of symbol between them."""
        for bit, blocks, before, zeros in self.levels:
            block = place >> 6
            mask = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
            ones = before[block] + np.bitwise_count(blocks[block] & mask)
            place = np.where((symbol >> bit) & 1, zeros + ones, place - ones)
        return place

    def step(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols held at places, and what rank() maps each of these to."""
        symbol = np.zeros(len(place), np.int64)
        for bit, blocks, before, zeros in self.levels:
            block, inside = place >> 6, (place & 63).astype(np.uint64)
            held = blocks[block]
            ones = before[block] + np.bitwise_count(held & ((np.uint64(1) << inside) - np.uint64(1)))
            one = ((held >> inside) & np.uint64(1)).astype(np.int64)
            symbol |= one << bit
            place = np.where(one, zeros + ones, place - ones)
        return symbol, place


class FmIndex:
    """FM-index of word sequences, each ended by a separator (symbol 0), with the owner of each row.

    It keeps the wavelet matrix and a sample of the suffix order, one place in SAMPLE; words and places are read from the matrix by steps back.
    """

    def __init__(self, sequences: list[np.ndarray], owners: np.ndarray):
        lengths = np.array([len(s) for s in sequences])
        self.ends = np.cumsum(lengths + 1) - 1
        n, count = int(self.ends[-1]) + 1, len(sequences)
        offset = np.arange(n) - np.repeat(self.ends - lengths, lengths + 1)
        ended = np.zeros(n, bool)
        ended[self.ends] = True
        text = np.zeros(n, np.int64)
        text[~ended] = np.concatenate(sequences)
        # Separators are told apart by their order, so that no comparison of suffixes goes past one.
        rank, span = text + (count - 1), 1
        rank[self.ends] = np.arange(count)
        while True:
            key = rank * (2 * n + 2)
            key[: n - span] += rank[span:] + 1
            order = np.argsort(key)
            step = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate([[False], step[1:] != step[:-1]]))
            if rank[order[-1]] == n - 1:
                break
            span *= 2
        top = int(text.max())
        below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        self.size, self.wavelet = n, WaveletMatrix(text[order - 1], top)
        self.first = below[:-1] - self.wavelet.rank(np.arange(top + 1), np.zeros(top + 1, np.int64))
        self.places = np.flatnonzero((offset % SAMPLE == 0) | ended)
        self.rows = rank[self.places]
        self.by_row = np.argsort(self.rows)
        self.owners, owner = np.unique(owners, return_inverse=True)
        self.least = [np.repeat(owner.astype(np.int32), lengths + 1)[order]]  # sparse table: least owner of 2**k rows from each row
        while len(self.least[-1]) > 1 << (len(self.least) - 1):
            half = 1 << (len(self.least) - 1)
            low = self.least[-1]
            self.least.append(np.minimum(low[:-half], low[half:]))

    def extend(self, symbol, low, high):
        """The rows of symbol + pattern, from the rows [low, high) of pattern."""
        both = self.first[np.concatenate([symbol, symbol])] + self.wavelet.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        return both[: len(low)], both[len(low) :]

    def least_owner(self, low, high):
        level = np.frexp((high - low).astype(float))[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level):
            at = level == k
            table = self.least[k]
            out[at] = np.minimum(table[low[at]], table[high[at] - (1 << k)])
        return out

    def back(self, row):
        """The word before each row's suffix, and the row of the suffix that starts with it."""
        symbol, place = self.wavelet.step(row)
        return symbol, self.first[symbol] + place

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Places of rows in the text: those of the sampled rows that steps back lead to, and the steps."""
        row, place = row.copy(), np.empty(len(row), np.int64)
        sampled, live, steps = self.rows[self.by_row], np.arange(len(row)), 0
        while True:
            at = np.minimum(np.searchsorted(sampled, row[live]), len(sampled) - 1)
            hit = sampled[at] == row[live]
            place[live[hit]] = self.places[self.by_row[at[hit]]] + steps
            live = live[~hit]
            if not len(live):
                return place
            row[live] = self.back(row[live])[1]
            steps += 1

    def following(self, place: np.ndarray, count: np.ndarray) -> np.ndarray:
        """A line for each place with its next count words, 0 beyond them and where the sequence ends: read by steps back from a sampled place."""
        out = np.zeros((len(place), int(count.max(initial=0))), np.int64)
        stop = np.minimum(place + count, self.ends[np.searchsorted(self.ends, place)])
        at = np.searchsorted(self.places, stop)
        here, row = self.places[at] - place, self.rows[at]
        live = np.flatnonzero(here > 0)
        while len(live):
            symbol, row[live] = self.back(row[live])
            here[live] -= 1
            wanted = here[live] < count[live]
            out[live[wanted], here[live[wanted]]] = symbol[wanted]
            live = live[here[live] > 0]
        return out

    def matches(self, queries: list[np.ndarray], owners: np.ndarray, width: int) -> list[tuple[int, int, int]]:
        """(query, from, to): matches of width words or more with sequences of smaller owners, which together cover all that such matches cover.

        The words from `from` to `to` occur in a sequence of the smallest owner that has the window, as far as one occurrence there goes
        (at most to the end of the piece), so to - from is a lower bound of the matching statistic at `from`. Starts between from and
        to - width lie in this match and aren't told again; all other starts have a statistic below width. All queries advance together, long ones
        in pieces of `width` window starts. A window is read from its last word to its first; if its last t words don't occur under
        a smaller owner, the next window to try starts after the first of them. What follows a window that does is read from the index.
        """
        whole = np.array([len(q) for q in queries], np.int64)
        words = np.concatenate(queries)
        parts = np.maximum(1, -(-(whole - width + 1) // width))
        query = np.repeat(np.arange(len(queries)), parts)
        offset = (np.arange(len(query)) - np.repeat(np.cumsum(parts) - parts, parts)) * width
        base = (np.cumsum(whole) - whole)[query] + offset
        lengths = np.minimum(whole[query] - offset, 2 * width - 1)
        mine, top = np.searchsorted(self.owners, owners)[query], len(self.first)
        at = np.zeros(len(query), np.int64)  # start of the window
        read = np.zeros(len(query), np.int64)  # words of it read so far
        low, high = np.zeros(len(query), np.int64), np.full(len(query), self.size)
        live, held, found = np.flatnonzero(lengths >= width), [], []
        while len(live):
            symbol = words[base[live] + at[live] + width - 1 - read[live]]
            inside = (symbol > 0) & (symbol < top)
            lo, hi = self.extend(np.where(inside, symbol, 0), low[live], high[live])
            good = inside & (lo < hi)
            good[good] = self.least_owner(lo[good], hi[good]) < mine[live[good]]
            read[live] += 1
            low[live], high[live] = lo, hi
            lost, full = live[~good], good & (read[live] == width)
            at[lost] += width + 1 - read[lost]
            read[lost], low[lost], high[lost] = 0, 0, self.size
            held.append(live[full])
            live = live[~full]
            live = live[at[live] + width <= lengths[live]]
            if not len(live):  # all windows found since the last time, at once
                full, held = np.concatenate(held), []
                least = self.least_owner(low[full], high[full])
                row = np.array([a + int(np.argmax(self.least[0][a:b] == o)) for a, b, o in zip(low[full].tolist(), high[full].tolist(), least.tolist(), strict=True)], np.int64)
                rest = lengths[full] - at[full] - width
                there = self.following(self.locate(row) + width, rest) if len(full) else np.zeros((0, 0), np.int64)
                column = np.arange(there.shape[1])
                here = words[np.minimum((base[full] + at[full] + width)[:, None] + column, len(words) - 1)]
                more = np.logical_and.accumulate((there == here) & (column < rest[:, None]), axis=1).sum(axis=1)
                start = offset[full] + at[full]
                found += zip(query[full].tolist(), start.tolist(), (start + width + more).tolist(), strict=True)
                at[full] += more + 1
                read[full], low[full], high[full] = 0, 0, self.size
                live = full[at[full] + width <= lengths[full]]
        return found


def _search_shard(width: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        ids: dict[bytes, int] = {}
        sequences = [np.array([ids.setdefault(w, len(ids) + 1) for w in words_of(c)], np.int64) for c in group["content"]]
        held, asked = np.flatnonzero(group["indexed"]), np.flatnonzero(group["asked"])
        if not len(held) or not len(asked):
            return pd.DataFrame({"m": [], "h": [], "parts": []}).astype({"m": "int64", "h": "int64", "parts": object})
        owner = group["d0"].to_numpy(np.int64)
        index = FmIndex([sequences[i] for i in held], owner[held])
        found = index.matches([sequences[i] for i in asked], owner[asked], width)
        joined: dict[int, list[dict[str, int]]] = {}
        for q, lo, hi in sorted(found):
            parts = joined.setdefault(q, [])
            if parts and lo <= parts[-1]["hi"]:
                parts[-1]["hi"] = max(hi, parts[-1]["hi"])
            else:
                parts.append({"lo": lo, "hi": hi})
        rows = asked[np.fromiter(joined, np.int64, len(joined))]
        return pd.DataFrame({"m": group["m"].to_numpy()[rows], "h": group["h"].to_numpy()[rows], "parts": pd.Series(list(joined.values()), dtype=object)})

    return run


def segment_texts(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """Adds content (the words of each segment, joined by spaces) to wanted (m, h, d, th, start, len, ...)."""
    per_text = wanted.groupBy("d", "th").agg(F.collect_list(F.struct("m", "h", "start", "len")).alias("parts"))
    texts = of_ids(keyed, per_text).dropDuplicates(["d", "th"]).join(per_text, ["d", "th"])

    def run(batches):
        kind = pa.list_(pa.int64())
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                m, h, content = [], [], []
                for text, parts in zip(part.column("text").to_pylist(), part.column("parts").to_pylist(), strict=True):
                    words = words_of(text.encode())
                    for p in parts:
                        m.append(p["m"])
                        h.append(p["h"])
                        content.append(b" ".join(words[p["start"] : p["start"] + p["len"]]))
                yield pa.RecordBatch.from_arrays([pa.array(m, pa.int64()), pa.array(h, pa.int64()), pa.array(content, pa.binary())], names=["m", "h", "content"])

    return texts.select("text", "parts").mapInArrow(run, "m long, h long, content binary")


def of_ids(keyed: DataFrame, wanted: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of keyed whose d is in wanted; sent to every task while the ids are few, else joined by a shuffle."""
    ids = wanted.select("d").distinct()
    return keyed.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "d", how)


def keyed_texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("d"), F.xxhash64("text").alias("th"), "text")


def repeated_intervals(docs: DataFrame, width: int = 50) -> DataFrame:
    """(d, th, parts): for each document with something to remove, the intervals [lo, hi) of its words, as a written table."""
    keyed = keyed_texts(docs)
    cut = materialize(segments(keyed, width))
    groups = cut.groupBy("m", "h").agg(F.min("d").alias("d0"), F.max("d").alias("d1"), F.max("len").alias("len"))
    mixed = groups.groupBy("m").agg(F.min("d0").alias("low"), F.max("d0").alias("high"), F.sum("len").alias("words")).where("low < high").select("m", "low", "words")
    marked = groups.drop("len").join(mixed, "m", "left").where("d1 > d0 or low is not null")
    hits = materialize(cut.join(marked, ["m", "h"]).where("d > d0 or low is not null").select("m", "h", "d", "th", "start", "len", "d0", "low", "words"))
    copies = hits.where("d > d0").select("d", "th", F.array(F.struct(F.col("start").alias("lo"), (F.col("start") + F.col("len")).alias("hi"))).alias("parts"))

    first = hits.where("d = d0 and low is not null")
    one = first.groupBy("m", "h").agg(F.min_by(F.struct("d", "th", "start", "len"), F.struct("d", "th", "start")).alias("at"), F.first("low").alias("low"), F.first("words").alias("words")).select("m", "h", "at.*", "low", "words")
    one = materialize(one)
    total = one.agg(F.coalesce(F.sum("len"), F.lit(0)).alias("n")).first()["n"]
    shards = max(1, -(-total // SHARD_WORDS))
    # A minimizer with more words than a shard holds is split into pieces by content, and each piece is searched in all of them.
    pieces = F.greatest(F.lit(1), F.ceil(F.col("words") / F.lit(SHARD_WORDS)).cast("int"))
    spread = one.withColumn("pieces", pieces).withColumn("own", F.pmod(F.xxhash64("h"), F.col("pieces")).cast("int"))
    told = spread.select("m", "h", F.col("d").alias("d0"), "low", "pieces", "own").join(segment_texts(keyed, one), ["m", "h"])
    told = told.withColumn("shard", F.when(F.col("pieces") > 1, F.col("m")).otherwise(F.pmod(F.xxhash64("m"), F.lit(shards))))
    asks = F.col("d0") > F.col("low")
    whole = told.where("pieces = 1").select("shard", F.lit(0).alias("i"), F.lit(0).alias("j"), "m", "h", "d0", "content", F.lit(True).alias("indexed"), asks.alias("asked"))
    split = told.where("pieces > 1").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    as_index = split.select("shard", F.col("own").alias("i"), (F.col("k") + 1).alias("j"), "m", "h", "d0", "content", F.lit(True).alias("indexed"), (asks & (F.col("own") == F.col("k"))).alias("asked"))
    as_query = split.where(asks & (F.col("own") != F.col("k"))).select("shard", F.col("k").alias("i"), (F.col("own") + 1).alias("j"), "m", "h", "d0", "content", F.lit(False).alias("indexed"), F.lit(True).alias("asked"))
    found = whole.unionByName(as_index).unionByName(as_query).groupBy("shard", "i", "j").applyInPandas(_search_shard(width), f"m long, h long, parts {INTERVALS}")
    moved = F.transform("parts", lambda p: F.struct((p["lo"] + F.col("start")).alias("lo"), (p["hi"] + F.col("start")).alias("hi")))
    near = first.select("m", "h", "d", "th", "start").join(found, ["m", "h"]).select("d", "th", moved.alias("parts"))
    out = materialize(copies.unionByName(near).groupBy("d", "th").agg(F.flatten(F.collect_list("parts")).alias("parts")))
    discard(cut, hits, one)
    return out


WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def keep_mask(n_words: int, parts) -> np.ndarray:
    """True for the words outside all intervals."""
    change = np.zeros(n_words + 1, np.int64)
    for p in parts if parts is not None else ():
        change[p["lo"]] += 1
        change[p["hi"]] -= 1
    return np.cumsum(change[:n_words]) == 0


def with_intervals(docs: DataFrame, found: DataFrame) -> list[DataFrame]:
    """docs with parts, in one frame or two: texts that lose nothing are not shuffled while the ids of the others are few."""
    keyed = docs.withColumns({"d": F.coalesce("doc_id", F.lit(LAST)), "th": F.xxhash64("text")})
    ids = found.select("d").distinct()
    if ids.count() > BROADCAST_IDS:
        return [keyed.join(found, ["d", "th"], "left")]
    ids = F.broadcast(ids)
    touched = keyed.join(ids, "d", "left_semi").join(found, ["d", "th"], "left")
    return [touched, keyed.join(ids, "d", "left_anti").withColumn("parts", F.lit(None).cast(found.schema["parts"].dataType))]


def digests(docs: DataFrame, width: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, one row per input row.

    Segments are compared by two 64-bit hashes, of their minimizer and of all their words; in an index, word by word. A word goes if a window of `width` words over it also starts in a document with a smaller doc_id, judged on
    the input. A null doc_id counts as greater than all others; rows that share a doc_id don't remove each other's words.
    Null texts have no words. Extra columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    frames = with_intervals(docs, repeated_intervals(docs, width))
    joined = reduce(DataFrame.unionByName, frames)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                n, gone, sha = [], [], []
                for text, parts in zip(part.column("text").to_pylist(), part.column("parts").to_pylist(), strict=True):
                    words = words_of(text.encode()) if text else []
                    kept = [words[i] for i in np.flatnonzero(keep_mask(len(words), parts))] if parts else words
                    n.append(len(words))
                    gone.append(len(words) - len(kept))
                    sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return joined.select("doc_id", "text", "parts").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, width: int = 50) -> DataFrame:
    """docs with the repeated words cut from their texts, each with the white space after it; other columns as they were."""
    names = docs.columns
    packed = docs.select("doc_id", "text", F.struct(*[c for c in names if c not in ("doc_id", "text")]).alias("_rest"))
    frames = with_intervals(packed, repeated_intervals(docs.select("doc_id", "text"), width))

    @F.pandas_udf("string")
    def cut(text: pd.Series, parts: pd.Series) -> pd.Series:
        def one(t, p):
            if t is None or p is None:
                return t
            raw = t.encode()
            starts = [m.start() for m in WORDS.finditer(raw)] + [len(raw)]
            keep = keep_mask(len(starts) - 1, p)
            return (raw[: starts[0]] + b"".join(raw[starts[i] : starts[i + 1]] for i in np.flatnonzero(keep))).decode()

        return pd.Series([one(t, p) for t, p in zip(text, parts, strict=True)], dtype=object)

    frames[0] = frames[0].withColumn("text", cut("text", "parts"))
    joined = reduce(DataFrame.unionByName, frames)
    return joined.select(*(c if c in ("doc_id", "text") else F.col("_rest")[c].alias(c) for c in names))


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
with words as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
windows as (
  select doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) as h from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from words where len(w) >= 50)),
firsts as (select h, min(doc_id) as d from windows group by h),
gone as (select distinct doc_id, unnest(range(i, i + 50)) as p from windows join firsts using (h) where doc_id > d),
places as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as p from words),
kept as (
  select doc_id, string_agg(word, ' ' order by p) as t, count(*) as n from places
  where not exists (select 1 from gone where gone.doc_id = places.doc_id and gone.p = places.p) group by doc_id)
select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256
from words left join kept using (doc_id)
"""
