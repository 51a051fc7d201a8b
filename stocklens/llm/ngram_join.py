"""N-gram Jaccard join: prefix filtering finds blocks of candidate sets, and a prefix tree in each block counts overlaps.

1. Equal sets become one class, named by the number of one of its rows; only classes go on.
2. Each class sends the smallest part of its set in hash order, long enough that linked sets share at least k(size) of it.
   Tokens that one class alone holds are dropped, and so are classes left with fewer than k shared tokens.
3. What is left of each part is ordered rarest first and cut to its prefix, so that linked sets still share a token of it.
   The classes that share a token meet in the block of the smallest class that has it.
4. In every block the sets are held in a trie. All sets follow one global order, that of their n-grams' hashes. A query walks the trie
   with one running overlap for each shared path and leaves subtrees whose sizes or remaining lengths can't reach the threshold. First
   only each block's leader is searched, by all its members; the components so found are final for most blocks, and only pairs
   across components are searched after that, in pieces of bounded size.

N-grams are compared by 64-bit hash, whole sets by 128 bits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHash, components, discard, gram_hashes, materialize, words_of

SPARE = 10  # k(size) is this percentage of the size
PIECE = 100_000  # shingles of a block's sets that one task holds as one side
BROADCAST_ROWS = 250_000


def shingles(text: str | None, n: int, words: WordHash) -> np.ndarray:
    """The sorted distinct n-word shingles of a text as 64-bit hashes; a shorter text is one shingle, an empty one has none."""
    found = words_of(text.encode().lower()) if text else []
    if not found:
        return np.empty(0, np.int64)
    values = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    grams = np.sort(gram_hashes(values, min(n, len(values))).view(np.int64))
    return grams[np.concatenate([[True], grams[1:] != grams[:-1]])]


def k_of(size: int) -> int:
    return max(1, size * SPARE // 100)


def least_partner(size: int, percent: int) -> int:
    """The smallest size of a set that can be linked with one of the given size; also the least overlap of such a pair."""
    return -(-size * percent // 100)


def sketch_length(size: int, percent: int) -> int:
    return min(size, size - least_partner(size, percent) + k_of(size))


def required(a: int, b: int, percent: int) -> int:
    """The least overlap with which 100 * overlap >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def features(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, 128 bits of the set's hash, its smallest hashes, and a number of the row."""

    def run(batches):
        words = WordHash()
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for start in range(0, batch.num_rows, 200):
                sets = [shingles(text, n, words) for text in texts.slice(start, 200).to_pylist()]
                high, low = digests(sets)
                parts = [found[: sketch_length(len(found), percent)] for found in sets]
                ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
                sketch = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts)))
                yield pa.RecordBatch.from_arrays([ids.slice(start, 200), pa.array([len(f) for f in sets], pa.int32()), high, low, sketch], names=["doc_id", "n_shingles", "high", "low", "sketch"])

    found = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles int, high long, low long, sketch array<long>")
    return found.withColumn("row", F.monotonically_increasing_id())


def digests(sets: list[np.ndarray]) -> tuple[pa.Array, pa.Array]:
    """Two halves of a 128-bit hash of each set."""
    import xxhash

    both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(found.tobytes()) for found in sets), np.int64).reshape(-1, 2)
    return pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())


class Trie:
    """Increasing sequences of hashes, with the paths that they share stored once. A node: hashes, children, own ids, least and greatest size below."""

    def __init__(self, sequences: list[np.ndarray], ids: list[int]):
        order = sorted(range(len(ids)), key=lambda i: sequences[i].astype(">i8").tobytes())
        seqs = [sequences[i] for i in order]
        names = [ids[i] for i in order]
        sizes = np.array([len(s) for s in seqs])
        self.root = [None, [], [], 0, 0]
        todo = [(self.root, 0, len(seqs), 0)]
        while todo:
            node, lo, hi, depth = todo.pop()
            node[3], node[4] = int(sizes[lo:hi].min()), int(sizes[lo:hi].max())
            # In sorted order the first and the last share what all of them share.
            differ = np.flatnonzero(seqs[lo][depth : node[3]] != seqs[hi - 1][depth : node[3]])
            stop = depth + int(differ[0]) if len(differ) else node[3]
            node[0] = seqs[lo][depth:stop]
            while lo < hi and sizes[lo] == stop:
                node[2].append(names[lo])
                lo += 1
            while lo < hi:
                token, end = seqs[lo][stop], lo + 1
                while end < hi and seqs[end][stop] == token:
                    end += 1
                child = [None, [], [], 0, 0]
                node[1].append(child)
                todo.append((child, lo, end, stop))
                lo = end

    def search(self, query: np.ndarray, percent: int, skip) -> list[int]:
        """Ids of stored sequences that link with query; skip(ids) tells that a node's ids need no answer."""
        size, found = len(query), []
        least, most = least_partner(size, percent), size * 100 // percent
        todo = [(self.root, 0, 0)]
        while todo:
            (tokens, children, own, low, high), overlap, depth = todo.pop()
            if high < least or low > most or (own and not children and skip(own)):
                continue
            place = np.searchsorted(query, tokens)
            overlap += int(np.count_nonzero(query[np.minimum(place, size - 1)] == tokens))
            depth += len(tokens)
            if own and 100 * overlap >= percent * (size + depth - overlap):
                found += own
            if children:
                # What follows is greater than the path's last hash on both sides.
                left = size - int(np.searchsorted(query, tokens[-1], "right")) if len(tokens) else size
                if overlap + min(left, high - depth) >= required(size, max(low, least), percent):
                    todo += [(c, overlap, depth) for c in children]
        return found


def block_links(index: list[np.ndarray], index_ids: list[int], probes: list[np.ndarray], probe_ids: list[int], percent: int, component: dict[int, int]) -> list[tuple[int, int]]:
    """Links between probes and index that join two components; component is updated as they are found."""
    trie = Trie(index, index_ids)

    def find(x):
        while component[x] != x:
            component[x] = component[component[x]]
            x = component[x]
        return x

    links = []
    for name, query in zip(probe_ids, probes, strict=True):
        for other in trie.search(query, percent, lambda own, name=name: all(find(o) == find(name) for o in own)):
            a, b = find(name), find(other)
            if a != b:
                component[max(a, b)] = min(a, b)
                links.append((min(name, other), max(name, other)))
    return links


def _search_group(percent: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        component: dict[int, int] = {}
        for cid, comp in zip(group["cid"].tolist(), group["comp"].tolist(), strict=True):
            component.setdefault(comp, comp)
            component[cid] = comp
        sets = [np.frombuffer(s, np.int64) for s in group["tokens"]]
        ids = group["cid"].tolist()
        pick = lambda mask: ([sets[i] for i in np.flatnonzero(mask)], [ids[i] for i in np.flatnonzero(mask)])
        index, probe = pick(group["indexed"].to_numpy(bool)), pick(group["probing"].to_numpy(bool))
        links = block_links(*index, *probe, percent, component) if index[1] and probe[1] else []
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return run


def few(df: DataFrame) -> DataFrame:
    """df, to be sent to every task while it has BROADCAST_ROWS rows at most; beyond that Spark joins it by a shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def blocks(classes: DataFrame, percent: int) -> DataFrame:
    """(leader, cid, size): classes that share a prefix token, in the block of the token's smallest class; every linkable pair meets in one."""
    tokens = classes.select("cid", "size", F.explode("sketch").alias("token"))
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    need = F.greatest(F.lit(1), F.expr(f"cast(ceil(size * {percent} / 100.0) as int) * {SPARE} div 100"))
    mine = tokens.join(shared, "token").groupBy("cid", "size").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("shared"))
    mine = mine.withColumn("spare", F.size("shared") - need + 1).where("spare > 0")
    prefix = materialize(mine.select("cid", "size", F.explode(F.slice("shared", F.lit(1), F.col("spare").cast("int"))["token"]).alias("token")))
    leaders = prefix.groupBy("token").agg(F.min("cid").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    met = materialize(prefix.join(leaders, "token").select("leader", "cid", "size").distinct())
    discard(prefix)
    return met


def full_sets(docs: DataFrame, wanted: DataFrame, repeated: DataFrame, n: int) -> DataFrame:
    """(cid, tokens): the whole sets of the classes in wanted (cid, rep, high, low), made again from the texts of the ids rep.

    Rows of one doc_id are told apart by the hash of their sets. repeated (doc_id) are the ids of more than one row: only there a set may come twice.
    """

    def run(batches):
        words = WordHash()
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                sets = [shingles(t, n, words) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *digests(sets), pa.array([s.tobytes() for s in sets], pa.binary())], names=["rep", "high", "low", "tokens"])

    texts = docs.select("doc_id", "text").join(few(wanted.select(F.col("rep").alias("doc_id")).distinct()), "doc_id", "left_semi")
    made = texts.mapInArrow(run, "rep long, high long, low long, tokens binary").join(few(wanted), ["rep", "high", "low"])
    if repeated.isEmpty():
        return made.select("cid", "tokens")
    twice = repeated.select(F.col("doc_id").alias("rep"))
    once = made.join(few(twice), "rep", "left_anti")
    return once.select("cid", "tokens").unionByName(made.join(few(twice), "rep", "left_semi").select("cid", "tokens").dropDuplicates(["cid"]))


def searched(plan: DataFrame, sets: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """Links (a, b) found in the groups of plan (keys, cid, comp, indexed, probing). Only here the sets are shuffled, once to each group that needs them."""
    plan = materialize(plan)
    links = materialize(sets.join(few(plan), "cid").groupBy(*keys).applyInPandas(_search_group(percent), "a long, b long"))
    discard(plan)
    return links


def first_plan(met: DataFrame) -> DataFrame:
    """Each block's leader against its members. Many members are dealt to several groups, and the leader goes to each of them."""
    many = met.groupBy("leader").agg(F.ceil(F.sum("size") / F.lit(PIECE)).cast("int").alias("pieces")).where("pieces > 1")
    leads = F.col("leader") == F.col("cid")
    met = met.join(few(many), "leader", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    piece = F.when(leads, F.sequence(F.lit(0), F.col("pieces") - 1)).otherwise(F.array(F.pmod(F.xxhash64("cid"), F.col("pieces")).cast("int")))
    return met.select("leader", F.explode(piece).alias("piece"), "cid", F.col("cid").alias("comp"), leads.alias("indexed"), (~leads).alias("probing"))


def with_components(met: DataFrame, found: DataFrame) -> DataFrame:
    """(leader, cid, size, comp, apart): members of blocks with their components so far, and whether that is another than the leader's."""
    label = lambda c: found.select(F.col("v").alias(c), F.col("component").alias(f"{c}_comp"))
    comp = F.coalesce("cid_comp", "cid")
    joined = met.join(few(label("cid")), "cid", "left").join(few(label("leader")), "leader", "left")
    return joined.select("leader", "cid", "size", comp.alias("comp"), (comp != F.coalesce("leader_comp", "leader")).alias("apart"))


def second_plan(named: DataFrame) -> DataFrame:
    """Pairs still open have a side apart from the leader's component: pieces of such sets, against all pieces of the block."""
    total = lambda mask: F.ceil(F.sum(F.when(mask, F.col("size")).otherwise(0)) / F.lit(PIECE)).cast("int")
    count = named.groupBy("leader").agg(total(F.col("apart")).alias("far"), total(~F.col("apart")).alias("near")).where("far > 0")
    own = F.pmod(F.xxhash64("cid"), F.when(F.col("apart"), F.col("far")).otherwise(F.col("near"))).cast("int")
    pieces = named.join(few(count), "leader").withColumn("own", own)
    near = pieces.where("not apart").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("far") - 1)))
    near = near.select("leader", "cid", "comp", "i", (-1 - F.col("own")).alias("j"), F.lit(True).alias("indexed"), F.lit(False).alias("probing"))
    probing = pieces.where("apart and near > 0").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("near") - 1)))
    probing = probing.select("leader", "cid", "comp", F.col("own").alias("i"), (-1 - F.col("j")).alias("j"), F.lit(False).alias("indexed"), F.lit(True).alias("probing"))
    far = pieces.where("apart").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("far") - 1)))
    far = far.select("leader", "cid", "comp", F.least("own", "k").alias("i"), F.greatest("own", "k").alias("j"), (F.col("own") <= F.col("k")).alias("indexed"), (F.col("own") >= F.col("k")).alias("probing"))
    return near.unionByName(probing).unionByName(far)


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per input row.

    Documents link when 100 * |A and B| >= percent * |A or B| over their sets of distinct n-word shingles (words lower-cased
    in A-Z; a shorter text is one shingle). component_id is the smallest doc_id reachable by links, the document's own
    included. Null, empty and blank texts have no shingles and link with nothing. Rows that share a doc_id are judged row by
    row. A row with a null doc_id links with nothing and has a null component_id. Extra columns are ignored.
    """
    marked = materialize(features(docs, n, percent))
    rows = materialize(marked.drop("sketch"))
    sized = "n_shingles > 0 and doc_id is not null"
    first = F.min(F.struct("doc_id", "row"))
    classes = rows.where(sized).groupBy("high", "low").agg(first.alias("first"), F.count(F.lit(1)).alias("copies"))
    classes = materialize(classes.select("high", "low", F.col("first.doc_id").alias("rep"), F.col("first.row").alias("cid"), "copies"))
    sketched = marked.join(few(classes.select(F.col("cid").alias("row"))), "row", "left_semi")
    met = blocks(sketched.select(F.col("row").alias("cid"), F.col("n_shingles").alias("size"), "sketch"), percent)
    discard(marked)
    wanted = classes.join(few(met.select("cid").distinct()), "cid", "left_semi").drop("copies")
    repeated = materialize(rows.where(sized).groupBy("doc_id").count().where("count > 1").select("doc_id"))
    sets = materialize(full_sets(docs, wanted, repeated, n))

    links = searched(first_plan(met), sets, ["leader", "piece"], percent)
    found = components(links)
    named = materialize(with_components(met, found))
    more = searched(second_plan(named), sets, ["leader", "i", "j"], percent)
    discard(met, named, sets, repeated)
    found = components(links.unionByName(more))
    linked = classes.join(found.select(F.col("v").alias("cid"), "component"), "cid", "left").select("high", "low", "rep", F.coalesce("component", "cid").alias("component"), "copies")
    least = linked.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = materialize(linked.join(least, "component").select("high", "low", "component_id", "copies"))
    discard(links, more, classes)
    return with_classes(rows, named)


def with_classes(rows: DataFrame, named: DataFrame) -> DataFrame:
    """rows with the component of their class. Classes of so many copies that fewer than 5,000 can be as large are dealt over several tasks."""
    most = max(500, rows.count() // 5000)
    hot = F.broadcast(named.where(F.col("copies") > most).select("high", "low", F.ceil(F.col("copies") / F.lit(most)).cast("int").alias("salts")))
    salts = F.coalesce("salts", F.lit(1))
    left = rows.join(hot, ["high", "low"], "left").withColumn("salt", F.pmod(F.xxhash64("row"), salts).cast("int"))
    right = named.join(hot, ["high", "low"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    out = left.join(right.select("high", "low", "salt", "component_id"), ["high", "low", "salt"], "left")
    return out.select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each group, that of the smallest doc_id; rows with a null doc_id stay. All columns are kept.

    Rows that share a doc_id stay or go together, unless their texts are equal too: then one stays.
    """
    gone = materialize(near_duplicates(docs, n, percent).where("doc_id <> component_id").select("doc_id").distinct())
    kept = docs.join(few(gone), "doc_id", "left_anti").select(docs.columns)
    # Only ids that occur twice are looked at again, so texts of the others are not shuffled.
    twice = materialize(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if twice.isEmpty():
        return kept
    return kept.join(few(twice), "doc_id", "left_anti").select(docs.columns).unionByName(kept.join(few(twice), "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id", "text"]))


def op7_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=4, percent=85)


SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sets as (
  select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as s from words),
grams as (select doc_id, unnest(s) as gram from sets),
shared as (select a.doc_id as x, b.doc_id as y, count(*) as n from grams a join grams b on a.gram = b.gram and a.doc_id < b.doc_id group by all),
near as (select x, y from shared join sets p on p.doc_id = x join sets q on q.doc_id = y where 100 * n >= 85 * (len(p.s) + len(q.s) - n)),
links as (select x, y from near union all select y, x from near),
reach(doc_id, other) as (select doc_id, doc_id from sets union select r.doc_id, l.y from reach r join links l on l.x = r.other)
select doc_id, len(s)::bigint as n_shingles, min(other) as component_id from sets join reach using (doc_id) group by doc_id, s
"""
