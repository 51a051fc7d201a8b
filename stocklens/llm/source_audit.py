"""Source divergence audit: how far the term shares of a language's sources lie from each other and from the language's own.

Terms become integers: the kept terms of a language are sorted once over all partitions, cut into chunks of consecutive terms, and
inside a chunk a term's id is its place in the sorted array. Ids thus follow the UTF-8 order of the terms. A task holds one chunk as a
dense matrix, a row for each source, and gives sums and leading terms of its chunk only; sums of chunks are added by Spark.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize

LEAST_DOCS = 10  # of a language, to keep a term
SCALE = 1_000_000_000
TOP = 10
CELLS = 1 << 19  # of a chunk's matrix: sources times terms
HELD = 200_000  # different terms that a task counts before it hands them on

#: Bytes of terms: A-Z lower-cased, a-z and all of other characters as they are; everything else parts terms.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def _counted(batches):
    """(lang, source, term, n, docs) of the rows of a partition, added up as far as HELD allows."""
    counts, held, size = {}, {}, 0

    def drain():
        for (lang, source), n in counts.items():
            docs, terms = held[lang, source], list(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in terms], pa.int64())],
                names=["lang", "source", "term", "n", "docs"],
            )

    for batch in batches:
        columns = (batch.column(c) for c in ("lang", "source", "text"))
        for lang, source, text in zip(*(c.to_pylist() for c in columns), strict=True):
            at = (lang, source)
            if at not in counts:
                counts[at], held[at] = Counter(), Counter()
            terms = text.translate(TERM_BYTES).split()
            before = len(counts[at])
            counts[at].update(terms)
            held[at].update(set(terms))
            size += len(counts[at]) - before
            if size > HELD:
                yield from drain()
                counts, held, size = {}, {}, 0
    yield from drain()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in a source, and the documents that hold it. Null text, lang and source count as ''."""
    rows = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    parts = rows.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(count: np.ndarray, total: np.ndarray | int, n_terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / (total + 2 * n_terms)), by long division in steps of 1000, as the product may not fit 64 bits."""
    under = np.asarray(total, np.int64) + 2 * n_terms
    value, rest = np.divmod(count + 2, under)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, under)
        value = value * 1000 + digit
    return value + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)); shares are at most SCALE + 1, so that squares fit 64 bits."""
    return (p - q) ** 2 // (p + q)


PARTS = "lang string, source string, part string, item string, value long"


def _chunk(rows: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
    """Divergences of one chunk: sums for each pair of sources (once, the smaller name first), and each source's TOP terms.

    rows: source, term, n. groups: a row for each source of the language, those without a term too, with its total, the language's and its terms.
    """
    groups = groups.sort_values("source")
    sources, n_terms = groups["source"].to_numpy(object), int(groups["n_terms"].iloc[0])
    kept = np.sort(rows["term"].unique().astype(object))
    ids = np.searchsorted(kept, rows["term"].to_numpy(object))
    lines = np.searchsorted(sources, rows["source"].to_numpy(object))
    # Rows are one for each source and term, so each cell gets one count: exact in doubles up to 2^53.
    dense = np.bincount(lines * len(kept) + ids, rows["n"].to_numpy(np.int64), len(sources) * len(kept)).astype(np.int64).reshape(len(sources), len(kept))
    p = shares(dense, groups["total"].to_numpy(np.int64)[:, None], n_terms)
    q = shares(dense.sum(axis=0), int(groups["lang_total"].iloc[0]), n_terms)
    out = []
    for i, source in enumerate(sources):
        sums = apart(p[i], p[i + 1 :]).sum(axis=1)
        out += [(source, "pair", other, int(v)) for other, v in zip(sources[i + 1 :], sums)]
        over = np.flatnonzero((dense[i] > 0) & (p[i] > q))
        values = apart(p[i][over], q[over])
        best = np.lexsort((over, -values))[:TOP]
        out += [(source, "term", kept[over[k]], int(values[k])) for k in best]
    return pd.DataFrame(out, columns=["source", "part", "item", "value"]).assign(lang=groups["lang"].iloc[0])[["lang", "source", "part", "item", "value"]]


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, cells: int = CELLS) -> DataFrame:
    """lang, source, part, item, value, rank: 'pair' rows tell the divergence of a source from each other source of its language, 'term' rows its TOP over-used terms.

    Null text, lang and source are read as ''; sources without terms are groups too; repeated rows are ordinary rows; doc_id and
    other columns are not read; an empty table gives no rows. A language without kept terms has pair rows of value 0. Everything is
    exact: totals below 2^53, integer arithmetic. Texts and terms of any length count whole.

    Texts are read once and leave their task as counts. A chunk has at most cells cells, so one task's memory doesn't grow with the
    table; pairs of sources are the result's own size.
    """
    counted = materialize(term_counts(docs))
    groups = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    per_lang = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all")).where(F.col("docs") >= least_docs)
    # Sorted over all partitions and written: the numbers rise with (lang, term), and a partition's run of one language is cut by place.
    table = materialize(per_lang.select("lang", "term", "all").sort("lang", "term").withColumn("_at", F.monotonically_increasing_id()))
    most = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    wide = max(64, cells // most)
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    ordered = table.select("lang", "term", "all", F.struct(part.alias("part"), F.floor(place / wide).alias("run")).alias("chunk"))
    kept = materialize(counted.join(ordered.drop("all"), ["lang", "term"]).select("lang", "source", "term", "n", "chunk"))
    of_lang = ordered.groupBy("lang").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("all").alias("lang_total"))
    of_source = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = materialize(groups.join(of_source, ["lang", "source"], "left").join(of_lang, "lang", "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("n_terms", F.lit(0)).alias("n_terms"), "lang_total"))
    frames = ordered.select("lang", "chunk").distinct().join(groups, "lang")
    parts = kept.groupBy("lang", "chunk").cogroup(frames.groupBy("lang", "chunk")).applyInPandas(_chunk, PARTS)
    parts = materialize(parts)
    sums = parts.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = sums.unionByName(sums.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    every = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    pairs = every.join(both, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = pairs.unionByName(parts.where("part = 'term'")).withColumn("rank", F.row_number().over(order))
    discard(counted, table, kept)
    return ranked.where(f"part = 'pair' or rank <= {TOP}")


def op12_source_audit(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = rf"""
with texts as (select row_number() over () as row_no, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as t from documents),
terms as (
  select row_no, lang, source, translate(unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from texts),
kept as (select lang, term, count(*) as a from terms group by all having count(distinct row_no) >= {LEAST_DOCS}),
langs as (select lang, count(*) as v, sum(a) as total from kept group by lang),
groups as (select distinct lang, source from texts),
counts as (select lang, source, term, count(*) as n from terms group by all),
totals as (select lang, source, sum(n) as total from counts join kept using (lang, term) group by all),
p as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + ({SCALE}::hugeint * (coalesce(c.n, 0) + 2)) // (coalesce(t.total, 0) + 2 * l.v) as p, 1 + ({SCALE}::hugeint * (k.a + 2)) // (l.total + 2 * l.v) as q
  from groups g join kept k using (lang) join langs l using (lang) left join totals t using (lang, source) left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term),
sums as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
parts as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0)::bigint as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source
  union all select lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::bigint from p where n > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from parts)
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= {TOP}
"""
