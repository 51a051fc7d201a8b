"""The queries over small Parquet tables: against their SQL, and the pipeline against a brute-force version."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from stocklens.llm import registry, rule_ensemble, toxicity
from stocklens.llm.common import words_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with copies, near copies, shared passages, junk and toxic words; every text and id kind that may be met."""
    rng, top = random.Random(12), str(tmp_path_factory.mktemp("tables"))
    vocabulary = ["the", "of", "und", "der"] + ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(400)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(70))
    rows, labels = [], []
    for i in range(240):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(25, 160))]
        toxic, poor = i % 5 == 0, i % 7 == 3
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["scumface", "vilescum", "scumlord"])
        if poor:
            words = [w.upper() + "!!!" for w in words]
        if i % 11 == 0:
            words[10:10] = passage.split()
        rows.append((i, " ".join(words) + ("\nsame line\nsame line" if i % 13 == 0 else ""), rng.choice(["en", "de"]), "s", 1))
        labels.append((i, int(not poor), int(toxic)))
    for i in range(30):
        source = rng.choice(rows)[1]
        rows.append((1000 + i, source if i % 2 else source + " tail", "en", "s", 1))
    rows += [(2000, "", "en", "s", 0), (2001, None, "de", "s", None), (2002, " \n ", None, "s", 3), (2003, "one " * 300, "en", "s", 1), (2004, "Ünïcode #tag | $5 日本 " * 12, "xx", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    g = np.random.default_rng(2)
    base = g.standard_normal((40, 16))
    vectors = [(i, [float(x) for x in (base[i % 40] + 0.1 * (i % 3) * g.standard_normal(16)).astype(np.float32)]) for i in range(120)]
    spark.createDataFrame(vectors + [(500, None), (501, [0.0] * 16), (502, vectors[0][1])], "vec_id long, embedding array<float>").write.parquet(f"{top}/embeddings.parquet")
    urls = ["https://www.example.com/en/x", "http://example.com/en/", "https://a.net/es/1", "https://NET/fr/?q", "nothing", None, "x://example.com", "https://example.com.org/en/"]
    spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").write.parquet(f"{top}/pages.parquet")
    return top


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, folder, name):
    base = duckdb.connect()
    for table in ("documents", "embeddings", "pages"):
        base.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    found = base.execute(registry.ORACLES[name])
    columns = [d[0] for d in found.description]
    want = Counter(found.fetchall())
    got = registry.QUERIES[name](spark, folder)
    assert sorted(got.columns) == sorted(columns)
    assert Counter(map(tuple, got.select(columns).collect())) == want


def sets_of(text, n):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    k = min(n, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def one_of_each(rows):
    """The smallest id of each group of texts that links of Jaccard 0.8 over five-word shingles join."""
    sets = {d: sets_of(t, 5) for d, t in rows}
    group = {d: d for d in sets}

    def find(d):
        while group[d] != d:
            d = group[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                group[max(x, y)] = min(x, y)
    return [(d, t) for d, t in rows if find(d) == d]


def cut(rows):
    """Words left of each text when windows of 50 that start in a document of a smaller id are taken out."""
    words = {d: WORD.findall(t or "") for d, t in rows}
    first = {}
    for d, w in words.items():
        for i in range(len(w) - 49):
            key = tuple(w[i : i + 50])
            first[key] = min(first.get(key, d), d)
    left = {}
    for d, w in words.items():
        gone = {p for i in range(len(w) - 49) if first[tuple(w[i : i + 50])] < d for p in range(i, i + 50)}
        left[d] = [x for i, x in enumerate(w) if i not in gone]
    return left


def test_pipeline_against_brute_force(spark, folder):
    """run() keeps what a plain version keeps, given the two trained models, and packs all of it with no more padding than its bounds need."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.trained(docs, labels)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    scores = toxicity.WordScores(model).of([words_of((t or "").lower().encode()) for _, t in rows])
    clean = [r for r, s in zip(rows, scores) if model.probability(model.highest(s)) < 0.7]
    assert 0 < len(clean) < len(rows)
    ids = {d for d, _ in clean}
    ensemble = rule_ensemble.trained(docs.where(docs.doc_id.isin(sorted(ids))), labels)
    stats = rule_ensemble.with_statistics(docs.select("doc_id", "text")).select("doc_id", *rule_ensemble.STATISTICS).collect()
    x = np.array([r[1:] for r in stats], float)
    total = ensemble.bias + sum(w * rule_ensemble.holds(rule, x) for rule, w in zip(ensemble.rules, ensemble.weights))
    good = {r.doc_id for r, p in zip(stats, 1 / (1 + np.exp(-np.asarray(total) * np.ones(len(x))))) if p >= 0.5}
    by_column = {r.doc_id: r.score for r in rule_ensemble.scored(docs.select("doc_id", "text"), ensemble).collect()}
    assert all((by_column[r.doc_id] >= 0.5) == (r.doc_id in good) for r in stats)
    left = cut(one_of_each([r for r in clean if r[0] in good]))
    got = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id: r.length for r in got} == {d: len(w) for d, w in left.items()} and len(got) == len(left)
    tops = sorted({r.bucket_length for r in got})
    assert all(r.bucket_length == next(t for t in tops if t >= r.length) and r.padding == r.bucket_length - r.length for r in got)


def test_stages_keep_columns_and_odd_rows(spark, folder):
    """All stages but the last return the columns of documents, with extra and clashing ones; null ids and texts pass; empty tables give empty ones."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "1 as score", "2 as _row", "3 as bucket", "4 as parts")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "some plain words here", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 as score", "2 as _row", "3 as bucket", "4 as parts")
    for some in (docs.where("doc_id < 40 or doc_id >= 2000").unionByName(odd), docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, some, folder)
            assert kept.columns == docs.columns, name
            assert kept.count() <= some.count(), name
        packed = corpus_pipeline.pack_documents(spark, some, folder).collect()
        words = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in some.where("doc_id is not null").collect()}
        assert len(packed) == some.count() and {r.doc_id: r.length for r in packed if r.doc_id is not None} == words
        assert sorted(r.length for r in packed if r.doc_id is None) == ([0, 4] if packed else [])


def test_digests_of_removed_passages(spark, folder):
    """What op4 leaves of a text, by the plain version."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    left = cut(rows)
    got = {r.doc_id: (r.n_words - r.n_removed, r.kept_sha256) for r in registry.QUERIES["op4_substring_dedup"](spark, folder).collect()}
    assert got == {d: (len(w), hashlib.sha256(" ".join(w).encode()).hexdigest()) for d, w in left.items()}
