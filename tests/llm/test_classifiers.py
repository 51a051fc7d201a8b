import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stocklens.llm import rule_ensemble, toxicity
from stocklens.llm.labelled import held_out

SCHEMA = "doc_id long, text string, score string, y int"
CLEAN = [f"word{i}" for i in range(60)]


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice(CLEAN) for _ in range(rng.randint(15, 80))]
        toxic, good = int(i % 4 == 0), int(i % 2)
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["scumface", "vilescum", "scumlord"])
        if not good:
            words = [w.upper() + "!!!" for w in words]
        rows.append((i, " ".join(words), "x", 1))
        labels.append((i, good, toxic))
    rows += [(None, "word1 word2", "x", 1), (1000, None, "x", 1), (1001, "", "x", 1), (1002, "word3 " * 30_000, "x", 1), (1003, "word1 " * 30 + "scumfaces", "x", 1), (1003, "word1", "x", 1)]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels + [(None, 1, 1), (5000, None, None)], "doc_id long, quality int, toxic int")


def accuracy(scored, labels, label):
    joined = scored.join(labels.where(held_out(F.col("doc_id"))), "doc_id")
    return joined.agg(F.avg((F.col("predicted") == F.col(label)).cast("double"))).first()[0]


def test_toxicity(tables):
    docs, labels = tables
    model = toxicity.trained(docs, labels)
    got = toxicity.score(docs, model)
    assert got.count() == docs.count() and got.where("score is null or score < 0 or score > 1").isEmpty()
    assert accuracy(got, labels, "toxic") > 0.9
    assert got.where("doc_id = 1003 and predicted = 1").count() == 1  # an unseen spelling in a long clean text
    kept = toxicity.reject_toxic(docs, model)
    assert kept.columns == docs.columns and kept.where("doc_id in (1000, 1001, 1002)").count() == 3


def test_rule_ensemble(tables):
    docs, labels = tables
    model = rule_ensemble.trained(docs, labels)
    got = rule_ensemble.scored(docs.drop("score"), model)
    assert got.count() == docs.count() and got.where("score is null or score < 0 or score > 1").isEmpty()
    assert accuracy(got.withColumn("predicted", (F.col("score") >= 0.5).cast("int")), labels, "quality") > 0.9
    assert rule_ensemble.reject_poor(docs, model).columns == docs.columns
    assert 0 < len(model.rules) < 200


@pytest.mark.parametrize("labels", [[], [(1, 1, 1)], [(1, 0, 0)]])
def test_one_class_or_none(spark, tables, labels):
    docs = tables[0].where("doc_id < 5")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert toxicity.score(docs, toxicity.trained(docs, table)).count() == 5
    assert rule_ensemble.scored(docs, rule_ensemble.trained(docs, table)).count() == 5
    assert toxicity.score(docs.limit(0), toxicity.trained(docs, table)).count() == 0


def test_rule_ensemble_keeps_the_class_ratio(spark):
    """Of the doubtful texts most are good in the table, but few in an even sample; the sample's size must not decide."""
    rng, rows, labels = random.Random(3), [], []
    for i in range(3000):
        doubtful = i % 5 < 2
        rows.append((i, " ".join(w.upper() if doubtful else w for w in CLEAN[:30])))
        labels.append((i, int(not doubtful or rng.random() < 0.7)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    decided = [rule_ensemble.scored(docs, rule_ensemble.trained(docs, table, n)).selectExpr("doc_id % 5 < 2 as doubtful", "score >= 0.5 as good").distinct().collect() for n in (100, 4000)]
    assert all(sorted(map(tuple, d)) == [(False, True), (True, True)] for d in decided)


def forward(model, text):
    """The score written out: n-grams hashed one by one, their vectors averaged to words, words to runs of three, a softmax over the classes."""
    words = []
    for word in (text or "").lower().encode().split():
        marked, grams = b"<" + word + b">", []
        for n in (3, 4, 5):
            for i in range(len(marked) - n + 1):
                h = 0x811C9DC5
                for byte in marked[i : i + n]:
                    h = (h ^ byte) * 0x01000193 % 2**32
                grams.append(model.vectors[(h ^ h >> 15) % len(model.vectors)].astype(float))
        words.append(np.mean(grams, axis=0))
    runs = [np.mean(words[i : i + 3], axis=0) for i in range(max(1, len(words) - 2))] if words else [np.zeros(model.vectors.shape[1])]
    logits = []
    for run in runs:
        z = run @ model.weights.astype(float) + model.bias.astype(float)
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        logits.append(math.log(p[1] / p[0]))
    return 1 / (1 + math.exp(-(model.slope * max(logits) + model.shift)))


def test_toxicity_against_a_plain_forward_pass(spark, tables):
    docs, labels = tables
    model = toxicity.trained(docs, labels)
    odd = ["", None, "a", "é ü", "word1", "word1 vilescum", "x " * 7, "\t\n", "Word1 WORD2 Scumface\x0bword3 \u00a0joined", "日本語 テキスト 漢字 かな"]
    rows = [(r.doc_id, r.text) for r in docs.where("doc_id < 40 or doc_id = 1003").collect()] + list(enumerate(odd, 5000))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.score) for r in toxicity.score(table, model).collect())
    want = sorted((i, forward(model, t)) for i, t in rows)
    assert [i for i, _ in got] == [i for i, _ in want]
    assert np.allclose([s for _, s in got], [s for _, s in want], atol=1e-5)
    kept = {r.doc_id for r in toxicity.reject_toxic(table.where("doc_id <> 1003"), model).collect()}
    assert kept == {i for i, s in want if s < 0.7 and i != 1003}
