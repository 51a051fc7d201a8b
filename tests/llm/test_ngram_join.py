import random
import re

import pytest

from stocklens.llm import ngram_join
from stocklens.llm.ngram_join import near_duplicates

SCHEMA = "doc_id long, text string, rep long, size int"


def brute(rows, n, percent):
    sets = []
    for _, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        k = min(n, len(words))
        sets.append({tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set())
    ids = [r[0] for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and ids[i] is not None and ids[j] is not None and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(sets[i]), None if d is None else least[find(i)]) for i, d in enumerate(ids)), key=str)


def corpus(seed, count=260):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(30))
    made = []
    for _ in range(count):
        kind = rng.random()
        if kind < 0.55 and made:
            words = rng.choice(made).split()
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(vocabulary)
            made.append(" ".join(words))
        elif kind < 0.75:
            made.append(passage + " " + " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60))))
        else:
            made.append(" ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 40, 100, 150]))))
    rows = [(i * 3 % 1009 - 7, t.upper() if i % 7 == 0 else t, 1, 2) for i, t in enumerate(made)]
    return rows + [(5000, None, 1, 2), (5001, "", 1, 2), (5002, " \n", 1, 2), (None, passage, 1, 2), (rows[0][0], rows[0][1], 1, 2)]


@pytest.mark.parametrize("n,percent,seed,piece", [(4, 85, 1, 50_000), (5, 80, 2, 700), (3, 60, 3, 300)])
def test_against_brute_force(spark, monkeypatch, n, percent, seed, piece):
    monkeypatch.setattr(ngram_join, "PIECE", piece)
    rows = corpus(seed)
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA), n, percent).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, n, percent)


def test_empty_table_and_long_text(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(df).count() == 0
    long = " ".join(str(i) for i in range(60_000))
    rows = [(1, long, 0, 0), (2, long + " end", 0, 0), (3, "short", 0, 0)]
    assert sorted((r.doc_id, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()) == [(1, 1), (2, 1), (3, 3)]


def test_texts_that_share_a_doc_id(spark):
    """Two texts of one id, each with a near copy of its own: both links are kept, whatever the order of the rows."""
    rng = random.Random(9)
    a, b = (" ".join(rng.choice("abcdefghij") + str(rng.randint(0, 99)) for _ in range(200)) for _ in range(2))
    rows = [(1, a, 0, 0), (1, b, 0, 0), (2, a + " z", 0, 0), (3, b + " z", 0, 0), (4, b, 0, 0)]
    for some in (rows, rows[::-1]):
        got = near_duplicates(spark.createDataFrame(some, SCHEMA), 4, 85).collect()
        assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 1)]


def test_many_copies_are_dealt_over_tasks(spark):
    rows = [(i, "one text that many share", 0, 0) for i in range(2000)] + [(5000 + i, f"text of row {i} alone", 0, 0) for i in range(50)]
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.component_id for r in got if r.doc_id < 5000} == {0} and all(r.component_id == r.doc_id for r in got if r.doc_id >= 5000)
