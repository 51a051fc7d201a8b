import hashlib
import random
import re

import numpy as np
import pytest

from stocklens.llm import substring_dedup
from stocklens.llm.substring_dedup import FmIndex, digests, remove_repeats

SCHEMA = "doc_id long, text string, d long, parts string"


def brute(rows, width):
    cut = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, *_ in rows]
    least = {}
    for (d, *_), words in zip(rows, cut):
        for i in range(len(words) - width + 1):
            key = tuple(words[i : i + width])
            least[key] = min(least.get(key, (1, 0)), (0, d) if d is not None else (1, 0))
    out = []
    for (d, *_), words in zip(rows, cut):
        gone = set()
        for i in range(len(words) - width + 1):
            if least[tuple(words[i : i + width])] < ((0, d) if d is not None else (1, 0)):
                gone |= set(range(i, i + width))
        kept = [w for i, w in enumerate(words) if i not in gone]
        out.append((d, len(words), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" for i in range(40)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(8, 40))] for _ in range(5)]
    rows = []
    for i in range(220):
        kind = rng.random()
        if kind < 0.3 and rows:
            words = rng.choice(rows)[1].split()
            for _ in range(rng.choice([0, 1, 2])):
                if words:
                    words[rng.randrange(len(words))] = "edit"
        elif kind < 0.4:
            words = [rng.choice("ab")] * rng.randint(0, 60)
        else:
            words = []
            for _ in range(rng.randint(0, 5)):
                words += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(vocabulary) for _ in range(rng.randint(0, 30))]
        rows.append((rng.randint(-50, 400), rng.choice([" ", "\n", "\t "]).join(words), 1, "x"))
    return rows + [(None, rows[3][1], 1, "x"), (None, " ".join(passages[0]), 1, "x"), (7, None, 1, "x"), (8, "", 1, "x")]


@pytest.mark.parametrize("width,seed,words", [(12, 1, 400_000), (20, 2, 60), (5, 3, 300)])
def test_against_brute_force(spark, monkeypatch, width, seed, words):
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", words)
    rows = corpus(seed)
    got = digests(spark.createDataFrame(rows, SCHEMA), width).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, width)


def test_text_form_keeps_other_text_and_columns(spark):
    a = " ".join(f"a{i}" for i in range(60))
    rows = [(1, f"start\n{a}", 5, "x"), (2, f"own  words\n{a}\ttail", 6, "y"), (3, None, 7, None)]
    got = {r.doc_id: (r.text, r.d, r.parts) for r in remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: (rows[0][1], 5, "x"), 2: ("own  words\ntail", 6, "y"), 3: (None, 7, None)}


def test_long_text_and_empty_table(spark):
    long = " ".join(str(i % 7000) for i in range(40_000))
    got = digests(spark.createDataFrame([(1, long, 0, ""), (2, "x " + long, 0, "")], SCHEMA)).collect()
    assert {r.doc_id: r.n_removed for r in got} == {1: 0, 2: 40_000}
    assert digests(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("seed,letters", [(1, 2), (2, 4), (3, 30)])
def test_matching_statistics_by_brute_force(seed, letters):
    """Each start with a statistic of a window or more lies in a told match; each told match occurs under a smaller owner and ends with it."""
    rng, width = random.Random(seed), 6
    passages = [[rng.randint(1, letters) for _ in range(40)] for _ in range(3)]
    sequences = [np.array(rng.choice(passages)[rng.randint(0, 20) : rng.randint(21, 40)] + [rng.randint(1, letters) for _ in range(rng.randint(1, 60))]) for _ in range(40)]
    owners = np.array([rng.randint(0, 25) for _ in sequences])
    found = FmIndex(sequences, owners).matches(sequences, owners, width)

    def statistic(q, start):
        words = sequences[q].tolist()
        longest = 0
        for s, owner in zip(sequences, owners):
            if owner < owners[q]:
                other = s.tolist()
                for i in range(len(other)):
                    k = 0
                    while i + k < len(other) and start + k < len(words) and other[i + k] == words[start + k]:
                        k += 1
                    longest = max(longest, k)
        return longest

    covered = {(q, i) for q, a, b in found for i in range(a, b)}
    expected = set()
    for q, s in enumerate(sequences):
        for i in range(len(s)):
            if (k := statistic(q, i)) >= width:
                expected |= {(q, j) for j in range(i, i + k)}
    assert covered == expected
    assert all(b - a <= statistic(q, a) for q, a, b in found)


def test_index_reads_its_words_back():
    rng = np.random.default_rng(3)
    sequences = [rng.integers(1, 5, n) for n in (1, 15, 16, 17, 90, 3)] + [np.ones(70, np.int64)] * 2
    index = FmIndex(sequences, np.arange(len(sequences)))
    assert len(index.places) < index.size / 4
    text = np.concatenate([np.append(s, 0) for s in sequences])
    places = np.arange(len(text))[text > 0]
    got = index.following(places, np.full(len(places), 20))
    for line, place in zip(got, places):
        rest = sequences[int(np.searchsorted(index.ends, place))][-int(index.ends[np.searchsorted(index.ends, place)] - place) :][:20]
        assert line.tolist() == rest.tolist() + [0] * (20 - len(rest))
    low, high = np.array([0]), np.array([index.size])
    for word in (1, 1, 1):
        low, high = index.extend(np.array([word]), low, high)
    expected = [i for i in range(len(text)) if text[i : i + 3].tolist() == [1, 1, 1]]
    assert sorted(index.locate(np.arange(low[0], high[0])).tolist()) == expected
