import itertools
import random

import numpy as np

from stocklens.llm.packing import optimal_bounds, pack, word_count


def padding(lengths, bounds):
    return sum(min(b for b in bounds if b >= x) - x for x in lengths)


def test_bounds_are_optimal():
    rng = random.Random(2)
    for _ in range(60):
        lengths = [rng.randint(0, 30) for _ in range(rng.randint(1, 40))]
        x, n = np.unique(lengths, return_counts=True)
        k = rng.randint(1, 5)
        found = optimal_bounds(x, n, k)
        others = [c for size in range(1, k + 1) for c in itertools.combinations(x.tolist(), min(size, len(x))) if c[-1] == max(x)]
        assert len(found) <= k and padding(lengths, found) == min(padding(lengths, c) for c in others)


def test_batches(spark):
    rng = random.Random(4)
    rows = [(i if i % 50 else None, rng.choice([5, 5, 5, rng.randint(0, 300), 9000 + rng.randint(0, 99)]), "c") for i in range(3000)] + [(3, None, "c")] * 3
    got = pack(spark.createDataFrame(rows, "doc_id long, length long, chunk string"), n_buckets=4, token_budget=2000, rows_per_chunk=100).collect()
    assert len(got) == len(rows) and {r.chunk for r in got} == {"c"}
    batches = {}
    for r in got:
        assert r.padding == r.bucket_length - r.length >= 0
        batches.setdefault((r.bucket, r.batch), []).append(r)
    for (bucket, batch), members in batches.items():
        top = members[0].bucket_length
        assert sorted(m.place for m in members) == list(range(len(members)))
        assert len(members) * top <= 2000 or len(members) == 1
        last = max(b for k, b in batches if k == bucket)
        assert batch == last or len(members) == max(1, 2000 // top)
    assert pack(spark.createDataFrame([], "doc_id long, length long")).count() == 0


def test_word_count(spark):
    rows = [(" a\tb\x0bc d\u3000e ",), ("",), (None,), ("x " * 50_000,)]
    got = [r[0] for r in spark.createDataFrame(rows, "text string").select(word_count("text")).collect()]
    assert got == [4, 0, 0, 50_000]


def test_optimal_above_4096(spark):
    """Long lengths are told apart by single words, and pack() gives the least padding of all cuts."""
    rng = random.Random(8)
    lengths = [5001] * 10 + [5004] * 10 + [rng.choice([4097, 6000, 6001, 20_011, 20_012, 70_000]) for _ in range(80)]
    rows = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, length long")
    distinct = sorted(set(lengths))
    for buckets in (1, 2, 3, 5):
        best = min(sum(next(b for b in (*cut, distinct[-1]) if b >= n) - n for n in lengths) for k in range(min(buckets, len(distinct))) for cut in itertools.combinations(distinct[:-1], k))
        got = pack(rows, n_buckets=buckets).collect()
        assert sum(r.padding for r in got) == best
        assert all(r.bucket_length - r.length == r.padding >= 0 for r in got)


def test_many_rows_of_one_id(spark):
    rows = spark.range(3000).selectExpr("cast(null as long) as doc_id", "cast(7 as long) as length", "id as batch")
    got = pack(rows, rows_per_chunk=200, token_budget=70).collect()
    places = sorted((r.batch, r.place) for r in got)
    assert places == [(i // 10, i % 10) for i in range(3000)]
