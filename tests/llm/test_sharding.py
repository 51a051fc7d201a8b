import hashlib
import random
import zlib

import pytest

from stocklens.llm import sharding
from stocklens.llm.sharding import shard_by_bytes

SCHEMA = "doc_id long, text string, shard int"


def check(got, rows, n_shards, slack):
    assert len(got) == len(rows)
    want = sorted((str(i), len((t or "").encode()) + 8, None if t is None else zlib.crc32(t.encode())) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got) == sorted(want, key=lambda r: r) or sorted(map(str, want)) == sorted(str((str(r.doc_id), r["size"], r.text_crc32)) for r in got)
    total = sum(r["size"] for r in got)
    for s in range(n_shards):
        mine = [r for r in got if r.shard == s]
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
        assert abs(sum(r["size"] for r in mine) - total / n_shards) <= slack
    assert {r.law for r in got} <= {"bytes"} and {r.grown_shard for r in got} <= {None}


def test_sizes_near_equal_with_hot_group(spark):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice("abcé ") for _ in range(rng.randint(0, 200))), 1) for i in range(2000)]
    rows += [(i, "hot text " * 10, 1) for i in range(2000, 3500)] + [(i, "", 1) for i in range(3500, 4200)] + [(None, None, 1), (7, None, 1), (7, None, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = shard_by_bytes(df, 12).collect()
    total = sum(r["size"] for r in got)
    check(got, rows, 12, 500 + 2 * total / 12 / 64)
    again = {(r.doc_id, r.text_crc32, r["size"]): r.shard for r in shard_by_bytes(df.repartition(7), 12).collect()}
    assert all(again[(r.doc_id, r.text_crc32, r["size"])] == r.shard for r in got if r.doc_id != 7)


def test_small_groups_stay_together(spark):
    rows = [(i, f"text {i // 3}", 0) for i in range(3000)]
    got = shard_by_bytes(spark.createDataFrame(rows, SCHEMA), 5).collect()
    shards = {}
    for r in got:
        shards.setdefault(r.text_crc32, set()).add(r.shard)
    assert all(len(s) == 1 for s in shards.values())


def test_empty_and_tiny(spark):
    df = spark.createDataFrame([(1, "x", 0)], SCHEMA)
    assert shard_by_bytes(df.limit(0)).count() == 0
    assert [(r.shard, r.slot) for r in shard_by_bytes(df).collect()] == [(0, 0)]


def brute(rows, n_shards, whole_share=1 / 64):
    """The law written out: records in the order of (text digest, size, crc, doc_id) share the bytes; small groups of one text are not cut."""
    made = []
    for i, t, _ in rows:
        raw = None if t is None else t.encode()
        made.append((-1 if raw is None else int(hashlib.md5(raw).hexdigest()[:15], 16), len(raw or b"") + 8, None if raw is None else zlib.crc32(raw), i))
    made.sort(key=lambda r: (r[0], r[1], r[2] or 0, r[3] is not None, r[3] or 0))
    total, at, out = sum(r[1] for r in made), 0, []
    groups = {}
    for r in made:
        groups.setdefault(r[:3], []).append(r)
    for members in groups.values():
        size, first = sum(r[1] for r in members), at
        for r in members:
            place = first if size <= int(total / n_shards * whole_share) else at
            out.append((r[3], r[2], min(n_shards - 1, place * n_shards // total)))
            at += r[1]
    return out


@pytest.mark.parametrize("rows_per_range", [1_000_000, 40])
def test_placement_against_brute_force(spark, rows_per_range):
    """Copies that share a doc_id, or have none, are dealt over ranges like others."""
    rng = random.Random(6)
    rows = [(i, "".join(rng.choice("abé ") for _ in range(rng.randint(0, 40))), 1) for i in range(500)] + [(None, "x y", 1)] * 700 + [(9, "z", 1)] * 300 + [(9, None, 1)] * 200
    got = shard_by_bytes(spark.createDataFrame(rows, SCHEMA), 7, ranges_per_shard=4, rows_per_range=rows_per_range).collect()
    key = lambda r: str(r)
    assert sorted(((r.doc_id, r.text_crc32, r.shard) for r in got), key=key) == sorted(brute(rows, 7), key=key)
    for s in range(7):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_sample_does_not_grow_with_the_rows(spark, monkeypatch):
    """Many ranges share one bounded sample, and their number is bounded too; the law holds all the same."""
    monkeypatch.setattr(sharding, "RANGES", 60)
    monkeypatch.setattr(sharding, "SAMPLED", 240)
    asked = []
    plain = sharding.splitters
    monkeypatch.setattr(sharding, "splitters", lambda rows, n, per, *more: asked.append((n, per)) or plain(rows, n, per, *more))
    rows = [(i, f"text {i * 7919 % 1000}", 1) for i in range(3000)]
    got = shard_by_bytes(spark.createDataFrame(rows, SCHEMA), 4, ranges_per_shard=2, rows_per_range=10).collect()
    assert asked == [(60, 4)]
    assert sorted((r.doc_id, r.text_crc32, r.shard) for r in got) == sorted(brute(rows, 4))
