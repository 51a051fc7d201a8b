import numpy as np
import pytest

from stocklens.llm import embedding_dedup
from stocklens.llm.embedding_dedup import near_vectors

SCHEMA = "vec_id long, embedding array<double>, component long"


def brute(rows, cosine):
    ids = [r[0] for r in rows]
    good = [r[0] is not None and r[1] is not None and None not in r[1] and bool(np.isfinite(r[1]).all()) and any(r[1]) for r in rows]
    unit = [np.array(r[1]) / np.linalg.norm(r[1]) if g else None for r, g in zip(rows, good)]
    links = {(i, j) for i in range(len(rows)) for j in range(len(rows)) if i != j and good[i] and good[j] and unit[i] @ unit[j] >= cosine}
    return ids, links


def make(n, dims, seed):
    rng = np.random.default_rng(seed)
    rows = [(i * 7 % 5003, rng.standard_normal(dims).tolist(), 1) for i in range(n)]
    for k in range(n // 2):
        base = np.array(rows[rng.integers(n // 8)][1])
        rows.append((6000 + k, (base + rng.uniform(0, 0.06) ** 0.5 * rng.standard_normal(dims)).tolist(), 1))
    rows += [(9000 + k, rows[0][1], 1) for k in range(40)]
    return rows + [(9900, None, 1), (9901, [0.0] * dims, 1), (9902, [float("nan")] + [1.0] * (dims - 1), 1), (9903, [float("inf")] + [1.0] * (dims - 1), 1), (9904, [None] + [1.0] * (dims - 1), 1), (None, rows[0][1], 1)]


@pytest.mark.parametrize("piece,bucket", [(1024, 256), (5, 16)])
def test_recall_and_no_false_links(spark, monkeypatch, piece, bucket):
    monkeypatch.setattr(embedding_dedup, "PIECE", piece)
    monkeypatch.setattr(embedding_dedup, "BUCKET", bucket)
    rows = make(800, 64, 1)
    ids, links = brute(rows, 0.9)
    got = near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    count = {d: 0 for d in ids}
    for i, _ in links:
        count[ids[i]] += 1
    assert all(r.n_links <= count[r.vec_id] for r in got)
    assert sum(r.n_links for r in got) >= 0.95 * len(links)
    assert all(r.kept == (r.component_id == r.vec_id) for r in got if r.vec_id is not None)
    odd = {r.vec_id: r for r in got if r.vec_id is None or r.vec_id >= 9900}
    assert all(r.n_links == 0 and r.component_id == d for d, r in odd.items())


def test_empty(spark):
    assert near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [tuple(r) for r in near_vectors(spark.createDataFrame([(1, None, 0)], SCHEMA)).collect()] == [(1, 0, 1, True)]
    assert [tuple(r) for r in near_vectors(spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [2.0, 4.0], 0)], SCHEMA)).collect()] == [(1, 1, 1, True), (2, 1, 1, False)]


def test_lengths_magnitudes_and_repeated_ids(spark):
    """Vectors of every length are compared, tiny and huge ones too; rows of one id are judged apart."""
    rng = np.random.default_rng(4)
    a, b, c = (rng.standard_normal(n) for n in (16, 16, 5))
    rows = [(i, rng.standard_normal(16).tolist()) for i in range(10, 40)]
    rows += [(1, a.tolist()), (2, (a * 1e-200).tolist()), (3, (a * 1e200).tolist()), (1, b.tolist()), (4, (b * 1.5).tolist())]
    rows += [(5, c.tolist()), (6, (c * 2).tolist()), (7, [1.0]), (8, [3.0]), (9, [1.0, 0.0, 0.0])]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("vec_id < 10").collect())
    assert got == [(1, 1, 1), (1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 1, 1), (5, 1, 5), (6, 1, 5), (7, 1, 7), (8, 1, 7), (9, 0, 9)]


def test_rotations_of_a_bounded_sample(spark, monkeypatch):
    """Few components on the driver, of which no row is left out of the comparison: links are still found, and copies always."""
    monkeypatch.setattr(embedding_dedup, "COMPONENTS", 64 * 150)
    sizes, plain = [], embedding_dedup.learn_rotations
    monkeypatch.setattr(embedding_dedup, "learn_rotations", lambda sample, *more: sizes.append(sample.shape) or plain(sample, *more))
    rows = make(600, 64, 2)
    ids, links = brute(rows, 0.9)
    got = near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(sizes) == 1 and 80 < sizes[0][0] < 260 and sizes[0][1] == 64
    assert sum(r.n_links for r in got) >= 0.95 * len(links)
    assert all(r.n_links >= 40 for r in got if r.vec_id is not None and 9000 <= r.vec_id < 9040)
