"""Toxicity: character n-gram vectors averaged into a linear softmax, embeddings and weights trained together in numpy.

A word is the mean of the vectors of its hashed n-grams, a bag of BAG consecutive words the mean of its words, and the softmax
is linear in that. Misspelt or unseen words share n-grams with known ones. A document is scored by its most toxic run of RUN words,
wherever it starts, so a few words in a long text are not thinned out; training works alike: at first all bags carry their document's
label, then toxic documents answer for their highest bag and others for all. A share of the sample that the model has not seen maps the
highest run to a probability.

At scoring time a word is one number, the difference of the two class weights applied to its vector, and numbers of words are kept.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import words_of
from .labelled import held_out, labelled_texts

PER_CLASS = 2500  # documents of each class that the model is fitted on at most
CHARACTERS = 4_000_000  # and about so many characters of them, which bounds what the driver holds
BUCKETS = 1 << 17
SIZES = (3, 4, 5)
DIMS = 4
BAG = 4  # words of a bag in training
RUN = 3  # words of the runs that a document is scored by
CACHE = 100_000
WORDS = 10_000  # words cut into n-grams at a time


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of words between '<' and '>': bucket ids, and for each the index of its word, in no special order."""
    raw = np.frombuffer(b"".join([b"<" + w + b">" for w in words]), np.uint8).astype(np.uint32)
    owner = np.repeat(np.arange(len(words), dtype=np.int32), np.fromiter(map(len, words), np.int64, len(words)) + 2)
    ids, owners = [], []
    h = np.full(len(raw), np.uint32(0x811C9DC5))
    with np.errstate(over="ignore"):
        for n in range(1, SIZES[-1] + 1):
            if len(raw) < n:
                break
            h = (h[: len(raw) - n + 1] ^ raw[n - 1 :]) * np.uint32(0x01000193)
            if n in SIZES:
                inside = np.flatnonzero(owner[: len(h)] == owner[n - 1 :])
                mixed = h[inside] ^ (h[inside] >> np.uint32(15))
                ids.append((mixed & np.uint32(BUCKETS - 1)).astype(np.int32))
                owners.append(owner[inside])
    return np.concatenate(ids), np.concatenate(owners)


def grams_by_word(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket ids of all words, word by word, and their number for each word."""
    flat, counts = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
    for at in range(0, len(words), WORDS):
        part = words[at : at + WORDS]
        ids, owners = subwords(part)
        flat.append(ids[np.argsort(owners, kind="stable")])
        counts.append(np.bincount(owners, minlength=len(part)))
    return np.concatenate(flat), np.concatenate(counts)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... for each start and count, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


@dataclass
class Model:
    vectors: np.ndarray  # BUCKETS x DIMS
    weights: np.ndarray  # DIMS x 2
    bias: np.ndarray  # 2
    slope: float = 1.0
    shift: float = 0.0

    def word_scores(self, words: list[bytes]) -> np.ndarray:
        value = self.vectors @ (self.weights[:, 1] - self.weights[:, 0])
        found = [np.empty(0)]
        for at in range(0, len(words), WORDS):
            part = words[at : at + WORDS]
            ids, owners = subwords(part)
            found.append(np.bincount(owners, value[ids], len(part)) / np.bincount(owners, minlength=len(part)))
        return np.concatenate(found)

    def highest(self, scores: np.ndarray) -> float:
        """The logit of the highest run of RUN words of a text, wherever it starts, from the scores of its words; the bias alone for no words."""
        base = float(self.bias[1] - self.bias[0])
        if len(scores) <= RUN:
            return base + (float(scores.mean()) if len(scores) else 0.0)
        total = np.cumsum(scores)
        return base + float(max(total[RUN - 1], (total[RUN:] - total[:-RUN]).max())) / RUN

    def probability(self, logit) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.asarray(logit, float) + self.shift, -50, 50)))


def platt(logits: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve with the least log loss, lightly held towards slope 1."""
    slope, shift = 1.0, 0.0
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(slope * logits + shift, -50, 50)))
        w = p * (1 - p) + 1e-6
        g = np.array([((p - target) * logits).sum() + 0.1 * (slope - 1), (p - target).sum()])
        h = np.array([[(w * logits**2).sum() + 0.1, (w * logits).sum()], [(w * logits).sum(), w.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, g)
        slope, shift = slope - np.clip(step[0], -2, 2), shift - np.clip(step[1], -5, 5)
    return float(max(slope, 0.05)), float(shift)


def fit(texts: Iterable[str | None], y: np.ndarray, prior: float | None = None, epochs: int = 12, batch: int = 64, rate: float = 0.03, seed: int = 7) -> Model:
    """Train on texts and labels (0 or 1); prior is the share of ones outside the sample. Without both classes the score is constant.

    Small samples are gone through more often, to about 400 steps.
    """
    rng = np.random.default_rng(seed)
    model = Model(np.zeros((BUCKETS, DIMS), np.float32), np.zeros((DIMS, 2), np.float32), np.zeros(2, np.float32))
    if len(y) == 0 or y.min() == y.max():
        model.shift = -20.0 if len(y) == 0 or y[0] == 0 else 20.0
        return model
    ids: dict[bytes, int] = {}
    docs = [np.array([ids.setdefault(w, len(ids)) for w in words_of((t or "").lower().encode())], np.int32) for t in texts]
    some = [i for i, d in enumerate(docs) if len(d)]
    flat, counts = grams_by_word(list(ids))
    starts = np.cumsum(counts) - counts
    place_of = np.zeros(len(counts), np.int32)  # of a word among those of a batch
    model.vectors = (rng.random((BUCKETS, DIMS), np.float32) - 0.5) / DIMS
    model.weights = (rng.random((DIMS, 2), np.float32) - 0.5) * 2
    checked = set(rng.permutation(some)[: len(some) // 5].tolist())
    train = np.array([i for i in some if i not in checked])
    weight = np.where(y == 1, 0.5 / max(1, y[train].sum()), 0.5 / max(1, (1 - y[train]).sum())) * len(train)
    parameters = [model.vectors, model.weights, model.bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parameters]
    step, epochs = 0, max(epochs, 400 * batch // len(train))
    for epoch in range(epochs):
        order = rng.permutation(train)
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            words = np.concatenate([docs[i] for i in chosen])
            sizes = np.array([len(docs[i]) for i in chosen])
            bag_at = np.concatenate([off + np.arange(0, n, BAG) for off, n in zip(np.cumsum(sizes) - sizes, sizes)])
            bag_doc = np.repeat(np.arange(len(chosen)), -(-sizes // BAG))
            bag_size = np.diff(np.append(bag_at, len(words)))
            used = np.flatnonzero(np.bincount(words, minlength=len(counts)))
            place_of[used] = np.arange(len(used), dtype=np.int32)
            place = place_of[words]
            grams = flat[ragged(starts[used], counts[used])]
            gram_at = np.cumsum(counts[used]) - counts[used]
            of_word = np.add.reduceat(model.vectors[grams], gram_at) / counts[used][:, None]
            of_bag = np.add.reduceat(of_word[place], bag_at) / bag_size[:, None]
            z = of_bag @ model.weights + model.bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            target = y[chosen][bag_doc]
            active = np.ones(len(bag_at))
            if 5 * epoch >= epochs:
                best = np.full(len(chosen), -1.0)
                np.maximum.at(best, bag_doc, p[:, 1])
                active = np.where(target == 1, p[:, 1] >= best[bag_doc], 1.0)
            # Each document weighs the same, but clean ones lean on the bags that look worst.
            share = active * np.where(target == 1, 1.0, p[:, 1] + 0.02)
            share /= np.maximum(np.bincount(bag_doc, share, len(chosen)), 1e-9)[bag_doc]
            dz = (p - np.stack([1 - target, target], axis=1)) * (share * weight[chosen][bag_doc])[:, None] / len(chosen)
            d_bag = (dz @ model.weights.T) / bag_size[:, None]
            d_place = np.repeat(d_bag, bag_size, axis=0)
            d_word = np.stack([np.bincount(place, d_place[:, k], len(used)) for k in range(DIMS)], axis=1) / counts[used][:, None]
            d_gram = np.repeat(d_word, counts[used], axis=0)
            touched = np.flatnonzero(np.bincount(grams, minlength=BUCKETS))
            d_vectors = np.stack([np.bincount(grams, d_gram[:, k], BUCKETS)[touched] for k in range(DIMS)], axis=1)
            step += 1
            for (m, v), value, slope, rows in zip(moments, parameters, (d_vectors, of_bag.T @ dz, dz.sum(axis=0)), (touched, slice(None), slice(None))):
                m[rows] = 0.9 * m[rows] + 0.1 * slope
                v[rows] = 0.99 * v[rows] + 0.01 * slope**2
                value[rows] -= rate * m[rows] / (1 - 0.9**step) / (np.sqrt(v[rows] / (1 - 0.99**step)) + 1e-6)
    scores = model.word_scores(list(ids))
    seen = np.array(sorted(checked)) if len(checked) > 20 and 0 < y[sorted(checked)].sum() < len(checked) else np.array(some)
    model.slope, model.shift = platt(np.array([model.highest(scores[docs[i]]) for i in seen]), y[seen])
    if prior is not None and 0 < prior < 1:
        share = y[seen].mean()
        model.shift += float(np.log(prior / (1 - prior)) - np.log(share / (1 - share)))
    return model


class WordScores(dict):
    """Scores of words by a model; emptied when it holds too many."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def of(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        wanted = set().union(*texts)
        new = wanted.difference(self)
        if new:
            if len(self) + len(new) > CACHE:
                self.clear()
                new = wanted
            new = list(new)
            self.update(zip(new, self.model.word_scores(new).tolist(), strict=True))
        return [np.fromiter(map(self.__getitem__, t), float, len(t)) for t in texts]


def score(docs: DataFrame, model: Model, threshold: float = 0.7, name: str = "score") -> DataFrame:
    """doc_id, score, predicted for every row of docs, from the whole text; a null text scores as an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few MB whatever the input's size

    def run(batches):
        known = WordScores(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = [words_of(t.lower().encode()) if t else [] for t in part.column("text").to_pylist()]
                logits = [shared.value.highest(s) for s in known.of(texts)]
                p = shared.value.probability(logits)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", name, "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, {name} double, predicted int")


def trained(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """A model fitted on at most per_class labelled documents of each class, and about CHARACTERS of them, outside the held-out fold."""
    rows = labelled_texts(docs, labels, "toxic", per_class, CHARACTERS).sort("doc_id").toArrow()
    usable = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1))
    prior = usable.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    return fit((t.as_py() for t in rows.column("text")), rows.column("y").to_numpy().astype(np.int64), prior)


def reject_toxic(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """docs without those whose score reaches threshold; a null text scores as an empty one. All columns are kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def toxic(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = WordScores(shared.value)
        for text in parts:
            found = []
            for at in range(0, len(text), 200):
                texts = [words_of(t.lower().encode()) if t else [] for t in text[at : at + 200]]
                found += [shared.value.highest(s) for s in known.of(texts)]
            yield pd.Series(shared.value.probability(found))

    return docs.where(toxic("text") < threshold)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted. Rows with a null doc_id are scored and not held out."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    found = score(docs, trained(docs, labels))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
