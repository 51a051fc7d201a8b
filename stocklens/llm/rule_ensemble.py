"""Quality classifier: a sparse rule ensemble over text statistics.

Boosted trees of small depth are grown on a bounded labelled sample; every path from a root to a node is a conjunctive rule. A
lasso logistic regression keeps few of the rules, and those are compiled into one Spark column expression, so that scoring
runs on statistics that are column expressions as well.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .divergence import text_words
from .labelled import class_counts, held_out, labelled_texts

PER_CLASS = 2500  # documents of each class that the model is fitted on at most
CHARACTERS = 20_000_000  # and about so many characters of them; only their statistics leave the executors
STATISTICS = ["n_words", "word_length", "longest", "distinct_words", "distinct_lines", "words_per_line", "upper", "digits", "symbols", "exclamations", "stops", "pipes", "short_words"]


def with_statistics(docs: DataFrame) -> DataFrame:
    """docs with the columns STATISTICS (doubles, never null); null texts count as empty, shares of nothing as 0."""
    cut = docs.withColumn("_t", F.coalesce("text", F.lit("")))
    cut = cut.withColumns({"_words": text_words(F.col("_t")), "_lines": F.split("_t", "\n"), "_bare": F.regexp_replace("_t", r"[a-z\x20\x09-\x0D\x80-￿]+", "")})
    n = F.greatest(F.size("_words"), F.lit(1))
    chars = F.greatest(F.length("_t"), F.lit(1))
    of = lambda inside: F.length(F.regexp_replace("_bare", f"[^{inside}]+", ""))
    made = {
        "n_words": F.size("_words"),
        "word_length": F.length("_t") / n,
        "longest": F.coalesce(F.array_max(F.transform("_words", lambda w: F.length(w))), F.lit(0)),
        "distinct_words": F.size(F.array_distinct("_words")) / n,
        "distinct_lines": F.size(F.array_distinct("_lines")) / F.greatest(F.size("_lines"), F.lit(1)),
        "words_per_line": F.size("_words") / F.greatest(F.size("_lines"), F.lit(1)),
        "upper": of("A-Z") / chars,
        "digits": of("0-9") / chars,
        "symbols": of("#*$%&<>") / chars,
        "exclamations": of("!") / chars,
        "stops": of(".,;:") / chars,
        "pipes": of("|") / chars,
        "short_words": F.size(F.filter("_words", lambda w: F.length(w) <= 3)) / n,
    }
    return cut.withColumns({k: v.cast("double") for k, v in made.items()}).drop("_t", "_words", "_lines", "_bare")


Rule = tuple[tuple[int, float, bool], ...]  # (statistic, threshold, at most): all must hold


@dataclass
class Ensemble:
    rules: list[Rule]
    weights: list[float]
    bias: float

    def column(self) -> Column:
        """The score as one expression: weights of the rules that hold, through the logistic function."""
        total = F.lit(float(self.bias))
        for rule, weight in zip(self.rules, self.weights, strict=True):
            holds = F.lit(True)
            for at, threshold, most in rule:
                holds = holds & ((F.col(STATISTICS[at]) <= threshold) if most else (F.col(STATISTICS[at]) > threshold))
            total = total + F.when(holds, F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for at, threshold, most in rule:
        out &= (x[:, at] <= threshold) if most else (x[:, at] > threshold)
    return out


def grow(x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, cuts: list[np.ndarray], depth: int, least: int, path: Rule = ()) -> list[tuple[Rule, np.ndarray, float]]:
    """Nodes of a tree fitted to the gradient: (path, rows, Newton step), split where the gain is largest."""
    rows = np.arange(len(x)) if not path else np.flatnonzero(holds(path, x))
    step = gradient[rows].sum() / (hessian[rows].sum() + 1.0)
    nodes = [(path, rows, step)] if path else []
    if depth == 0 or len(rows) < 2 * least:
        return nodes
    score = lambda g, h: g * g / (h + 1.0)
    best = (1e-6, None)
    for at, thresholds in enumerate(cuts):
        if not len(thresholds):
            continue
        place = np.searchsorted(thresholds, x[rows, at], "left")
        g, h, n = (np.cumsum(np.bincount(place, w, len(thresholds) + 1))[:-1] for w in (gradient[rows], hessian[rows], None))
        all_g, all_h = gradient[rows].sum(), hessian[rows].sum()
        gain = np.where((n >= least) & (len(rows) - n >= least), score(g, h) + score(all_g - g, all_h - h) - score(all_g, all_h), -1)
        k = int(np.argmax(gain))
        if gain[k] > best[0]:
            best = (gain[k], (at, float(thresholds[k])))
    if best[1] is None:
        return nodes
    at, threshold = best[1]
    for most in (True, False):
        nodes += grow(x, gradient, hessian, cuts, depth - 1, least, (*path, (at, threshold, most)))
    return nodes


def largest_value(z: np.ndarray, weight: np.ndarray, rounds: int = 60) -> float:
    """An upper estimate of the largest eigenvalue of z' diag(weight) z, by power iteration."""
    v = np.ones(z.shape[1]) / max(1.0, np.sqrt(z.shape[1]))
    value = 0.0
    for _ in range(rounds):
        v = ((z @ v.astype(z.dtype)) * weight).astype(z.dtype) @ z
        value = float(np.linalg.norm(v))
        if value == 0:
            break
        v = v / value
    return 1.05 * value


def lasso(z: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, rounds: int = 600) -> tuple[np.ndarray, float]:
    """Logistic regression of weighted rows (weights of mean 1) with an L1 penalty by accelerated proximal gradients."""
    n, k = z.shape
    share = (weight * y).mean()
    w, b = np.zeros(k), float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    v, c, t = w.copy(), b, 1.0
    rate = 4 * n / (largest_value(z, weight) + n)
    for _ in range(rounds):
        error = weight * (1 / (1 + np.exp(-np.clip(z @ v.astype(z.dtype) + c, -50, 50))) - y)
        new = v - rate * (error.astype(z.dtype) @ z) / n
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        new_b = c - rate * error.mean()
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / t_new * (new - w), new_b + (t - 1) / t_new * (new_b - b)
        w, b, t = new, new_b, t_new
    return w, b


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, trees: int = 40, depth: int = 3, penalty: float = 0.001, rate: float = 0.3) -> Ensemble:
    """An ensemble for statistics x and labels y, each row as heavy as its weight says. Without both classes the score is a constant near the only label."""
    if len(y) == 0 or y.min() == y.max():
        return Ensemble([], [], 0.0 if len(y) == 0 else (6.0 if y[0] else -6.0))
    cuts = [np.unique((u[1:] + u[:-1]) / 2) if len(u) <= 64 else np.unique(np.quantile(v, np.arange(1, 64) / 64)) for v in x.T for u in (np.unique(v),)]
    weight = np.ones(len(y)) if weight is None else weight / weight.mean()
    share = (weight * y).mean()
    raw = np.full(len(y), np.log(share / (1 - share)))
    least, found = max(3, len(y) // 400), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        nodes = grow(x, weight * (y - p), weight * p * (1 - p), cuts, depth, least)
        if not nodes:
            break
        deepest = {path[:-1] for path, *_ in nodes}
        for path, rows, step in nodes:
            found.setdefault(path, None)
            if path not in deepest:
                raw[rows] += rate * np.clip(step, -4, 4)
    rules = list(found)
    z = np.zeros((len(y), len(rules)), np.float32)
    for i, r in enumerate(rules):
        z[:, i] = holds(r, x)
    w, b = lasso(z, y, weight, penalty)
    keep = np.flatnonzero(np.abs(w) > 1e-4)
    return Ensemble([rules[i] for i in keep], w[keep].tolist(), b)


def trained(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Ensemble:
    """An ensemble fitted on at most per_class labelled documents of each class outside the held-out fold, weighted to the ratio of all such labels."""
    texts = labelled_texts(docs, labels, "quality", per_class, CHARACTERS)
    found = with_statistics(texts).select("doc_id", *STATISTICS, "y").toPandas().sort_values("doc_id")
    x, y = found[STATISTICS].to_numpy(float), found["y"].to_numpy(float)
    counts = class_counts(labels, "quality")
    weight = np.array([counts[k] / max(1, (y == k).sum()) if k in counts else 1.0 for k in (0, 1)])
    return fit(x, y, weight[y.astype(int)])


def scored(docs: DataFrame, model: Ensemble, name: str = "score") -> DataFrame:
    """docs with the score, without the statistics; a column of that name is replaced."""
    kept = [c for c in docs.columns if c != name]
    packed = docs.select("text", F.struct(*kept).alias("_row"))
    return with_statistics(packed).select("_row.*", model.column().alias(name))


def reject_poor(docs: DataFrame, model: Ensemble, threshold: float = 0.5) -> DataFrame:
    """docs whose score reaches threshold, with all columns of docs, whatever their names."""
    packed = docs.select("text", F.struct(*docs.columns).alias("_row"))
    return with_statistics(packed).where(model.column() >= threshold).select("_row.*")


def op3_rule_ensemble(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted. Rows with a null doc_id are scored and not held out; null texts score as empty ones."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    found = scored(docs.select("doc_id", "text"), trained(docs, labels))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
