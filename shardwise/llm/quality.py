"""Quality by Bradley-Terry pairwise ranking.

A document's strength is linear in shape features of its text (shares of
character classes, word and line repetition, lengths), each expanded by hinges
at sample quantiles. The weights maximise the likelihood that in a pair of one
good and one bad document the good one wins: a logistic loss on the difference
of their features. The cut is the quantile of the sample's strengths at the
share of bad documents; the score is logistic in the strength and has the value
``THRESHOLD`` at the cut.

Fixed parameters: fitting uses at most about ``TRAIN_ROWS`` labelled rows and
``PAIRS`` pairs; all documents are scored over their whole texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_blocks
from .labelled import held_out, training_rows

TRAIN_ROWS = 20_000
PAIRS = 40_000
THRESHOLD = 0.3
SEED = 6
HINGES = (0.05, 0.25, 0.5, 0.75, 0.95)
SHAPES = 20


def shape(text: str | None) -> list[float]:
    """Shape features of a whole text; all zero for a null or blank text."""
    words = text.split() if text else []
    if not words:
        return [0.0] * SHAPES
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    n = len(codes)
    ascii_counts = np.bincount(np.minimum(codes, 128), minlength=129)
    upper = ascii_counts[65:91].sum()
    lower = ascii_counts[97:123].sum()
    digits = ascii_counts[48:58].sum()
    blank = ascii_counts[32] + ascii_counts[9:14].sum()
    stops = ascii_counts[[44, 46]].sum()
    other = ascii_counts[33:127].sum() - upper - lower - digits - stops
    counts = Counter(words)
    m = len(words)
    top = counts.most_common(2)
    lines = [x for x in text.split("\n") if x.strip()]
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    alpha = sum(c for w, c in counts.items() if w.isalpha())
    loud = sum(c for w, c in counts.items() if w.isupper() and len(w) > 1)
    tail = sum(c for w, c in counts.items() if not w[-1].isalnum() and w[-1] not in ".,")
    full = sum(c for w, c in counts.items() if w[-1] == ".")
    pairs = len(set(zip(words, words[1:])))
    return [
        upper / n, lower / n, digits / n, blank / n, stops / n, other / n, ascii_counts[128] / n,
        np.log(m), (n - blank) / m, len(counts) / m, top[0][1] / m, (top[1][1] / m if len(top) > 1 else 0.0),
        repeats / m, alpha / m, loud / m, tail / m, full / m,
        pairs / max(1, m - 1), len(set(lines)) / len(lines), np.log1p(n / len(lines)),
    ]


class Ranking:
    """A fitted ranking: hinge places, scaling, weights and the cut."""

    def __init__(self, places, mean, scale, weights, cut, constant=None):
        self.places, self.mean, self.scale = places, mean, scale
        self.weights, self.cut, self.constant = weights, cut, constant

    def expanded(self, x: np.ndarray) -> np.ndarray:
        parts = [x] + [np.maximum(0.0, x - q) for q in self.places]
        return (np.concatenate(parts, axis=1) - self.mean) / self.scale

    def strength(self, x: np.ndarray) -> np.ndarray:
        return self.expanded(x) @ self.weights

    def score(self, x: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = self.strength(x) - self.cut + np.log(threshold / (1 - threshold))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, ridge: float = 3.0) -> Ranking:
    """Weights by Newton steps on the pairwise logistic loss with a ridge term."""
    if len(y) == 0 or y.min() == y.max():
        return Ranking(None, None, None, None, None, constant=1.0 if len(y) and y[0] == 1 else 0.0)
    places = np.quantile(x, HINGES, axis=0)
    raw = np.concatenate([x] + [np.maximum(0.0, x - q) for q in places], axis=1)
    mean, scale = raw.mean(0), raw.std(0)
    scale = np.where(scale < 1e-9, 1.0, scale)
    z = (raw - mean) / scale
    rng = np.random.default_rng(SEED)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = np.zeros(z.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(np.clip(d @ w, -40, 40)))
        grad = -d.T @ p + ridge * w
        hess = (d * (p * (1 - p))[:, None]).T @ d + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-6:
            break
    return Ranking(places, mean, scale, w, float(np.quantile(z @ w, 1 - y.mean())))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS) -> Ranking:
    """Learn the ranking from labelled documents outside the held-out fold.

    Without labels, or with one class only, every score is the same (1 when all
    labels are 1, else 0).
    """
    sample = training_rows(docs, labels, label, rows)

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in column_blocks(batches):
            yield pa.RecordBatch.from_arrays(
                [block.column(0), block.column(2),
                 pa.array([shape(t) for t in block.column(1).to_pylist()], pa.list_(pa.float64()))],
                names=["doc_id", "label", "x"])

    # A bounded sample (TRAIN_ROWS rows of SHAPES numbers) comes to the driver.
    rows_ = sample.mapInArrow(shapes, f"doc_id {sample.schema['doc_id'].dataType.simpleString()}, "
                                      "label int, x array<double>").toPandas()
    rows_ = rows_.sort_values(["doc_id", "label"], kind="stable")
    if not len(rows_):
        return fit(np.zeros((0, SHAPES)), np.zeros(0))
    return fit(np.stack(rows_["x"].to_list()), rows_["label"].to_numpy(dtype=np.float64))


def score_texts(docs: DataFrame, ranking: Ranking) -> DataFrame:
    """``doc_id, score`` of every row over its whole text (null: empty)."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in column_blocks(batches):
            x = np.array([shape(t) for t in block.column(1).to_pylist()]).reshape(-1, SHAPES)
            yield pa.RecordBatch.from_arrays(
                [block.column(0), pa.array(ranking.score(x), pa.float64())], names=["doc_id", "score"])

    src = docs.select("doc_id", "text")
    return src.mapInArrow(scored, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of a documents table."""
    out = score_texts(docs, train(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))
