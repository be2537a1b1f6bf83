"""Toxicity by a factorization machine over hashed terms.

Terms are the distinct runs of letters of the lower-cased text, hashed into
``BUCKETS`` buckets. From a bounded labelled sample two kinds of buckets are kept
as features: those most associated with the label by themselves (at most
``FEATURES``, z of at least ``LEAST_Z``), and the members of pairs whose share of
label 1 is not what the two shares tell (at most ``FEATURES`` more, z of at least
``PAIR_Z``). Pairs are looked for among the first kind and the ``PAIR_TERMS`` most
frequent buckets. The machine learns a weight and a vector for each and scores ``bias + sum(w) + sum over pairs of <v_i, v_j>``, so that a
pair of terms (an insult next to the mention of a group) can weigh more than
the two alone. Presence counts, not frequency, so long texts are not diluted.

Fixed parameters: at most about ``TRAIN_ROWS`` labelled rows are used for
fitting; all documents are scored over their whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_blocks
from .labelled import held_out, training_rows

TRAIN_ROWS = 20_000
BUCKETS = 1 << 20
FEATURES = 1024
FACTORS = 8
LEAST_Z = 5.0
PAIR_TERMS = 2048
PAIR_ROWS = 10
PAIR_Z = 6.0
SEED = 9
LETTERS = r"\p{L}+"


class TermIndex(dict):
    """Term to feature number (-1: not a feature); remembers a bounded number of terms."""

    def __init__(self, of_bucket: dict[int, int] | None):
        super().__init__()
        self.of_bucket = of_bucket

    def __missing__(self, term: str) -> int:
        bucket = xxhash.xxh3_64_intdigest(term) % BUCKETS
        value = bucket if self.of_bucket is None else self.of_bucket.get(bucket, -1)
        if len(self) < 500_000:
            self[term] = value
        return value


def features_of(texts: list, index: TermIndex, words) -> list[np.ndarray]:
    """The distinct features of every text, in increasing order."""
    out = []
    for text in texts:
        found = {index[w] for w in set(words(text.lower()))} if text else set()
        found.discard(-1)
        out.append(np.array(sorted(found), dtype=np.int64))
    return out


class Machine:
    """A factorization machine: bias, weights and factors of the features."""

    def __init__(self, buckets: list[int], bias: float, weights: np.ndarray, factors: np.ndarray):
        self.buckets, self.bias, self.weights, self.factors = buckets, bias, weights, factors

    def raw(self, rows: list[np.ndarray]) -> np.ndarray:
        lens = np.array([len(r) for r in rows])
        out = np.full(len(rows), self.bias)
        if lens.sum():
            idx = np.concatenate(rows)
            own = np.repeat(np.arange(len(rows)), lens)
            linear = np.bincount(own, self.weights[idx], len(rows))
            sums = np.stack([np.bincount(own, self.factors[idx, k], len(rows))
                             for k in range(self.factors.shape[1])], axis=1)
            squares = np.bincount(own, (self.factors ** 2).sum(1)[idx], len(rows))
            out += linear + 0.5 * ((sums ** 2).sum(1) - squares)
        return out

    def probability(self, rows: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(rows), -40, 40)))


def fit(rows: list[np.ndarray], labels: np.ndarray, buckets: list[int], factors: int = FACTORS,
        epochs: int = 30, rate: float = 0.05, decay: float = 1e-3) -> Machine:
    """Adam on the logistic loss, both classes weighing the same in total."""
    n, k = len(rows), len(buckets)
    rng = np.random.default_rng(SEED)
    share = float(labels.mean()) if n else 0.0
    if n == 0 or share in (0.0, 1.0) or k == 0:
        return Machine(buckets, 40.0 if share == 1.0 else -40.0 if share == 0.0 else
                       float(np.log(share / (1 - share))), np.zeros(k), np.zeros((k, factors)))
    cost = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    params = [np.zeros(1), np.zeros(k), rng.normal(0, 0.01, (k, factors))]
    m1, m2, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(n)
        for s in range(0, n, 256):
            pick = order[s:s + 256]
            x = np.zeros((len(pick), k))
            for i, r in enumerate(pick):
                x[i, rows[r]] = 1.0
            sums = x @ params[2]
            raw = params[0] + x @ params[1] + 0.5 * ((sums ** 2).sum(1) - x @ (params[2] ** 2).sum(1))
            err = (1 / (1 + np.exp(-np.clip(raw, -40, 40))) - labels[pick]) * cost[pick] / len(pick)
            xe = x.T @ err
            grads = [np.array([err.sum()]), xe + decay * params[1],
                     x.T @ (err[:, None] * sums) - xe[:, None] * params[2] + decay * params[2]]
            step += 1
            for p, g, a, b in zip(params, grads, m1, m2):
                a *= 0.9
                a += 0.1 * g
                b *= 0.999
                b += 0.001 * g * g
                p -= rate * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.999 ** step)) + 1e-8)
    return Machine(buckets, float(params[0][0]), params[1], params[2])


def paired(rows: list[np.ndarray], labels: np.ndarray, k: int, limit: int, least: float = PAIR_Z) -> list[int]:
    """The terms below ``k`` in pairs whose label does not follow from the two alone.

    Expected is the share of label 1 by adding the log odds of the two terms; the
    z value of the pair's count has a continuity correction. Pairs in fewer than
    ``PAIR_ROWS`` rows are left out. The strongest pairs come first, up to
    ``limit`` terms.
    """
    both, ones = np.zeros((k, k), np.float32), np.zeros((k, k), np.float32)
    for s in range(0, len(rows), 2048):
        part = rows[s:s + 2048]
        x = np.zeros((len(part), k), np.float32)
        for i, r in enumerate(part):
            x[i, r] = 1.0
        both += x.T @ x
        x = x[labels[s:s + 2048] == 1]
        ones += x.T @ x
    # Log odds with half a row of each label added, relative to those of all rows.
    n, n1 = np.diag(both).astype(np.float64), np.diag(ones).astype(np.float64)
    base = np.log((labels.sum() + 0.5) / ((1 - labels).sum() + 0.5))
    odds = np.log((n1 + 0.5) / (n - n1 + 0.5)) - base
    found = []
    for s in range(0, k, 256):
        m, m1 = both[s:s + 256].astype(np.float64), ones[s:s + 256].astype(np.float64)
        p = 1 / (1 + np.exp(-np.clip(odds[s:s + 256, None] + odds + base, -40, 40)))
        z = (np.abs(m1 - m * p) - 0.5) / np.sqrt(m * p * (1 - p) + 0.25)
        z[m < PAIR_ROWS] = 0
        a, b = np.nonzero(np.triu(z >= least, s + 1))
        order = np.argsort(-z[a, b], kind="stable")[:limit * 8]
        found += [(-z[a[i], b[i]], int(a[i]) + s, int(b[i])) for i in order]
    out = {}
    for _, a, b in sorted(found):
        if len(out.keys() | {a, b}) <= limit:
            out[a] = out[b] = True
    return list(out)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = TRAIN_ROWS,
          features: int = FEATURES) -> Machine:
    """Learn the machine from labelled documents outside the held-out fold.

    Without labels, or with one class only, every score is the same (0 when no
    row is labelled 1, else 1).
    """
    sample = training_rows(docs, labels, label, rows)

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, words = TermIndex(None), regex.compile(LETTERS).findall
        for block in column_blocks(batches):
            found = features_of(block.column(1).to_pylist(), index, words)
            yield pa.RecordBatch.from_arrays(
                [block.column(0), block.column(2), pa.array(found, pa.list_(pa.int64()))],
                names=["doc_id", "label", "buckets"])

    bags = sample.mapInArrow(terms, f"doc_id {sample.schema['doc_id'].dataType.simpleString()}, "
                                    "label int, buckets array<long>").persist()
    total, ones = bags.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not 0 < ones < total:
        bags.unpersist()
        return fit([], np.zeros(0), []) if not ones else fit([np.zeros(0, np.int64)], np.ones(1), [])
    # z value of the term's count among rows labelled 1, with a continuity correction.
    expected = F.col("n") * F.lit(ones / total)
    spread = F.sqrt(expected * F.lit(1 - ones / total) * (1 - F.col("n") / F.lit(total)) + F.lit(1e-9))
    counts = (bags.select("label", F.explode("buckets").alias("bucket"))
              .groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("ones"))
              .where("n >= 2").withColumn("z", (F.abs(F.col("ones") - expected) - 0.5) / spread).persist())
    alone = [r["bucket"] for r in counts.where(F.col("z") >= LEAST_Z)
             .orderBy(F.desc("z"), "bucket").limit(features).select("bucket").collect()]
    often = [r["bucket"] for r in counts.where(F.col("n") >= PAIR_ROWS)
             .orderBy(F.desc("n"), "bucket").limit(PAIR_TERMS).select("bucket").collect()]
    counts.unpersist()
    pool = alone + sorted(set(often) - set(alone))
    sorted_pool, place = np.sort(np.array(pool, np.int64)), np.argsort(np.array(pool, np.int64)).astype(np.int32)

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for found in batch.column(2).to_pylist():
                _, at, _ = np.intersect1d(sorted_pool, np.array(found, np.int64), assume_unique=True,
                                          return_indices=True)
                out.append(np.sort(place[at]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "label", "b"])

    # The sample is bounded (TRAIN_ROWS) and so are the buckets kept of each row.
    kept = bags.mapInArrow(pooled, f"doc_id {sample.schema['doc_id'].dataType.simpleString()}, "
                                   "label int, b array<int>").orderBy("doc_id", "label", "b").toArrow()
    bags.unpersist()
    rows_of = [np.array(r.values, dtype=np.int64) for r in kept.column("b")]
    y = kept.column("label").to_numpy().astype(np.float64)
    used = list(range(len(alone)))
    used += sorted(set(paired(rows_of, y, len(pool), features)) - set(used))
    number = np.full(len(pool), -1)
    number[used] = np.arange(len(used))
    picked = [number[r] for r in rows_of]
    return fit([np.sort(r[r >= 0]) for r in picked], y, [pool[i] for i in used])


def score_texts(docs: DataFrame, machine: Machine) -> DataFrame:
    """``doc_id, score`` of every row over its whole text (null: empty)."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = TermIndex({bucket: i for i, bucket in enumerate(machine.buckets)})
        words = regex.compile(LETTERS).findall
        for block in column_blocks(batches):
            p = machine.probability(features_of(block.column(1).to_pylist(), index, words))
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(p, pa.float64())],
                                             names=["doc_id", "score"])

    src = docs.select("doc_id", "text")
    return src.mapInArrow(scored, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of a documents table."""
    out = score_texts(docs, train(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))
