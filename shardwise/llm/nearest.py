"""Nearest neighbours by a block matrix join of int8 products.

Queries and rows are dealt into blocks; every query block meets every row block
in one task, which holds two bounded blocks and nothing else. Vectors are scaled
to length one and rounded to int8 with a scale each; the rounding error of a
vector is known, so a product of int8 rows gives the cosine within a known
bound. A row whose upper bound lies below the query's k-th lower bound is out;
the others are recomputed from the original vectors in double precision, each
task keeps a heap of k rows a query, and the heaps are merged by query.

The search is whole: the bound drops only rows that cannot be among the k.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .vectors import cosines, distinct_vectors, matrix, norms

QUERY_BLOCK = 1024
ROW_BLOCK = 2048


def int8_rows(x: np.ndarray, lengths: np.ndarray):
    """Rows scaled to length one as int8, their scales and their exact rounding errors."""
    unit = x / lengths[:, None]
    scale = np.abs(unit).max(1) / 127.0
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.sqrt(((unit - q * scale[:, None]) ** 2).sum(1))
    return q, scale, error


def tile_top(qid, q, cid, c, k: int):
    """``(query, row, cosine)`` triples: the k best rows of this tile for every query."""
    nq, nc = norms(q), norms(c)
    q8, qs, qe = int8_rows(q, nq)
    c8, cs, ce = int8_rows(c, nc)
    # Products of int8 rows are whole numbers below 2**24 for up to 1,040 components,
    # so single precision adds them exactly; longer rows use double precision.
    kind = np.float32 if q.shape[1] <= 1040 else np.float64
    est = (q8.astype(kind) @ c8.astype(kind).T).astype(np.float64) * qs[:, None] * cs[None, :]
    slack = qe[:, None] + (1 + qe)[:, None] * ce[None, :] + 1e-9
    own = qid[:, None] == cid[None, :]
    lower = np.where(own, -np.inf, est - slack)
    upper = np.where(own, -np.inf, est + slack)
    # A vec_id met several times counts once, so the cut takes as many more rows.
    spare = len(cid) - len(np.unique(cid))
    kth = min(k + spare, lower.shape[1])
    cut = np.partition(lower, -kth, axis=1)[:, -kth]
    qi, ci = np.nonzero((upper >= cut[:, None]) & ~own)
    score = cosines(q[qi], c[ci], nq[qi], nc[ci])
    out = []
    ends = np.searchsorted(qi, np.arange(len(qid) + 1))
    for i in range(len(qid)):
        best: dict[int, float] = {}
        for j in range(ends[i], ends[i + 1]):
            v = int(cid[ci[j]])
            best[v] = max(best.get(v, -2.0), float(score[j]))
        out.extend((int(qid[i]), v, s) for s, v in
                   ((s, -m) for s, m in heapq.nlargest(k, ((s, -v) for v, s in best.items()))))
    return out


def search(rows: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id",
           vector: str = "embedding", query_block: int = QUERY_BLOCK,
           row_block: int = ROW_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k rows of largest cosine for every query row.

    Nearest first, equal scores by smaller id; a query never meets rows of its
    own id; fewer than k candidates give all of them. Rows with a null id and
    vectors that are null, empty, zero, or hold null or non-finite components
    take no part; vectors of different length do not meet. An id met several
    times counts once, with its best score. Empty input gives no rows.
    """
    clean = materialize(
        distinct_vectors(rows.withColumn("__q", F.coalesce(is_query, F.lit(False))), id_col, vector, "__q")
        .select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v"), "__q",
                F.size(vector).alias("dims")), "nn")
    n, nq = clean.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("__q").cast("long")), F.lit(0))).first()
    row_blocks, query_blocks = max(1, -(-n // row_block)), max(1, -(-nq // query_block))
    queries = (clean.where("__q").select("id", "v", "dims", F.pmod(F.xxhash64("id"), F.lit(query_blocks)).alias("qb"))
               .withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1)).cast("array<long>"))))
    targets = (clean.select("id", "v", "dims", F.pmod(F.xxhash64("id"), F.lit(row_blocks)).alias("rb"))
               .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)).cast("array<long>"))))

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            found = tile_top(left["id"].to_numpy(), matrix(left["v"]),
                             right["id"].to_numpy(), matrix(right["v"]), k)
        return pa.table({"query_id": pa.array([f[0] for f in found], pa.int64()),
                         "vec_id": pa.array([f[1] for f in found], pa.int64()),
                         "score": pa.array([f[2] for f in found], pa.float64())})

    keys = ["qb", "rb", "dims"]
    heaps = queries.groupBy(*keys).cogroup(targets.groupBy(*keys)).applyInArrow(
        tile, "query_id long, vec_id long, score double")
    best = heaps.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (best.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def search_embeddings(embeddings: DataFrame) -> DataFrame:
    """The 5 nearest of every row whose vec_id is divisible by 50."""
    return search(embeddings, F.col("vec_id") % 50 == 0)
