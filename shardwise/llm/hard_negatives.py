"""Hard negatives by a secondary-sort shuffle of pair scores.

Anchors and rows are dealt into blocks that meet in tiles, as in a block join.
A first round of tiles keeps each anchor's best rows of its own label, which
gives the positives and their scores. A second round scores the rows of other
labels; a tile sends on, for every positive, only the first rows below its score
(more of one tile cannot be among the first of all). Pair scores travel under
the key (anchor, descending score, id): repartitioned by anchor and sorted
inside the partitions by Spark, so an iterator reads each anchor's pairs in
order, opens a window when a positive passes, hands the next rows to all open
windows and closes those that are full or too far above. It holds the open
windows of one anchor and nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

POSITIVES = 5
NEGATIVES = 5
SCALE = 256
LEAST_SHARE = (4, 5)  # a negative has at least 80 % of the positive's score
ANCHOR_BLOCK = 512
ROW_BLOCK = 8192
LONG = (-(1 << 63), (1 << 63) - 1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows; beyond the range of a long they count as its ends."""
    if not (len(a) and len(b) and a.shape[1]):
        return np.zeros((len(a), len(b)), dtype=np.int64)
    most = max(abs(int(a.min())), abs(int(a.max()))) * max(abs(int(b.min())), abs(int(b.max()))) * a.shape[1]
    for kind, limit in ((np.float32, 1 << 24), (np.float64, 1 << 53)):
        if most <= limit:
            return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)
    if most <= LONG[1]:
        return a @ b.T
    whole = a.astype(object) @ b.astype(object).T
    return np.clip(whole, *LONG).astype(np.int64)


def far_enough(negative: int, positive: int) -> bool:
    part, whole = LEAST_SHARE
    return part * positive <= whole * negative


def block(table: pa.Table) -> dict:
    """A tile's side as arrays, ordered by id and row number so that earlier means smaller."""
    at = np.lexsort((table["r"].to_numpy(), table["id"].to_numpy()))
    vectors = table["q"].combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    side = {name: table[name].to_numpy()[at] for name in ("r", "id", "label")}
    return side | {"q": flat.reshape(len(at), -1 if len(flat) else 0)[at], "at": at}


def descending(scores: np.ndarray) -> np.ndarray:
    """Places by descending score, ties by place (``~x`` is ``-x - 1``, which cannot overflow)."""
    return np.argsort(~scores, kind="stable")


def first_rows(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, largest first, ties by place."""
    if len(scores) > k:
        places = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
    else:
        places = np.arange(len(scores))
    return places[descending(scores[places])][:k]


def tile_positives(anchors: dict, rows: dict, k: int) -> list[tuple]:
    """``(anchor row, row, id, score)``: every anchor's k best rows of its label in this tile."""
    out = []
    for label in np.unique(anchors["label"]):
        left, right = np.flatnonzero(anchors["label"] == label), np.flatnonzero(rows["label"] == label)
        scores = products(anchors["q"][left], rows["q"][right])
        for i, a in enumerate(left):
            others = np.flatnonzero(rows["r"][right] != anchors["r"][a])
            own = scores[i][others]
            for p in first_rows(own, k):
                j = right[others[p]]
                out.append((int(anchors["r"][a]), int(rows["r"][j]), int(rows["id"][j]), int(own[p])))
    return out


def tile_negatives(anchors: dict, levels: list, rows: dict, k: int) -> list[tuple]:
    """``(anchor row, row, id, score)``: for every level of an anchor, this tile's k first rows not above it."""
    out = []
    scores = products(anchors["q"], rows["q"])
    part, whole = LEAST_SHARE
    for i in range(len(levels)):
        own = scores[i]
        top, low = max(levels[i]), min(levels[i])
        # Python numbers: a multiple of a score may leave the range of a long.
        floor = max(LONG[0], min(LONG[1], -(-part * low // whole)))
        places = np.flatnonzero((own <= top) & (own >= floor) & (rows["label"] != anchors["label"][i]))
        if not len(places):
            continue
        places = places[descending(own[places])]
        ordered = own[places]
        picked = set()
        for level in set(levels[i]):
            start = int(np.searchsorted(~ordered, ~level))
            for p in range(start, min(start + k, len(places))):
                if not far_enough(int(ordered[p]), level):
                    break
                picked.add(p)
        out.extend((int(anchors["r"][i]), int(rows["r"][places[p]]), int(rows["id"][places[p]]), int(ordered[p]))
                   for p in sorted(picked))
    return out


PAIR = "anchor long, r long, id long, score long"


def pair_table(found: list[tuple]) -> pa.Table:
    return pa.table({name: pa.array([f[i] for f in found], pa.int64())
                     for i, name in enumerate(("anchor", "r", "id", "score"))})


def windows(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Read pairs sorted by anchor, descending score, positives first, id; emit every positive's k negatives."""
    anchor, opened = None, []
    for batch in batches:
        out = []
        columns = [batch.column(c).to_pylist() for c in ("anchor", "score", "kind", "id", "anchor_id")]
        for own, score, kind, ident, anchor_id in zip(*columns):
            if own != anchor:
                anchor, opened = own, []
            if kind == 0:
                opened.append([ident, score, 0])
                continue
            for window in opened:
                if far_enough(score, window[1]):
                    window[2] += 1
                    out.append((anchor_id, window[0], window[2], ident, window[1], score))
                else:
                    window[2] = k
            opened = [w for w in opened if w[2] < k]
        yield pa.RecordBatch.from_arrays(
            [pa.array([o[i] for o in out], pa.int32() if i == 2 else pa.int64()) for i in range(6)],
            names=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])


def mine(rows: DataFrame, is_anchor: Column, label: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
         scale: int = SCALE, id_col: str = "vec_id", vector: str = "embedding",
         anchor_block: int = ANCHOR_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Vectors are scaled and rounded down to whole numbers; a score is the inner
    product of two of them. An anchor's positives are its first ``positives``
    other rows of the same label, larger scores first, ties by smaller id; a
    positive's negatives are the first ``negatives`` rows of other labels whose
    score is not above the positive's and at least 80 % of it (never for a
    positive below zero). A positive without negatives gives no row.

    Rows with a null id, label or vector or a null or non-finite component take
    no part; rows equal in id, label and vector count once, an id with several
    vectors or labels counts as several rows (each an anchor of its own, ties
    among them in any order). Vectors of different length do not meet; empty
    ones have score 0. Scaled components and scores beyond the range of a long
    count as its ends. Other columns are ignored; empty input gives no rows.
    """
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) &
                      (F.abs(x.cast("double")) < F.lit(float("inf"))))
    clean = rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"),
                        F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"), v.alias("v"),
                        F.coalesce(v.isNotNull() & finite, F.lit(False)).alias("ok"))
    clean = (clean.where("ok AND id IS NOT NULL AND label IS NOT NULL").distinct()
             .select("id", "label", "is_anchor",
                     F.transform("v", lambda x: F.floor(x.cast("double") * scale)).alias("q")))
    clean = materialize(clean.select("id", "label", "is_anchor", "q", F.size("q").alias("dims"),
                                     F.monotonically_increasing_id().alias("r")), "hn")
    row = clean.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("is_anchor"), 1)).alias("anchors"),
                    F.max(F.array_max("q")).alias("high"), F.min(F.array_min("q")).alias("low")).first()
    if -(1 << 15) <= (row["low"] or 0) and (row["high"] or 0) < 1 << 15:
        clean = clean.withColumn("q", F.col("q").cast("array<short>"))
    row_blocks, anchor_blocks = max(1, -(-row["n"] // row_block)), max(1, -(-row["anchors"] // anchor_block))

    def dealt(df: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        """Blocks by row number: no id or label can make one hot."""
        every = F.explode(F.sequence(F.lit(0), F.lit(n_other - 1)).cast("array<long>"))
        return df.withColumn(own, F.pmod(F.xxhash64("r"), F.lit(n_own))).withColumn(other, every)

    keys = ["ab", "rb", "dims"]
    targets = dealt(clean.drop("is_anchor"), "rb", row_blocks, "ab", anchor_blocks).groupBy(*keys)
    anchors = clean.where("is_anchor").drop("is_anchor")

    def near(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return pair_table([])
        return pair_table(tile_positives(block(left), block(right), positives))

    def below(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return pair_table([])
        side = block(left)
        levels = left["levels"].to_pylist()
        return pair_table(tile_negatives(side, [levels[i] for i in side["at"]], block(right), negatives))

    first = dealt(anchors, "ab", anchor_blocks, "rb", row_blocks).groupBy(*keys).cogroup(targets).applyInArrow(near, PAIR)
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "id", "r")
    best = materialize(first.withColumn("n", F.row_number().over(order)).where(F.col("n") <= positives).drop("n"), "hn")
    levels = best.groupBy(F.col("anchor").alias("r")).agg(F.collect_list("score").alias("levels"))
    wanted = materialize(anchors.join(levels, "r"), "hn")
    second = dealt(wanted, "ab", anchor_blocks, "rb", row_blocks).groupBy(*keys).cogroup(targets).applyInArrow(below, PAIR)
    pairs = (best.withColumn("kind", F.lit(0)).unionByName(second.withColumn("kind", F.lit(1)))
             .join(anchors.select(F.col("r").alias("anchor"), F.col("id").alias("anchor_id")), "anchor"))
    ordered = pairs.repartition("anchor").sortWithinPartitions("anchor", F.desc("score"), "kind", "id", "r")
    return ordered.mapInArrow(
        lambda batches: windows(batches, negatives),
        "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def mine_embeddings(embeddings: DataFrame) -> DataFrame:
    """Anchors are the rows whose vec_id is divisible by 100; ids divisible by 7 carry the next label."""
    given = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (given + 1) % 10).otherwise(given)
    return mine(embeddings, F.col("vec_id") % 100 == 0, label)
