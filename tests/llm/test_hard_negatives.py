"""Hard negatives against all pairs."""

import math
import random

from pyspark.sql import functions as F

from shardwise.llm import hard_negatives

ROWS = "vec_id LONG, embedding ARRAY<DOUBLE>, label INT"
LONG = (-(1 << 63), (1 << 63) - 1)


def clip(x):
    return max(LONG[0], min(LONG[1], x))


def brute(rows, every, positives=5, negatives=5):
    clean = []
    for ident, vector, label in {(i, None if v is None else tuple(v), y) for i, v, y in rows}:
        if ident is None or vector is None or label is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        label = int(math.fmod(label + 1, 10)) if ident % 7 == 0 else label
        clean.append((ident, label, [clip(math.floor(256 * x)) if math.isfinite(256 * x) else LONG[x > 0]
                                     for x in vector]))
    out = []
    for a, anchor in enumerate(clean):
        if anchor[0] % every:
            continue
        scored = [(-clip(sum(x * y for x, y in zip(anchor[2], row[2]))), row[0], row[1])
                  for b, row in enumerate(clean) if a != b and len(row[2]) == len(anchor[2])]
        for p, pid, _ in sorted(s for s in scored if s[2] == anchor[1])[:positives]:
            fit = sorted((n, i) for n, i, y in scored if y != anchor[1] and 80 * -p <= 100 * -n <= 100 * -p)
            out.extend((anchor[0], pid, r + 1, i, -p, -n) for r, (n, i) in enumerate(fit[:negatives]))
    return sorted(out)


def mined(spark, rows, every, **blocks):
    df = spark.createDataFrame(rows, ROWS).repartition(3).selectExpr("*", "1 as r", "2 as score", "'q' as q", "3 as anchor")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    out = hard_negatives.mine(df, F.col("vec_id") % every == 0, label, **blocks)
    assert out.dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"),
                          ("positive_score", "bigint"), ("negative_score", "bigint")]
    return sorted(tuple(r) for r in out.collect())


def vectors(n, dims, labels, seed, spread=1.0):
    rng = random.Random(seed)
    return [(i, [rng.choice([-1, 1, 1]) * rng.random() * spread for _ in range(dims)], rng.randrange(labels))
            for i in range(n)]


def test_against_all_pairs_in_any_blocks(spark):
    rows = vectors(300, 4, 3, 1)
    want = brute(rows, 10)
    assert len(want) > 300
    for blocks in ({}, {"anchor_block": 7, "row_block": 40}):
        assert mined(spark, rows, 10, **blocks) == want


def test_ties_hot_label_and_negative_scores(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.5]) for _ in range(3)], 1 if i % 3 else rng.randrange(4)) for i in range(200)]
    assert mined(spark, rows, 5, row_block=30) == brute(rows, 5)


def test_odd_rows(spark):
    rows = vectors(60, 3, 2, 2) + [
        (100, None, 1), (101, [0.1, None, 0.2], 1), (102, [float("nan"), 0.1, 0.2], 1), (103, [float("inf"), 0.1, 0.2], 1),
        (104, [0.1, 0.2, 0.3], None), (None, [0.1, 0.2, 0.3], 1), (110, [0.0, 0.0, 0.0], 1), (120, [], 1), (130, [], 0),
        (140, [0.5, 0.5], 1), (150, [0.5, 0.5], 0), (151, [0.4, 0.5], 1), (161, [0.5, 0.25], 2147483647)]
    assert mined(spark, rows + rows, 10) == brute(rows, 10)
    assert mined(spark, [], 10) == []
    assert mined(spark, rows[-1:], 1) == []


def test_scores_beyond_a_long_count_as_its_ends(spark):
    big = [2.0 ** 20, 2.0 ** 40, 2.0 ** 56, 1e300]
    rng = random.Random(9)
    for top in big:
        rows = [(i, [rng.choice([-1, 1]) * top * rng.random() for _ in range(2)], rng.randrange(2)) for i in range(40)]
        assert mined(spark, rows, 4, row_block=16) == brute(rows, 4)
