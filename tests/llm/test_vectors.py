import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shardwise.llm import near_vectors, nearest

from .helpers import components, cosine, usable

SCHEMA = "vec_id LONG, embedding ARRAY<FLOAT>, label INT"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).selectExpr(
        "*", "1 as rank", "'x' as score", "2 as component_id", "3 as id")


def odd_rows(dims):
    nan, inf = float("nan"), float("inf")
    return [(900, None, 1), (901, [0.0] * dims, 1), (902, [nan] + [1.0] * (dims - 1), 1), (903, [inf] * dims, 1),
            (904, [None] + [1.0] * (dims - 1), 1), (905, [], 1), (906, [1.0] * dims, None), (907, [1.0] * dims, None),
            (None, [1.0] * dims, 1)]


def clustered(dims=16, seed=3):
    rng = np.random.default_rng(seed)
    rows, at = [], 0
    for _ in range(12):
        centre = rng.normal(size=dims)
        for _ in range(rng.integers(1, 14)):
            v = centre + rng.normal(size=dims) * rng.choice([0.0, 0.05, 0.12, 0.2])
            rows.append((at, [float(np.float32(x)) for x in v * rng.uniform(0.5, 2)], int(rng.integers(0, 2))))
            at += 1
    return rows


def brute_links(rows, threshold=0.98):
    ok = [(i, v, lab) for i, v, lab in rows if i is not None]
    pairs = [(a[0], b[0]) for k, a in enumerate(ok) for b in ok[k + 1:]
             if a[0] != b[0] and a[2] is not None and a[2] == b[2] and usable(a[1]) and usable(b[1])
             and len(a[1]) == len(b[1]) and cosine(a[1], b[1]) >= threshold]
    ids = {i for i, _, _ in ok}
    comp = components(ids, pairs)
    n = dict.fromkeys(ids, 0)
    for a, b in pairs:
        n[a] += 1
        n[b] += 1
    return {i: (n[i], comp[i], comp[i] == i) for i in ids}


@pytest.mark.parametrize("block", [4, 1024])
def test_near_duplicates_equal_brute_force(spark, block):
    rows = clustered() + odd_rows(16) + [(800 + i, [1.0, 2.0] * 8, 1) for i in range(30)]
    got = near_vectors.near_duplicates(table(spark, rows), block=block).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got} == brute_links(rows)
    assert len(got) == len({r["vec_id"] for r in got})


def test_repeated_rows_count_once_and_empty_tables_work(spark):
    rows = clustered()
    twice = {r["vec_id"]: tuple(r) for r in near_vectors.near_duplicates(table(spark, rows + rows)).collect()}
    once = {r["vec_id"]: tuple(r) for r in near_vectors.near_duplicates(table(spark, rows)).collect()}
    assert twice == once
    assert near_vectors.near_duplicates(table(spark, rows).where("false")).count() == 0
    assert nearest.search_embeddings(table(spark, rows).where("false")).count() == 0


def test_estimates_are_unbiased_and_bounds_hold():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x + rng.normal(size=x.shape) * 0.02
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    turn = near_vectors.rotations(64, 256)
    signs, factor = near_vectors.encode(x, turn)
    est, spread = near_vectors.estimate(signs, factor, y @ turn.T, 64)
    true = x @ y.T
    assert abs((est - true).mean()) < 0.002
    assert (est + near_vectors.SIGMAS * spread[:, None] >= true).all()
    assert 0.75 < factor.mean() < 0.85


def test_bands_miss_less_than_promised():
    for n in (10, 10_000, 10**9):
        bits, bands = near_vectors.band_plan(n)
        agree = 1 - np.arccos(0.98) / np.pi
        assert (1 - agree ** bits) ** bands <= near_vectors.MISS


def brute_nearest(rows, k=5):
    ok = {i: v for i, v, _ in rows if i is not None and usable(v)}
    out = []
    for q in ok:
        if q % 50 == 0:
            best = sorted(((-cosine(ok[q], v), i) for i, v in ok.items() if i != q and len(v) == len(ok[q])))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(1, 7), (1024, 2048)])
def test_nearest_equals_brute_force(spark, blocks):
    rows = clustered(dims=12, seed=5) + odd_rows(12) + [(700 + i, [1.0, 3.0] * 6, 0) for i in range(9)]  # ties
    rows += [(950, [1.0, 2.0, 3.0], 1), (951, [1.0, 2.0, 2.0], 1)]  # another length
    got = nearest.search(table(spark, rows), F.col("vec_id") % 50 == 0, query_block=blocks[0], row_block=blocks[1])
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect()) == brute_nearest(rows)
    again = nearest.search_embeddings(table(spark, rows + rows))
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in again.collect()) == brute_nearest(rows)


def test_int8_error_is_exact():
    rng = random.Random(4)
    x = np.array([[rng.gauss(0, 1) for _ in range(20)] for _ in range(30)])
    q, scale, error = nearest.int8_rows(x, np.linalg.norm(x, axis=1))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert np.allclose(np.linalg.norm(unit - q * scale[:, None], axis=1), error)
