"""Near-duplicate vectors from randomised-rotation binary codes.

Each vector, scaled to length one, is turned by random orthonormal matrices and
kept as the signs of its coordinates: a binary code. With the code goes one
correction factor, the inner product of the vector with its own code point;
dividing by it makes ``<code of x, rotated y> / factor`` an unbiased estimate
of the cosine of x and y, with an error that has a known spread. A pair whose
estimate plus ``SIGMAS`` spreads stays below the threshold is dropped; every
other pair that meets is recomputed from the original vectors in double
precision. Only such recomputed pairs become links.

Pairs meet in bands: disjoint slices of the code, within equal labels. The
number of bands is chosen so that a pair exactly at the threshold misses all of
them with a probability below ``MISS`` (nearer pairs less). A pair that shares
several bands counts in the first one only. A band bucket of more than
``BLOCK`` rows is cut into blocks that meet two at a time, so no task holds more
than two blocks; equal vectors are one row throughout, with their number.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from collections.abc import Iterator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialize, worker_cache
from .vectors import cosines, distinct_vectors, matrix, norms

THRESHOLD = 0.98
MISS = 1e-7
SIGMAS = 6.0
BLOCK = 1024
BUCKET_ROWS = 256
SEED = 1


def band_plan(n: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """Bits a band and number of bands for ``n`` vectors.

    Unrelated vectors of a label fill buckets of about ``BUCKET_ROWS`` rows; the
    number of bands follows from the chance that a pair at the threshold agrees
    in all bits of a band.
    """
    bits = min(24, max(4, math.ceil(math.log2(max(2, n / BUCKET_ROWS)))))
    agree = 1 - math.acos(threshold) / math.pi
    return bits, max(1, math.ceil(math.log(miss) / math.log(1 - agree ** bits)))


def rotations(dims: int, code_bits: int, seed: int = SEED) -> np.ndarray:
    """Random orthonormal matrices of ``dims`` rows, stacked to ``code_bits`` rows or more."""
    rng = np.random.default_rng([seed, dims])
    parts = []
    for _ in range(-(-code_bits // dims)):
        q, r = np.linalg.qr(rng.normal(size=(dims, dims)))
        parts.append((q * np.sign(np.diag(r))).T)
    return np.concatenate(parts)


def encode(unit: np.ndarray, turn: np.ndarray):
    """Signs of the turned rows and the correction factors ``<x, code point of x>``."""
    coords = unit @ turn.T
    signs = coords > 0
    return signs, np.abs(coords).sum(1) / np.sqrt(len(turn)) / np.sqrt(len(turn) / unit.shape[1])


def estimate(signs: np.ndarray, factor: np.ndarray, turned: np.ndarray, dims: int):
    """Estimates of all cosines between coded rows and turned rows, and the spread per coded row."""
    width = signs.shape[1]
    copies = width / dims
    points = np.where(signs, np.float32(1), np.float32(-1)) / np.float32(np.sqrt(width) * np.sqrt(copies))
    est = (points @ turned.T.astype(np.float32)) / factor[:, None].astype(np.float32)
    spread = np.sqrt(np.maximum(0.0, 1 - factor ** 2) / factor ** 2 / max(1, dims - 1))
    return est, spread


def band_keys(signs: np.ndarray, bits: int, bands: int) -> np.ndarray:
    weights = 1 << np.arange(bits, dtype=np.int64)
    return signs[:, :bits * bands].reshape(len(signs), bands, bits) @ weights


def linked_pairs(left: dict, right: dict, same: bool, band: int, threshold: float):
    """Index pairs of rows that link, and which of them this band counts."""
    est, spread = estimate(left["signs"], left["factor"], right["turned"], left["x"].shape[1])
    maybe = est + (SIGMAS * spread)[:, None] >= threshold
    if same:
        maybe = np.triu(maybe, 1)
    i, j = np.nonzero(maybe)
    keep_i, keep_j = [i[:0]], [j[:0]]
    for s in range(0, len(i), 1 << 17):
        a, b = i[s:s + (1 << 17)], j[s:s + (1 << 17)]
        ok = cosines(left["x"][a], right["x"][b], left["norm"][a], right["norm"][b]) >= threshold
        keep_i.append(a[ok])
        keep_j.append(b[ok])
    i, j = np.concatenate(keep_i), np.concatenate(keep_j)
    earlier = np.zeros(len(i), dtype=bool)
    for k in range(band):
        earlier |= left["keys"][i, k] == right["keys"][j, k]
    return i, j, ~earlier


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For ``n`` rows the smallest row number reachable over the index pairs."""
    low = np.arange(n)
    while len(i):
        before = low.copy()
        m = np.minimum(low[i], low[j])
        np.minimum.at(low, i, m)
        np.minimum.at(low, j, m)
        low = low[low]
        if (low == before).all():
            break
    return low


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding",
                    label: str = "label", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every id of ``rows``.

    Two ids link when their labels are equal and not null and the cosine of
    their vectors reaches ``threshold``. Vectors that are null, empty, zero, or
    hold null or non-finite components, rows with a null label, and vectors of
    different length link with nothing; such ids are their own component. Rows
    with a null id are left out, equal rows of one id count once, and an id
    with several vectors has the links of all. Empty input gives no rows.
    """
    ids = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id")).distinct()
    clean = distinct_vectors(rows.where(F.col(label).isNotNull()), id_col, vector, label).select(
        F.col(id_col).cast("long").alias("id"), F.col(label).cast("string").alias("label"),
        F.col(vector).cast("array<double>").alias("v"))
    members = materialize(clean.withColumn("digest", F.sha2(F.concat_ws(
        "|", "label", F.array_join(F.transform("v", lambda x: (x + F.lit(0.0)).cast("string")), ",")), 256)), "vec")
    classes = materialize(members.groupBy("digest").agg(
        F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"),
        F.first("v").alias("v")).withColumn("dims", F.size("v")), "vec-class")
    n = classes.count()
    bits, bands = band_plan(n, threshold)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column(4).to_numpy()
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                turn = turns.setdefault(int(d), rotations(int(d), bits * bands))
                x = matrix(part.column(3))
                signs, factor = encode(x / norms(x)[:, None], turn)
                keys = band_keys(signs, bits, bands)
                code = np.packbits(signs, axis=1)
                for at in range(bands):
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), part.column(1), part.column(2), part.column(4), part.column(3),
                         pa.array([c.tobytes() for c in code], pa.binary()), pa.array(factor, pa.float64()),
                         pa.array(np.full(len(x), at), pa.int32()), pa.array(keys[:, at], pa.int64())],
                        names=["rep", "copies", "label", "dims", "v", "code", "factor", "band", "key"])

    banded = classes.select("rep", "copies", "label", "v", "dims").mapInArrow(
        coded, "rep long, copies long, label string, dims int, v array<double>, code binary, "
               "factor double, band int, key long")
    where = ["label", "dims", "band", "key"]
    # How many rows meet in a bucket; buckets of one row hold no pair.
    banded = materialize(banded, "vec-band")
    sizes = banded.groupBy(*where).agg(F.count(F.lit(1)).alias("size")).where("size > 1").withColumn(
        "blocks", F.ceil(F.col("size") / F.lit(block)).cast("int"))
    own = F.pmod(F.xxhash64("rep", "band"), F.col("blocks").cast("long")).cast("int")
    dealt = (banded.join(sizes, where).withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .withColumn("t1", F.least("own", "other")).withColumn("t2", F.greatest("own", "other"))
             .drop("size", "blocks", "other"))

    def tile(table: pa.Table) -> pa.Table:
        x = matrix(table["v"])
        dims = x.shape[1]
        norm = norms(x)
        turn = worker_cache(("turn", dims, bits * bands), lambda: rotations(dims, bits * bands))
        width = len(turn)
        signs = np.unpackbits(np.frombuffer(b"".join(table["code"].to_pylist()), dtype=np.uint8)
                              .reshape(len(x), -1), axis=1)[:, :width].astype(bool)
        part = {"x": x, "norm": norm, "signs": signs, "factor": table["factor"].to_numpy(),
                "turned": (x / norm[:, None]) @ turn.T, "keys": band_keys(signs, bits, bands)}
        band, own_ = int(table["band"][0].as_py()), table["own"].to_numpy()
        t1, t2 = table["t1"][0].as_py(), table["t2"][0].as_py()
        if t1 == t2:
            i, j, counts = linked_pairs(part, part, True, band, threshold)
        else:
            a, b = np.flatnonzero(own_ == t1), np.flatnonzero(own_ == t2)
            left, right = ({k: v[s] for k, v in part.items()} for s in (a, b))
            i, j, counts = linked_pairs(left, right, False, band, threshold)
            i, j = a[i], b[j]
        rep, copies = table["rep"].to_numpy(), table["copies"].to_numpy()
        order = np.argsort(rep, kind="stable")
        rank = np.empty(len(rep), dtype=np.int64)
        rank[order] = np.arange(len(rep))
        low = rep[order][forest(len(rep), rank[i], rank[j])][rank]
        links = np.bincount(i[counts], copies[j[counts]], len(rep)) + \
            np.bincount(j[counts], copies[i[counts]], len(rep))
        some = (links > 0) | (low != rep)
        return pa.table({"rep": pa.array(rep[some], pa.int64()),
                         "links": pa.array(links[some].astype(np.int64), pa.int64()),
                         "low": pa.array(low[some], pa.int64())})

    found = materialize(dealt.groupBy(*where, "t1", "t2").applyInArrow(
        tile, "rep long, links long, low long"), "vec-links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    # An id with several vectors belongs to several classes; it ties them together.
    ties = members.join(classes.select("digest", "rep"), "digest").select(
        F.col("id").alias("a"), F.col("rep").alias("b")).where("a <> b")
    joined = components(found.where("rep <> low").select(F.col("rep").alias("a"), F.col("low").alias("b")).union(ties))
    per_id = (members.join(classes.select("digest", "rep", "copies"), "digest").join(links, "rep", "left")
              .groupBy("id").agg(F.sum(F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    return (ids.join(per_id.withColumnRenamed("id", "vec_id"), "vec_id", "left")
            .join(joined.withColumnRenamed("id", "vec_id"), "vec_id", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
                    F.coalesce("component", "vec_id").alias("component_id"))
            .withColumn("kept", F.col("vec_id") == F.col("component_id")))
