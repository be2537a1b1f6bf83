import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shardwise.functions.rowindex import with_row_index
from shardwise.operators import shards as sh


def reference_feed(n, s, r, w, m):
    """Brute force of the reference iterator: positions of worker w's first m shards, mod n."""
    out = []
    start = w * s
    for _ in range(m):
        out.append([p % n for p in range(start, start + s)])
        start += r * s
    return out


def collect_feed(df, worker):
    rows = df.where(F.col("worker") == worker).select("step", "pos", "row_idx").collect()
    by_step = {}
    for row in rows:
        by_step.setdefault(row["step"], {})[row["pos"]] = row["row_idx"]
    return [[by_step[k][p] for p in sorted(by_step[k])] for k in sorted(by_step)]


def indexed(spark, n):
    return spark.range(n).withColumnRenamed("id", "row_idx")


def test_resolve_sizes():
    assert sh.resolve_sizes(4, None) == (4, 4)
    assert sh.resolve_sizes(None, 3) == (3, 3)
    with pytest.warns(UserWarning):
        assert sh.resolve_sizes(8, 2) == (2, 2)
    with pytest.raises(ValueError):
        sh.resolve_sizes(None, None)
    with pytest.raises(ValueError):
        sh.resolve_sizes(0, None)
    with pytest.raises(ValueError):
        sh.resolve_sizes(2.5, None)


def test_validate_worker_and_range():
    sh.validate_worker(1, 2, 4)
    with pytest.raises(ValueError):
        sh.validate_worker(2, 2, 4)
    with pytest.raises(ValueError):
        sh.validate_worker(-1, 2, 4)
    with pytest.raises(ValueError):
        sh.validate_worker(0, 2, None)
    sh.check_range(10, 0, 9)
    with pytest.raises(ValueError):
        sh.check_range(10, 0, 10)


def test_wrap_example(spark):
    # N=10, s=4, r=2, M=3: worker 0 gets [0-3], [8,9,0,1], [6-9]; worker 1 [4-7], [2-5], [0-3].
    df = sh.assign_shards(indexed(spark, 10), 10, 4, 2, 3)
    assert collect_feed(df, 0) == [[0, 1, 2, 3], [8, 9, 0, 1], [6, 7, 8, 9]]
    assert collect_feed(df, 1) == [[4, 5, 6, 7], [2, 3, 4, 5], [0, 1, 2, 3]]


def test_oversize_shard_repeats_rows(spark):
    df = sh.assign_shards(indexed(spark, 3), 3, 7, 1, 2)
    assert collect_feed(df, 0) == reference_feed(3, 7, 1, 0, 2)


def test_zero_max_shards_is_empty(spark):
    assert sh.assign_shards(indexed(spark, 5), 5, 2, 1, 0).count() == 0
    with pytest.raises(ValueError):
        sh.assign_shards(indexed(spark, 5), 5, 2, 1, None)


def test_first_step_window_equals_full_plan(spark):
    full = sh.assign_shards(indexed(spark, 23), 23, 5, 3, 6)
    part = sh.assign_shards(indexed(spark, 23), 23, 5, 3, 2, first_step=3)
    a = sorted(tuple(r) for r in full.where("step >= 3 and step < 5").collect())
    b = sorted(tuple(r) for r in part.collect())
    assert a == b


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(n=st.integers(1, 40), s=st.integers(1, 25), r=st.integers(1, 4), m=st.integers(1, 4))
def test_property_matches_reference_iterator(spark, n, s, r, m):
    df = sh.assign_shards(indexed(spark, n), n, s, r, m).cache()
    # each (worker, step) has exactly s rows; positions are covered once
    sizes = {(x["worker"], x["step"]): x["c"] for x in df.groupBy("worker", "step").agg(F.count("*").alias("c")).collect()}
    assert len(sizes) == r * m and set(sizes.values()) == {s}
    for w in range(r):
        assert collect_feed(df, w) == reference_feed(n, s, r, w, m)
    df.unpersist()


def test_slice_rows(spark):
    idx = indexed(spark, 10)
    assert [r["row_idx"] for r in sh.slice_rows(idx, 10, 3, 6).orderBy("seq").collect()] == [3, 4, 5]
    assert [r["row_idx"] for r in sh.slice_rows(idx, 10, 8, 2).orderBy("seq").collect()] == [8, 9, 0, 1]


def brute_read_spec(objs, start, end):
    """Reference read spec on a list of (id, start_idx, end_idx)."""
    first = next(i for i, (_, a, b) in enumerate(objs) if a <= start < b)
    last = max(i for i, (_, a, b) in enumerate(objs) if a <= end <= b)
    out = []
    if end > start:
        for _, a, b in objs[first:last + 1]:
            skip = max(0, start - a)
            out.append((skip, min(b, end) - (a + skip)))
    else:
        for _, a, b in objs[first:]:
            skip = max(0, start - a)
            out.append((skip, b - (a + skip)))
        for _, a, b in objs[:last + 1]:
            out.append((0, min(b, end) - a))
    return out


@pytest.mark.parametrize("start,end", [(0, 5), (2, 9), (5, 9), (4, 5), (7, 3), (9, 5), (3, 0), (5, 5)])
def test_read_spec_against_brute_force(spark, start, end):
    counts = [(0, 5), (1, 0), (2, 4), (3, 1)]  # an empty object between two others
    objs, total = [], 0
    for i, c in counts:
        objs.append((i, total, total + c))
        total += c
    man = spark.createDataFrame(objs, "id INT, start_idx BIGINT, end_idx BIGINT")
    got = [(r["skiprows"], r["numrows"]) for r in sh.read_spec(man, total, start, end).orderBy("seq").collect()]
    assert got == brute_read_spec(objs, start, end)


def test_read_spec_rows_add_up(spark):
    objs = [(0, 0, 4), (1, 4, 9), (2, 9, 12)]
    man = spark.createDataFrame(objs, "id INT, start_idx BIGINT, end_idx BIGINT")
    spec = sh.read_spec(man, 12, 10, 6).collect()
    assert sum(r["numrows"] for r in spec) == 12 - 10 + 6


def test_shard_positions():
    assert sh.shard_positions(10, 8, 4) == [(8, 2)]
    assert sh.shard_positions(3, 0, 7) == [(0, 0), (0, 0), (0, 1)]


def test_shards_on_indexed_table(spark):
    df = spark.createDataFrame([(k, f"v{k}") for k in (30, 10, 20, 40, 50)], "k LONG, v STRING")
    idx, n = with_row_index(df, "k", return_count=True)
    out = sh.shard(idx, n, 2, step=1, worker=0, replicas=2)
    # positions 4, 5 -> rows 4, 0 (wrap): keys 50, 10
    assert [r["k"] for r in out.collect()] == [50, 10]


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(n=st.integers(2, 40), s=st.integers(1, 15), r=st.integers(2, 4), m=st.integers(1, 4),
       first=st.integers(0, 3))
def test_single_worker_filter_keeps_exactly_its_rows(spark, n, s, r, m, first):
    full = sh.assign_shards(indexed(spark, n), n, s, r, m, first_step=first)
    for w in range(r):
        one = sh.assign_shards(indexed(spark, n), n, s, r, m, worker=w, first_step=first)
        a = sorted(tuple(x) for x in full.where(F.col("worker") == w).collect())
        b = sorted(tuple(x) for x in one.collect())
        assert a == b
