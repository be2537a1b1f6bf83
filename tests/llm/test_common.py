import random

import pyarrow as pa
from pyspark.sql import functions as F

from shardwise.llm import common

from .helpers import components


def test_running_before_equals_a_loop(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["a", None, "hot", "hot", "hot"]), i, rnd.randrange(9)) for i in range(700)] + [("a", 5, 1)] * 3
    df = spark.createDataFrame(rows, "k STRING, id LONG, w LONG").withColumn("d", F.md5(F.col("id").cast("string")))
    for cells in (1, 50, 5000):
        got = common.running_before(df, ["k"], "d", ["id", "w"], F.col("w"), "b", len(rows), cells).collect()
        assert len(got) == len(rows)
        by = {}
        for r in got:
            by.setdefault(r["k"], []).append((r["d"], r["id"], r["w"], r["b"]))
        for items in by.values():
            total = 0
            for _, _, w, b in sorted(items):
                assert b == total
                total += w


def test_components_of_chains_stars_and_random_edges(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 620)] + [
        (rnd.randrange(1000, 1200), rnd.randrange(1000, 1200)) for _ in range(150)] + [(7, 7), (9, 8), (8, 9)]
    got = {r["id"]: r["component"] for r in common.components(
        spark.createDataFrame(edges, "a LONG, b LONG")).collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    want = components(nodes, [e for e in edges if e[0] != e[1]])
    assert got == want


def test_components_of_no_edges(spark):
    assert common.components(spark.createDataFrame([], "a LONG, b LONG")).count() == 0


def test_materialize_keeps_the_schema(spark):
    df = spark.range(0).selectExpr("id", "cast(null as string) as s")
    back = common.materialize(df, "t")
    assert back.count() == 0 and back.columns == ["id", "s"]


def test_arrow_rows_bounds_what_a_worker_is_handed(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    given = spark.conf.get(common.ARROW_ROWS)
    with common.arrow_rows(spark, 100):
        got = [r["n"] for r in spark.range(0, 1050, 1, 1).mapInArrow(sizes, "n long").collect()]
        with common.arrow_rows(spark, 500):
            assert spark.conf.get(common.ARROW_ROWS) == "100"
    assert sum(got) == 1050 and max(got) == 100
    assert spark.conf.get(common.ARROW_ROWS) == given
