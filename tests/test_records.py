"""Quoted line breaks against Python's csv module, with objects cut into many splits."""

import csv
import io
import os
import random

import pytest

from shardwise.plans.dataset import ShardedDataset
from shardwise.sources import records as rec


@pytest.fixture()
def tiny_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], "64")
    spark.conf.set(names[1], "1")
    yield
    for n, v in zip(names, old):
        spark.conf.set(n, v)


def put(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w", newline="") as f:
        f.write(text)
    return f"file://{folder}/*.csv"


def in_order(df):
    return df.orderBy("__path", "__block", "__mid")


def random_csv(rnd, rows, end):
    out = io.StringIO()
    w = csv.writer(out, lineterminator=end)
    w.writerow(["id", "note", "text"])
    bits = ["a", ",", '"', '""', "\n", "\n\n", '",', ',"', "word ", '"\n', 'é', "long " * 9]
    want = []
    for i in range(rows):
        row = [str(i), *("x" + "".join(rnd.choice(bits) for _ in range(rnd.choice([0, 1, 4, 12]))) for _ in range(2))]
        want.append(row)
        w.writerow(row)
    return out.getvalue(), want


@pytest.mark.parametrize("seed,end", [(1, "\n"), (2, "\n"), (3, "\r\n")])
def test_records_of_many_splits_equal_the_csv_module(spark, tmpdir_path, tiny_splits, seed, end):
    rnd = random.Random(seed)
    want = []
    for k in range(2):
        text, rows = random_csv(rnd, 40, end)
        glob = put(f"{tmpdir_path}/q", f"p{k}.csv", text)
        want += rows
    tagged = rec.tagged_records(spark, glob, schema="id STRING, note STRING, text STRING")
    assert tagged.select("__path", "__block").distinct().count() > 20
    assert [list(r)[:3] for r in in_order(tagged).collect()] == want
    data = ShardedDataset(spark, glob, multiline=True, stats_glob=False, shard_size=7,
                          schema="id STRING, note STRING, text STRING")
    assert (data.obj_count, data.row_count) == (2, 80)
    got = [list(r) for r in data.table().orderBy("row_idx").collect()]
    assert got == [[*r, i] for i, r in enumerate(want)]
    assert [r["1"] for r in data.read_range(70, 10).orderBy("seq").collect()] == [
        r[1] for r in want[70:] + want[:10]]


def test_one_record_over_several_splits(spark, tmpdir_path, tiny_splits):
    long = "\n".join(f"line {i}, still the same" for i in range(40))
    glob = put(f"{tmpdir_path}/o", "a.csv", f'"h\n1",h2\n1,"{long}"\n\n \n2,b\n')
    got = in_order(rec.records(spark, glob)).collect()
    assert [r["record"] for r in got] == [f'1,"{long}"', "2,b"]
    assert in_order(rec.records(spark, glob, header=None)).first()["record"] == '"h\n1",h2'


@pytest.mark.parametrize("line,outside,inside", [
    ("a,b", 0, 1), ('"a', 1, 0), ('5" pipe,x', 0, 0), ('5" pipe,"x', 1, 1), ('a,"', 1, 0), ('"a""', 1, 0),
    ('"a"","b', 0, 1), ('""', 0, 1), ('"', 1, 0), ('"a"b"c', 0, 0), ('x",y', 0, 0), ("", 0, 1), ('a,"b\r', 1, 0)])
def test_state_behind_a_line(spark, line, outside, inside):
    from pyspark.sql import functions as F

    row = spark.range(1).select(rec.state_behind(F.lit(line), 0), rec.state_behind(F.lit(line), 1)).first()
    assert (row[0], row[1]) == (outside, inside)


def test_types_are_found_and_open_quotes_refused(spark, tmpdir_path):
    glob = put(f"{tmpdir_path}/t", "a.csv", 'a,b,c,d\n1,2.5,"x, ""y""\nz",\n,3,5" pipe,8589934592\n')
    tagged = rec.tagged_records(spark, glob)
    assert [f.dataType.simpleString() for f in tagged.schema.fields[:4]] == ["int", "double", "string", "bigint"]
    assert [tuple(r)[:4] for r in in_order(tagged).collect()] == [
        (1, 2.5, 'x, "y"\nz', None), (None, 3.0, '5" pipe', 8589934592)]
    bad = put(f"{tmpdir_path}/u", "a.csv", 'a,b\n1,"never\nclosed\n')
    with pytest.raises(ValueError, match="still open"):
        rec.records(spark, bad)


def test_objects_without_records(spark, tmpdir_path):
    put(f"{tmpdir_path}/e", "a.csv", "")
    put(f"{tmpdir_path}/e", "b.csv", "a,b\n\n")
    glob = put(f"{tmpdir_path}/e", "c.csv", 'a,b\n"1\n",2')
    data = ShardedDataset(spark, glob, multiline=True, stats_glob=False, schema="a STRING, b INT")
    assert data.row_count == 1
    assert [list(r) for r in data.table().collect()] == [["1\n", 2, 0]]


@pytest.mark.parametrize("seed,end", [(4, "\n"), (5, "\r\n")])
def test_a_split_is_composed_in_stretches_of_few_lines(spark, tmpdir_path, monkeypatch, seed, end):
    rnd = random.Random(seed)
    want = []
    for k in range(2):
        text, rows = random_csv(rnd, 40, end)
        glob = put(f"{tmpdir_path}/s", f"p{k}.csv", text)
        want += rows
    # One split for each object, but groups of three lines, dealt over more partitions than Spark has.
    monkeypatch.setattr(rec, "STRETCH_LINES", 3, raising=False)
    monkeypatch.setattr(rec, "PARTITION_BYTES", 100, raising=False)
    states, kept = [], rec.written

    def spied(df, name):
        out = kept(df, name)
        if name == "csv-states":
            states.append(out)
        return out

    monkeypatch.setattr(rec, "written", spied)
    data = ShardedDataset(spark, glob, multiline=True, stats_glob=False, schema="id STRING, note STRING, text STRING")
    assert [list(r) for r in data.table().orderBy("row_idx").collect()] == [[*r, i] for i, r in enumerate(want)]
    assert states[0].select("path", "block").distinct().count() == 2
    groups = states[0].groupBy("path", "block", "stretch").count()
    assert groups.count() > 40 and groups.agg({"count": "max"}).first()[0] == 3
    assert len({os.path.basename(f).split("-")[1] for f in states[0].inputFiles()}) > 8


def test_parts_of_documents_follow_the_bytes_of_their_texts(spark, tmpdir_path, monkeypatch):
    from shardwise.plans import objects

    docs = [(i if i < 60 else 60, "en", f'{i} "quoted"\n' + "x" * 4000) for i in range(120)] + [(None, None, None)]
    spark.createDataFrame(docs, "doc_id BIGINT, lang STRING, text STRING").coalesce(1).write.parquet(
        f"{tmpdir_path}/documents.parquet")
    monkeypatch.setattr(objects, "BYTES_PER_PART", 20_000, raising=False)
    monkeypatch.setattr(objects, "scratch_path", lambda _, name: f"{tmpdir_path}/{name}")
    got = objects.q_csv_quoted_records(spark, tmpdir_path).orderBy("row_idx").collect()
    assert sorted(map(str, ([r["doc_id"], r["lang"], r["text"]] for r in got))) == sorted(str(list(r)) for r in docs)
    assert [r["doc_id"] for r in got] == [None, *(r[0] for r in docs[:-1])]
    assert [r["row_idx"] for r in got] == list(range(121))
    # Half of the rows have one doc_id: they are in several parts too, none with much more than its share.
    sizes = [os.path.getsize(os.path.join(f"{tmpdir_path}/quoted-parts", f))
             for f in os.listdir(f"{tmpdir_path}/quoted-parts") if f.startswith("part-")]
    assert len(sizes) > 20 and max(sizes) < 3 * 20_000
