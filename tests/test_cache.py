"""Read-through cache: known objects are not read again, changed ones are."""

import os
import warnings

import pytest

from shardwise import ShardedDataset


def put(folder, name, rows, when):
    path = os.path.join(folder, name)
    with open(path, "w") as f:
        f.write("a,b\n" + "".join(f"{a},{b}\n" for a, b in rows))
    os.utime(path, (when, when))
    return path


def read(spark, folder, cache, schema="a BIGINT, b STRING", **options):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        data = ShardedDataset(spark, f"{folder}/*.csv", header=True, schema=schema, cache=cache, **options)
    return data, [tuple(r) for r in data.table().orderBy("row_idx").select("row_idx", "0", "1").collect()]


def garble(path, when):
    """Other bytes under the same length and time: only a read of the source would show them."""
    size = os.path.getsize(path)
    with open(path, "w") as f:
        f.write("?" * size)
    os.utime(path, (when, when))


@pytest.mark.parametrize("multiline", [False, True])
@pytest.mark.parametrize("schema", ["a BIGINT, b STRING", None])
def test_second_read_touches_no_source_and_changes_are_read(spark, tmpdir_path, multiline, schema):
    folder, cache = os.path.join(tmpdir_path, "in put"), os.path.join(tmpdir_path, "cache")
    os.makedirs(folder)
    one = put(folder, "1.csv", [(i, f"x{i}") for i in range(5)], 1000)
    put(folder, "2.csv", [], 1000)
    three = put(folder, "3.csv", [(i, f"y{i}") for i in range(5, 9)], 1000)
    want = [(i, i, f"x{i}" if i < 5 else f"y{i}") for i in range(9)]
    _, got = read(spark, folder, cache, schema, multiline=multiline)
    assert got == want
    garble(one, 1000)
    garble(three, 1000)
    data, got = read(spark, folder, cache, schema, multiline=multiline)
    assert got == want
    ranged = sorted(tuple(r) for r in data.read_range(4, 7).select("row_idx", "0", "1").collect())
    assert ranged == want[4:7]
    # One object changes: it alone is read again, the garbled first one is not.
    if schema is not None:
        put(folder, "3.csv", [(7, "new"), (8, "newer")], 2000)
        _, got = read(spark, folder, cache, schema, multiline=multiline)
        assert got == [*want[:5], (5, 7, "new"), (6, 8, "newer")]
        # Another way of reading is another entry: now the garbled source shows.
        put(folder, "1.csv", [(1, "z")], 3000)
        _, got = read(spark, folder, cache, "a STRING, b STRING", multiline=multiline)
        assert got == [(0, "1", "z"), (1, "7", "new"), (2, "8", "newer")]


def test_objects_without_rows_and_a_failed_fill(spark, tmpdir_path, monkeypatch):
    folder, cache = os.path.join(tmpdir_path, "in"), os.path.join(tmpdir_path, "cache")
    os.makedirs(folder)
    put(folder, "1.csv", [], 1000)
    assert read(spark, folder, cache)[1] == []
    assert read(spark, folder, cache)[1] == []
    put(folder, "2.csv", [(1, "x")], 1000)
    from shardwise.sources import cache as module

    with monkeypatch.context() as m:
        m.setattr(module, "literal_rows", lambda *a: 1 / 0)  # dies before the index is published
        with pytest.raises(ZeroDivisionError):
            read(spark, folder, cache)
    assert read(spark, folder, cache)[1] == [(0, 1, "x")]


def test_an_object_that_changes_while_it_is_read_is_not_published(spark, tmpdir_path, monkeypatch):
    folder, cache = os.path.join(tmpdir_path, "in"), os.path.join(tmpdir_path, "cache")
    os.makedirs(folder)
    put(folder, "1.csv", [(1, "old")], 1000)
    from shardwise.sources import cache as module

    real, calls = module.object_statuses, []

    def changing(spark_, glob):
        calls.append(glob)
        if len(calls) == 2:  # after the fill, before it is published
            put(folder, "1.csv", [(1, "new"), (2, "newer")], 2000)
        return real(spark_, glob)

    monkeypatch.setattr(module, "object_statuses", changing)
    assert read(spark, folder, cache)[1] == [(0, 1, "new"), (1, 2, "newer")]
    assert len(calls) == 5
