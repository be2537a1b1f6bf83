"""N-gram join, line dedup and mixing against brute force."""

import random

import numpy as np
import pytest

from shardwise.llm import line_dedup, mixing, ngram_join

from .helpers import deduped_lines, docs_frame, jaccard_components, sha


def words(rnd, n, size=40):
    return " ".join(f"w{rnd.randrange(size)}" for _ in range(n))


def corpus(seed=1):
    rnd = random.Random(seed)
    passage = words(rnd, 60, 4000)
    rows = []
    for _ in range(25):
        base = words(rnd, rnd.choice([3, 8, 40, 120]), 5000)
        if rnd.random() < 0.5:
            base = base + " " + passage
        for _ in range(rnd.choice([1, 1, 2, 6])):
            w = base.split(" ")
            for _ in range(rnd.choice([0, 0, 1, 2, 5])):
                w[rnd.randrange(len(w))] = f"e{rnd.randrange(10**6)}"
            text = " ".join(w)
            rows.append((len(rows) * 3 + 1, text.upper() if rnd.random() < 0.3 else text.replace(" ", " \t\n", 3)))
    rows += [(1001, None), (1002, ""), (1003, " \n "), (1004, "one two"), (1005, "ONE\x0btwo"), (1006, "one two "),
             (1007, "É two three four five"), (1008, "é two three four five"), (1009, "a b c d e f")]
    rows += [(2000 + i, passage + f" tail{i % 3}") for i in range(12)]
    return rows


@pytest.mark.parametrize("entries", [200, 1 << 21])
def test_ngram_join_equals_all_pairs(spark, monkeypatch, entries):
    monkeypatch.setattr(ngram_join, "ROW_BLOCK_ENTRIES", entries)
    rows = corpus()
    got = ngram_join.join_documents(docs_frame(spark, rows)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == jaccard_components(rows)


def test_threshold_is_met_exactly(spark):
    # sets of 9 and 9 shingles sharing 8 of 10 (0.8 exactly), and 8 of 11
    a = " ".join(f"x{i}" for i in range(13))
    b = " ".join(f"x{i}" for i in range(12)) + " y"
    c = "z " + " ".join(f"x{i}" for i in range(1, 12)) + " y y2"
    rows = [(1, a), (2, b), (3, c)]
    got = ngram_join.join_documents(docs_frame(spark, rows)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == jaccard_components(rows)


def test_ngram_join_of_repeated_rows_null_ids_and_nothing(spark):
    text = "a b c d e f g"
    rows = [(5, text), (5, text), (None, text), (9, text), (7, None), (None, None)]
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]))
                 for r in ngram_join.join_documents(docs_frame(spark, rows)).collect())
    assert got == [("5", 3, "5"), ("5", 3, "5"), ("7", 0, "7"), ("9", 3, "5"), ("None", 0, "None"), ("None", 3, "5")]
    kept = ngram_join.keep_one(docs_frame(spark, rows))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["5", "7", "None"]
    assert kept.columns == docs_frame(spark, rows).columns
    assert ngram_join.join_documents(docs_frame(spark, rows).where("false")).count() == 0


def test_one_row_of_each_group_stays(spark):
    words = [" ".join(f"{c}{i}" for i in range(30)) for c in "abcde"]
    rows = [(5, words[0]), (5, words[1]), (None, words[2]), (None, words[2] + " more"), (None, words[3]),
            (3, words[3]), (6, words[0] + " more"), (8, words[4]), (8, words[4]), (9, ""), (9, ""), (None, None)]
    kept = sorted(((r["doc_id"], r["text"]) for r in ngram_join.keep_one(docs_frame(spark, rows)).collect()), key=repr)
    thirds = [k for k in kept if k[1] in (words[2], words[2] + " more")]
    assert len(thirds) == 1 and thirds[0][0] is None
    rest = [k for k in kept if k not in thirds]
    assert rest == sorted([(5, words[0]), (5, words[1]), (3, words[3]), (8, words[4]), (9, ""), (9, ""), (None, None)],
                          key=repr)


def passages(n, k, seed=3):
    """Documents of two of ``k`` shared passages and words of their own."""
    rnd = random.Random(seed)
    pool = [" ".join(f"p{i}w{j}" for j in range(40)) for i in range(k)]
    rows = []
    for i in range(n):
        a, b = rnd.sample(pool, 2)
        own = " ".join(f"o{i}x{j}" for j in range(rnd.choice([2, 2, 6, 30])))
        rows.append((i, f"{a} {b} {own}" if rnd.random() < 0.8 else f"{a} {own} {b}"))
    return rows


def test_documents_of_shared_passages(spark):
    rows = passages(150, 5) + [(1000 + i, t) for i, (_, t) in enumerate(passages(20, 5, 4))]
    got = ngram_join.join_documents(docs_frame(spark, rows)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == jaccard_components(rows)


def test_shared_passages_give_few_rows_and_columns(spark):
    sizes = []
    for n in (200, 400):
        sets = ngram_join.candidates(ngram_join.incidence(docs_frame(spark, passages(n, 5)), "text", "doc_id"))
        matrix = ngram_join.weighted_columns(sets)
        sizes.append(matrix.count())
    assert sizes[1] <= 1.2 * sizes[0] + 10


def test_dropping_many_lines_of_one_text_is_linear(spark):
    import time

    def seconds(n):
        text = "\n".join(f"a repeated line number {i % (n // 2)}" for i in range(n))
        df = docs_frame(spark, [(1, text), (2, text + "\nlast")])
        start = time.perf_counter()
        got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"])
               for r in line_dedup.dedup_report(df).collect()}
        assert got == {1: (n, 0, sha(text)), 2: (n + 1, n, sha("last"))}
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(200_000) < 30


def test_mixing_of_null_and_repeated_ids(spark):
    rows = [(None, f"text number {i} " * 3, "en", "a") for i in range(50)] + [(7, f"other {i}", "en", "a") for i in range(50)]
    got = mixing.mix_report(docs_frame(spark, rows)).collect()
    assert len(got) == 100 and abs(sum(r["taken"] for r in got) - got[0]["target"]) < 1
    assert len({r["position"] for r in got if r["taken"]}) > 60


def test_a_large_group_of_near_copies(spark):
    rnd = random.Random(8)
    base = [f"q{i}" for i in range(200)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(2):
            w[rnd.randrange(200)] = f"r{rnd.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = ngram_join.join_documents(docs_frame(spark, rows)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == jaccard_components(rows)


LINES = ["", "short", "  A common line of text  ", "a COMMON line of text", "a long line number one", "tiny",
         "x" * 9, "x" * 10, "Ünïcode línes are kept apart", "ünïcode línes are kept apart", "tab\tinside is kept \r"]


def line_rows(seed=3):
    rnd = random.Random(seed)
    rows = [(i * 2, "\n".join(rnd.choice(LINES + [f"own line of document {i}"]) for _ in range(rnd.randrange(1, 12))))
            for i in range(40)]
    return rows + [(101, None), (103, ""), (105, "\n\n"), (107, "a common line of text\na common line of text")]


@pytest.mark.parametrize("batches, fanout", [(1, 2), (4, 2), (9, 3)])
def test_line_dedup_equals_a_loop(spark, batches, fanout):
    from pyspark.sql import functions as F

    rows = line_rows()
    out = line_dedup.drop_lines(docs_frame(spark, rows), batches=batches, fanout=fanout).select(
        "doc_id", F.size("__lines").alias("n"), F.array_join("__kept", "\n").alias("kept"))
    want = deduped_lines(rows)
    assert {r["doc_id"]: (r["n"], r["kept"]) for r in out.collect()} == {d: (n, k) for d, (n, _, k) in want.items()}


def test_line_dedup_report_and_odd_rows(spark):
    rows = line_rows()
    want = {d: (n, g, sha(k)) for d, (n, g, k) in deduped_lines(rows).items()}
    got = line_dedup.dedup_report(docs_frame(spark, rows))
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in got.collect()} == want
    odd = [(None, "a line of no document"), (3, "a line of no document"), (3, "a line of no document"),
           (8, "a line of no document\nrest")]
    out = line_dedup.dedup_documents(docs_frame(spark, odd))
    assert sorted((str(r["doc_id"]), r["text"], r["n_chars"]) for r in out.collect()) == [
        ("3", "a line of no document", 21), ("3", "a line of no document", 21), ("8", "rest", 4),
        ("None", "a line of no document", 21)]
    assert out.columns == docs_frame(spark, odd).columns
    assert line_dedup.dedup_report(docs_frame(spark, odd).where("false")).count() == 0


def test_runs_stay_few(spark):
    runs = line_dedup.Runs(spark, fanout=2)
    for i in range(5):
        runs.add(spark.range(i * 10, i * 10 + 10).selectExpr("id as h1", "id as h2"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert sum(t.count() for t in runs.tables()) == 50
    runs.close()
    assert not spark.catalog.listTables() or all("line_run" not in t.name for t in spark.catalog.listTables())


def mix_rows(seed=5):
    rnd = random.Random(seed)
    names = ["b", None, "a", "é", "big", "big", "big"]
    rows = [(i, " ".join("w" * 3 for _ in range(rnd.randrange(0, 60))), "en", rnd.choice(names)) for i in range(200)]
    return rows + [(900, None, "en", "a"), (901, "", "en", "empty")]


def test_mix_meets_its_targets(spark):
    rows = mix_rows()
    got = mixing.mix_report(docs_frame(spark, rows)).collect()
    assert len(got) == len(rows)
    source = {r[0]: r[3] for r in rows}
    sizes, taken, target = {}, {}, {}
    for r in got:
        s = source[r["doc_id"]]
        assert r["taken"] <= 2 * r["size"] and (r["taken"] == 0) == (r["position"] is None)
        sizes[s] = sizes.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
        target[s] = r["target"]
        assert r["position"] is None or 0 <= r["position"] <= 1
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    # Shares by repeated resharing, as the contract words it.
    want, left, open_ = dict.fromkeys(order, 0.0), 1.5 * sum(sizes.values()), set(order)
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / total for s in open_}
        left = 0.0
        for s, x in share.items():
            want[s] += x
            if want[s] >= 2 * sizes[s]:
                left += want[s] - 2 * sizes[s]
                want[s] = 2.0 * sizes[s]
                open_.discard(s)
    for s in order:
        assert target[s] == pytest.approx(want[s], abs=1e-6)
        assert abs(taken[s] - target[s]) < 1


def test_mixing_twice_agrees_and_copies_follow_positions(spark):
    rows = mix_rows()
    a = [tuple(r) for r in mixing.mix_report(docs_frame(spark, rows, parts=2)).collect()]
    b = [tuple(r) for r in mixing.mix_report(docs_frame(spark, rows, parts=5)).collect()]
    assert a == b
    stream = mixing.mix(docs_frame(spark, rows))
    copies = {}
    for r in stream.collect():
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    for r in a:
        assert abs(copies.get(r[0], 0) * r[1] - r[4]) <= r[1] / 2 and copies.get(r[0], 0) <= 2
    assert stream.columns == docs_frame(spark, rows).columns
    assert mixing.mix(docs_frame(spark, rows).where("false")).count() == 0


def test_position_inverts_the_integrated_schedule(spark):
    from pyspark.sql import functions as F

    knots = ((0.0, 0.0), (0.25, 4.0), (0.5, 1.0), (1.0, 1.0))
    rows = spark.range(0, 101).withColumn("x", F.col("id") / 100.0).withColumn(
        "t", mixing.position(F.col("x"), F.lit(1), (knots,))).collect()
    for r in rows:
        done = 0.0
        for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
            u = min(max(r["t"] - t0, 0.0), t1 - t0)
            done += w0 * u + (w1 - w0) / (t1 - t0) * u * u / 2
        assert done / mixing.integral(knots) == pytest.approx(r["x"], abs=1e-9)


@pytest.mark.parametrize("n", [0, 1, 2, 5000])
def test_ngram_entries_come_back_from_their_bytes(n):
    rng = np.random.default_rng(n)
    h = np.sort(rng.integers(0, 2**64, n, dtype=np.uint64))
    if n > 2:
        h[1], h[-2] = h[0], h[-1]
    places = rng.integers(0, ngram_join.LOCAL + 1, n).astype(np.uint16)
    payload = ngram_join.packed(h, places)
    got_h, got_places = ngram_join.unpacked(payload)
    assert len(payload) == 10 * n
    assert got_h.tolist() == h.tolist() and got_places.tolist() == places.tolist()
