"""Contract columns, oracles, and the pipeline stage by stage."""

import importlib
import inspect

import pytest

import __spark_entry__ as E
import corpus_pipeline
from shardwise.llm import langid, line_dedup, mixing, nearest, ngram_join, near_vectors, queries
from shardwise.llm.common import materialize, table

from ..conftest import TESTDATA
from ..oracle_check import duck, frame_rows
from .helpers import deduped_lines, jaccard_components
from .test_models import check_packing

SF = f"{TESTDATA}/sf0.001"
COLUMNS = {
    "op1_": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op2_": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op3_": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op4_": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint",
             "base_sha256": "string", "spans": "string"},
    "op5_": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op6_": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op7_": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint",
             "sequence_id": "bigint", "offset": "bigint"},
    "op8_": {"doc_id": "bigint", "n_lines": "bigint", "n_dropped": "bigint", "kept_sha256": "string"},
    "op9_": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op10_": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op11_": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op12_": {"doc_id": "bigint", "n_a": "bigint", "n_b": "bigint", "n_groups": "bigint", "n_links": "bigint",
              "n_best": "bigint", "count_sum": "bigint", "groups_sha256": "string"},
    "op13_": {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint",
              "positive_score": "bigint", "negative_score": "bigint"},
}


@pytest.mark.parametrize("prefix", COLUMNS)
def test_contract_columns_and_rows(spark, prefix):
    name = next(n for n in E.queries() if n.startswith(prefix))
    df = E.queries()[name](spark, SF)
    kinds = dict(df.dtypes)
    assert {c: kinds.get(c) for c in COLUMNS[prefix]} == COLUMNS[prefix]
    rows = df.count()
    if prefix not in ("op3_", "op7_", "op13_"):
        name = {"op1_": "embeddings", "op11_": "pages"}.get(prefix, "documents")
        assert rows == table(spark, SF, name).count()
    assert rows > 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_oracle(spark, name):
    got = frame_rows(E.queries()[name](spark, SF).toPandas())
    assert got == frame_rows(duck(SF).execute(queries.ORACLE_SQL[name]).df())


def test_native_operators_run_no_python_on_executors():
    for module in (mixing, line_dedup):
        source = inspect.getsource(module)
        for word in ("mapIn", "applyIn", "udf", "toPandas", ".rdd", "import pandas", "import numpy"):
            assert word not in source


def test_no_local_checkpoints_or_cross_joins():
    for name in ("common", "langid", "labelled", "line_dedup", "mixing", "near_vectors", "nearest", "ngram_join",
                 "packing", "quality", "queries", "secret_scan", "toxicity", "vectors"):
        source = inspect.getsource(importlib.import_module(f"shardwise.llm.{name}"))
        assert "localCheckpoint" not in source and "crossJoin" not in source


def test_pipeline_stages_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language ID", "line dedup", "n-gram Jaccard join", "mixing", "packing"]
    # Near copies that survive line dedup, and documents that language ID rejects.
    more = docs.limit(20).selectExpr("doc_id + 100000 as doc_id", "concat(replace(text, chr(10), ' '), ' tail') as text",
                                     "lang", "source", "n_chars")
    junk = spark.createDataFrame([(200001, None, "en", "s", None), (200002, "12 34 !", "en", "s", 7)], docs.schema)
    docs = materialize(docs.unionByName(more).unionByName(junk), "test-docs")

    def rows(df):
        return [(r["doc_id"], r["text"]) for r in df.collect()]

    kept = materialize(corpus_pipeline.language_id(spark, docs, SF), "t1")
    assert kept.columns == columns
    # Known trigrams of the learned rows, counted one by one.
    sample = langid.training_sample(docs.where(~langid.held_out(docs["doc_id"])))
    known = set(langid.known_trigrams(sample).tolist())
    letters = langid.Letters(langid.DIMS)
    stays = set()
    for d, text in rows(docs):
        found = langid.text_trigrams([text], letters)[0]
        if found is not None and 2 * sum(n for t, n in zip(*(f.tolist() for f in found)) if t in known) >= found[1].sum():
            stays.add(d)
    verdict = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs).collect()}
    assert sorted(d for d, _ in rows(kept)) == sorted(d for d in stays if verdict[d] != "und")
    assert not {200001, 200002} & {d for d, _ in rows(kept)}

    lines = materialize(corpus_pipeline.line_deduplication(spark, kept, SF), "t2")
    assert lines.columns == columns
    assert sorted(rows(lines)) == sorted((d, k) for d, (_, _, k) in deduped_lines(rows(kept)).items())

    single = materialize(corpus_pipeline.near_duplicates(spark, lines, SF), "t3")
    assert single.columns == columns
    assert sorted(d for d, _ in rows(single)) == sorted(d for d, _, c in jaccard_components(rows(lines)) if d == c)

    mixed = materialize(corpus_pipeline.source_mix(spark, single, SF), "t4")
    assert mixed.columns == columns
    wanted = {r["doc_id"]: r for r in mixing.mix_report(single).collect()}
    copies = {}
    for d, _ in rows(mixed):
        copies[d] = copies.get(d, 0) + 1
    for d, r in wanted.items():
        assert abs(copies.get(d, 0) * r["size"] - r["taken"]) <= r["size"] / 2

    packed = corpus_pipeline.packed_sequences(spark, mixed, SF).collect()
    used, bound = check_packing(rows(mixed), packed)
    assert used <= 1.05 * bound + 1


# Names that operators use for working columns, or did.
CLASHES = ("given", "file", "place", "id", "size", "before", "at", "copy", "copies", "gone", "lines", "pos", "digest",
           "leads", "component", "component_id", "class", "lang_pred", "score", "share", "row", "n", "h1", "target",
           "__at", "__size", "__rn", "__id", "__lines", "__lang", "__share", "gone_id", "_metadata")


def test_stages_carry_columns_of_any_name(spark):
    docs = table(spark, SF, "documents").limit(60)
    docs = materialize(docs.selectExpr("*", *[f"777 + {i} as {name}" for i, name in enumerate(CLASHES)]), "test-clash")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = materialize(stage(spark, docs, SF), "test-stage")
        assert out.columns == docs.columns
        values = {tuple(r) for r in out.select(*CLASHES).collect()}
        assert values == {tuple(777 + i for i in range(len(CLASHES)))}, name


def test_pipeline_of_an_empty_table(spark, tmpdir_path):
    table(spark, SF, "documents").where("false").write.parquet(f"{tmpdir_path}/documents.parquet")
    assert corpus_pipeline.run(spark, tmpdir_path).count() == 0


def test_operators_keep_their_general_interface(spark):
    emb = table(spark, SF, "embeddings").selectExpr("vec_id as key", "embedding as v", "label as grp")
    near = near_vectors.near_duplicates(emb, "key", "v", "grp", threshold=0.9)
    assert near.count() == emb.count()
    assert nearest.search(emb, emb["key"] == 3, k=2, id_col="key", vector="v").count() == 2
    docs = table(spark, SF, "documents").selectExpr("doc_id as key", "text as body")
    assert ngram_join.join_documents(docs, "body", "key").count() == docs.count()
