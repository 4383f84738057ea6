"""The registered queries: SQL checks where there are any, and the pipeline as a whole."""

import compare
import cases
import pytest

import corpus_pipeline
from nearby_engine.llm import byte_bpe
from nearby_engine.llm.catalog import ORACLES, QUERIES
from nearby_engine.llm.queries_native import OP9_SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def engine():
    return compare.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, engine, name):
    assert compare.differences(QUERIES[name](spark, FOLDER), engine, ORACLES[name]) == []


def test_shards_by_sql(spark, engine):
    assert compare.differences(QUERIES["op9_hash_tree"](spark, FOLDER).drop("text_crc32"), engine, OP9_SQL) == []


def test_all_are_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)} | {"pipeline"}


def test_the_pipeline_keeps_what_its_stages_keep(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    outs = [docs]
    for _, stage in corpus_pipeline.STAGES:
        outs.append(stage(spark, outs[-1], FOLDER).cache())
    assert all(o.columns == docs.columns for o in outs[:-1])
    counts = [o.count() for o in outs]
    assert counts[0] >= counts[1] >= counts[2] and counts[3] == counts[4] > 0
    # Decoding gives each kept text back.
    texts = sorted((r.doc_id, cases.sha(r.text or "")) for r in outs[3].collect())
    assert sorted((r.doc_id, r.decoded_sha256) for r in outs[4].collect()) == texts
    assert cases.rows_of(corpus_pipeline.run(spark, FOLDER)) == cases.rows_of(outs[4])


def test_the_pipeline_takes_awkward_documents(spark):
    docs = cases.documents(spark).drop("source").withColumn("source", byte_bpe.F.lit(None).cast("string"))
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER).cache()
    assert docs.count() > 0
