"""A training corpus from the documents: toxic texts go, one text of each near-duplicate group stays, sources are mixed to
target weights, and what is left is encoded.

Each stage takes (spark, docs, sf_dir) and returns a table; it is written as Parquet and read again as the next stage's
documents. All stages but the last return the columns of the documents, whatever further columns there are.
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from nearby_engine.llm import byte_bpe, lsh_forest, mixing, toxicity
from nearby_engine.llm.storage import stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the grammar rejects; it is taught by the labels that are not held out."""
    return toxicity.clean_documents(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group at five-word shingles and similarity 0.8."""
    return lsh_forest.one_of_each_group(docs, shingle_words=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and samples documents so that sources meet weights 1, 2, 3 in turn, at most three times each."""
    return mixing.mix(docs, (1, 2, 3), 3.0)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes every document and decodes it again: counts and digests."""
    ranks = Path(public_tokenizers.path("byte_bpe_50k.tiktoken")).read_bytes()
    return byte_bpe.round_trip(docs, byte_bpe.Vocabulary.from_tiktoken(ranks, public_tokenizers.PATTERN))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_copies),
    ("mixing", mixed),
    ("byte_bpe", encoded),
]

#: The first two stages and the encoding are not expressible in SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
