"""Registered queries of the operators that use Python inside tasks."""

from __future__ import annotations

from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from nearby_engine.llm import byte_bpe, lsh_forest, pivot_dedup, toxicity, wavelet
from nearby_engine.llm.registry import register, table


@register("op2_byte_bpe")
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by ranks and decoded again."""
    ranks = Path(public_tokenizers.path("byte_bpe_50k.tiktoken")).read_bytes()
    vocabulary = byte_bpe.Vocabulary.from_tiktoken(ranks, public_tokenizers.PATTERN)
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary)


@register("op4_pivot_dedup")
def op4_pivot_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its links at cosine 0.9 and its group."""
    return pivot_dedup.near_duplicate_vectors(table(spark, sf_dir, "embeddings"), threshold=0.9)


@register("op5_lsh_forest")
def op5_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its near-duplicate group at 2-word shingles and similarity 0.8."""
    return lsh_forest.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2, percent=80)


@register("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by the grammar, which is taught by labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@register("op8_wavelet_tokens")
def op8_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, written to wavelet matrices and read back."""
    tokenizer = Path(public_tokenizers.path("byte_bpe_50k.json")).read_bytes()
    return wavelet.write_and_read(table(spark, sf_dir, "documents"), tokenizer)
