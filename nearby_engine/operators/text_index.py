"""Trigram postings of names and titles, so that a text search reads the lists of its own grams only.

A posting says that a row's text holds a gram. Word grams (words padded with blanks) decide similarity: the share of common
grams follows from the counts in the lists and the sizes kept with them. Plain grams of the lower-cased text decide where a
pattern can occur: a text that holds it holds all grams of its literal stretches.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearby_engine.functions.text import TRIGRAM_THRESHOLD, trigrams, trigrams_of
from nearby_engine.operators.ranking import once
from nearby_engine.session import dealt

BUCKETS = 64
WORDS, PLAIN = "w", "p"
SCHEMA = "gram string, key {key}, size int, kind string, bucket int"


def _plain_grams(text: Column) -> Column:
    low = F.lower(text)
    places = F.when(F.length(low) >= 3, F.sequence(F.lit(1), F.length(low) - 2)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substr(low, i, F.lit(3))))


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def postings(rows: DataFrame, key: str, similar_by: str, contained_in: str) -> DataFrame:
    """gram, key, size (of the text's grams), kind, bucket: the postings of both columns. Null texts have none.

    The rows are narrow beside their postings, so they are dealt over tasks first; the grams of a text are made once.
    """
    texts = dealt(rows.select(F.col(key).alias("key"), F.col(similar_by).alias("_similar"), F.col(contained_in).alias("_held")), "key")

    def of(kind: str, grams: Column) -> DataFrame:
        held = once(texts, {"grams": grams}).filter(F.col("grams").isNotNull())
        return held.select(F.explode("grams").alias("gram"), "key", F.size("grams").alias("size"), F.lit(kind).alias("kind"))

    both = of(WORDS, trigrams(F.col("_similar"))).unionByName(of(PLAIN, _plain_grams(F.col("_held"))))
    return both.withColumn("bucket", _bucket(F.col("gram")))


def write_postings(found: DataFrame, path: str) -> None:
    """Partitions by kind and bucket; inside, the list of a gram lies together, so row groups of others are skipped. Frequent
    grams make large buckets, which are split by their size."""
    found.hint("rebalance", "kind", "bucket").sortWithinPartitions("kind", "bucket", "gram", "size").write.partitionBy("kind", "bucket").parquet(path)


def read_postings(spark: SparkSession, path: str, key_type: str) -> DataFrame:
    return spark.read.schema(SCHEMA.format(key=key_type)).parquet(path)


def _lists(index: DataFrame, kind: str, grams: list[str]) -> DataFrame:
    """The lists of the given grams: partitions by bucket, row groups by gram."""
    wanted = index.sparkSession.createDataFrame([(g,) for g in grams], "gram string").select(_bucket(F.col("gram")).alias("b")).distinct()
    buckets = sorted(r.b for r in wanted.collect())
    return index.filter((F.col("kind") == kind) & F.col("bucket").isin(buckets) & F.col("gram").isin(grams))


def similar_keys(index: DataFrame, query: str, threshold: float = TRIGRAM_THRESHOLD) -> DataFrame:
    """Keys of the texts whose similarity to the query is at least ``threshold``, exactly.

    Texts with too few or too many grams for it are left out by their size when the lists are read.
    """
    grams = trigrams_of(query)
    n = len(grams)
    least, most = math.ceil(threshold * n - 1e-9), math.floor(n / threshold + 1e-9) if threshold > 0 else 1 << 30
    lists = _lists(index, WORDS, grams).filter(F.col("size").between(least, most))
    counted = lists.groupBy("key", "size").agg(F.count("*").alias("shared"))
    shared = F.col("shared").cast("double")
    return counted.filter(shared / (F.col("size") + n - shared) >= threshold).select("key").distinct()


def holding_keys(index: DataFrame, query: str) -> DataFrame | None:
    """Keys of the texts that may hold the query (with its wildcards) ignoring case; None if it has no literal stretch of
    three letters, so that every text may."""
    stretches = re.split(r"\\.|[%_]", query.lower())
    grams = sorted({s[i : i + 3] for s in stretches for i in range(len(s) - 2)})
    if not grams:
        return None
    counted = _lists(index, PLAIN, grams).groupBy("key").agg(F.countDistinct("gram").alias("held"))
    return counted.filter(F.col("held") == len(grams)).select("key")


def candidate_keys(index: DataFrame, query: str) -> DataFrame | None:
    """Keys whose text may be similar to the query or hold it."""
    holding = holding_keys(index, query)
    return None if holding is None else holding.unionByName(similar_keys(index, query)).distinct()
