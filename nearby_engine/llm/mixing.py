"""Mixing sources to target weights: whole copies by rate, plus one hash-seeded Bernoulli copy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from nearby_engine.llm.storage import stored

#: A word; sizes count words.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_rates(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), most_repeats: float = 3.0) -> DataFrame:
    """Per source: source, source_size, target, rate; from rows (source, size).

    Sources in order (null last) take the weights in turn. Targets share the sum of all sizes by weight; a target above
    ``most_repeats`` times its source stops there and the excess is shared again by weight until none is above. Works on
    one row per source; each round of sharing is one aggregation, and ends at least one source, so rounds are few.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1) % len(weights)
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), turn)
    table = stored(per_source.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * most_repeats).alias("most")))
    share, stopped = 0.0, -1
    while True:
        at_most = F.col("most") < F.col("weight") * F.lit(share)
        total, most, weight_left, now = table.agg(
            F.sum("source_size"), F.sum(F.when(at_most, F.col("most"))), F.sum(F.when(~at_most, F.col("weight"))), F.count_if(at_most)
        ).first()
        if now == stopped or not total or not weight_left:
            break
        stopped = now
        share = (total - (most or 0.0)) / weight_left
    target = F.least(F.col("most"), F.col("weight") * F.lit(share))
    rate = F.when(F.col("source_size") > 0, F.least(target / F.col("source_size"), F.lit(most_repeats))).otherwise(0.0)
    return table.select("source", "source_size", target.alias("target"), rate.alias("rate"))


def copies(key: Column, rate: Column, seed: str = "mix") -> Column:
    """floor(rate) copies, and one more with probability equal to the fraction, drawn from a hash of the key."""
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(seed + "/"), key).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def plan_mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), most_repeats: float = 3.0, seed: str = "mix") -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken.

    The text is read once, for its word count. The table of sources is joined by its measured size, so a source with a
    third of all rows is either met by a broadcast or split by adaptive execution. Nulls: a null text has size 0, a null
    source is a source of its own (last in order), a null doc_id draws as the text ``null``. Rows that repeat a doc_id
    draw alike. A source without words has target 0 and takes nothing. Extra columns are left out.
    """
    slim = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    rates = source_rates(slim, weights, most_repeats)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    joined = slim.alias("d").join(rates.alias("r"), F.col("d.source").eqNullSafe(F.col("r.source")))
    return joined.select(
        "d.doc_id", "d.size", "r.source_size", "r.target", (F.col("d.size") * copies(key, F.col("r.rate"), seed)).alias("taken")
    )


def mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), most_repeats: float = 3.0, seed: str = "mix") -> DataFrame:
    """The mixture itself: the rows of ``docs``, with all their columns, each as often as the mix takes it."""
    sizes = docs.select("source", word_count(F.col("text")).alias("size"))
    rates = source_rates(sizes, weights, most_repeats).select(F.col("source").alias("_mix_source"), F.col("rate").alias("_mix_rate"))
    key = F.coalesce(docs["doc_id"].cast("string"), F.lit("null"))
    joined = docs.join(rates, docs["source"].eqNullSafe(F.col("_mix_source")))
    repeats = F.array_repeat(F.lit(0), copies(key, F.col("_mix_rate"), seed).cast("int"))
    return joined.select(*[docs[c] for c in docs.columns], F.explode(repeats).alias("_mix_copy")).drop("_mix_copy")
