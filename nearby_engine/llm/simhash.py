"""SimHash fingerprints of whole texts, and exact search within a Hamming radius by permuted block tables.

Terms are pairs of neighbouring words (a lone word is its own term). A term's 64-bit hash votes for or against each bit
with the term's weight; longer words are rarer, so the weight is the pair's length less four, within 1 to 15. Votes are
counted by an aggregation over exploded terms, the votes of two bits in one 64-bit sum.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from nearby_engine.functions.text import let
from nearby_engine.llm.mixing import WORD
from nearby_engine.llm.ordering import range_buckets

BITS, MOST_WEIGHT = 64, 15
#: Bits whose votes share one sum; each has 32 bits of it, room for 140 million terms of the greatest weight.
SHARED = 2


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def terms(text: Column) -> Column:
    """Array of (h, w): hash and weight of each pair of neighbouring words."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    weight = lambda n: F.greatest(F.lit(1), F.least(F.lit(MOST_WEIGHT), n - 4)).cast("long")
    term = lambda a, b: F.struct(F.xxhash64(a, b).alias("h"), weight(F.length(a) + F.length(b)).alias("w"))
    alone = lambda ws: F.transform(ws, lambda a: F.struct(F.xxhash64(a).alias("h"), weight(F.length(a)).alias("w")))
    pairs = lambda ws: F.zip_with(F.slice(ws, F.lit(1), F.size(ws) - 1), F.slice(ws, F.lit(2), F.size(ws) - 1), term)
    return let(words, lambda ws: F.when(F.size(ws) < 2, alone(ws)).otherwise(pairs(ws)))


def votes() -> list[Column]:
    """Aggregates over term rows (h, w): the weight of the terms that have a bit, for two bits each, and of all terms."""
    def pair(i: int) -> Column:
        bits = F.shiftrightunsigned("h", SHARED * i).bitwiseAND(_long(3))
        apart = bits.bitwiseAND(_long(1)) + bits.bitwiseAND(_long(2)) * _long(1 << 31)
        return F.coalesce(F.sum(F.col("w") * apart), _long(0)).alias(f"v{i}")

    return [*[pair(i) for i in range(BITS // SHARED)], F.coalesce(F.sum("w"), _long(0)).alias("total")]


def fingerprint() -> Column:
    """64 bits as a long, from the columns of ``votes``: set where the terms that have the bit weigh more than the others."""
    bits = []
    for b in range(BITS):
        count = F.shiftrightunsigned(f"v{b // SHARED}", 32 * (b % SHARED)).bitwiseAND(_long(0xFFFFFFFF))
        bits.append(F.when(count * 2 > F.col("total"), _long(1 << b if b < 63 else -(1 << 63))).otherwise(_long(0)))
    while len(bits) > 1:
        bits = [x.bitwiseOR(y) for x, y in zip(bits[::2], bits[1::2])]
    return bits[0]


def as_text(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), BITS // 4, "0"))


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def likeness(a: Column, b: Column) -> Column:
    """The cosine of the terms' weights that the distance stands for, at least 0."""
    return F.greatest(F.lit(0.0), F.cos(distance(a, b) * F.lit(math.pi / BITS)))


def with_next(docs: DataFrame, rows_per_bucket: int = 1000) -> DataFrame:
    """bucket, pos, guest, doc_id, text, next_text: the next document in descending doc_id order; after the last comes the
    first.

    The ids are cut into consecutive ranges (buckets). The first document of each range is also sent to the range before
    it, as a guest at the end, so every range knows its successor and the texts are shuffled once. Guests stay in the
    result; ``pos`` numbers the rows of a range.
    """
    known = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ranges = range_buckets(known, "doc_id", rows_per_bucket)
    tops = known.groupBy(ranges.of(F.col("doc_id")).alias("bucket")).agg(F.max("doc_id").alias("top"))
    # One short row per range.
    order = Window.orderBy("bucket")
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    guests = tops.select("top", F.coalesce(F.lead("bucket").over(order), F.first("bucket").over(everything)).alias("guest_of"))
    placed = known.join(guests, F.col("doc_id").eqNullSafe(F.col("top")), "left")
    at = lambda bucket, guest: F.struct(bucket.alias("bucket"), F.lit(guest).alias("guest"))
    own, sent = at(ranges.of(F.col("doc_id")), 0), at(F.col("guest_of"), 1)
    rows = placed.select("doc_id", "text", F.explode(F.when(F.col("guest_of").isNull(), F.array(own)).otherwise(F.array(own, sent))).alias("p"))
    window = Window.partitionBy("bucket").orderBy("guest", F.desc_nulls_last("doc_id"), F.desc("text"))
    return rows.select("p.bucket", "p.guest", "doc_id", "text").select(
        "bucket", F.row_number().over(window).alias("pos"), "guest", "doc_id", "text", F.lead("text").over(window).alias("next_text")
    )


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last third of the code points replaced by the first as many of the next document. A null
    text is empty; the fingerprint of a text without words is all zeros. A null doc_id comes last. Rows that share a
    doc_id follow each other in descending order of their texts. Extra columns are left out; an empty table gives no
    rows.
    """
    third = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - third), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), third))
    rows = with_next(docs).select("bucket", "pos", "guest", "doc_id", "text", edited.alias("edited"))
    document = ["bucket", "pos", "guest", "doc_id", "n_chars", "edited_sha256"]
    read = lambda which, text: F.struct(F.lit(which).alias("which"), F.col(text).alias("text"))
    texts = rows.select(
        "bucket", "pos", "guest", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        F.explode(F.when(F.col("guest") == 1, F.array(read(0, "text"))).otherwise(F.array(read(0, "text"), read(1, "edited")))).alias("t"),
    )
    voting = texts.select(*document, "t.which", F.explode_outer(terms(F.col("t.text"))).alias("x")).select(*document, "which", "x.h", "x.w")
    counted = voting.groupBy(*document, "which").agg(*votes()).select(*document, "which", fingerprint().alias("fp"))
    of = lambda which: F.max(F.when(F.col("which") == which, F.col("fp")))
    both = counted.groupBy(*document).agg(of(0).alias("fp"), of(1).alias("edited_fp"))
    following = F.lead("fp").over(Window.partitionBy("bucket").orderBy("pos"))
    return both.withColumn("next_fp", following).where("guest = 0").select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )


# --- permuted block tables -----------------------------------------------------------------------------------------------


def block_keys(fp: Column, radius: int, blocks: int) -> Column:
    """Array of (table, key): the bits of every choice of blocks - radius blocks. Two fingerprints within the radius
    differ in at most ``radius`` blocks, so they agree in at least one whole choice."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    masks = [sum(1 << b for b in range(low, high)) for low, high in zip(edges, edges[1:])]
    made = []
    for number, chosen in enumerate(itertools.combinations(masks, blocks - radius)):
        mask = sum(chosen)
        made.append(F.struct(F.lit(number).alias("table"), fp.bitwiseAND(_long(mask - (1 << 64) if mask >> 63 else mask)).alias("key")))
    return F.array(*made)


def neighbours(queries: DataFrame, index: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """query, fp, d: the distinct fingerprints of ``index`` (column fp, long) within ``radius`` of each distinct one of
    ``queries`` (column fp), itself included. Equal fingerprints are one entry, so copies make no pairs."""
    if not 0 <= radius < blocks <= BITS:
        raise ValueError("the radius must be less than the number of blocks")
    tables = lambda df, name: df.where("fp is not null").select("fp").distinct().select(F.col("fp").alias(name), F.explode(block_keys(F.col("fp"), radius, blocks)).alias("b")).select(name, "b.*")
    met = tables(queries, "query").join(tables(index, "fp"), ["table", "key"])
    near = met.select("query", "fp", distance(F.col("query"), F.col("fp")).alias("d")).where(F.col("d") <= radius)
    return near.distinct()
