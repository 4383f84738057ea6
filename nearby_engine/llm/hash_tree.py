"""Sharding by a hierarchical weighted hash tree.

A document descends region, rack and shard. At every level each child draws a hash of (document id, child's name) and the
child with the smallest ``-ln(u) / weight`` wins. A child's draw depends on its own name and weight alone, so a change of
weights moves only documents that enter or leave the subtrees whose weights changed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from nearby_engine.llm.ordering import range_buckets
from nearby_engine.llm.storage import stored

#: Draws are integers of 52 bits, read from the first 13 hex digits of an MD5.
DRAW_DIGITS = 13


@dataclass(frozen=True)
class Node:
    """A region, a rack or (with ``shard``) a leaf. An inner node weighs as much as its leaves together."""

    name: str
    children: tuple["Node", ...] = ()
    shard: int = -1
    own_weight: float = 0.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


def leaf(shard: int, weight: float = 1.0) -> Node:
    return Node(f"s{shard}", (), shard, weight)


def balanced_tree(shards: int = 8, per_rack: int = 2, per_region: int = 4) -> Node:
    """Shards 0 .. n-1 of equal weight in racks and regions of fixed sizes."""
    if shards < 1:
        raise ValueError("a tree needs at least one shard")
    racks = lambda low, high: tuple(
        Node(f"k{i // per_rack}", tuple(leaf(s) for s in range(i, min(high, i + per_rack)))) for i in range(low, high, per_rack)
    )
    return Node("root", tuple(Node(f"r{i // per_region}", racks(i, min(shards, i + per_region))) for i in range(0, shards, per_region)))


def grow(tree: Node, shard: int, weight: float = 1.0) -> Node:
    """One more shard in a region of its own: no other draw changes, so rows move into the new shard only."""
    region = Node(f"grown{shard}", (Node(f"grown{shard}k", (leaf(shard, weight),)),))
    return Node(tree.name, (*tree.children, region))


def _score(key: Column, child: Node) -> Column:
    digits = F.substring(F.md5(F.concat(key, F.lit("/" + child.name)).cast("binary")), 1, DRAW_DIGITS)
    u = (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2 ** (4 * DRAW_DIGITS)))
    return -F.log(u) / F.lit(child.weight)


def _winner(key: Column, children: tuple[Node, ...]) -> Column:
    """Place of the child with the smallest score; the first one wins a tie."""
    if len(children) == 1:
        return F.lit(0)
    return F.array_min(F.array(*[F.struct(_score(key, c), F.lit(i)) for i, c in enumerate(children)]))["col2"]


def shard_of(key: Column, node: Node) -> Column:
    """The shard a document id (as text) descends to; a branch that is not taken is not drawn."""
    children = tuple(c for c in node.children if c.weight > 0)
    if not node.children:
        return F.lit(node.shard)
    if not children:
        raise ValueError(f"nothing below {node.name} has a weight")
    place = _winner(key, children)
    below = None
    for i, child in enumerate(children[:-1]):
        below = F.when(place == i, shard_of(key, child)) if below is None else below.when(place == i, shard_of(key, child))
    return shard_of(key, children[-1]) if below is None else below.otherwise(shard_of(key, children[-1]))


def assign(docs: DataFrame, tree: Node, grown: Node | None = None, rows_per_bucket: int = 100_000) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Slots number the rows of a shard from 0 without gaps in the order of doc_id. They are counted inside consecutive id
    ranges, and each range starts after the rows of the earlier ranges, so no task holds a shard. Nulls: a null text has
    no bytes (size 1, checksum 0); a null doc_id is the key ``null``, placed first. Repeated rows get the same shard and
    different slots. Rows with one doc_id keep together. Extra columns are left out. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    slim = docs.select("doc_id", key.alias("key"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = stored(
        slim.select(
            "doc_id", "size", "text_crc32", shard_of(F.col("key"), tree).cast("int").alias("shard"),
            (F.lit(None) if grown is None else shard_of(F.col("key"), grown)).cast("int").alias("grown_shard"),
        )
    )
    ranges = range_buckets(placed, "doc_id", rows_per_bucket)
    ranged = placed.withColumn("part", ranges.of(F.col("doc_id")))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranged.groupBy("shard", "part").agg(F.count("*").alias("rows"))
        .select("shard", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    )
    inside = Window.partitionBy("shard", "part").orderBy(F.asc_nulls_first("doc_id"), "text_crc32", "size")
    return (
        ranged.withColumn("place", F.row_number().over(inside) - 1)
        .join(starts, ["shard", "part"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("place")).cast("long").alias("slot"), "grown_shard")
    )


def write_shards(docs: DataFrame, tree: Node, path: str) -> None:
    """The documents as Parquet, one folder per shard; a shard may have many files."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    docs.withColumn("_shard", shard_of(key, tree)).write.partitionBy("_shard").parquet(path)
