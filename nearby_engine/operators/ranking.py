"""Row helpers: single evaluation, keep-first selection, ordered numbering without oversized groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearby_engine.session import cut


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are evaluated exactly once per row.

    The optimizer copies projected expressions into later filters and projections, which is wrong
    for expressions as costly as a rule table. It does not move anything through a generator.
    """
    made = F.struct(*[column.alias(name) for name, column in columns.items()])
    return df.select("*", F.inline(F.array(made)))


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first by ``order``; combines before the shuffle, so hot keys stay small."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    return (
        df.groupBy(*keys)
        .agg(F.min_by(F.struct(*order, *rest), F.struct(*order)).alias("_first"))
        .select(*keys, "_first.*")
        .select(*df.columns)
    )


def first_n(df: DataFrame, keys: list[str], order: list[Column | str], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows per key; the planner limits each group before the shuffle as well."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)


def numbered(df: DataFrame, coarse: list[Column], fine: list[Column], into: str) -> DataFrame:
    """Zero-based position of every row in the order (coarse, fine) over the whole frame.

    A window over all rows would run in one task. Here rows are dealt to tasks by ranges of the order and numbered inside
    their range; the number of rows in the ranges before is added, one number per range. Positions are kept while the ranges
    are, so the numbered rows are written to the shared folder first.
    """
    order = [*coarse, *fine]
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(ranges.withColumn("_place", F.monotonically_increasing_id()))
    # The upper bits number the range, the lower 33 the row inside it.
    range_of = F.shiftrightunsigned("_place", 33).cast("int")
    sizes = placed.groupBy(range_of.alias("_range")).agg(F.count("*").alias("n")).collect()
    before, rows = 0, []
    for number, n in sorted(sizes):
        rows.append((number, before))
        before += n
    offsets = df.sparkSession.createDataFrame(rows, "_range int, _before long")
    inside = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    joined = placed.withColumn("_range", range_of).join(F.broadcast(offsets), "_range")
    return joined.withColumn(into, F.col("_before") + inside).drop("_range", "_place", "_before")


HOT_SHARE = 1000


def joined_to_few(rows: DataFrame, few: DataFrame, key: str, spread: str) -> DataFrame:
    """``rows`` left-joined to ``few``, which has one row per ``key``, with no key in one task that has a large share of rows.

    A key with more than one in ``HOT_SHARE`` of all rows is dealt into parts of that size by the hash of ``spread``, and its
    row of ``few`` is given to each part. There are fewer than ``HOT_SHARE`` such keys at any size, so their list is broadcast.
    """
    counts = cut(rows.groupBy(key).agg(F.count("*").alias("_n")))
    size = max(1, (counts.agg(F.sum("_n")).first()[0] or 0) // HOT_SHARE)
    hot = F.broadcast(counts.filter((F.col("_n") > size) & F.col(key).isNotNull()).select(key, F.ceil(F.col("_n") / size).cast("int").alias("_parts")))
    part = F.coalesce(F.pmod(F.xxhash64(spread), F.col("_parts").cast("long")), F.lit(0).cast("long")).cast("int")
    dealt = rows.join(hot, key, "left").withColumn("_part", part).drop("_parts")
    parts = F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)
    given = few.join(hot, key, "left").withColumn("_part", F.explode(parts)).drop("_parts")
    return dealt.join(given, [key, "_part"], "left").drop("_part")
