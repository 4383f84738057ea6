"""Cutting a table into consecutive ranges of a numeric id, so that ordered work never needs one task."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from nearby_engine.functions.text import let

SEGMENTS = 64


@dataclass(frozen=True)
class RangeBuckets:
    """A rising piecewise-linear map from ids to bucket numbers 0 .. count-1; null ids get -1."""

    lows: tuple[int, ...]
    highs: tuple[int, ...]
    parts: tuple[int, ...]

    @property
    def count(self) -> int:
        return sum(self.parts)

    def of(self, value: Column) -> Column:
        if not self.lows:
            return F.when(value.isNull(), F.lit(-1).cast("long")).otherwise(F.lit(0).cast("long"))
        starts = [sum(self.parts[:i]) for i in range(len(self.parts))]
        array = lambda values, kind: F.array(*[F.lit(v).cast(kind) for v in values])
        lows, widths = array(self.lows, "long"), array([h - l + 1 for l, h in zip(self.lows, self.highs)], "double")
        parts, bases = array(self.parts, "long"), array(starts, "long")
        x = value.cast("long")
        segment = F.greatest(F.size(F.filter(lows, lambda low: low <= x)) - 1, F.lit(0))
        inside = lambda s: F.floor((x - F.get(lows, s)) / F.get(widths, s) * F.get(parts, s))
        bucket = lambda s: F.get(bases, s) + F.greatest(F.lit(0).cast("long"), F.least(F.get(parts, s) - 1, inside(s)))
        return F.when(value.isNull(), F.lit(-1).cast("long")).otherwise(let(segment, bucket))


def range_buckets(df: DataFrame, id_column: str, rows_per_bucket: int) -> RangeBuckets:
    """Ranges of about ``rows_per_bucket`` rows each.

    The ids' distribution is read as 64 approximate quantiles (one aggregation, a bounded result); inside a quantile the
    ids are cut into equal widths. Any number of buckets costs the same small expression.
    """
    marks = [i / SEGMENTS for i in range(SEGMENTS + 1)]
    x = F.col(id_column)
    rows, low, high, cuts = df.agg(
        F.count(x), F.min(x), F.max(x), F.percentile_approx(x, marks, 2000)
    ).first()
    if not rows:
        return RangeBuckets((), (), ())
    lows = sorted({int(low), *(int(c) for c in cuts[:-1])})
    highs = [*(n - 1 for n in lows[1:]), int(high)]
    each = max(1, math.ceil(rows / len(lows) / rows_per_bucket))
    return RangeBuckets(tuple(lows), tuple(highs), tuple(min(each, h - l + 1) for l, h in zip(lows, highs)))
