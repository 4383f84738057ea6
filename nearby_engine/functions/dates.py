"""Time parsing, formatting and durations as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"
ISO_LOCAL = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}([.,]\d+)?)?$"
ISO_ZONED = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}([.,]\d+)?)?([Zz]|[+-]\d{2}(:?\d{2})?)$"
ISO_PLAIN = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"
EPOCH_MS_FLOOR = 1e11


def has_zone(text: Column) -> Column:
    return F.trim(text).rlike(ISO_ZONED)


def iso_timestamp(text: Column) -> Column:
    """ISO text to an instant; no zone means UTC, anything else than ISO gives null. The usual form is read as it stands."""
    value = F.trim(text)
    dotted = F.regexp_replace(F.upper(value), r",(\d)", ".$1")
    colon = F.regexp_replace(dotted, r"([+-]\d{2})(\d{2})$", "$1:$2")
    full = F.regexp_replace(colon, r"([+-]\d{2})$", "$1:00")
    return (
        F.when(value.rlike(ISO_PLAIN), value.try_cast("timestamp"))
        .when(value.rlike(ISO_ZONED), full.try_cast("timestamp"))
        .when(value.rlike(ISO_LOCAL), F.concat(dotted, F.lit("Z")).try_cast("timestamp"))
        .when(value.rlike(ISO_DATE), F.concat(value, F.lit("T00:00:00Z")).try_cast("timestamp"))
    )


def epoch_or_iso(text: Column) -> Column:
    """Union of epoch seconds, epoch milliseconds and ISO text, all read as text."""
    number = text.try_cast("double")
    seconds = F.when(number > EPOCH_MS_FLOOR, number / 1000.0).otherwise(number)
    in_range = F.abs(seconds) < 253402300800.0
    return F.when(
        number.isNotNull(),
        F.when(in_range, F.timestamp_micros((F.round(seconds * 1e6, 0)).cast("long"))),
    ).otherwise(iso_timestamp(text))


def iso_z(instant: Column) -> Column:
    return F.date_format(F.to_utc_timestamp(instant, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def millis_between(start: Column, end: Column) -> Column:
    return F.floor((F.unix_micros(end) - F.unix_micros(start)) / 1000.0)


def duration_text(seconds: Column) -> Column:
    """``42s``, ``1m 15s``, ``1h 5m``: zero parts are dropped, negative counts as zero."""
    total = F.greatest(seconds, F.lit(0)).cast("long")
    hours, minutes, rest = F.floor(total / 3600), F.floor(total / 60) % 60, total % 60

    def part(value: Column, unit: str) -> Column:
        return F.when(value > 0, F.concat(value.cast("long").cast("string"), F.lit(unit)))

    return F.when(total == 0, F.lit("0s")).otherwise(
        F.concat_ws(" ", part(hours, "h"), part(minutes, "m"), part(rest, "s"))
    )
