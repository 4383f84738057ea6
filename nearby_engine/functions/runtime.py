"""Run durations and labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nearby_engine.functions.classify import lookup
from nearby_engine.functions.dates import duration_text, millis_between

# Label prefix of each run state.
RUN_LABELS = {
    "running": "Running for ",
    "pending": "Queued for ",
    "completed": "Took ",
    "partial": "Partial after ",
    "failed": "Failed after ",
    "cancelled": "Cancelled after ",
}
SOURCE_RUN_LABELS = {k: v for k, v in RUN_LABELS.items() if k != "partial"}


def _runtime(millis: Column, status: Column, labels: dict[str, str]) -> Column:
    seconds = F.floor(millis / 1000.0)
    return F.struct(
        millis.cast("long").alias("duration_ms"),
        seconds.cast("long").alias("elapsed_seconds"),
        F.concat(lookup(status, labels, F.lit("")), duration_text(seconds)).alias("duration_text"),
    )


def run_runtime(
    status: Column, started: Column, finished: Column, created: Column, updated: Column, as_of: Column
) -> Column:
    """Duration of a run: open runs count to ``as_of``, closed ones to their end or last change."""
    begin = F.coalesce(started, created)
    millis = (
        F.when(status == "running", millis_between(begin, as_of))
        .when(status == "pending", millis_between(created, as_of))
        .when(~status.isin(list(RUN_LABELS)), millis_between(created, as_of))
        .when(finished.isNotNull(), millis_between(begin, finished))
        .otherwise(millis_between(created, updated))
    )
    return _runtime(millis, status, RUN_LABELS)


def source_run_runtime(
    status: Column, duration_ms: Column, started: Column, finished: Column, created: Column, as_of: Column
) -> Column:
    """Duration of one source in a run; a recorded duration wins."""
    millis = (
        F.when(duration_ms > 0, duration_ms)
        .when(finished.isNotNull() & started.isNotNull(), millis_between(started, finished))
        .otherwise(millis_between(F.coalesce(started, created), as_of))
    )
    return _runtime(millis, status, SOURCE_RUN_LABELS)
