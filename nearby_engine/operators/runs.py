"""The run ledger: events folded to states, totals, repairs and reports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearby_engine.functions.classify import client_status
from nearby_engine.operators.ranking import first_n
from nearby_engine.operators.search import instant

# Statuses that end a run, and the error of a run whose lease ran out.
FINAL = ["completed", "partial", "failed", "cancelled"]
LEASE_ERROR = "lease expired after maximum attempts"
LATEST_RUNS = 20

COUNTS = ["company_count", "job_count", "evidence_count"]
SOURCE_RUN_LAST = [
    "source_family", "status", "attempts", *COUNTS, "error", "duration_ms", "started_at", "finished_at",
]


def fold_source_runs(events: DataFrame) -> DataFrame:
    """Latest report per (run, source); everything but the creation time is overwritten."""
    return (
        events.groupBy("discovery_job_id", "source")
        .agg(
            F.max_by(F.struct(*SOURCE_RUN_LAST), "seq").alias("_last"),
            F.min("happened_at").alias("created_at"),
            F.max("happened_at").alias("updated_at"),
        )
        .select("discovery_job_id", "source", "_last.*", "created_at", "updated_at")
    )


def fold_runs(events: DataFrame) -> DataFrame:
    """State of every run from its events (run_id, seq, happened_at, kind, status, error, counts).

    Kinds are ``create``, ``claim``, ``cancel`` and ``finish``. A cancel of an open run sticks. A
    finish counts for a running or cancelled run: the first one ends a running run, later ones only
    update a cancelled one. Completion clears the error; counts keep their last value that is set.
    """
    claim, stop = F.col("kind") == "claim", F.col("kind") == "cancel"
    marks = events.groupBy("run_id").agg(
        F.min(F.when(claim, F.struct("seq", "happened_at"))).alias("claimed"),
        F.min(F.when(stop, F.col("seq"))).alias("cancel_seq"),
        F.min(F.when(F.col("kind") == "create", F.col("happened_at"))).alias("created_at"),
    )
    opened = F.least("claimed.seq", "cancel_seq")
    finishes = events.filter(F.col("kind") == "finish").join(marks, "run_id").filter(F.col("seq") > opened)
    ends = finishes.groupBy("run_id").agg(
        F.min(F.struct("seq", "status")).alias("end"),
        F.coalesce(F.min("cancel_seq") < F.min("seq"), F.lit(False)).alias("was_cancelled"),
    )
    counted = finishes.join(ends, "run_id").filter(F.col("was_cancelled") | (F.col("seq") == F.col("end.seq")))

    def last_set(column: str, wanted: Column) -> Column:
        return F.max_by(F.when(wanted, F.col(column)), F.when(wanted, F.col("seq")))

    completed = F.col("status") == "completed"
    wrong = ~completed & F.col("error").isNotNull()
    completed_seq, error_seq = F.max(F.when(completed, F.col("seq"))), F.max(F.when(wrong, F.col("seq")))
    totals = counted.groupBy("run_id").agg(
        F.max("happened_at").alias("finished_at"),
        F.when(completed_seq.isNull() | (error_seq > completed_seq), last_set("error", wrong)).alias("error"),
        *[last_set(c, F.col(c).isNotNull()).alias(c) for c in COUNTS],
    )
    joined = marks.join(ends, "run_id", "left").join(totals, "run_id", "left")
    cancelled = F.col("cancel_seq").isNotNull() & (F.col("end").isNull() | F.col("was_cancelled"))
    status = (
        F.when(cancelled, "cancelled")
        .when(F.col("end").isNotNull(), F.col("end.status"))
        .when(F.col("claimed").isNotNull(), "running")
        .otherwise("pending")
    )
    started = F.when(
        F.col("cancel_seq").isNull() | (F.col("claimed.seq") < F.col("cancel_seq")), F.col("claimed.happened_at")
    )
    return joined.select(
        "run_id", status.alias("status"), "created_at", started.alias("started_at"), "finished_at", "error",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS],
    )


def is_reapable(as_of: Column) -> Column:
    """Running, lease over, no attempts left."""
    return F.coalesce(
        (F.col("status") == "running") & (F.col("lease_expires_at") < as_of)
        & (F.col("attempts") >= F.col("max_attempts")),
        F.lit(False),
    )


def is_claimable(as_of: Column) -> Column:
    """Pending, or running with its lease over, and attempts left."""
    waiting = (F.col("status") == "pending") | (
        (F.col("status") == "running") & (F.col("lease_expires_at") < as_of)
    )
    return F.coalesce(waiting & (F.col("attempts") < F.col("max_attempts")), F.lit(False))


def claimable(runs: DataFrame, as_of: datetime | str | Column, limit: int | None = 1) -> DataFrame:
    """Runs a worker may take, oldest first."""
    found = runs.filter(is_claimable(instant(as_of))).orderBy("created_at", "id")
    return found if limit is None else found.limit(limit)


def reap(runs: DataFrame, as_of: datetime | str | Column) -> DataFrame:
    """The ledger with exhausted runs marked as failed."""
    now = instant(as_of)
    dead = is_reapable(now)
    return runs.withColumns(
        {
            "status": F.when(dead, "failed").otherwise(F.col("status")),
            "error": F.when(dead, F.coalesce("error", F.lit(LEASE_ERROR))).otherwise(F.col("error")),
            "finished_at": F.when(dead, now).otherwise(F.col("finished_at")),
            "updated_at": F.when(dead, now).otherwise(F.col("updated_at")),
        }
    )


def cancel(runs: DataFrame, as_of: datetime | str | Column, wanted: Column) -> DataFrame:
    """The ledger with the wanted open runs cancelled."""
    hit = F.coalesce(wanted & F.col("status").isin("pending", "running"), F.lit(False))
    return runs.withColumns(
        {
            "status": F.when(hit, "cancelled").otherwise(F.col("status")),
            "updated_at": F.when(hit, instant(as_of)).otherwise(F.col("updated_at")),
        }
    )


def run_status(source_runs: DataFrame, runs: DataFrame) -> DataFrame:
    """Final status per run: cancelled, failed by error, then by the outcome of its sources.

    ``runs`` has (id, cancelled, error). A run without sources completed.
    """
    done = F.col("status") == "completed"
    outcome = source_runs.groupBy(F.col("discovery_job_id").alias("id")).agg(
        F.bool_and(done).alias("all_done"), F.bool_or(done).alias("some_done"),
        *[F.sum(c).alias(c) for c in COUNTS],
    )
    status = (
        F.when(F.col("cancelled"), "cancelled")
        .when(F.col("error").isNotNull(), "failed")
        .when(F.coalesce("all_done", F.lit(True)), "completed")
        .when(F.col("some_done"), "partial")
        .otherwise("failed")
    )
    return runs.join(outcome, "id", "left").select(
        "id", status.alias("status"), *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS]
    )


def source_totals(batch_counts: DataFrame) -> DataFrame:
    """Accepted companies, jobs and evidence per run and source over its batches."""
    kind = F.col("kind")
    return batch_counts.groupBy("discovery_job_id", "source").agg(
        F.sum(F.when(kind == "company", F.col("accepted")).otherwise(0)).alias("company_count"),
        F.sum(F.when(kind == "job", F.col("accepted")).otherwise(0)).alias("job_count"),
        F.sum("accepted").alias("evidence_count"),
    )


def latest_runs(runs: DataFrame, user_id: object | None = None, limit: int = LATEST_RUNS) -> DataFrame:
    """The newest runs of one user, or of every user, with client-side status names."""
    shown = runs.withColumn("status", client_status(F.col("status")))
    if user_id is not None:
        return shown.filter(F.col("user_id") == user_id).orderBy(F.desc("created_at"), "id").limit(limit)
    return first_n(shown, ["user_id"], [F.desc("created_at"), F.col("id")], limit)
