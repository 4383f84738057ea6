"""Evidence batches: reading, identifying and flattening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearby_engine.functions.dates import iso_timestamp, iso_z
from nearby_engine.operators.ranking import once
from nearby_engine.schemas import COMPANY_EVIDENCE, CONTRACT_VERSION, EVIDENCE_BATCH, JOB_EVIDENCE
from nearby_engine.session import landed

HEADER = ["contract_version", "discovery_job_id", "source", "source_family", "observed_at"]


def with_batch_id(batches: DataFrame) -> DataFrame:
    """The same batch delivered again gets the same id."""
    return batches.withColumn("batch_id", F.sha2(F.to_json(F.struct(*HEADER, "companies", "jobs")), 256))


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """One row per landed batch; lines or whole files of JSON."""
    return with_batch_id(spark.read.schema(EVIDENCE_BATCH).json(path))


def parse_batches(lines: DataFrame) -> DataFrame:
    """Batches held as JSON text in ``value``."""
    # Behind a generator: the filters that opening the records brings would parse every text again.
    return with_batch_id(once(lines.select("value"), {"b": F.from_json("value", EVIDENCE_BATCH)}).select("b.*"))


def once_each(batches: DataFrame) -> DataFrame:
    """Batches without repetitions, written to the shared folder: equal ids mean equal batches, so only ids are shuffled."""
    every = landed(batches.withColumn("_row", F.monotonically_increasing_id()))
    counted = every.groupBy(F.col("batch_id").alias("_id")).agg(F.min("_row").alias("_kept"), F.count("*").alias("n"))
    repeated = landed(counted.filter(F.col("n") > 1).select("_id", "_kept"))
    marked = every.join(repeated, F.col("batch_id").eqNullSafe(F.col("_id")), "left")
    return marked.filter(F.col("_kept").isNull() | (F.col("_kept") == F.col("_row"))).select(batches.columns)


def sequence_key(kind: int | Column, index: Column, at: Column | None = None) -> Column:
    """Arrival order of a record; rows already stored sort before all of them. ``at`` is the parsed time of its batch."""
    return F.struct(
        F.lit(1).alias("fresh"),
        (iso_timestamp(F.col("observed_at")) if at is None else at).alias("observed_at"),
        F.col("source").alias("source"),
        F.col("batch_id").alias("batch_id"),
        F.lit(kind).alias("kind"),
        index.alias("index"),
    )


def stored_key(seen: Column) -> Column:
    """Arrival order of a row that is already stored."""
    return F.struct(
        F.lit(0).alias("fresh"),
        seen.cast("timestamp").alias("observed_at"),
        F.lit("").alias("source"),
        F.lit("").alias("batch_id"),
        F.lit(0).alias("kind"),
        F.lit(0).alias("index"),
    )


def _rows(batches: DataFrame, column: str, kind: int) -> DataFrame:
    # The time of a batch is parsed before its records are opened.
    timed = batches.select("batch_id", *HEADER, iso_timestamp(F.col("observed_at")).alias("at"), column)
    flat = timed.select("batch_id", *HEADER, "at", F.posexplode(column).alias("index", "record"))
    return flat.select(
        "batch_id", "discovery_job_id", "source", "source_family",
        F.col("at").alias("observed_at"), F.col("observed_at").alias("observed_text"),
        "index", sequence_key(kind, F.col("index"), F.col("at")).alias("seq"), "record.*",
    )


def company_rows(batches: DataFrame) -> DataFrame:
    """One row per company record with its header and arrival order."""
    return _rows(batches, "companies", 0)


def job_rows(batches: DataFrame) -> DataFrame:
    """One row per job record; times parsed, their text kept for validation."""
    rows = _rows(batches, "jobs", 1)
    times = ["posted_at", "first_seen_at", "last_seen_at"]
    return rows.withColumns(
        {**{f"{c}_text": F.col(c) for c in times}, **{c: iso_timestamp(F.col(c)) for c in times}}
    )


def to_batches(
    companies: DataFrame,
    jobs: DataFrame,
    source: str,
    source_family: str,
    run_id: Column,
    as_of: Column,
    batch_size: int = 50,
) -> DataFrame:
    """Pack evidence rows into batches of about ``batch_size`` records.

    Both frames carry ``page``, the origin that keeps records together. A page is split by record
    hash into as many chunks as its size asks for, so no batch grows with its page.
    """

    def shaped(rows: DataFrame, schema: T.StructType, kind: str) -> DataFrame:
        record = F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
        empty = {
            "company": F.lit(None).cast(COMPANY_EVIDENCE), "job": F.lit(None).cast(JOB_EVIDENCE), kind: record,
        }
        return rows.select("page", "content_hash", empty["company"].alias("company"), empty["job"].alias("job"))

    # Written once: they are read for the sizes of the pages and to be packed, and making them is the costly part.
    records = landed(shaped(companies, COMPANY_EVIDENCE, "company").unionByName(shaped(jobs, JOB_EVIDENCE, "job")))
    sizes = records.groupBy("page").agg(F.ceil(F.count("*") / F.lit(float(batch_size))).alias("chunks"))
    chunk = F.pmod(F.xxhash64("content_hash"), F.col("chunks"))

    def ordered(name: str) -> Column:
        pair = F.when(F.col(name).isNotNull(), F.struct("content_hash", name))
        return F.transform(
            F.array_sort(F.collect_list(pair), lambda a, b: F.when(a["content_hash"] < b["content_hash"], -1)
                         .when(a["content_hash"] > b["content_hash"], 1).otherwise(0)),
            lambda x: x[name],
        )

    packed = (
        records.join(sizes, "page")
        .groupBy("page", chunk.alias("chunk"))
        .agg(ordered("company").alias("companies"), ordered("job").alias("jobs"))
    )
    return with_batch_id(
        packed.select(
            F.lit(CONTRACT_VERSION).alias("contract_version"), run_id.alias("discovery_job_id"),
            F.lit(source).alias("source"), F.lit(source_family).alias("source_family"),
            iso_z(as_of).alias("observed_at"), "companies", "jobs",
        )
    )
