"""Canonical tables: schemas, versioned writes and reads.

A version is one folder per write with a Parquet table per entity. The manifest has one small file per
finished version, named by its number, so readers switch to a version only when all of it is there, and a
write that dies half-way leaves nothing visible. A number is taken once: of two writers that started from
the same version the second fails, and reads again. Old versions stay readable until they are removed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from datetime import datetime, timezone

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from nearby_engine.functions.geo import space_code

SCHEMAS = {
    "companies": "id string, name string, normalized_name string, domain string, industry string, "
    "employee_count string, description string, verified boolean, first_seen_at timestamp, last_seen_at timestamp",
    "company_aliases": "company_id string, alias string, normalized_alias string, alias_type string",
    "company_domains": "company_id string, normalized_domain string, domain_type string, is_primary boolean, "
    "first_seen_at timestamp, last_seen_at timestamp",
    "locations": "id string, company_id string, label string, address string, city string, lat double, lng double, "
    "confidence double, presence_type string, verified boolean, location_type string, status string, "
    "country_code string, address_hash string, first_seen_at timestamp, last_seen_at timestamp",
    "sightings": "id string, source string, source_family string, first_seen_at timestamp, source_record_id string, "
    "content_hash string, discovery_job_id string, source_url string, company_name string, raw_address string, "
    "lat double, lng double, metadata string, company_id string, location_id string, last_seen_at timestamp, "
    "scraped_at timestamp",
    "jobs": "id string, source string, first_seen_at timestamp, created_at timestamp, is_active boolean, "
    "company_id string, discovery_job_id string, source_family string, source_job_id string, canonical_url string, "
    "title string, normalized_title string, description_excerpt string, content_hash string, "
    "work_arrangement string, publication_state string, posted_at timestamp, posted_at_confidence double, "
    "last_seen_at timestamp, technical_classification string, rule_version string, "
    "classification_reasons array<string>, metadata string, role_family string, seniority string, "
    "employment_type string, state string, activity_confidence double",
    "job_locations": "job_id string, ordinal bigint, location_raw string, latitude double, longitude double, "
    "coordinate_source string, confidence double, location_kind string, country_code string, is_active boolean, "
    "first_seen_at timestamp, last_seen_at timestamp",
    "job_remote_eligibility": "job_id string, scope_type string, scope_code string, source_record_id string, "
    "confidence double, is_active boolean, first_seen_at timestamp, last_seen_at timestamp",
    "data_sources": "slug string, name string, source_type string, source_family string",
    "ingestion_runs": "id string, source string, discovery_job_id string, adapter_version string, status string, "
    "accepted_count int, rejected_count int",
    "source_records": "id string, source string, record_type string, run_id string, external_id string, "
    "source_url string, payload_hash string, first_seen_at timestamp, payload string, last_seen_at timestamp",
    "company_source_links": "company_id string, source_record_id string, relation string, confidence double, "
    "first_seen_at timestamp, last_seen_at timestamp",
    "job_source_links": "job_id string, source_record_id string, relation string, confidence double, "
    "first_seen_at timestamp, last_seen_at timestamp",
}

# Columns kept for later merges beside those of the entity. Files that were written without them have nulls there.
BESIDE = {"companies": "first_mention string"}

# Write order inside a table: rows close in space or time share files and row groups, so the
# ranges of radius and recency filters skip most of them.
LAYOUT = {
    "locations": ["cell"],
    "job_locations": ["cell"],
    "jobs": ["posted_at"],
    "sightings": ["company_id", "scraped_at"],
}

# Where the points of a table are: their space code is stored with the rows, as the column ``cell``, and orders them.
POINTS = {"locations": ("lat", "lng"), "job_locations": ("latitude", "longitude")}
CELL = "cell"
# The column whose hash decides the partition of a row where tables are partitioned: a delivery knows it for all it changes.
KEYS = {
    "companies": "id", "company_aliases": "normalized_alias", "company_domains": "normalized_domain", "locations": "company_id",
    "sightings": "id", "jobs": "id", "job_locations": "job_id", "job_remote_eligibility": "job_id", "data_sources": "slug",
    "ingestion_runs": "id", "source_records": "id", "company_source_links": "source_record_id",
    "job_source_links": "source_record_id",
}
# Names of versions that hold changed partitions only; the tables themselves are under ``tables``.
KEYED = "delivery-"

MANIFEST = "version string, sequence bigint, delivery string, at timestamp"


def schema_of(name: str) -> T.StructType:
    return T.StructType.fromDDL(", ".join([SCHEMAS[name], *([BESIDE[name]] if name in BESIDE else [])]))


def stored_schema(name: str) -> T.StructType:
    """The columns of a table's files."""
    return schema_of(name).add(CELL, T.LongType()) if name in POINTS else schema_of(name)


def stored_rows(name: str, rows: DataFrame) -> DataFrame:
    """Rows of a table with the columns and types of its files."""
    typed = rows.select([F.col(f.name).cast(f.dataType) for f in schema_of(name)])
    return typed.withColumn(CELL, space_code(*map(F.col, POINTS[name]))) if name in POINTS else typed


def empty_tables(spark: SparkSession) -> dict[str, DataFrame]:
    return {name: no_rows(spark, schema_of(name)) for name in SCHEMAS}


def no_rows(spark: SparkSession, kinds: T.StructType) -> DataFrame:
    """A table that the planner knows to be empty: joins and merges with it are left out."""
    return spark.createDataFrame([], kinds).limit(0)


def versions(spark: SparkSession, root: str) -> DataFrame:
    """Finished versions of a table root; empty for a new root."""
    try:
        return spark.read.schema(MANIFEST).option("mode", "FAILFAST").json(f"{root}/manifest")
    except AnalysisException as error:
        # Only a root that was never written is empty; anything else that cannot be read is an error.
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def latest(spark: SparkSession, root: str) -> tuple[str, int] | None:
    row = versions(spark, root).agg(F.max(F.struct("sequence", "version")).alias("v")).first()
    return (row.v.version, row.v.sequence) if row is not None and row.v is not None else None


def is_delivered(spark: SparkSession, root: str, delivery: str) -> bool:
    return not versions(spark, root).filter(F.col("delivery") == delivery).isEmpty()


def read_tables(spark: SparkSession, root: str, cells: bool = False) -> dict[str, DataFrame]:
    """Tables of the latest version, or empty ones; with ``cells`` those with points have their space code too, by which a
    search in a circle skips row groups. Partitioned tables are read as they are in place."""
    newest = latest(spark, root)
    wanted = {name: (stored_schema(name) if cells else schema_of(name)).fieldNames() for name in SCHEMAS}
    if newest is None:
        return {name: stored_rows(name, df).select(wanted[name]) for name, df in empty_tables(spark).items()}
    folder = "tables" if newest[0].startswith(KEYED) else newest[0]
    read = {}
    for name in SCHEMAS:
        path = f"{root}/{folder}/{name}"
        held = exists(spark, path) or not newest[0].startswith(KEYED)
        rows = spark.read.schema(stored_schema(name)).parquet(path) if held else no_rows(spark, stored_schema(name))
        # A partition that was emptied holds one row without a key.
        read[name] = (rows.filter(F.col(KEYS[name]).isNotNull()) if newest[0].startswith(KEYED) else rows).select(wanted[name])
    return read


class ConcurrentWrite(RuntimeError):
    """Another writer published the same version number first; read the tables again and repeat the merge."""


def _path(spark: SparkSession, path: str):
    """A path and its file system."""
    jvm = spark.sparkContext._jvm
    named = jvm.org.apache.hadoop.fs.Path(path)
    return named, named.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    named, files = _path(spark, path)
    return files.exists(named)


def create_once(spark: SparkSession, path: str, text: str) -> None:
    """Creates a small file; fails if the name is taken."""
    named, files = _path(spark, path)
    try:
        out = files.create(named, False)
    except Py4JJavaError as error:
        if files.exists(named):
            raise ConcurrentWrite(f"{path} was created by another writer") from error
        raise
    out.write(bytearray(text.encode()))
    out.close()


def write_tables(
    spark: SparkSession, tables: Mapping[str, DataFrame], root: str, delivery: str, based_on: int | None = None
) -> str:
    """Write a full version next to the others, then book it in the manifest.

    ``based_on`` is the number of the version that the tables were merged onto (default: the newest now). Raises
    ConcurrentWrite if another version was published on it meanwhile.
    """
    if based_on is None:
        newest = latest(spark, root)
        based_on = 0 if newest is None else newest[1]
    version = f"v-{uuid.uuid4().hex}"
    for name in SCHEMAS:
        rows = stored_rows(name, tables[name])
        order = LAYOUT.get(name)
        if order:
            rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
        rows.write.parquet(f"{root}/{version}/{name}")
    booked = {
        "version": version, "sequence": based_on + 1, "delivery": delivery,
        "at": datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%fZ"),
    }
    create_once(spark, f"{root}/manifest/{based_on + 1:012d}.json", json.dumps(booked) + "\n")
    return version


def remove_old_versions(spark: SparkSession, root: str, keep: int = 1) -> list[str]:
    """Deletes the table folders of all but the newest ``keep`` versions; the manifest keeps its entries, so a
    delivery stays known. To be called when no reader uses the old versions."""
    if keep < 1:
        raise ValueError("the newest version cannot be removed")
    names = [r.version for r in versions(spark, root).orderBy(F.desc("sequence")).select("version").collect()]
    removed = []
    for version in names[keep:]:
        path, files = _path(spark, f"{root}/{version}")
        if files.delete(path, True):
            removed.append(version)
    return removed


def read_jdbc(spark: SparkSession, url: str, table: str, properties: Mapping[str, str], **split: object) -> DataFrame:
    """A table of an existing database; ``split`` gives column, lowerBound, upperBound, numPartitions."""
    return spark.read.jdbc(url, table, properties=dict(properties), **split)
