"""Explicit schemas and closed vocabularies. Nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

# Closed vocabularies of the data model.
PRESENCE_TYPES = ["confirmed_office", "probable_office", "job_location_only"]
WORK_ARRANGEMENTS = ["in_office", "hybrid", "remote", "unknown"]
PUBLICATION_STATES = ["posted_recently", "observed_recently", "stale"]

# Limits of the evidence contract.
CONTRACT_VERSION = 1
MAX_DESCRIPTION_CHARS = 2000
MAX_METADATA_BYTES = 64 * 1024
MAX_NAME_CHARS = 500
MAX_SOURCE_CHARS = 100
FUTURE_TOLERANCE_MINUTES = 5

STR, DBL, INT, LONG, TS, BOOL = (
    T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType(), T.TimestampType(), T.BooleanType(),
)


def struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


COMPANY_EVIDENCE = struct(
    ("name", STR), ("source_record_id", STR), ("evidence_url", STR), ("domain", STR),
    ("address", STR), ("lat", DBL), ("lng", DBL), ("phone", STR),
    ("content_hash", STR), ("metadata", STR),
)

# Times stay text here: validation has to see whether they carry a zone.
JOB_EVIDENCE = struct(
    ("company_name", STR), ("title", STR), ("source_job_id", STR), ("canonical_url", STR),
    ("company_domain", STR), ("description_excerpt", STR), ("content_hash", STR),
    ("location_raw", STR), ("lat", DBL), ("lng", DBL), ("coordinate_source", STR),
    ("work_arrangement", STR), ("publication_state", STR), ("posted_at", STR),
    ("posted_at_confidence", DBL), ("first_seen_at", STR), ("last_seen_at", STR),
    ("technical_classification", STR), ("rule_version", STR),
    ("classification_reasons", T.ArrayType(STR)), ("metadata", STR),
    ("remote_scopes", T.ArrayType(STR)),
)

EVIDENCE_BATCH = struct(
    ("contract_version", INT), ("discovery_job_id", STR), ("source", STR), ("source_family", STR),
    ("observed_at", STR),
    ("companies", T.ArrayType(COMPANY_EVIDENCE)), ("jobs", T.ArrayType(JOB_EVIDENCE)),
)

NAMED = struct(("id", LONG), ("name", STR))

GREENHOUSE_JOB = struct(
    ("id", STR), ("internal_job_id", STR), ("title", STR), ("updated_at", STR), ("absolute_url", STR),
    ("location", STR), ("workplace_type", STR), ("departments", T.ArrayType(NAMED)), ("content", STR),
)
GREENHOUSE_PAGE = struct(("jobs", T.ArrayType(GREENHOUSE_JOB)))

LEVER_POSTING = struct(
    ("id", STR), ("text", STR), ("createdAt", STR), ("hostedUrl", STR), ("applyUrl", STR),
    ("categories", T.MapType(STR, STR)), ("descriptionPlain", STR), ("description", STR),
)
LEVER_PAGE = struct(("postings", T.ArrayType(LEVER_POSTING)), ("jobs", T.ArrayType(LEVER_POSTING)))

POINT = struct(("lat", DBL), ("lon", DBL))
OSM_ELEMENT = struct(
    ("type", STR), ("id", LONG), ("lat", DBL), ("lon", DBL), ("center", POINT),
    ("tags", T.MapType(STR, STR)),
)
OSM_EXTRACT = struct(("elements", T.ArrayType(OSM_ELEMENT)))
