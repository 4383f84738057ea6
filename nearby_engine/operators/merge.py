"""Keyed merges of evidence into the canonical tables.

Every merge is stored rows plus new rows, read by key: first-seen columns come from the earliest row,
the others from the latest. Which rows these are is found on the order of arrival alone, combined before
the shuffle, so a key with very many deliveries costs one narrow row per task; texts and payloads are
fetched for the latest rows only. Delivering the same evidence twice changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from nearby_engine.functions.classify import job_state, lookup, remote_scopes
from nearby_engine.functions.text import casefold, nul_digest, strip
from nearby_engine.operators.ranking import joined_to_few
from nearby_engine.sources.evidence import stored_key

# Defaults of merged rows and the source type behind each source family.
DEFAULT_CLASSIFICATION = "software_engineering"
DEFAULT_ROLE_FAMILY = "engineering"
SOURCE_TYPE_BY_FAMILY = {"official_site": "official_site", "job_ats": "official_ats"}
SCOPE_CONFIDENCE = 0.8
LINK_CONFIDENCE = 1.0
STICKY_SOURCES = ["structured", "provider"]


def fold(rows: DataFrame, keys: list[str], first: list[str], last: list[str]) -> DataFrame:
    """One row per key: ``first`` columns from the earliest row by ``seq``, ``last`` from the latest; all of them narrow."""
    columns = [F.min_by(F.struct(*first), "seq").alias("_first"), F.max_by(F.struct(*last), "seq").alias("_last")]
    return rows.groupBy(*keys).agg(*columns).select(*keys, "_first.*", "_last.*")


def fold_wide(rows: DataFrame, keys: list[str], first: list[str], last: list[str]) -> DataFrame:
    """As :func:`fold` for wide ``last`` columns; no two rows of a key have the same ``seq``.

    The aggregate reads keys, order and the few ``first`` columns. The latest rows are then fetched by key and order, which
    deals the rows of a hot key over many tasks; the others never leave their task's side of the join. Key and order are given
    to the join as two hashes of 64 bits, a fraction of their texts.
    """
    order = _short_order(rows)
    found = rows.select(*keys, order.alias("seq"), *first).groupBy(*keys)
    found = found.agg(F.min_by(F.struct(*first), "seq").alias("_first"), F.max("seq").alias("_latest"))

    def mark(at: Column) -> list[Column]:
        # A hash passes over nulls, so where they are is hashed too.
        parts = [x for k in keys for x in (F.col(k).isNull(), F.col(k))] + [at]
        return [F.xxhash64(*parts).alias("_mark"), F.xxhash64(F.lit(1), *parts).alias("_check")]

    latest = found.select("_first", *mark(F.col("_latest")))
    return rows.select(*keys, *last, *mark(order)).join(latest, ["_mark", "_check"]).select(*keys, "_first.*", *last)


def _short_order(rows: DataFrame) -> Column:
    """``seq`` with the digest in it as bytes, which sort like its hexadecimal text and are half as long."""
    kind = rows.schema["seq"].dataType
    if not isinstance(kind, StructType) or "batch_id" not in kind.names:
        return F.col("seq")
    digest = F.coalesce(F.unhex("seq.batch_id"), F.encode("seq.batch_id", "utf-8"))
    return F.struct(*[digest.alias(n) if n == "batch_id" else F.col(f"seq.{n}").alias(n) for n in kind.names])


def known_run(rows: DataFrame, runs: DataFrame | None) -> DataFrame:
    """Keep the run id only where the ledger has it."""
    if runs is None:
        return rows
    ledger = runs.select(F.col("id").alias("discovery_job_id")).distinct().withColumn("_known", F.lit(True))
    return (
        rows.join(ledger, "discovery_job_id", "left")
        .withColumn("discovery_job_id", F.when(F.col("_known"), F.col("discovery_job_id")))
        .drop("_known")
    )


def natural_key(external: Column, digest: Column) -> Column:
    """The external id when there is one, else the content digest."""
    present = F.coalesce(external, F.lit("")) != ""
    return F.when(present, F.concat(F.lit("i:"), external)).otherwise(F.concat(F.lit("h:"), digest))


def _nonblank(value: Column) -> Column:
    return F.when(value != "", value)


# --- sightings -----------------------------------------------------------------------------

SIGHTING_FIRST = ["source_family", "first_seen_at"]
SIGHTING_LAST = [
    "source_record_id", "content_hash", "discovery_job_id", "source_url", "company_name", "raw_address",
    "lat", "lng", "metadata", "company_id", "location_id", "last_seen_at", "scraped_at",
]


def with_metadata(metadata: Column, extra: dict[str, Column]) -> Column:
    """Metadata JSON with text fields added or replaced where the new value is set."""
    given = F.coalesce(F.from_json(metadata, "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    pairs = [x for name, value in extra.items() for x in (F.lit(name), _nonblank(value).cast("variant"))]
    added = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())
    kept = F.map_filter(given, lambda k, _: ~F.map_contains_key(added, k))
    return F.to_json(F.map_concat(kept, added))


def sighting_metadata(metadata: Column, domain: Column, phone: Column) -> Column:
    """Evidence metadata with domain and phone added when they are set."""
    return with_metadata(metadata, {"domain": domain, "phone": phone})


def sighting_digest() -> Column:
    fallback = nul_digest(F.col("name"), F.col("address"), F.col("domain"))
    return F.coalesce(_nonblank(F.col("content_hash")), fallback)


def with_sighting_key(rows: DataFrame) -> DataFrame:
    """Company records with the key of the sighting they describe."""
    return rows.withColumn("record_key", natural_key(F.col("source_record_id"), sighting_digest()))


def sighting_id(source: Column, record_key: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit("sighting"), source, record_key), 256)


def merge_sightings(existing: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` are company records with company_id and location_id."""
    digest = sighting_digest()
    incoming = with_sighting_key(rows).select(
        "source", "record_key", "seq",
        "source_family", F.col("observed_at").alias("first_seen_at"),
        F.col("source_record_id"), digest.alias("content_hash"), "discovery_job_id",
        F.col("evidence_url").alias("source_url"), F.col("name").alias("company_name"),
        F.coalesce("address", F.lit("")).alias("raw_address"), "lat", "lng",
        sighting_metadata(F.col("metadata"), F.col("domain"), F.col("phone")).alias("metadata"),
        "company_id", "location_id", F.col("observed_at").alias("last_seen_at"),
        F.col("observed_at").alias("scraped_at"),
    )
    stored = existing.withColumns(
        {
            "record_key": natural_key(F.col("source_record_id"), F.col("content_hash")),
            "seq": stored_key(F.col("last_seen_at")),
        }
    ).drop("id")
    merged = fold_wide(stored.unionByName(incoming), ["source", "record_key"], SIGHTING_FIRST, SIGHTING_LAST)
    return merged.select(
        sighting_id(F.col("source"), F.col("record_key")).alias("id"),
        "source", *SIGHTING_FIRST, *SIGHTING_LAST,
    )


# --- jobs ----------------------------------------------------------------------------------

JOB_FIRST = ["first_seen_at", "created_at", "is_active"]
JOB_LAST = [
    "company_id", "discovery_job_id", "source_family", "source_job_id", "canonical_url", "title",
    "normalized_title", "description_excerpt", "content_hash", "work_arrangement", "publication_state",
    "posted_at", "posted_at_confidence", "last_seen_at", "technical_classification", "rule_version",
    "classification_reasons", "metadata", "role_family", "seniority", "employment_type", "state",
    "activity_confidence",
]


def job_digest() -> Column:
    fallback = nul_digest(F.col("company_name"), F.col("title"), F.col("canonical_url"))
    return F.coalesce(_nonblank(F.col("content_hash")), fallback)


def job_id(source: Column, record_key: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit("job"), source, record_key), 256)


def with_job_id(rows: DataFrame) -> DataFrame:
    """Job records with the key and id of the posting they describe."""
    return rows.withColumn("record_key", natural_key(F.col("source_job_id"), job_digest())).withColumn(
        "job_id", job_id(F.col("source"), F.col("record_key"))
    )


def merge_jobs(existing: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` are job records with company_id, record_key and job_id."""
    title = strip(F.col("title"))
    incoming = rows.select(
        "source", "record_key", "seq", "first_seen_at", F.col("observed_at").alias("created_at"),
        F.lit(True).alias("is_active"), "company_id", "discovery_job_id", "source_family", "source_job_id",
        _nonblank(F.col("canonical_url")).alias("canonical_url"), title.alias("title"),
        casefold(title).alias("normalized_title"), "description_excerpt", job_digest().alias("content_hash"),
        "work_arrangement", "publication_state", "posted_at",
        F.coalesce("posted_at_confidence", F.lit(0.0)).alias("posted_at_confidence"), "last_seen_at",
        F.coalesce(_nonblank(F.col("technical_classification")), F.lit(DEFAULT_CLASSIFICATION)).alias(
            "technical_classification"
        ),
        F.coalesce("rule_version", F.lit("v1")).alias("rule_version"), "classification_reasons",
        F.coalesce("metadata", F.lit("{}")).alias("metadata"),
        F.lit(DEFAULT_ROLE_FAMILY).alias("role_family"), F.lit("unknown").alias("seniority"),
        F.lit("unknown").alias("employment_type"), job_state(F.col("publication_state")).alias("state"),
        F.coalesce("posted_at_confidence", F.lit(0.0)).alias("activity_confidence"),
    )
    stored = existing.withColumns(
        {
            "record_key": natural_key(F.col("source_job_id"), F.col("content_hash")),
            "seq": stored_key(F.col("last_seen_at")),
        }
    ).drop("id")
    merged = fold_wide(stored.unionByName(incoming), ["source", "record_key"], JOB_FIRST, JOB_LAST)
    return merged.select(job_id(F.col("source"), F.col("record_key")).alias("id"), "source", *JOB_FIRST, *JOB_LAST)


# --- job locations and remote eligibility ----------------------------------------------------

# Columns of job records that the two merges read.
JOB_LOCATION_READS = [
    "job_id", "seq", "observed_at", "location_raw", "lat", "lng", "coordinate_source", "first_seen_at", "last_seen_at",
]
ELIGIBILITY_READS = ["job_id", "seq", "observed_at", "source_record_id", "work_arrangement", "remote_scopes"]

LOCATION_FIELDS = [
    "job_id", "ordinal", "location_raw", "latitude", "longitude", "coordinate_source", "confidence",
    "location_kind", "country_code", "is_active", "first_seen_at", "last_seen_at",
]


def _after_reset(events: DataFrame) -> DataFrame:
    """Drop the resets and whatever came before the last one of each job; the events of a job with very many are parted."""
    resets = events.filter("reset").groupBy("job_id").agg(F.max("seq").alias("_reset"))
    alive = joined_to_few(events.filter(~F.col("reset")), resets, "job_id", "seq")
    return alive.filter(F.col("_reset").isNull() | (F.col("seq") > F.col("_reset"))).drop("_reset", "reset")


def merge_job_locations(existing: DataFrame, rows: DataFrame) -> DataFrame:
    """One primary location per job; coordinates stay once a structured or provider source gave them."""
    text = F.coalesce("location_raw", F.lit(""))
    located = F.col("lat").isNotNull()
    given = F.coalesce(_nonblank(F.col("coordinate_source")), F.lit("unknown"))
    source = F.when(given != "unknown", given).otherwise(F.when(located, "provider").otherwise("unknown"))
    incoming = rows.select(
        "job_id", "seq", ((text == "") & ~located).alias("reset"), F.lit(0).cast("long").alias("ordinal"),
        text.alias("location_raw"), F.col("lat").alias("latitude"), F.col("lng").alias("longitude"),
        source.alias("coordinate_source"), F.when(located, 1.0).otherwise(0.0).alias("confidence"),
        F.when(text != "", "stated_job_location").otherwise("inferred").alias("location_kind"),
        F.lit("IN").alias("country_code"), F.lit(True).alias("is_active"), "first_seen_at", "last_seen_at",
    )
    stored = existing.select(
        "job_id", stored_key(F.col("last_seen_at")).alias("seq"), F.lit(False).alias("reset"),
        F.col("ordinal").cast("long").alias("ordinal"), *LOCATION_FIELDS[2:],
    )
    alive = _after_reset(stored.unionByName(incoming))
    point = F.struct("latitude", "longitude", "coordinate_source", "confidence")
    sticky = F.col("coordinate_source").isin(STICKY_SOURCES)
    merged = alive.groupBy("job_id", "ordinal").agg(
        F.coalesce(
            F.min_by(F.when(sticky, point), F.when(sticky, F.col("seq"))), F.max_by(point, "seq")
        ).alias("point"),
        F.max_by(F.struct("location_raw", "location_kind", "country_code", "last_seen_at"), "seq").alias("last"),
        F.min_by(F.struct("first_seen_at", "is_active"), "seq").alias("first"),
    )
    return merged.select("job_id", "ordinal", "point.*", "last.*", "first.*").select(LOCATION_FIELDS)


ELIGIBILITY_FIELDS = [
    "job_id", "scope_type", "scope_code", "source_record_id", "confidence", "is_active", "first_seen_at",
    "last_seen_at",
]


def merge_remote_eligibility(existing: DataFrame, rows: DataFrame) -> DataFrame:
    """Remote scopes per job; a delivery without scopes, or not remote, clears what was there."""
    scopes = F.when(F.col("work_arrangement") == "remote", remote_scopes(F.col("remote_scopes")))
    events = rows.select(
        "job_id", "seq", "source_record_id", "observed_at", scopes.alias("scopes"),
        (F.coalesce(F.size(scopes), F.lit(0)) <= 0).alias("reset"),
    )
    incoming = events.select(
        "job_id", "seq", "reset", "source_record_id", F.explode_outer("scopes").alias("scope"), "observed_at"
    ).select(
        "job_id", "seq", "reset", "scope.scope_type", "scope.scope_code", "source_record_id",
        F.col("observed_at").alias("first_seen_at"), F.col("observed_at").alias("last_seen_at"),
        F.lit(SCOPE_CONFIDENCE).alias("confidence"), F.lit(True).alias("is_active"),
    )
    stored = existing.select(
        "job_id", stored_key(F.col("last_seen_at")).alias("seq"), F.lit(False).alias("reset"),
        "scope_type", "scope_code", "source_record_id", "first_seen_at", "last_seen_at", "confidence", "is_active",
    )
    # A scope that nobody delivered keeps its state; a delivered one is active, at the confidence it was first booked with.
    merged = fold(
        _after_reset(stored.unionByName(incoming)), ["job_id", "scope_type", "scope_code"],
        ["source_record_id", "first_seen_at", "confidence"], ["last_seen_at", "is_active"],
    )
    return merged.select(ELIGIBILITY_FIELDS)


# --- sources, runs, records, links -----------------------------------------------------------


def merge_data_sources(existing: DataFrame, batches: DataFrame) -> DataFrame:
    """Insert sources that are not registered yet; the first family seen decides the type."""
    fresh = batches.groupBy(F.col("source").alias("slug")).agg(
        F.min_by("source_family", F.struct("observed_at", "batch_id")).alias("source_family")
    )
    rows = fresh.join(existing, "slug", "left_anti").select(
        "slug", F.col("slug").alias("name"),
        lookup(F.col("source_family"), SOURCE_TYPE_BY_FAMILY, F.lit("open_dataset")).alias("source_type"),
        "source_family",
    )
    return existing.unionByName(rows)


def ingestion_runs(existing: DataFrame, batches: DataFrame) -> DataFrame:
    """One completed run per batch with its record count; a batch already booked is not booked twice."""
    rows = batches.select(
        F.col("batch_id").alias("id"), "source", "discovery_job_id", F.lit("v1").alias("adapter_version"),
        F.lit("completed").alias("status"),
        (F.coalesce(F.size("companies"), F.lit(0)) + F.coalesce(F.size("jobs"), F.lit(0))).alias("accepted_count"),
        F.lit(0).alias("rejected_count"),
    ).dropDuplicates(["id"])
    return existing.unionByName(rows.join(existing, "id", "left_anti"))


def company_payload() -> Column:
    """Canonical JSON of a company record, keys sorted, missing values left out."""
    return F.to_json(F.struct("address", "domain", "lat", "lng", "name", "phone"))


def job_payload() -> Column:
    """Canonical JSON of a job record without the times of sight, which change on every delivery."""
    fields = sorted(
        [
            "company_name", "title", "source_job_id", "canonical_url", "company_domain", "description_excerpt",
            "content_hash", "location_raw", "lat", "lng", "coordinate_source", "work_arrangement",
            "publication_state", "posted_at", "posted_at_confidence", "technical_classification",
            "rule_version", "classification_reasons", "metadata", "remote_scopes",
        ]
    )
    return F.to_json(F.struct(*fields))


RECORD_FIRST = ["run_id", "external_id", "source_url", "payload_hash", "first_seen_at"]
RECORD_LAST = ["payload", "last_seen_at"]


def with_record(rows: DataFrame, record_type: str, external: str, url: str, payload: Column) -> DataFrame:
    """Add the source record a row supports: its payload, hash, key and id."""
    return (
        rows.withColumns({"payload": payload, "record_type": F.lit(record_type)})
        .withColumn("payload_hash", nul_digest(F.col("payload")))
        .withColumns(
            {
                "record_external_id": _nonblank(F.col(external)),
                "record_url": _nonblank(F.col(url)) if record_type == "job" else F.col(url),
                "source_record_key": natural_key(F.col(external), F.col("payload_hash")),
            }
        )
        .withColumn("record_ref", record_ref())
    )


def record_ref() -> Column:
    return F.sha2(F.concat_ws("|", F.lit("record"), "source", "record_type", "source_record_key"), 256)


# Columns of records that the two merges read.
SOURCE_RECORD_READS = [
    "source", "record_type", "source_record_key", "seq", "batch_id", "record_external_id", "record_url", "payload_hash", "observed_at", "payload",
]
LINK_READS = ["record_ref", "observed_at"]


def merge_source_records(existing: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` come from :func:`with_record`. Hash, url and run stay from the first delivery."""
    incoming = rows.select(
        "source", "record_type", F.col("source_record_key").alias("record_key"), "seq",
        F.col("batch_id").alias("run_id"), F.col("record_external_id").alias("external_id"),
        F.col("record_url").alias("source_url"), "payload_hash", F.col("observed_at").alias("first_seen_at"),
        "payload", F.col("observed_at").alias("last_seen_at"),
    )
    stored = existing.withColumns(
        {
            "record_key": natural_key(F.col("external_id"), F.col("payload_hash")),
            "seq": stored_key(F.col("last_seen_at")),
        }
    ).drop("id")
    merged = fold_wide(stored.unionByName(incoming), ["source", "record_type", "record_key"], RECORD_FIRST, RECORD_LAST)
    return merged.select(
        F.sha2(F.concat_ws("|", F.lit("record"), "source", "record_type", "record_key"), 256).alias("id"),
        "source", "record_type", *RECORD_FIRST, *RECORD_LAST,
    )


def merge_links(existing: DataFrame, rows: DataFrame, entity: str) -> DataFrame:
    """Unique (entity, record) pairs with first and last sight; ``rows`` have the entity and record_ref."""
    fresh = rows.select(
        entity, F.col("record_ref").alias("source_record_id"), F.lit("evidence").alias("relation"),
        F.lit(LINK_CONFIDENCE).alias("confidence"),
        F.col("observed_at").alias("first_seen_at"), F.col("observed_at").alias("last_seen_at"),
    )
    return (
        existing.unionByName(fresh)
        .groupBy(entity, "source_record_id")
        .agg(
            F.min("relation").alias("relation"), F.max("confidence").alias("confidence"),
            F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"),
        )
    )

