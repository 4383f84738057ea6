"""JSON-LD in pages to company and job evidence.

Page frames have (url, html); ``url`` is the base for links and the key of a page.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearby_engine.functions import markup as M
from nearby_engine.functions.classify import page_arrangement, page_publication_state
from nearby_engine.functions.dates import iso_timestamp, iso_z
from nearby_engine.functions.text import page_company_hash, page_job_hash, plain_text, strip
from nearby_engine.functions.urls import bare_domain, resolve_or_base
from nearby_engine.operators.ranking import keep_first, once
from nearby_engine.operators.search import instant
from nearby_engine.session import cut

# Entity types that describe a company, and the one that describes a posting.
COMPANY_TYPES = [
    "organization",
    "corporation",
    "company",
    "localbusiness",
    "store",
    "restaurant",
    "professionalservice",
    "financialservice",
    "automotivebusiness",
    "medicalorganization",
    "educationalorganization",
    "ngo",
    "governmentorganization",
]
JOB_TYPE = "jobposting"


def page_entities(pages: DataFrame) -> DataFrame:
    """(url, position, entity, types) of every typed entity, in page order."""
    # Pages without a JSON-LD script are dropped before the expressions that parse it.
    marked = pages.filter(F.lower("html").contains("application/ld+json"))
    read = once(marked.select("url", "html"), {"blocks": M.ld_blocks(F.col("html"))})
    blocks = read.select("url", F.posexplode("blocks").alias("at", "entity"))
    level = cut(blocks.select("url", F.array("at").alias("path"), "entity"))
    levels = [level]
    # Lists and graphs are opened level by level until nothing is left inside.
    while True:
        inside = once(level, {"inside": M.children(F.col("entity"))})
        opened = inside.select("url", "path", F.posexplode("inside").alias("at", "entity"))
        level = cut(opened.select("url", F.concat("path", F.array("at")).alias("path"), "entity"))
        if level.isEmpty():
            break
        levels.append(level)
    every = reduce(DataFrame.unionByName, levels).filter(M.is_typed(F.col("entity")))
    # Children come before their parent.
    placed = every.select("url", F.concat("path", F.array(F.lit(2**31 - 1))).alias("position"), "entity")
    return once(placed, {"types": M.entity_types(F.col("entity"))})


def _is_company() -> Column:
    return F.arrays_overlap(F.col("types"), F.array(*[F.lit(t) for t in COMPANY_TYPES]))


def _name(entity: Column) -> Column:
    return M.first_text(entity, "$.name", "$.legalName")


def _either(entity: Column, first: str, second: str) -> Column:
    return F.when(M.is_truthy(entity, first), M.scalar_at(entity, first)).otherwise(M.scalar_at(entity, second))


def structured_companies(entities: DataFrame) -> DataFrame:
    """Company evidence per page, repeated entities of a page once."""
    e = F.col("entity")
    record = F.when(M.is_truthy(e, '$["@id"]'), M.scalar_at(e, '$["@id"]')).otherwise(M.identifier(e))
    # Every field is read from the entity once; what follows works on plain columns.
    read = once(
        entities.filter(_is_company()).withColumnRenamed("url", "page"),
        {
            "name": _name(e), "source_record_id": record, "link": M.text_at(e, "$.url"),
            "address": M.postal_address(e), "raw_point": M.raw_point(e),
            "phone": _either(e, "$.telephone", "$.phone"), "raw_type": M.node(e, '$["@type"]'),
            "about": F.when(M.is_truthy(e, "$.description"), M.scalar_at(e, "$.description")),
        },
    ).filter(F.col("name").isNotNull())
    linked = once(read, {"evidence_url": resolve_or_base(F.col("link"), F.col("page"))})
    placed = once(
        linked,
        {
            "point": M.valid_point(F.col("raw_point")),
            "domain": F.coalesce(bare_domain(F.col("evidence_url")), bare_domain(F.col("page"))),
            "described": F.when(F.col("about").isNotNull(), plain_text(F.col("about"))),
        },
    )
    rows = placed.select(
        "page", "position", "name", "source_record_id", "evidence_url", "domain", "address",
        F.col("point.lat").alias("lat"), F.col("point.lng").alias("lng"), "phone",
        page_company_hash(F.col("name"), F.col("domain"), F.col("address"), F.col("point.lat"), F.col("point.lng")).alias(
            "content_hash"
        ),
        F.to_json(F.struct("raw_type", F.col("described").alias("description"))).alias("metadata"),
    )
    return keep_first(rows, ["page", "content_hash"], ["position"])


def structured_jobs(entities: DataFrame, as_of: datetime | str | Column) -> DataFrame:
    """Job evidence per page, repeated entities of a page once.

    An entity that is also a company without a name is skipped, as for companies.
    """
    now = instant(as_of)
    e, hiring, place = F.col("entity"), F.col("hiring"), F.col("place")
    usable = F.array_contains("types", JOB_TYPE) & ~(_is_company() & _name(e).isNull())
    located = F.when(M.is_list(e, "$.jobLocation"), M.node(e, "$.jobLocation[0]")).otherwise(
        M.node(e, "$.jobLocation")
    )
    parts = once(
        entities.filter(usable).withColumnRenamed("url", "page"),
        {
            "title": M.first_text(e, "$.title", "$.jobTitle"),
            "hiring": M.node(e, "$.hiringOrganization"), "place": located,
            "source_job_id": F.coalesce(M.identifier(e), M.scalar_at(e, '$["@id"]')),
            "link": M.text_at(e, "$.url"), "about": F.coalesce(M.scalar_at(e, "$.description"), F.lit("")),
            "location_type": M.scalar_at(e, "$.jobLocationType"), "posted_text": M.scalar_at(e, "$.datePosted"),
            "raw_type": M.node(e, '$["@type"]'),
            "employment_type": F.when(M.is_truthy(e, "$.employmentType"), M.node(e, "$.employmentType")),
        },
    ).filter(F.col("title").isNotNull())
    as_object = M.is_object(hiring, "$")
    inside = M.is_object(place, "$")
    loose = F.coalesce(F.when(~M.is_list(place, "$"), M.scalar_at(place, "$")), F.lit(""))
    read = once(
        parts.drop("entity"),
        {
            "employer": F.when(as_object, _either(hiring, "$.name", "$.legalName")).otherwise(M.text_at(hiring, "$")),
            "employer_link": F.when(as_object, F.coalesce(M.text_at(hiring, "$.url"), F.col("page"))),
            "location_raw": F.when(inside, M.postal_address(place)).otherwise(loose),
            "raw_point": F.when(inside, M.raw_point(place)),
            "posted": iso_timestamp(F.col("posted_text")),
            "canonical_url": F.coalesce(resolve_or_base(F.col("link"), F.col("page")), F.lit("")),
        },
    )
    placed = once(
        read,
        {
            "point": M.valid_point(F.col("raw_point")),
            "company_name": F.coalesce(strip(F.col("employer")), F.lit("Unknown")),
            "company_domain": F.coalesce(
                bare_domain(F.when(F.col("employer_link").isNotNull(), resolve_or_base(F.col("employer_link"), F.col("page")))),
                bare_domain(F.col("canonical_url")), bare_domain(F.col("page")),
            ),
            "excerpt": plain_text(F.col("about")),
        },
    )
    rows = placed.select(
        "page", "position", "company_name", "title", "source_job_id", "canonical_url", "company_domain",
        F.when(F.col("excerpt") != "", F.col("excerpt")).alias("description_excerpt"),
        page_job_hash(F.col("company_name"), F.col("title"), F.col("canonical_url"), F.col("location_raw")).alias(
            "content_hash"
        ),
        "location_raw", F.col("point.lat").alias("lat"), F.col("point.lng").alias("lng"),
        F.lit("unknown").alias("coordinate_source"),
        page_arrangement(F.col("location_type"), F.col("title")).alias("work_arrangement"),
        page_publication_state(F.col("posted"), now).alias("publication_state"),
        iso_z(F.col("posted")).alias("posted_at"),
        F.when(F.col("posted").isNotNull(), 1.0).otherwise(0.0).alias("posted_at_confidence"),
        iso_z(now).alias("first_seen_at"), iso_z(now).alias("last_seen_at"),
        F.lit("").alias("technical_classification"), F.lit("v1").alias("rule_version"),
        F.array().cast("array<string>").alias("classification_reasons"),
        F.to_json(F.struct("raw_type", "employment_type")).alias("metadata"),
        F.array().cast("array<string>").alias("remote_scopes"),
    )
    return keep_first(rows, ["page", "content_hash"], ["position"])
