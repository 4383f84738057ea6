"""Map elements to company evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearby_engine import schemas as S
from nearby_engine.functions.geo import in_radius
from nearby_engine.functions.text import company_hash, join_present, strip
from nearby_engine.functions.urls import host

# Office kinds and amenity that count, address parts in reading order, default radius.
OFFICE_KINDS = "company|it|software|telecommunication|coworking|research"
AMENITY = "coworking_space"
ADDRESS_TAGS = ["addr:housenumber", "addr:street", "addr:suburb", "addr:city", "addr:postcode"]
DEFAULT_RADIUS_KM = 15.0
ELEMENT_URL = "https://www.openstreetmap.org/"


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """One row per element of the landed extracts."""
    extracts = spark.read.schema(S.OSM_EXTRACT).json(path, multiLine=True)
    return extracts.select(F.inline("elements"))


def elements_of(payloads: DataFrame) -> DataFrame:
    """One row per element of extracts held as JSON text in ``payload``."""
    return payloads.select(F.inline(F.from_json("payload", S.OSM_EXTRACT)["elements"]))


def _tag(name: str) -> Column:
    return F.try_element_at(F.col("tags"), F.lit(name))


def _first_tag(*names: str) -> Column:
    return F.coalesce(*[F.when(_tag(n) != "", _tag(n)) for n in names])


def with_point(elements: DataFrame) -> DataFrame:
    """Own coordinates, or those of the centre when either is missing."""
    own = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    return elements.withColumns(
        {
            "lat": F.when(own, F.col("lat")).otherwise(F.col("center.lat")),
            "lng": F.when(own, F.col("lon")).otherwise(F.col("center.lon")),
        }
    ).drop("lon", "center")


def candidates(
    elements: DataFrame, lat: float | None, lng: float | None, radius_km: float | None = None
) -> DataFrame:
    """Office-like elements around a centre; without a centre (None) nothing is found."""
    if lat is None or lng is None:
        return with_point(elements).filter(F.lit(False))
    metres = int((radius_km or DEFAULT_RADIUS_KM) * 1000)
    radius = float(metres if metres > 0 else DEFAULT_RADIUS_KM * 1000)
    wanted = F.coalesce(_tag("office").rlike(OFFICE_KINDS), F.lit(False)) | F.coalesce(
        _tag("amenity") == AMENITY, F.lit(False)
    )
    return with_point(elements).filter(wanted & in_radius(F.col("lat"), F.col("lng"), lat, lng, radius))


def osm_companies(points: DataFrame) -> DataFrame:
    """Company evidence of elements that have a name of two characters and a point."""
    name = strip(_first_tag("name", "brand", "operator"))
    website = strip(_first_tag("website", "contact:website", "url"))
    site = F.when(website.rlike("^https?://"), website).otherwise(F.concat(F.lit("https://"), website))
    domain = F.regexp_replace(host(site), r"^www\.", "")
    domain = F.when(domain.contains(".") & (F.length(domain) >= 4), domain)
    record = F.concat_ws(":", F.lit("osm"), F.coalesce("type", F.lit("node")), F.col("id").cast("string"))
    named = points.filter(
        (F.length(name) >= 2) & F.col("lat").isNotNull() & F.col("lng").isNotNull()
    )
    return named.select(
        record.alias("page"), name.alias("name"), record.alias("source_record_id"),
        F.concat(F.lit(ELEMENT_URL), F.coalesce("type", F.lit("node")), F.lit("/"), F.col("id").cast("string")).alias(
            "evidence_url"
        ),
        domain.alias("domain"), join_present(", ", *[_tag(t) for t in ADDRESS_TAGS]).alias("address"),
        "lat", "lng", _first_tag("phone", "contact:phone").alias("phone"),
        company_hash(name, domain, record).alias("content_hash"),
        F.to_json(
            F.struct(F.coalesce("type", F.lit("node")).alias("osm_type"), F.col("id").alias("osm_id"), "tags")
        ).alias("metadata"),
    )
