"""Radius search over offices and jobs, and the per-company reads.

``t`` is a mapping of canonical tables. Every function returns a lazy DataFrame, an
optional filter that is not given adds no predicate, and nothing is collected.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearby_engine.functions.classify import days_before
from nearby_engine.functions.geo import distance_m, in_codes, in_radius
from nearby_engine.functions.text import contains_ignoring_case, trigram_similar
from nearby_engine.operators.text_index import candidate_keys

Tables = Mapping[str, DataFrame]

DEFAULT_LIMIT = 50


def instant(as_of: datetime | str | Column) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")


def paged(rows: DataFrame, limit: int | None, offset: int) -> DataFrame:
    """One page of ordered rows; None means all rows from the offset on."""
    if offset < 0 or limit is not None and limit < 1:
        raise ValueError("a page needs a positive limit and an offset of at least zero")
    rest = rows.offset(offset) if offset else rows
    return rest if limit is None else rest.limit(limit)


def trusted_recent(as_of: datetime | str | Column) -> Column:
    """Job rows that count for a company: active, posted in the window, trusted date."""
    since = days_before(instant(as_of))
    state = F.col("publication_state")
    trusted = (state == "posted_recently") | (
        (F.col("posted_at_confidence") > 0) & ~state.isin("observed_recently", "stale")
    )
    return F.col("is_active") & F.col("posted_at").isNotNull() & (F.col("posted_at") >= since) & trusted


def company_hiring(jobs: DataFrame, as_of: datetime | str | Column) -> DataFrame:
    """Per company: how many trusted recent jobs, and which arrangements they offer."""
    return (
        jobs.filter(trusted_recent(as_of))
        .groupBy("company_id")
        .agg(
            F.count("*").alias("recent_technical_job_count"),
            F.array_sort(F.collect_set("work_arrangement")).alias("arrangements"),
        )
    )


#: Optional tables of a mapping: trigram postings of company names and of job titles.
COMPANY_POSTINGS, JOB_POSTINGS = "company_postings", "job_postings"


def _among_candidates(rows: DataFrame, key: str, index: DataFrame | None, query: str) -> DataFrame:
    """Rows that the postings leave in question; all rows where there are none, or the query has nothing to look up."""
    keys = None if index is None else candidate_keys(index, query)
    return rows if keys is None else rows.join(keys.withColumnRenamed("key", key), key, "left_semi")


def _company_matches(query: str) -> Column:
    return contains_ignoring_case(F.col("name"), query) | trigram_similar(F.col("normalized_name"), query)


def in_circle(rows: DataFrame, lat_column: str, lng_column: str, lat: float, lng: float, radius_m: float) -> DataFrame:
    """Rows in the circle; stored rows that carry their space code are found by ranges of it first."""
    inside = in_radius(F.col(lat_column), F.col(lng_column), lat, lng, radius_m)
    if "cell" not in rows.columns:
        return rows.filter(inside)
    return rows.filter(in_codes(F.col("cell"), lat, lng, radius_m) & inside).drop("cell")


def matching_offices(
    t: Tables,
    lat: float,
    lng: float,
    radius_m: float,
    min_confidence: float | None = None,
    industry: str | None = None,
    query: str | None = None,
    viewport: Column | None = None,
) -> DataFrame:
    """Offices in the circle joined to their companies, job-only places left out."""
    offices = in_circle(t["locations"], "lat", "lng", lat, lng, radius_m).filter(F.col("presence_type") != "job_location_only")
    if viewport is not None:
        offices = offices.filter(viewport)
    if min_confidence is not None:
        offices = offices.filter(F.col("confidence") >= min_confidence)
    companies = t["companies"]
    if industry is not None:
        companies = companies.filter(contains_ignoring_case(F.col("industry"), industry))
    if query is not None:
        companies = _among_candidates(companies, "id", t.get(COMPANY_POSTINGS), query).filter(_company_matches(query))
    left = offices.withColumnRenamed("id", "location_id").drop("name")
    right = companies.select(
        F.col("id").alias("company_id"), "name", "domain", "industry", "employee_count"
    )
    return left.join(right, "company_id")


def search_offices(
    t: Tables,
    lat: float,
    lng: float,
    radius_m: float,
    as_of: datetime | str,
    min_confidence: float | None = None,
    industry: str | None = None,
    query: str | None = None,
    limit: int | None = DEFAULT_LIMIT,
    offset: int = 0,
) -> DataFrame:
    """A page of offices by distance with company facts and company-wide hiring facts."""
    found = matching_offices(t, lat, lng, radius_m, min_confidence, industry, query)
    measured = found.withColumn("distance_m", distance_m(F.col("lat"), F.col("lng"), lat, lng))
    # The page is cut before the jobs are looked at: the left join keeps every office and
    # adds no rows, so only the companies on the page need their jobs counted.
    page = paged(measured.orderBy("distance_m", "location_id"), limit, offset)
    wanted = page.select("company_id").distinct()
    # A page is small by its own size; without one the planner decides.
    wanted = wanted if limit is None else F.broadcast(wanted)
    hiring = company_hiring(t["jobs"].join(wanted, "company_id", "left_semi"), as_of)
    return (
        page.join(hiring, "company_id", "left")
        .select(
            "company_id", "name", "domain", "industry", "employee_count",
            "location_id", "label", "address", "city", "lat", "lng", "confidence", "distance_m",
            F.coalesce("presence_type", F.lit("probable_office")).alias("presence_type"),
            F.coalesce("recent_technical_job_count", F.lit(0)).alias("recent_technical_job_count"),
            F.coalesce("arrangements", F.array().cast("array<string>")).alias("arrangements"),
            "verified",
        )
        .orderBy("distance_m", "location_id")
    )


def count_offices(
    t: Tables,
    lat: float,
    lng: float,
    radius_m: float,
    min_confidence: float | None = None,
    industry: str | None = None,
    query: str | None = None,
) -> DataFrame:
    found = matching_offices(t, lat, lng, radius_m, min_confidence, industry, query)
    return found.agg(F.count("*").alias("total"))


def searchable_jobs(t: Tables, as_of: datetime | str, arrangement: str | None = None) -> DataFrame:
    """Active, local, trusted postings of the last 14 days."""
    jobs = t["jobs"].filter(
        F.col("is_active")
        & (F.col("work_arrangement") != "remote")
        & (F.col("publication_state") == "posted_recently")
        & F.col("posted_at").isNotNull()
        & (F.col("posted_at") >= days_before(instant(as_of)))
        & (F.col("posted_at_confidence") > 0)
    )
    return jobs if arrangement is None else jobs.filter(F.col("work_arrangement") == arrangement)


def _located(t: Tables, lat: float, lng: float, radius_m: float) -> DataFrame:
    placed = F.col("is_active") & F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    return in_circle(t["job_locations"].filter(placed), "latitude", "longitude", lat, lng, radius_m)


def _with_company(jobs: DataFrame, t: Tables, query: str | None) -> DataFrame:
    companies = t["companies"].select(
        F.col("id").alias("company_id"), F.col("name").alias("company_name"), F.col("domain").alias("company_domain")
    )
    if query is None:
        return jobs.join(companies, "company_id")
    indexes = t.get(JOB_POSTINGS), t.get(COMPANY_POSTINGS)
    keys = [None if index is None else candidate_keys(index, query) for index in indexes]
    if keys[0] is not None and keys[1] is not None:
        # A job is in question by its own title or by its company's name.
        by_title = jobs.join(keys[0].withColumnRenamed("key", "id"), "id", "left_semi")
        by_company = jobs.join(keys[1].withColumnRenamed("key", "company_id"), "company_id", "left_semi")
        others = by_company.join(keys[0].withColumnRenamed("key", "id"), "id", "left_anti")
        jobs = by_title.unionByName(others)
    joined = jobs.join(companies, "company_id")
    return joined.filter(
        contains_ignoring_case(F.col("title"), query)
        | trigram_similar(F.col("normalized_title"), query)
        | contains_ignoring_case(F.col("company_name"), query)
    )


def search_jobs(
    t: Tables,
    lat: float,
    lng: float,
    radius_m: float,
    as_of: datetime | str,
    query: str | None = None,
    arrangement: str | None = None,
    limit: int | None = DEFAULT_LIMIT,
    offset: int = 0,
) -> DataFrame:
    """A page of jobs by the distance of their nearest location in the circle; places of other jobs are not looked at."""
    jobs = searchable_jobs(t, as_of, arrangement)
    nearest = (
        _located(t, lat, lng, radius_m)
        .join(jobs.select(F.col("id").alias("job_id")), "job_id", "left_semi")
        .withColumn("distance_m", distance_m(F.col("latitude"), F.col("longitude"), lat, lng))
        .groupBy("job_id")
        .agg(
            F.min(
                F.struct("distance_m", "ordinal", "location_raw", "latitude", "longitude")
            ).alias("near")
        )
        .select(F.col("job_id").alias("id"), "near.*")
    )
    found = _with_company(jobs.join(nearest, "id"), t, query)
    rows = found.select(
            "id", "company_id", "company_name", "company_domain", "title", "normalized_title",
            "description_excerpt", "canonical_url", "source", "source_family", "location_raw",
            F.col("latitude").alias("lat"), F.col("longitude").alias("lng"), "distance_m",
            "work_arrangement", "publication_state", "posted_at", "posted_at_confidence",
            "first_seen_at", "last_seen_at", "metadata",
        ).orderBy("distance_m", F.desc("posted_at"), "id")
    return paged(rows, limit, offset)


def count_jobs(
    t: Tables,
    lat: float,
    lng: float,
    radius_m: float,
    as_of: datetime | str,
    query: str | None = None,
    arrangement: str | None = None,
) -> DataFrame:
    places = _located(t, lat, lng, radius_m).select(F.col("job_id").alias("id"))
    jobs = searchable_jobs(t, as_of, arrangement).join(places, "id", "left_semi")
    return _with_company(jobs, t, query).agg(F.count("*").alias("total"))


def company_jobs(
    t: Tables, company_id: object | None = None, since: datetime | str | Column | None = None
) -> DataFrame:
    """Active jobs with their first active location, newest first; all companies without an id."""
    jobs = t["jobs"].filter("is_active")
    if company_id is not None:
        jobs = jobs.filter(F.col("company_id") == company_id)
    shown = F.coalesce("posted_at", "last_seen_at")
    if since is not None:
        jobs = jobs.filter(shown >= instant(since))
    first = (
        t["job_locations"]
        .filter("is_active")
        .groupBy(F.col("job_id").alias("id"))
        .agg(F.min(F.struct("ordinal", "location_raw", "latitude", "longitude")).alias("place"))
    )
    return (
        jobs.join(first, "id", "left")
        .select(
            *[c for c in jobs.columns],
            F.coalesce("place.location_raw", F.lit("")).alias("location_raw"),
            F.col("place.latitude").alias("lat"),
            F.col("place.longitude").alias("lng"),
        )
        .orderBy(F.desc(shown), "id")
    )


def company(t: Tables, company_id: object) -> DataFrame:
    return t["companies"].filter(F.col("id") == company_id)


def company_offices(t: Tables, company_id: object | None = None) -> DataFrame:
    offices = t["locations"]
    return offices if company_id is None else offices.filter(F.col("company_id") == company_id)


def company_sightings(t: Tables, company_id: object | None = None) -> DataFrame:
    """Sightings newest first; all companies without an id."""
    seen = t["sightings"]
    if company_id is not None:
        seen = seen.filter(F.col("company_id") == company_id)
    return seen.orderBy(F.desc("scraped_at"), "id")


def company_sources(sightings: DataFrame) -> DataFrame:
    """Distinct lower-cased sources of each company with the first URL seen there."""
    newest_first = F.struct((-F.unix_micros("scraped_at")).alias("age"), "id", "source_url")
    linked = F.when(F.coalesce(F.col("source_url"), F.lit("")) != "", newest_first)
    return (
        sightings.groupBy("company_id", F.lower("source").alias("source"))
        .agg(F.count("*").alias("sightings"), F.min(linked)["source_url"].alias("first_url"))
    )


def nearest_preset(points: DataFrame, presets: list[tuple[str, float, float]] | None = None) -> DataFrame:
    """Name of the preset city closest in plain degrees; the first one wins ties."""
    cities = presets if presets is not None else CITY_PRESETS
    ranked = [
        F.struct(
            F.hypot(F.col("lat") - F.lit(lat), F.col("lng") - F.lit(lng)).alias("d"),
            F.lit(i).alias("i"),
            F.lit(name).alias("name"),
        )
        for i, (name, lat, lng) in enumerate(cities)
    ]
    return points.withColumn("nearest_city", F.least(*ranked)["name"])


# City presets of the client map.
CITY_PRESETS = [
    ("Bangalore", 12.9716, 77.5946),
    ("Hyderabad", 17.385, 78.4867),
    ("Pune", 18.5204, 73.8567),
    ("Chennai", 13.0827, 80.2707),
    ("Gurgaon", 28.4595, 77.0266),
    ("Noida", 28.5355, 77.391),
]
