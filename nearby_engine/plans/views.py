"""Search-shaped views over the landed star-schema tables.

The tables carry no coordinates, companies or postings, so the views derive them from the
keys with integer arithmetic. Each view is one SQL text that Spark and the check engine both
read, with the tables as ``{name}``; none of them shuffles or drops rows of its table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearby_engine.session import dealt, tune

AS_OF = "2000-06-01 00:00:00"
LATE = "2002-01-01 00:00:00"
CENTER = (12.9716, 77.5946)
RADIUS_M = 15000.0

TITLES = [
    "Senior Backend Developer", "Data Engineer", "Site Reliability Engineer", "Account Executive",
    "Technical Recruiter", "Solutions Architect", "QA Automation Engineer", "Engineering Manager",
    "Embedded Systems Engineer", "Systems Engineer", "Security Analyst", "Office Manager",
    "Machine Learning Engineer", "Sanitation Engineer", "Customer Support Engineer", "Product Manager",
    "Hybrid Cloud Architect", "Remote Frontend Engineer", "Payroll Specialist", "Field Engineer",
    "Legal Counsel", "Staff Architect", "Growth Marketer",
]
CATEGORIES = ["Engineering", "Sales", "Data Platform", "People", "Pre-Sales Engineering", "Support", "Finance"]
BRANDS = ["Nova", "Orbit", "Quartz", "Lumen", "Harbor", "Pixel", "Cedar", "Vertex", "Zephyr", "Mosaic", "Tundra"]
TRADES = ["Robotics", "Analytics", "Software Labs", "Cloud Systems", "Health", "Payments", "Logistics"]
PLACES = [
    "Bengaluru", " bengaluru ", "Pune, India", "Remote", "Koramangala 5th Block", "", "Hyderabad", "Atlantis",
]


def choose(key: str, values: list[str]) -> str:
    """A CASE that picks a value by key modulo the number of values."""
    arms = " ".join("WHEN {} THEN '{}'".format(i, v.replace("'", "''")) for i, v in enumerate(values))
    return f"CASE CAST(({key}) % {len(values)} AS INT) {arms} END"


NAME = f"({choose('c_custkey', BRANDS)} || ' ' || {choose('c_custkey * 5 + 3', TRADES)} || ' #' || CAST(c_custkey AS STRING))"

COMPANIES = f"""
SELECT c_custkey AS id, {NAME} AS name, lower(replace({NAME}, ' #', ' ')) AS normalized_name,
  CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'c' || CAST(c_custkey AS STRING) || '.example' END AS domain,
  c_mktsegment AS industry, CAST(c_custkey % 900 AS STRING) AS employee_count
FROM {{customer}}"""


def _office(number: int, lat_step: int, lng_step: int) -> str:
    presence = choose(
        f"c_custkey + {number}", ["confirmed_office", "probable_office", "probable_office", "job_location_only"]
    )
    return f"""
SELECT c_custkey * 2 + {number} AS id, c_custkey AS company_id, 'Office {number + 1}' AS label,
  CAST(c_custkey % 400 AS STRING) || ' Main Road' AS address,
  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'City ' || CAST(c_nationkey AS STRING) END AS city,
  12.9716e0 + CAST((c_custkey * {lat_step}) % 2001 - 1000 AS DOUBLE) / 5000.0e0 AS lat,
  77.5946e0 + CAST((c_custkey * {lng_step}) % 2001 - 1000 AS DOUBLE) / 5000.0e0 AS lng,
  CAST((c_custkey * 37 + {number}) % 101 AS DOUBLE) / 100.0e0 AS confidence,
  {presence} AS presence_type, (c_custkey + {number}) % 5 = 0 AS verified
FROM {{customer}}"""


LOCATIONS = _office(0, 7919, 104729) + "\nUNION ALL" + _office(1, 6007, 7907)

TITLE = f"({choose('o_orderkey * 7', TITLES)} || CASE WHEN o_orderkey % 6 = 0 THEN ' II' ELSE '' END)"

JOBS = f"""
SELECT o_orderkey AS id, o_custkey AS company_id,
  {choose('o_orderkey', ['greenhouse', 'lever', 'company_site'])} AS source,
  {choose('o_orderkey', ['job_ats', 'job_ats', 'official_site'])} AS source_family,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'J' || CAST(o_orderkey AS STRING) END AS source_job_id,
  'https://jobs.example/' || CAST(o_orderkey AS STRING) AS canonical_url,
  {TITLE} AS title, lower({TITLE}) AS normalized_title,
  'Order ' || o_orderpriority AS description_excerpt,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'in_office' WHEN '2-HIGH' THEN 'hybrid'
    WHEN '3-MEDIUM' THEN 'remote' WHEN '4-NOT SPECIFIED' THEN 'unknown' ELSE 'in_office' END AS work_arrangement,
  CASE WHEN o_orderkey % 5 < 3 THEN 'posted_recently' WHEN o_orderkey % 5 = 3 THEN 'observed_recently'
    ELSE 'stale' END AS publication_state,
  CASE WHEN o_orderkey % 11 = 0 THEN CAST(NULL AS TIMESTAMP) ELSE CAST(o_orderdate AS TIMESTAMP) END AS posted_at,
  CAST((o_orderkey * 13) % 11 AS DOUBLE) / 10.0e0 AS posted_at_confidence,
  CAST(o_orderdate AS TIMESTAMP) AS first_seen_at,
  CAST(o_orderdate AS TIMESTAMP) + INTERVAL '2' DAY AS last_seen_at,
  o_orderstatus <> 'F' AS is_active, '{{{{}}}}' AS metadata
FROM {{orders}}"""

JOB_LOCATIONS = f"""
SELECT l_orderkey AS job_id,
  CAST(l_linenumber AS BIGINT) * 1000000000000 + l_partkey * 100000 + l_suppkey AS ordinal,
  {choose('l_partkey', PLACES)} AS location_raw,
  CASE WHEN l_partkey % 9 = 0 THEN NULL
    ELSE 12.9716e0 + CAST((l_partkey * 7919 + l_suppkey) % 2001 - 1000 AS DOUBLE) / 4000.0e0 END AS latitude,
  CASE WHEN l_partkey % 9 = 0 THEN NULL
    ELSE 77.5946e0 + CAST((l_partkey * 104729 + l_suppkey * 31) % 2001 - 1000 AS DOUBLE) / 4000.0e0 END AS longitude,
  l_linestatus = 'O' AS is_active
FROM {{lineitem}}"""

SIGHTINGS = """
SELECT event_id AS id, user_id AS company_id, upper(substr(event_type, 1, 1)) || substr(event_type, 2) AS source,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'https://seen.example/' || CAST(event_id AS STRING) END AS source_url,
  CAST(ts AS TIMESTAMP) AS scraped_at, props AS metadata
FROM {events}"""

VIEWS = {
    "companies": COMPANIES,
    "locations": LOCATIONS,
    "jobs": JOBS,
    "job_locations": JOB_LOCATIONS,
    "sightings": SIGHTINGS,
}

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{folder}/{name}.parquet")


def used_tables(text: str) -> list[str]:
    return [name for name in TABLES if "{" + name + "}" in text]


def derive(spark: SparkSession, folder: str, text: str, dealt_by: str | None = None) -> DataFrame:
    """Run one view text over the tables of a folder; ``dealt_by`` deals their rows over tasks by an expression first."""
    tables = {name: table(spark, folder, name) for name in used_tables(text)}
    if dealt_by:
        tables = {name: dealt(rows, F.expr(dealt_by)) for name, rows in tables.items()}
    return spark.sql(text, **tables)


def search_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: derive(spark, folder, text) for name, text in VIEWS.items()}


def check_sql(text: str) -> str:
    """The same view text for the check engine, where tables go by their own names."""
    return text.format(**{name: name for name in TABLES})


def with_views(names: list[str], body: str) -> str:
    """``body`` with the named views in front of it."""
    parts = ", ".join(f"v_{name} AS ({check_sql(VIEWS[name])})" for name in names)
    return f"WITH {parts} {body}"
