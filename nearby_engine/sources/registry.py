"""Named adapters and the order in which their evidence is gathered.

An adapter turns landed input into (companies, jobs) evidence rows. The gathering runs in three
stages: candidate sources name companies, their sites are walked, and job boards found on the sites
are read next to the configured ones. Sites and boards pass between stages as DataFrames.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearby_engine.functions.text import strip
from nearby_engine.functions.urls import clean_domain
from nearby_engine.operators.crawl import board_targets, discovered_boards, discovered_sites, walk
from nearby_engine.schemas import COMPANY_EVIDENCE, JOB_EVIDENCE
from nearby_engine.session import cut, dealt, landed
from nearby_engine.sources import boards, directory, osm, site, structured
from nearby_engine.sources.evidence import to_batches

BOARD_FIELDS = "provider string, token string, company_name string, company_domain string"

# Family of every adapter.
FAMILIES = {
    "openstreetmap": "open_dataset",
    "configured_directory": "public_directory",
    "company_site": "official_site",
    "greenhouse": "job_ats",
    "lever": "job_ats",
}

Rows = tuple[DataFrame, DataFrame]


def no_rows(spark: SparkSession, kind: str) -> DataFrame:
    fields = COMPANY_EVIDENCE if kind == "company" else JOB_EVIDENCE
    return spark.createDataFrame([], fields).withColumn("page", F.lit(None).cast("string"))


def read_osm(spark: SparkSession, path: str, as_of: Column, **where: float) -> DataFrame:
    elements = osm.read_elements(spark, path)
    points = osm.candidates(elements, **where) if where else osm.with_point(elements)
    return packed(spark, "openstreetmap", (osm.osm_companies(points), no_rows(spark, "job")), as_of)


def read_greenhouse(spark: SparkSession, path: str, as_of: Column) -> DataFrame:
    """``path`` holds ``boards.json`` lines and ``pages/<token>/<page>.json``."""
    listed = spark.read.schema(BOARD_FIELDS).json(f"{path}/boards.json")
    payloads = boards.read_payloads(spark, f"{path}/pages")
    rows = boards.greenhouse_companies(listed), boards.greenhouse_jobs(payloads, listed, as_of)
    return packed(spark, "greenhouse", rows, as_of)


def read_lever(spark: SparkSession, path: str, as_of: Column) -> DataFrame:
    listed = spark.read.schema(BOARD_FIELDS).json(f"{path}/boards.json")
    payloads = boards.read_payloads(spark, f"{path}/pages")
    rows = boards.lever_companies(listed), boards.lever_jobs(payloads, listed, as_of)
    return packed(spark, "lever", rows, as_of)


def read_site(spark: SparkSession, path: str, as_of: Column) -> DataFrame:
    """Evidence of the sites in ``seeds.json`` (seed): their landed pages, ``pages`` in Parquet (url, html), are walked from
    the homepage; a homepage without a structured company gives one from its title."""
    pages = spark.read.schema("url string, html string").parquet(f"{path}/pages")
    visits = walk(spark.read.schema("seed string").json(f"{path}/seeds.json"), pages)
    return packed(spark, "company_site", site_evidence(visits, pages, as_of), as_of)


DIRECTORY = "directory_id string, start_page int, card map<string,string>, detail map<string,string>"


def read_directory(spark: SparkSession, path: str, as_of: Column) -> DataFrame:
    """Evidence of the directories in ``directories.json``, one JSON line each with the selectors of its cards and of its detail
    pages. ``pages`` (directory_id, page, url, html) and ``details`` (url, html) are landed Parquet."""
    pages = spark.read.schema("directory_id string, page int, url string, html string").parquet(f"{path}/pages")
    details = spark.read.schema("url string, html string").parquet(f"{path}/details")
    companies = no_rows(spark, "company")
    # The list of directories is a configuration, one line each.
    for listed in spark.read.schema(DIRECTORY).json(f"{path}/directories.json").collect():
        mine = pages.filter(F.col("directory_id") == listed.directory_id)
        cards = directory.page_cards(mine, listed.card or {}, listed.start_page or 1)
        companies = companies.unionByName(directory.directory_companies(cards, details, listed.detail), allowMissingColumns=True)
    return packed(spark, "configured_directory", (companies, no_rows(spark, "job")), as_of)


ADAPTERS: dict[str, Callable[..., DataFrame]] = {
    "openstreetmap": read_osm,
    "configured_directory": read_directory,
    "greenhouse": read_greenhouse,
    "lever": read_lever,
    "company_site": read_site,
}


def site_evidence(visits: DataFrame, pages: DataFrame, as_of: Column) -> Rows:
    """Companies and jobs of the pages that a walk visited."""
    read = dealt(visits, "url").join(pages, "url")
    entities = structured.page_entities(read.select("url", "html"))
    return site.site_companies(read), structured.structured_jobs(entities, as_of)


def packed(spark: SparkSession, name: str, rows: Rows, as_of: Column, run_id: str = "") -> DataFrame:
    companies, jobs = rows
    return to_batches(companies, jobs, name, FAMILIES[name], F.lit(run_id), as_of)


def source_config(spark: SparkSession, path: str) -> DataFrame:
    """Configured boards, one JSON line each; a missing name defaults to the token."""
    rows = spark.read.schema(BOARD_FIELDS).json(path)
    token = strip(F.col("token"))
    return rows.filter(token != "").select(
        "provider", token.alias("token"), F.coalesce("company_name", token).alias("company_name"),
        clean_domain(F.col("company_domain")).alias("company_domain"),
    )


@dataclass(frozen=True)
class Gathered:
    """What the three stages found."""

    visits: DataFrame
    site_rows: Rows
    targets: DataFrame
    board_rows: dict[str, Rows]


def gather(
    candidates: DataFrame,
    pages: DataFrame,
    configured: DataFrame,
    payloads: dict[str, DataFrame],
    as_of: Column,
    seeds: DataFrame | None = None,
) -> Gathered:
    """Stages two and three behind the candidate companies of stage one.

    ``candidates`` has (discovery_job_id, domain, name, seq), ``pages`` landed (url, html),
    ``payloads`` landed board pages per provider.
    """
    # Read three times: for the walk, for the names of the boards, and for their companies.
    sites = cut(discovered_sites(candidates))
    found = sites.select(F.concat(F.lit("https://"), "domain").alias("seed"))
    starts = found if seeds is None else seeds.select("seed").unionByName(found)
    visits = walk(starts.distinct(), pages)
    names = sites.groupBy("domain").agg(F.min_by("name", "seq").alias("name"))
    site_rows = site_evidence(visits, pages, as_of)
    # Read by every provider, for its companies and for its jobs.
    targets = landed(board_targets(configured, discovered_boards(visits, pages, names)))
    board_rows: dict[str, Rows] = {}
    makers = {
        "greenhouse": (boards.greenhouse_companies, boards.greenhouse_jobs),
        "lever": (boards.lever_companies, boards.lever_jobs),
    }
    for provider, (companies_of, jobs_of) in makers.items():
        mine = targets.filter(F.col("provider") == provider)
        if provider in payloads:
            board_rows[provider] = companies_of(mine), jobs_of(payloads[provider], mine, as_of)
    return Gathered(visits, site_rows, targets, board_rows)


def gathered_batches(spark: SparkSession, first: dict[str, Rows], found: Gathered, as_of: Column, run_id: str = "") -> DataFrame:
    """Batches of a whole run: the candidate sources of stage one (rows by adapter), the sites and the boards."""
    every = {**first, "company_site": found.site_rows, **found.board_rows}
    return reduce(DataFrame.unionByName, [packed(spark, name, rows, as_of, run_id) for name, rows in every.items()])
