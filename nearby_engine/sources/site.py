"""Company-site pages: structured data, and the homepage itself where there is none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearby_engine.functions import markup as M
from nearby_engine.functions.text import page_company_hash, title_head
from nearby_engine.functions.urls import bare_domain
from nearby_engine.operators.ranking import keep_first
from nearby_engine.sources.structured import page_entities, structured_companies


def homepage_companies(homepages: DataFrame, structured: DataFrame, closed: bool = False) -> DataFrame:
    """Company from title, address and phone link of homepages without a structured company.

    With ``closed`` only entities that end in a semicolon are decoded in titles.
    """
    missing = F.lit(None).cast("double")
    bare = homepages.join(structured.select(F.col("page").alias("url")).distinct(), "url", "left_anti")
    read = bare.select(
        F.col("url").alias("page"), title_head(M.page_title(F.col("html"), closed)).alias("name"),
        bare_domain(F.col("url")).alias("domain"), M.address_text(F.col("html")).alias("address"),
        M.phone_link(F.col("html")).alias("phone"),
    ).filter(F.col("name") != "")
    return read.select(
        "page", "name", F.lit(None).cast("string").alias("source_record_id"),
        F.col("page").alias("evidence_url"), "domain", "address", missing.alias("lat"), missing.alias("lng"),
        "phone", page_company_hash(F.col("name"), F.col("domain"), F.col("address"), missing, missing).alias("content_hash"),
        F.lit('{"source":"html_enrichment"}').alias("metadata"),
    )


def site_companies(pages: DataFrame) -> DataFrame:
    """``pages`` has (url, html, depth, visit): structured companies everywhere, homepages as fallback.

    A company found on several pages is kept from the page visited first.
    """
    structured = structured_companies(page_entities(pages.select("url", "html")))
    homepages = pages.filter("depth = 0").select("url", "html")
    fallback = homepage_companies(homepages, structured).withColumn("position", F.array(F.lit(0)))
    found = structured.unionByName(fallback).join(
        pages.select(F.col("url").alias("page"), "visit"), "page"
    )
    return keep_first(found, ["content_hash"], ["visit", "page", "position"]).drop("visit", "position")


def sitemap_links(sitemaps: DataFrame) -> DataFrame:
    """(url, position, link) of every URL a sitemap lists."""
    return sitemaps.select("url", F.posexplode(M.sitemap_urls(F.col("xml"))).alias("position", "link"))
