"""Site walks over landed pages, and what they discover."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearby_engine.functions import markup
from nearby_engine.functions.text import let, title_head
from nearby_engine.functions.urls import (
    allowing_site,
    bare_domain,
    clean_domain,
    greenhouse_token,
    is_allowed_on_site,
    is_public_url,
    lever_token,
    resolve,
    without_fragment,
)
from nearby_engine.operators.ranking import joined_to_few, keep_first, numbered, once
from nearby_engine.session import bucketed, dealt, fresh_folder


def page_links(pages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(url, position, href, target) of every link of every page, resolved and without fragment; ``keep`` is carried along."""
    kept = keep or []
    read = once(pages.select("url", *kept, "html"), {"links": markup.links(F.col("html"))})
    found = read.select("url", *kept, F.posexplode("links").alias("position", "href"))
    return found.select(
        "url", *kept, "position", "href", without_fragment(resolve(F.col("href"), F.col("url"))).alias("target")
    )


def followed_links(pages: DataFrame) -> DataFrame:
    """(url, position, target, site) of every link a walk may follow, and the only site it may follow it on; a sitemap gives its
    listed URLs. Whether a link is allowed depends on the link, so that no level of a walk judges it again."""
    as_map = markup.is_sitemap(F.col("url"), F.col("html"))
    links = F.when(F.col("as_map"), markup.sitemap_urls(F.col("html"))).otherwise(markup.links(F.col("html")))
    read = once(once(pages.select("url", "html"), {"as_map": as_map}), {"links": links})
    found = read.select("url", "as_map", F.posexplode("links").alias("position", "href"))
    target = F.when(F.col("as_map"), F.col("href")).otherwise(without_fragment(resolve(F.col("href"), F.col("url"))))
    resolved = once(found, {"target": target}).select("url", "position", "target")
    return once(resolved, {"site": allowing_site(F.col("target"))}).filter(F.col("site").isNotNull())


def walk(
    seeds: DataFrame,
    pages: DataFrame,
    sitemaps: DataFrame | None = None,
    max_pages: int | None = None,
    max_depth: int | None = None,
) -> DataFrame:
    """Pages visited per seed in breadth-first order: (seed, url, depth, visit).

    ``seeds`` has (seed), ``pages`` has (url, html), ``sitemaps`` optionally (seed, xml). A level is
    one pass: links of the pages visited on the level before, allowed ones only, not seen before.
    Links of a page come before those of the next page. The walk ends when a level is empty, or at
    the given ceilings.

    The links are read from the markup once, into a table bucketed by URL, which no level shuffles. A
    level is written as one more partition by depth; what was visited before is read, never rewritten.
    """
    spark = pages.sparkSession
    root = fresh_folder(spark, "walk")
    levels = spark.read.schema("seed string, url string, visit int, depth int")

    def keep(rows: DataFrame, depth: int) -> DataFrame:
        rows.select("seed", "url", F.col("visit").cast("int")).write.parquet(f"{root}/depth={depth}")
        return levels.parquet(root)

    first = seeds.select("seed", F.col("seed").alias("url"), F.lit(1).alias("visit"))
    visited = keep(first.filter(bare_domain(F.col("seed")).isNotNull()).dropDuplicates(["seed"]), 0)
    extra = None
    if sitemaps is not None:
        listed = sitemaps.select("seed", F.posexplode(markup.sitemap_urls(F.col("xml"))).alias("position", "url"))
        extra = listed.filter(is_allowed_on_site(F.col("url"), bare_domain(F.col("seed")))).select(
            "seed", "url", F.lit(0).alias("parent"), "position"
        )
    depth = 0
    with bucketed(followed_links(pages), "url") as links:
        while max_depth is None or depth < max_depth:
            level = once(visited.filter(F.col("depth") == depth), {"of": clean_domain(bare_domain(F.col("seed")))})
            depth += 1
            # The site is a range, not a second key of the join: the links stay where their URL put them.
            candidates = level.join(links, "url").filter(F.col("site").between(F.col("of"), F.col("of"))).select(
                "seed", F.col("target").alias("url"), F.col("visit").alias("parent"), "position"
            )
            if depth == 1 and extra is not None:
                candidates = extra.unionByName(candidates)
            fresh = keep_first(candidates, ["seed", "url"], ["parent", "position"]).join(
                visited.select("seed", "url"), ["seed", "url"], "left_anti"
            )
            numbered_level = _numbered_on(fresh, visited)
            if max_pages is not None:
                numbered_level = numbered_level.filter(F.col("visit") <= max_pages)
            visited = keep(numbered_level, depth)
            if visited.filter(F.col("depth") == depth).isEmpty():
                break
    return visited.select("seed", "url", "depth", "visit")


def _numbered_on(fresh: DataFrame, visited: DataFrame) -> DataFrame:
    """``fresh`` with ``visit``, which goes on from what each seed has visited. All links of the level are numbered by ranges
    of their order, so that those of one seed may lie in many tasks; a seed then only has to know where its own begin."""
    placed = numbered(fresh, [F.col("seed")], [F.col(c) for c in ("parent", "position", "url")], "_nth")
    begins = placed.groupBy("seed").agg(F.min("_nth").alias("_begin"))
    used = visited.groupBy("seed").agg(F.max("visit").alias("_used"))
    of_seed = begins.join(used, "seed").select("seed", (F.col("_used") + 1 - F.col("_begin")).alias("_shift"))
    return joined_to_few(placed, of_seed, "seed", "url").select("seed", "url", (F.col("_nth") + F.col("_shift")).cast("int").alias("visit"))


def discovered_boards(
    visits: DataFrame, pages: DataFrame, names: DataFrame | None = None,
) -> DataFrame:
    """Job boards linked from visited pages: (provider, token, company_name, company_domain)."""
    # Levels of a walk are few files; their pages are dealt before they are read.
    reading = dealt(visits, "url").join(pages, "url")
    named = reading.withColumn("company_domain", bare_domain(F.col("seed")))
    if names is not None:
        named = named.join(
            names.select(F.col("domain").alias("company_domain"), F.col("name").alias("known_name")),
            "company_domain", "left",
        )
    else:
        named = named.withColumn("known_name", F.lit(None).cast("string"))
    head = title_head(markup.page_title(F.col("html")))
    read = once(
        named.filter(~markup.is_sitemap(F.col("url"), F.col("html"))),
        {"company_name": F.coalesce("known_name", let(head, lambda h: F.when(h != "", h))), "links": markup.links(F.col("html"))},
    )
    titled = read.select(
        "seed", "visit", "url", "company_domain", "company_name", F.posexplode("links").alias("position", "href")
    )
    linked = once(titled, {"target": without_fragment(resolve(F.col("href"), F.col("url")))})
    tagged = linked.withColumn(
        "board",
        F.explode(
            F.array(
                F.struct(F.lit("greenhouse").alias("provider"), greenhouse_token(F.col("target")).alias("token")),
                F.struct(F.lit("lever").alias("provider"), lever_token(F.col("target")).alias("token")),
            )
        ),
    ).filter(F.col("board.token").isNotNull())
    return (
        tagged.filter(is_public_url(F.col("target")))
        .select("board.provider", "board.token", "company_name", "company_domain", "visit", "position")
        .groupBy("provider", "token", "company_name", "company_domain")
        .agg(F.min(F.struct("visit", "position")).alias("found"))
    )


def board_targets(configured: DataFrame, discovered: DataFrame) -> DataFrame:
    """Configured and discovered boards, one per (provider, token); configured ones win."""
    fields = ["provider", "token", "company_name", "company_domain"]
    absent = F.lit(None).cast(T_FOUND)
    both = configured.select(*fields, F.lit(0).alias("tier"), absent.alias("found")).unionByName(
        discovered.select(*fields, F.lit(1).alias("tier"), F.col("found").cast(T_FOUND).alias("found"))
    )
    order = F.struct("tier", "found", "company_domain", "company_name")
    return both.groupBy("provider", "token").agg(
        F.min(order)["company_name"].alias("company_name"), F.min(order)["company_domain"].alias("company_domain")
    )


T_FOUND = "struct<visit:int,position:int>"


def discovered_sites(companies: DataFrame, run: str = "discovery_job_id") -> DataFrame:
    """The domains seen per run, with the arrival and the name they were first seen under."""
    keyed = once(companies.withColumnRenamed("domain", "_given"), {"domain": clean_domain(F.col("_given"))})
    keyed = keyed.filter(F.col("domain").isNotNull())
    return keyed.groupBy(run, "domain").agg(
        F.min("seq").alias("seq"), F.min_by(F.coalesce("name", "domain"), "seq").alias("name")
    )
