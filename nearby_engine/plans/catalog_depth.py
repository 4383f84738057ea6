"""Registered queries whose inputs go beyond what readers once stopped at: nesting, padding, markup, stored state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearby_engine.functions.urls import is_public_url
from nearby_engine.operators import merge as M
from nearby_engine.operators.clusters import cluster_kmeans
from nearby_engine.operators.crawl import page_links
from nearby_engine.plans.catalog import register, sql_iso
from nearby_engine.plans.views import table
from nearby_engine.session import dealt
from nearby_engine.sources import structured
from nearby_engine.sources.evidence import sequence_key
from nearby_engine.sources.tables import schema_of


@register(
    "links_as_markup_means_them",
    """SELECT page_id, 'https://m.example/p?id=' || CAST(page_id AS VARCHAR) || '&b=1&c=2&d=3' AS target FROM pages
    UNION ALL SELECT page_id, 'https://m.example/q' AS target FROM pages WHERE page_id % 2 = 0""",
)
def links_as_markup_means_them(spark: SparkSession, folder: str) -> DataFrame:
    """Comments hold no links, data-href is no href, numeric entities are characters."""
    html = F.concat(
        F.lit('<!-- <a href="/hidden">h</a> --><a data-href="/wrong" href="/p?id='), F.col("page_id").cast("string"),
        F.lit('&#38;b=1&#x26;c=2&amp;d=3">x</a><a title="href=/no" class="k">n</a><abbr href="/no">n</abbr>'),
        F.when(F.col("page_id") % 2 == 0, F.lit("<A CLASS='a > b' HREF = /q >y</A>")).otherwise(""),
    )
    pages = table(spark, folder, "pages").select("page_id", F.lit("https://m.example/").alias("url"), html.alias("html"))
    return page_links(pages, keep=["page_id"]).select("page_id", "target")


@register(
    "deeply_nested_companies",
    """SELECT 'https://deep' || CAST(c_custkey AS VARCHAR) || '.example/' AS page, 'Deep ' || c_name || ' ' || CAST(i AS VARCHAR) AS name
    FROM customer, range(0, 3) t(i)""",
)
def deeply_nested_companies(spark: SparkSession, folder: str) -> DataFrame:
    """An organization one list deep, one twelve lists deep, one inside twelve graphs."""
    def organization(i: int):
        return F.concat(F.lit('{"@type":"Organization","name":"Deep '), F.col("c_name"), F.lit(f' {i}"}}'))

    twelve = F.concat(F.lit("[" * 12), organization(1), F.lit("]" * 12))
    graphs = F.concat(F.lit('{"@graph":' * 12), organization(2), F.lit("}" * 12))
    block = F.concat(F.lit('<script type="application/ld+json">['), organization(0), F.lit(","), twelve, F.lit(","), graphs, F.lit("]</script>"))
    hidden = F.lit('<!-- <script type="application/ld+json">{"@type":"Organization","name":"Hidden"}</script> -->')
    url = F.concat(F.lit("https://deep"), F.col("c_custkey").cast("string"), F.lit(".example/"))
    customers = dealt(table(spark, folder, "customer").select("c_custkey", "c_name"), "c_custkey")
    pages = customers.select(url.alias("url"), F.concat(hidden, block).alias("html"))
    return structured.structured_companies(structured.page_entities(pages)).select("page", "name")


@register(
    "padded_addresses",
    """SELECT l_orderkey % 4 AS form, l_orderkey % 3 = 0 AS public, count(*) AS urls FROM lineitem GROUP BY ALL""",
)
def padded_addresses(spark: SparkSession, folder: str) -> DataFrame:
    """127.0.0.x, 10.x and 8.8.x.x as numbers with up to forty leading zeros."""
    key = F.col("l_orderkey")
    number = F.when(key % 3 == 0, F.lit(134744064) + key % 250).when(key % 3 == 1, F.lit(2130706433) + key % 250).otherwise(F.lit(167772161) + key % 250)
    zeros = F.repeat(F.lit("0"), (key % 41).cast("int"))
    form = key % 4
    text = (
        F.when(form == 0, number.cast("string")).when(form == 1, F.concat(F.lit("0"), zeros, number.cast("string")))
        .when(form == 2, F.concat(F.lit("0x"), zeros, F.lower(F.hex(number)))).otherwise(F.concat(F.lit("0X"), zeros, F.hex(number)))
    )
    judged = table(spark, folder, "lineitem").select(form.alias("form"), is_public_url(F.concat(F.lit("http://"), text, F.lit("/"))).alias("public"))
    return judged.groupBy("form", "public").agg(F.count("*").alias("urls"))


@register(
    "eligibility_on_stored_rows",
    f"""SELECT 'j' || CAST(o_orderkey AS VARCHAR) AS job_id, CASE WHEN o_orderkey % 3 = 1 THEN 'GLOBAL' ELSE 'IN' END AS scope_code,
      CASE WHEN o_orderkey % 3 = 1 THEN 0.8e0 ELSE 0.3e0 END AS confidence, o_orderkey % 3 <> 2 AS is_active,
      {sql_iso("CASE WHEN o_orderkey % 3 = 1 THEN TIMESTAMP '2026-02-01' ELSE TIMESTAMP '2026-01-01' END")} AS first_seen,
      {sql_iso("CASE WHEN o_orderkey % 3 = 2 THEN TIMESTAMP '2026-01-02' ELSE TIMESTAMP '2026-02-01' END")} AS last_seen
    FROM orders WHERE o_orderkey % 5 <> 0 OR o_orderkey % 3 = 2""",
)
def eligibility_on_stored_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Inactive scopes are stored. A third of the jobs deliver the scope again, a third another one after a reset, the
    rest nothing; every fifth delivery only clears."""
    key = F.col("o_orderkey")
    job = F.concat(F.lit("j"), key.cast("string"))
    at = lambda text: F.lit(text).cast("timestamp")
    orders = table(spark, folder, "orders")
    stored = orders.select(
        job.alias("job_id"), F.lit("country").alias("scope_type"), F.lit("IN").alias("scope_code"), F.lit("r").alias("source_record_id"),
        F.lit(0.3).alias("confidence"), F.lit(False).alias("is_active"), at("2026-01-01").alias("first_seen_at"), at("2026-01-02").alias("last_seen_at"),
    ).select(schema_of("job_remote_eligibility").names)
    given = orders.where(key % 3 != 2).select(
        job.alias("job_id"), F.lit("r2").alias("source_record_id"), F.lit("remote").alias("work_arrangement"), at("2026-02-01").alias("observed_at"),
        F.lit("s").alias("source"), F.lit("b").alias("batch_id"),
        F.when(key % 5 == 0, F.array()).when(key % 3 == 0, F.array(F.lit("IN"))).otherwise(F.array(F.lit("GLOBAL"))).cast("array<string>").alias("remote_scopes"),
        (key % 3).cast("int").alias("third"),
    )
    cleared = given.where("third = 1").withColumn("remote_scopes", F.array().cast("array<string>"))
    rows = cleared.withColumn("index", F.lit(0)).unionByName(given.withColumn("index", F.lit(1)))
    merged = M.merge_remote_eligibility(stored, rows.withColumn("seq", sequence_key(1, F.col("index"))))
    shown = "yyyy-MM-dd'T'HH:mm:ss'Z'"
    return merged.select(
        "job_id", "scope_code", "confidence", "is_active",
        F.date_format("first_seen_at", shown).alias("first_seen"), F.date_format("last_seen_at", shown).alias("last_seen"),
    )


@register(
    "cluster_kmeans_of_separate_groups",
    """SELECT count(*) AS count, round(avg(10.0e0 + 5 * (c_custkey % 4) + (c_custkey % 7) / 100.0e0), 6) AS lat,
      round(avg(70.0e0 + 5 * (c_custkey % 4) + (c_custkey % 11) / 100.0e0), 6) AS lng FROM customer GROUP BY c_custkey % 4""",
)
def cluster_kmeans_of_separate_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Four tight groups hundreds of kilometres apart: whatever the start, each becomes one cluster."""
    key = F.col("c_custkey")
    customers = table(spark, folder, "customer")
    name = key.cast("string")
    none = F.lit(None).cast("string")
    companies = customers.select(
        name.alias("id"), F.col("c_name").alias("name"), none.alias("domain"), none.alias("industry"), none.alias("employee_count")
    )
    locations = customers.select(
        name.alias("id"), name.alias("company_id"), F.lit("confirmed_office").alias("presence_type"), F.lit(1.0).alias("confidence"),
        (F.lit(10.0) + (key % 4) * 5 + (key % 7) / 100.0).alias("lat"), (F.lit(70.0) + (key % 4) * 5 + (key % 11) / 100.0).alias("lng"),
    )
    found = cluster_kmeans({"companies": companies, "locations": locations}, 17.5, 77.5, 3_000_000.0, k=4)
    return found.select("count", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))
