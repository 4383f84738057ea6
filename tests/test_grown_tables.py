"""Queries on tables that repeat rows under new keys, as larger copies of the tables do, against their SQL."""

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

import compare
from nearby_engine.plans import load_catalog
from nearby_engine.plans.catalog import CATALOG
from nearby_engine.streaming.intake import append_unseen

load_catalog()
FOLDER = "/root/testdata/sf0.001"


def differences(spark, folder, name, **tables):
    """What a query and its SQL disagree on, with some tables of the folder replaced by SQL over the small ones."""
    con = compare.connect(FOLDER)
    for table in compare.TABLES:
        rows = tables.get(table, f"SELECT * FROM {table} LIMIT 40" if tables else f"SELECT * FROM {table}")
        con.execute(f"COPY ({rows}) TO '{folder}/{table}.parquet' (FORMAT parquet)")
    entry = CATALOG[name]
    return compare.differences(entry.plan(spark, str(folder)), compare.connect(str(folder)), entry.sql)


def test_links_of_pages_that_share_a_url(spark, tmp_path):
    pages = "SELECT page_id + 1000 * i AS page_id, url, html FROM pages, range(2) t(i)"
    assert differences(spark, tmp_path, "site_links", pages=pages) == []


CUT = "SELECT 1 AS page_id, 'https://a.example/' AS url, '<title>Fish &amp; Chips &copy; &am; &amp</title><nav></nav><p>a &lt;b&gt; &quot &amp' AS html"


@pytest.mark.parametrize("name", ["homepage_companies", "page_titles", "text_excerpts"])
def test_references_cut_before_their_semicolon(spark, tmp_path, name):
    assert differences(spark, tmp_path, name, pages=CUT) == []


@pytest.mark.parametrize("name", ["source_totals", "validation_report", "rejected_batches", "intake_tables"])
def test_batches_seen_after_the_tables_of_today(spark, tmp_path, name):
    orders = "SELECT * REPLACE (o_orderkey + 4000000 * i AS o_orderkey) FROM (SELECT * FROM orders LIMIT 300), range(2) t(i)"
    assert differences(spark, tmp_path, name, orders=orders) == []


def test_stored_records_are_not_shuffled_for_every_batch(spark, tmp_path, monkeypatch):
    plans, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **b: (plans.append(self._df._jdf.queryExecution().executedPlan().toString()), write(self, *a, **b))[1])
    rows = lambda low, high: spark.range(low, high).select(F.lit("s").alias("source"), F.col("id").cast("string").alias("content_hash"))
    append_unseen(rows(0, 5000), 0, str(tmp_path))
    append_unseen(rows(4990, 5010), 1, str(tmp_path))
    assert spark.read.parquet(str(tmp_path)).select("content_hash").distinct().count() == spark.read.parquet(str(tmp_path)).count() == 5010
    assert "LeftSemi, BuildRight" in plans[-1]


def test_a_name_goes_to_the_first_of_two_companies_of_one_batch_in_waves_too(spark, tmp_path):
    """Two domains of one name are seen in one batch, the name alone much later."""
    spread = """SELECT j, 10 * j + CASE (10 * j) % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE 0 END AS a, 10 * j + CASE (10 * j) % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 2 END AS b,
      10 * (j + 100) + (3 - (10 * (j + 100)) % 3) % 3 AS c FROM range(30) t(j)"""
    keys = f"SELECT a AS k, j + 1 AS cust FROM ({spread}) UNION ALL SELECT b, j + 3081 FROM ({spread}) UNION ALL SELECT c, j + 1 FROM ({spread})"
    orders = f"SELECT o.* REPLACE (CAST(x.k AS BIGINT) AS o_orderkey, CAST(x.cust AS BIGINT) AS o_custkey) FROM (SELECT * FROM orders LIMIT 1) o, ({keys}) x"
    assert differences(spark, tmp_path, "merge_companies_second_wave", orders=orders) == []


def test_batches_are_parsed_once(spark):
    """Opening the records of a batch must not parse its text again."""
    from nearby_engine.plans.catalog_merge import batch_lines, records
    from nearby_engine.sources.evidence import job_rows, parse_batches

    rows = job_rows(parse_batches(batch_lines(records(spark, FOLDER))))
    assert rows._jdf.queryExecution().executedPlan().toString().count("from_json(") == 1


def test_mentions_are_read_from_batches_at_once(spark):
    from nearby_engine.operators import identity
    from nearby_engine.plans.catalog_merge import batch_lines, records
    from nearby_engine.sources.evidence import company_rows, job_rows, parse_batches

    batches = parse_batches(batch_lines(records(spark, FOLDER)))
    found = identity.mentions_of(batches)
    both = identity.mentions(company_rows(batches), job_rows(batches))
    assert found.columns == both.columns
    assert found.count() == both.count() and found.exceptAll(both).isEmpty()
    assert found._jdf.queryExecution().executedPlan().toString().count("from_json(") == 1


def test_links_are_judged_once_as_on_every_site(spark):
    from nearby_engine.functions.urls import allowing_site, is_allowed_on_site

    urls = ["https://www.a.example/", "https://a.example/jobs/p1", "https://A.example/login/jobs", "ftp://a.example/jobs", "/jobs", "", None,
            "https://a.example/pricing", " https://a.example/about?x=1 ", "https://b.example/careers", "https:///jobs", "https://a.example/team?login=1"]
    sites = ["a.example", "WWW.b.example", "", None]
    rows = spark.createDataFrame([(u, s) for u in urls for s in sites], "url string, site string")
    site = F.regexp_replace(F.lower("site"), r"^www\.", "")
    judged = rows.select("url", "site", is_allowed_on_site(F.col("url"), F.col("site")).alias("a"), F.coalesce(allowing_site(F.col("url")) == site, F.lit(False)).alias("b"))
    assert judged.filter("a").count() == 4 and judged.filter("a <> b").isEmpty()


def test_walked_pages_are_made_in_many_tasks(spark):
    from nearby_engine.plans.catalog_sources import walk_pages

    assert walk_pages(spark, FOLDER).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_directory_pages_are_made_in_many_tasks(spark):
    from nearby_engine.plans.catalog_sources import detail_pages, directory_pages

    for pages in (directory_pages(spark, FOLDER), detail_pages(spark, FOLDER)):
        assert pages.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_nested_pages_are_made_in_many_tasks(spark, monkeypatch):
    from nearby_engine.plans import catalog_depth

    seen, read = [], catalog_depth.structured.page_entities
    monkeypatch.setattr(catalog_depth.structured, "page_entities", lambda pages: (seen.append(pages.rdd.getNumPartitions()), read(pages))[1])
    catalog_depth.deeply_nested_companies(spark, FOLDER)
    assert seen[0] >= spark.sparkContext.defaultParallelism


def test_documents_are_judged_in_many_tasks(spark):
    found = CATALOG["role_in_documents"].plan(spark, FOLDER)
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_postings_are_made_in_many_tasks(spark):
    from nearby_engine.operators import text_index

    rows = spark.range(100, numPartitions=1).select("id", F.concat(F.lit("name "), F.col("id").cast("string")).alias("name"))
    found = text_index.postings(rows, "id", "name", "name")
    assert found.select("key").distinct().count() == 100
    assert found.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
