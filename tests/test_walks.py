"""Walks whose seeds have very many links, and the table the links are joined from."""

from pyspark.sql import functions as F

from nearby_engine.operators import ranking
from nearby_engine.operators.crawl import _numbered_on, walk
from nearby_engine.session import bucketed


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_bucketed_table_is_not_shuffled_again(spark):
    links = spark.range(2000).select(F.concat(F.lit("u"), F.col("id") % 300).alias("url"), F.col("id").alias("position"))
    level = spark.range(250).select(F.concat(F.lit("u"), F.col("id")).alias("url"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with bucketed(links, "url") as table:
            joined = level.join(table, "url")
            assert plan_of(joined).count("Exchange hashpartitioning") == 1
            assert joined.count() == level.join(links, "url").count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("bucketed_")]


def test_links_of_a_hot_seed_are_numbered_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(ranking, "HOT_SHARE", 10)
    fresh = spark.range(4000).select(
        F.when(F.col("id") % 4 == 0, F.concat(F.lit("s"), F.col("id") % 7)).otherwise(F.lit("hot")).alias("seed"),
        F.concat(F.lit("u"), F.col("id")).alias("url"), (F.col("id") % 50).cast("int").alias("parent"), (F.col("id") % 90).cast("int").alias("position"),
    )
    visited = spark.createDataFrame([("hot", 1), ("hot", 2), *[(f"s{i}", 1) for i in range(7)]], "seed string, visit int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = _numbered_on(fresh, visited)
        assert "Window" not in plan_of(got)
        tasks = got.withColumn("task", F.spark_partition_id()).filter("seed = 'hot'").groupBy("task").count().count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert tasks > 1
    wanted, seen = {}, {"hot": 2}
    for r in sorted(fresh.collect(), key=lambda r: (r.seed, r.parent, r.position, r.url)):
        seen[r.seed] = seen.get(r.seed, 1) + 1
        wanted[r.seed, r.url] = seen[r.seed]
    assert {(r.seed, r.url): r.visit for r in got.collect()} == wanted


def test_a_long_chain_of_pages_is_walked_to_its_end(spark):
    pages = [(f"https://s.example/jobs/{i}", f'<a href="/jobs/{i + 1}">x</a>') for i in range(6)]
    frame = spark.createDataFrame(pages, "url string, html string")
    seeds = spark.createDataFrame([("https://s.example/jobs/0",), (None,)], "seed string")
    assert [(r.url[-1], r.depth, r.visit) for r in walk(seeds, frame).orderBy("visit").collect()] == [(str(i), i, i + 1) for i in range(7)]
    assert walk(seeds.limit(0), frame).count() == 0
