"""Merges by narrow order first, and keys that hold a third of the rows."""

import random

from pyspark.sql import functions as F

from builders import batch, company, frame, job
from nearby_engine.operators import merge as M
from nearby_engine.operators import ranking
from nearby_engine.operators.ranking import joined_to_few
from nearby_engine.sources.evidence import company_rows, job_rows
from nearby_engine.sources.tables import empty_tables


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def aggregates_of(df):
    return [line for line in plan_of(df).split("\n") if "SortAggregate" in line]


def test_no_payload_is_sorted_to_find_the_latest(spark):
    given = frame(spark, [batch([], [job("A", "Engineer", source_job_id="1")])])
    rows = M.with_job_id(M.with_record(job_rows(given).withColumn("company_id", F.lit("c")), "job", "source_job_id", "canonical_url", M.job_payload()))
    t = empty_tables(spark)
    jobs = M.merge_jobs(t["jobs"], rows)
    owned = company_rows(given).withColumns({"company_id": F.lit("c"), "location_id": F.lit("l")})
    sightings, records = M.merge_sightings(t["sightings"], owned), M.merge_source_records(t["source_records"], rows)
    for df, wide in ((jobs, "description_excerpt"), (sightings, "raw_address"), (records, "payload#")):
        assert aggregates_of(df) and not any(wide in line for line in aggregates_of(df)), wide


def test_latest_and_earliest_of_every_key(spark):
    dice = random.Random(2)
    rows = [(dice.choice("aaaab") + str(dice.randrange(4)) if dice.random() < 0.9 else None, i, dice.randrange(9), f"payload {i}") for i in range(400)]
    df = spark.createDataFrame(rows, "k string, seq long, early int, wide string").repartition(5)
    wanted = {}
    for k, seq, early, wide in rows:
        lo, hi = wanted.get(k, ((seq, early), (seq, wide)))
        wanted[k] = (min(lo, (seq, early)), max(hi, (seq, wide)))
    wanted = {k: (lo[1], hi[1]) for k, (lo, hi) in wanted.items()}
    for fold in (M.fold, M.fold_wide):
        assert {r.k: (r.early, r.wide) for r in fold(df, ["k"], ["early"], ["wide"]).collect()} == wanted


def test_a_hot_key_is_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(ranking, "HOT_SHARE", 20)
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("k"), F.col("id").alias("seq"))
    rows = rows.unionByName(spark.createDataFrame([(None, 9000)], "k string, seq long"))
    few = rows.filter("k is not null and k <> 'k1'").groupBy("k").agg(F.max("seq").alias("most"))
    joined = joined_to_few(rows, few, "k", "seq")
    got, plain = (sorted(map(tuple, df.select("k", "seq", "most").collect()), key=repr) for df in (joined, rows.join(few, "k", "left")))
    assert got == plain
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        tasks = joined_to_few(rows, few, "k", "seq").filter("k = 'hot'").groupBy(F.spark_partition_id().alias("task")).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(r["count"] for r in tasks) == 1000 and max(r["count"] for r in tasks) <= 400


def test_resets_of_a_job_with_a_third_of_all_events(spark, monkeypatch):
    """Places and scopes after the last reset, as a loop over the events leaves them."""
    monkeypatch.setattr(ranking, "HOT_SHARE", 10)
    dice = random.Random(6)
    batches, state, scopes = [], {}, {}
    for i in range(120):
        key = "j0" if i % 3 == 0 else f"j{dice.randrange(1, 25)}"
        remote = dice.random() < 0.5
        named = dice.sample(["IN", "GLOBAL", "EMEA"], dice.randrange(3)) if remote else []
        place = "" if dice.random() < 0.3 else f"Place {i}"
        batches.append(batch([], [job("A", "Engineer", source_job_id=key, work_arrangement="remote" if remote else "hybrid", remote_scopes=named, location_raw=place)], observed_at=f"2026-09-{1 + i // 60:02d}T{i // 60 % 24:02d}:{i % 60:02d}:00Z"))
        state[key] = place or None
        scopes[key] = (scopes.get(key, set()) | set(named)) if named else set()
    rows = M.with_job_id(job_rows(frame(spark, batches))).withColumn("source_record_id", F.col("job_id"))
    t = empty_tables(spark)
    ids = {r.job_id: r.source_job_id for r in rows.select("job_id", "source_job_id").distinct().collect()}
    places = {ids[r.job_id]: r.location_raw for r in M.merge_job_locations(t["job_locations"], rows).collect()}
    assert places == {k: v for k, v in state.items() if v}
    found = {}
    for r in M.merge_remote_eligibility(t["job_remote_eligibility"], rows).collect():
        found.setdefault(ids[r.job_id], set()).add(r.scope_code)
    assert found == {k: v for k, v in scopes.items() if v}


def test_merges_move_only_what_they_read(spark, monkeypatch):
    """Records are written with the columns of their table, and key and order of the latest are joined as numbers."""
    from nearby_engine.plans import catalog_merge as plans

    written, inner = [], plans.landed
    monkeypatch.setattr(plans, "landed", lambda df: (written.append(df.columns), inner(df))[1])
    merged = plans.job_source_records(spark, "/root/testdata/sf0.001", waves=True)
    assert len(written) == 3 and not any({"title", "description_excerpt", "observed_text"} & set(columns) for columns in written)
    assert "[_mark#" in plan_of(merged)


def test_a_merge_with_an_empty_table_reads_the_new_rows_only(spark):
    given = frame(spark, [batch([company("A"), company("B")])])
    rows = M.with_record(company_rows(given).withColumn("company_id", F.col("name")), "company", "source_record_id", "evidence_url", M.company_payload())
    merged = M.merge_links(empty_tables(spark)["company_source_links"], rows, "company_id")
    assert "Union" not in plan_of(merged) and merged.count() == 2
