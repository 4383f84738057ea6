import random

import pytest
from pyspark.sql import functions as F

from nearby_engine.operators import runs as R
from nearby_engine.operators.ranking import numbered
from nearby_engine.operators.search import search_jobs, search_offices
from nearby_engine.plans.views import AS_OF, CENTER, RADIUS_M, search_tables


def loop_runs(events):
    states = {}
    for e in sorted(events, key=lambda e: e["seq"]):
        s = states.setdefault(e["run_id"], dict(status="pending", error=None, company_count=0))
        if e["kind"] == "claim" and s["status"] == "pending":
            s["status"] = "running"
        elif e["kind"] == "cancel" and s["status"] in ("pending", "running"):
            s["status"] = "cancelled"
        elif e["kind"] == "finish" and s["status"] in ("running", "cancelled"):
            s["error"] = None if e["status"] == "completed" else e["error"] or s["error"]
            s["company_count"] = s["company_count"] if e["company_count"] is None else e["company_count"]
            s["status"] = "cancelled" if s["status"] == "cancelled" else e["status"]
    return states


@pytest.mark.parametrize("seed", range(3))
def test_fold_agrees_with_a_loop(spark, seed):
    dice = random.Random(seed)
    events = []
    for seq in range(300):
        kind = dice.choice(["create", "claim", "claim", "cancel", "finish", "finish"])
        status = dice.choice(["completed", "partial", "failed"]) if kind == "finish" else None
        events.append(dict(
            run_id=f"r{dice.randrange(50)}", seq=seq, happened_at=None, kind=kind, status=status,
            error=dice.choice([None, f"e{seq}"]) if kind == "finish" else None,
            company_count=dice.choice([None, seq]), job_count=1, evidence_count=1,
        ))
    schema = "run_id string, seq int, happened_at timestamp, kind string, status string, error string, company_count int, job_count int, evidence_count int"
    rows = spark.createDataFrame([tuple(e.values()) for e in events], schema)
    got = {r.run_id: (r.status, r.error, r.company_count) for r in R.fold_runs(rows).collect()}
    assert got == {k: (s["status"], s["error"], s["company_count"]) for k, s in loop_runs(events).items()}


def test_numbering_equals_a_global_window(spark):
    rows = spark.range(500).select((F.col("id") * 7 % 13).alias("a"), (F.col("id") * 11 % 17).alias("b"), F.col("id").alias("c"))
    got = numbered(rows, [-F.col("a"), F.col("b")], [F.col("c")], "n").orderBy("n").collect()
    want = sorted(((-(i * 7 % 13)), i * 11 % 17, i) for i in range(500))
    assert [(-r.a, r.b, r.c) for r in got] == want and [r.n for r in got] == list(range(500))


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_search_plans_stay_in_the_engine(spark):
    t = search_tables(spark, "/root/testdata/sf0.001")
    for frame in (search_offices(t, *CENTER, RADIUS_M, AS_OF, query="nova"), search_jobs(t, *CENTER, RADIUS_M, AS_OF, query="dev")):
        plan = plan_of(frame)
        assert "TakeOrderedAndProject" in plan
        assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_ranges_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "locations")
    search_tables(spark, "/root/testdata/sf0.001")["locations"].write.parquet(path)
    stored = {"locations": spark.read.parquet(path), **{k: v for k, v in search_tables(spark, "/root/testdata/sf0.001").items() if k != "locations"}}
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = plan_of(search_offices(stored, *CENTER, RADIUS_M, AS_OF, min_confidence=0.5))
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "locations" in line)
    for wanted in ("GreaterThanOrEqual(lat", "LessThanOrEqual(lng", "GreaterThanOrEqual(confidence,0.5)"):
        assert wanted in scan
