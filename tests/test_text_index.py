"""Postings of names against a search of every text."""

import random

from pyspark.sql import functions as F

from nearby_engine.functions.text import contains_ignoring_case, trigram_similar
from nearby_engine.operators.text_index import candidate_keys, holding_keys, postings, read_postings, similar_keys, write_postings

QUERIES = ["nova robo", "Nova", "engineer", "eng%neer", "ab", "a_b", "%", "", "café", "ROBOTICS #12", "50\\% off", "zzz", "no va", "nov% #1"]


def _index(spark, tmp_path):
    dice = random.Random(4)
    words = ["Nova", "Robotics", "Engineer", "Café", "Ab", "aXb", "Labs", "50% off", "engine", "#12", "nov", "İstanbul"]
    texts = [" ".join(dice.choice(words) for _ in range(dice.randint(0, 4))) for _ in range(500)] + [None, "", "ab", "a", "nova"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, name string")
    path = str(tmp_path / "postings")
    write_postings(postings(rows, "id", "name", "name"), path)
    return rows, read_postings(spark, path, "bigint")


def test_postings_give_the_rows_of_a_full_search(spark, tmp_path):
    rows, index = _index(spark, tmp_path)
    ids = lambda df, name="id": {r[name] for r in df.collect()}
    for query in QUERIES:
        similar = ids(rows.filter(trigram_similar(F.col("name"), query)))
        assert ids(similar_keys(index, query), "key") == similar, query
        held = ids(rows.filter(contains_ignoring_case(F.col("name"), query)))
        found = holding_keys(index, query)
        assert found is None or ids(found, "key") >= held, query
        keys = candidate_keys(index, query)
        assert (keys is None) == (query in ("ab", "a_b", "%", "")), query
        if keys is not None:
            assert ids(keys, "key") >= held | similar


def test_only_the_lists_of_the_query_are_read(spark, tmp_path):
    _, index = _index(spark, tmp_path)
    plan = similar_keys(index, "nova robo")._jdf.queryExecution().executedPlan().toString()
    assert "In(gram" in plan and "GreaterThanOrEqual(size" in plan
    assert "bucket" in plan.split("PartitionFilters")[1].split("]")[0] or "bucket" in plan.split("PartitionFilters")[1]
