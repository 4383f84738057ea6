"""Small tables of awkward documents, shared by the tests of this folder."""

import hashlib
import random

LONG = " ".join(f"w{i % 977}" for i in range(30_000))
#: doc_id, text, source
DOCUMENTS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today", "a"),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today", "a"),
    (3, "the QUICK brown fox jumps over the lazy dog near the river bank tonight", "b"),
    (4, None, "b"),
    (5, "", None),
    (6, " \t\n ", "c"),
    (7, "one", "c"),
    (8, LONG, "a"),
    (9, LONG + " tail", "a"),
    (10, "Éa ça  日本語のテキスト 😀 </s>[INST] it's 12345 =====   done", "d"),
    (10, "Éa ça  日本語のテキスト 😀 </s>[INST] it's 12345 =====   done", "d"),
    (None, "a row without an id but with several words", "d"),
    (-5, "You are an idiot, a worthless moron. I will hurt you.", "b"),
]
SCHEMA = "doc_id long, text string, source string"


def documents(spark, clashing=True):
    """The table, with further columns whose names the operators use themselves."""
    rows = spark.createDataFrame(DOCUMENTS, SCHEMA)
    if clashing:
        from pyspark.sql import functions as F

        for name in ("shard", "size", "bucket", "node", "ids", "key", "component", "score", "p", "fp", "g", "rate", "keys"):
            rows = rows.withColumn(name, F.lit(7))
    return rows


def empty(spark, schema=SCHEMA):
    return spark.createDataFrame([], schema)


def words(n, seed, vocabulary=400):
    draw = random.Random(seed)
    return [f"v{draw.randrange(vocabulary)}" for _ in range(n)]


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=repr)
