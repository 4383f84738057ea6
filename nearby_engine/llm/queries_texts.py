"""Registered queries of the ranking, run and quality operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from nearby_engine.functions.text import let
from nearby_engine.llm import lexical, pairwise, squares
from nearby_engine.llm.registry import register, table

# --- op11: ranked lexical search -----------------------------------------------------------------------------------------

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERMS_SQL = f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}')"
OP11_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS_SQL} AS terms FROM documents),
filled AS (SELECT r, doc_id, terms, len(terms) AS n FROM docs WHERE len(terms) > 0),
corpus AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_words FROM filled),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM filled) GROUP BY r, term),
items AS (SELECT DISTINCT item_id, text FROM benchmark),
asked AS (SELECT item_id, text, term, count(*) AS repeats FROM (SELECT item_id, text, unnest({_TERMS_SQL}) AS term FROM items) GROUP BY ALL),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM tf WHERE term IN (SELECT term FROM asked) GROUP BY term), corpus),
scored AS (
  SELECT item_id, text, r, CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_words)))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN filled USING (r), corpus GROUP BY item_id, text, r),
ranked AS (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id, scored.text ORDER BY score DESC, doc_id) AS rank
  FROM scored JOIN filled USING (r) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""


@register("op11_lexical_search", OP11_SQL)
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best documents for every benchmark item."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


# --- op12: periodic runs -------------------------------------------------------------------------------------------------


def periodic_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text; in a tenth of the documents, by hash of the id, the words from one on repeat a stretch of themselves.
    A row without an id keeps its text."""
    number = F.crc32(F.col("doc_id").cast("string").cast("binary"))

    def edited(words: Column, n: Column) -> Column:
        g = F.floor(number / 10)
        start = g % n
        period = 1 + F.floor((n - start) / (3 + g % 8))
        return F.array_join(F.transform(words, lambda w, i: F.when(i < start, w).otherwise(F.get(words, (start + (i - start) % period).cast("int")))), " ")

    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    changed = let(words, lambda w: F.when(F.size(w) > 0, edited(w, F.size(w))).otherwise(F.col("text")))
    return docs.select("doc_id", F.when((number % 10 == 0) & F.col("text").isNotNull(), changed).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """The digest columns of the query from the operator's runs and collapsed texts."""
    stronger = lambda a, b: b["length"] * a["period"] > a["length"] * b["period"]
    best = F.aggregate(F.slice("runs", 2, F.greatest(F.size("runs"), F.lit(1))), F.get("runs", F.lit(0)), lambda a, b: F.when(stronger(a, b), b).otherwise(a))
    line = lambda r: F.concat(F.concat_ws(",", *[r[k].cast("string") for k in ("start", "length", "period")]), F.lit("\n"))
    lines = F.array_join(F.transform("runs", line), "")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(F.expr("1000 * best.length div best.period")).alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


@register("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of every document, a tenth of them with a periodic tail."""
    return run_digests(squares.periodic_runs(periodic_tails(table(spark, sf_dir, "documents"))))


# --- op13: quality -------------------------------------------------------------------------------------------------------


@register("op13_pairwise_quality")
def op13_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by the ranker, which is taught by labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return pairwise.score(docs, pairwise.train(docs, table(spark, sf_dir, "labels")))
