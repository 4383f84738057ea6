"""Job-board payloads to company and job evidence.

Payload frames have (token, page, payload): one row per landed page of a board, JSON as text.
Board frames have (token, company_name, company_domain); missing names default to the token.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearby_engine import schemas as S
from nearby_engine.functions.classify import arrangement, publication_state, role_of_reason, with_role_reason
from nearby_engine.functions.dates import epoch_or_iso, iso_timestamp, iso_z
from nearby_engine.functions.text import clean_excerpt, company_hash, job_hash, strip
from nearby_engine.operators.search import instant

# Public addresses of boards and postings.
GREENHOUSE_BOARD = "https://boards.greenhouse.io/"
LEVER_BOARD = "https://jobs.lever.co/"


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Landed pages under ``path/<token>/<page>.json``."""
    files = spark.read.text(f"{path}/*/*.json", wholetext=True)
    place = F.col("_metadata.file_path")
    return files.select(
        F.url_decode(F.regexp_extract(place, r"/([^/]+)/[^/]+\.json$", 1)).alias("token"),
        F.regexp_extract(place, r"(\d+)\.json$", 1).try_cast("int").alias("page"),
        F.col("value").alias("payload"),
    )


def _first_seen_items(payloads: DataFrame, items: Column, item_id: str) -> DataFrame:
    """One row per (token, id) of all landed pages, the first met; a posting without an id goes by its content."""
    opened = payloads.select("token", "page", F.posexplode(items).alias("position", "item"))
    content = F.concat(F.lit("content-"), F.sha2(F.to_json("item"), 256))
    named = opened.withColumn("job_id", F.coalesce(F.col(f"item.{item_id}"), content))
    # The winner is found by its place alone; its body is fetched afterwards.
    places = named.groupBy("token", "job_id").agg(F.min(F.struct("page", "position")).alias("_at"))
    chosen = places.select("token", F.col("_at.page").alias("page"), F.col("_at.position").alias("position"))
    return named.join(chosen, ["token", "page", "position"], "left_semi")


def _boards(boards: DataFrame) -> DataFrame:
    return boards.select(
        "token",
        F.coalesce(F.when(F.col("company_name") != "", F.col("company_name")), F.col("token")).alias("company_name"),
        "company_domain",
    ).dropDuplicates(["token"])


def _board_companies(boards: DataFrame, provider: str, address: str, token_key: str) -> DataFrame:
    return _boards(boards).select(
        F.col("token").alias("page"), F.col("company_name").alias("name"),
        F.col("token").alias("source_record_id"), F.concat(F.lit(address), F.col("token")).alias("evidence_url"),
        F.col("company_domain").alias("domain"), F.lit("").alias("address"),
        F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lng"),
        F.lit(None).cast("string").alias("phone"),
        company_hash(F.col("company_name"), F.col("company_domain"), F.col("token")).alias("content_hash"),
        F.to_json(F.struct(F.lit(provider).alias("ats"), F.col("token").alias(token_key))).alias("metadata"),
    )


def _board_jobs(items: DataFrame, boards: DataFrame, provider: str, as_of: Column) -> DataFrame:
    """``items`` has title, categories, workplace, place, posted_at, url, body, metadata per posting."""
    technical = (
        with_role_reason(items, F.col("title"), F.col("categories"))
        .withColumn("role", role_of_reason(F.col("reason")))
        .filter("role.is_technical")
    )
    dated = technical.join(_boards(boards), "token")
    state = publication_state(F.col("posted_at"), as_of, as_of)
    kind = arrangement(
        text=F.concat_ws(" ", F.coalesce("place", F.lit("")), "title"), workplace_type=F.col("workplace")
    )
    return dated.select(
        F.col("token").alias("page"), "company_name", "title", F.col("job_id").alias("source_job_id"),
        F.col("url").alias("canonical_url"), "company_domain",
        clean_excerpt(F.col("body")).alias("description_excerpt"),
        job_hash(F.lit(provider), F.col("job_id"), F.col("title"), F.col("url")).alias("content_hash"),
        F.coalesce("place", F.lit("")).alias("location_raw"),
        F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lng"),
        F.lit("unknown").alias("coordinate_source"), kind.alias("work_arrangement"),
        state.alias("publication_state"), iso_z(F.col("posted_at")).alias("posted_at"),
        F.when(F.col("posted_at").isNotNull(), 1.0).otherwise(0.0).alias("posted_at_confidence"),
        iso_z(as_of).alias("first_seen_at"), iso_z(as_of).alias("last_seen_at"),
        F.col("role.classification").alias("technical_classification"),
        F.col("role.rule_version").alias("rule_version"),
        F.col("role.reasons").alias("classification_reasons"), "metadata",
        F.array().cast("array<string>").alias("remote_scopes"),
    )


def greenhouse_companies(boards: DataFrame) -> DataFrame:
    """One company per board, also for boards without jobs."""
    return _board_companies(boards, "greenhouse", GREENHOUSE_BOARD, "board_token")


def greenhouse_jobs(
    payloads: DataFrame, boards: DataFrame, as_of: datetime | str | Column
) -> DataFrame:
    """Technical postings of ``{"jobs": [...]}`` or ``[...]`` pages."""
    listed = F.coalesce(
        F.from_json("payload", S.GREENHOUSE_PAGE)["jobs"],
        F.from_json("payload", T.ArrayType(S.GREENHOUSE_JOB)),
    )
    firsts = _first_seen_items(payloads, listed, "id")
    names = F.filter(
        F.transform("item.departments", lambda d: d["name"]), lambda n: n.isNotNull() & (n != "")
    )
    names = F.coalesce(names, F.array().cast("array<string>"))
    place = F.col("item.location")
    url = F.col("item.absolute_url")
    items = firsts.select(
        "token", "job_id", F.coalesce(strip(F.col("item.title")), F.lit("")).alias("title"), names.alias("categories"),
        F.col("item.workplace_type").alias("workplace"),
        F.when(place.startswith("{"), F.get_json_object(place, "$.name")).otherwise(place).alias("place"),
        iso_timestamp(F.col("item.updated_at")).alias("posted_at"),
        F.when(url != "", url)
        .otherwise(F.concat(F.lit(GREENHOUSE_BOARD), "token", F.lit("/jobs/"), "job_id")).alias("url"),
        F.col("item.content").alias("body"),
        F.to_json(F.struct(F.lit("greenhouse").alias("ats"), names.alias("departments"))).alias("metadata"),
    )
    return _board_jobs(items, boards, "greenhouse", instant(as_of))


def lever_companies(boards: DataFrame) -> DataFrame:
    return _board_companies(boards, "lever", LEVER_BOARD, "site")


def lever_jobs(
    payloads: DataFrame, boards: DataFrame, as_of: datetime | str | Column
) -> DataFrame:
    """Technical postings of ``[...]``, ``{"postings": [...]}`` or ``{"jobs": [...]}`` pages."""
    page = F.from_json("payload", S.LEVER_PAGE)
    listed = F.coalesce(page["postings"], page["jobs"], F.from_json("payload", T.ArrayType(S.LEVER_POSTING)))
    firsts = _first_seen_items(payloads, listed, "id")
    categories = F.col("item.categories")
    listed_values = F.map_values(
        F.map_filter(categories, lambda k, v: (k != "workplaceType") & v.isNotNull() & (v != ""))
    )
    url, plain = F.col("item.hostedUrl"), F.col("item.descriptionPlain")
    items = firsts.select(
        "token", "job_id", F.coalesce(strip(F.col("item.text")), F.lit("")).alias("title"),
        F.coalesce(listed_values, F.array().cast("array<string>")).alias("categories"),
        F.try_element_at(categories, F.lit("workplaceType")).alias("workplace"),
        F.try_element_at(categories, F.lit("location")).alias("place"),
        epoch_or_iso(F.col("item.createdAt")).alias("posted_at"),
        F.when(url != "", url).otherwise(F.concat(F.lit(LEVER_BOARD), "token", F.lit("/"), "job_id")).alias("url"),
        F.when(plain != "", plain).otherwise(F.col("item.description")).alias("body"),
        F.to_json(
            F.struct(
                F.lit("lever").alias("ats"),
                F.coalesce(categories, F.create_map().cast("map<string,string>")).alias("categories"),
            )
        ).alias("metadata"),
    )
    return _board_jobs(items, boards, "lever", instant(as_of))
