"""Company identity: which stored or new company every mention belongs to.

The rule is sequential (first mention wins, a domain beats a name, a company without a domain is
taken over by the first new domain of its name) but its outcome depends only on the first mention
of every domain and of every name. Those are small aggregates, so mentions are never gathered.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearby_engine.functions.dates import iso_timestamp
from nearby_engine.functions.text import normalized_name, strip
from nearby_engine.functions.urls import clean_domain
from nearby_engine.operators.ranking import once
from nearby_engine.session import landed
from nearby_engine.sources.evidence import sequence_key

COMPANY_FIELDS = [
    "id", "name", "normalized_name", "domain", "industry", "employee_count", "description", "verified",
    "first_seen_at", "last_seen_at", "first_mention",
]


@dataclass(frozen=True)
class Identity:
    """``companies`` is the new table; ``by_domain`` and ``by_name`` resolve mentions."""

    companies: DataFrame
    by_domain: DataFrame
    by_name: DataFrame
    created: DataFrame


def company_key(kind: str, value: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{kind}:"), value), 256)


def mentions(company_rows: DataFrame, job_rows: DataFrame) -> DataFrame:
    """(name, domain, seq, observed_at) of every company and job record."""
    return company_rows.select("name", "domain", "seq", "observed_at").unionByName(
        job_rows.select(
            F.col("company_name").alias("name"), F.col("company_domain").alias("domain"), "seq", "observed_at"
        )
    )


def mentions_of(batches: DataFrame) -> DataFrame:
    """As :func:`mentions`, from the batches themselves: they are read once for both kinds of records."""

    def listed(column: str, kind: int, name: str, domain: str) -> Column:
        found = F.transform(
            column,
            lambda r, i: F.struct(F.lit(kind).alias("kind"), i.alias("index"), r[name].alias("name"), r[domain].alias("domain")),
        )
        return F.coalesce(found, F.array().cast("array<struct<kind:int,index:int,name:string,domain:string>>"))

    both = F.concat(listed("companies", 0, "name", "domain"), listed("jobs", 1, "company_name", "company_domain"))
    timed = once(batches, {"at": iso_timestamp(F.col("observed_at")), "r": both})
    opened = timed.select("batch_id", "source", F.col("at").alias("observed_at"), F.inline("r"))
    return opened.select("name", "domain", sequence_key(F.col("kind"), F.col("index"), F.col("observed_at")).alias("seq"), "observed_at")


def _mention_order(seq: Column) -> Column:
    """The place of a mention among those of the same time, as text that sorts like it."""
    return F.concat_ws("|", seq["source"], seq["batch_id"], seq["kind"].cast("string"), F.lpad(seq["index"].cast("string"), 10, "0"))


def with_identity_keys(rows: DataFrame, name: str = "name", domain: str = "domain") -> DataFrame:
    return once(rows, {"norm_key": normalized_name(F.col(name)), "domain_key": clean_domain(F.col(domain))})


def resolve(existing: DataFrame, mentioned: DataFrame) -> Identity:
    """``mentioned`` may have its identity keys already, as mentions that are read more than once should."""
    if "first_mention" not in existing.columns:
        existing = existing.withColumn("first_mention", F.lit(None).cast("string"))
    # One row per distinct (name, domain): written once, as everything below starts from it.
    keyed = landed(
        (mentioned if "norm_key" in mentioned.columns else with_identity_keys(mentioned))
        .groupBy("norm_key", "domain_key")
        .agg(
            F.min(F.struct("seq", "name")).alias("first"),
            F.min("observed_at").alias("seen_from"),
            F.max("observed_at").alias("seen_to"),
        )
        .select("norm_key", "domain_key", "first.seq", strip(F.col("first.name")).alias("name"), "seen_from", "seen_to")
    )
    domains = (
        keyed.filter(F.col("domain_key").isNotNull())
        .groupBy("domain_key")
        .agg(
            F.min(F.struct("seq", "norm_key", "name")).alias("first"),
            F.min("seen_from").alias("seen_from"),
            F.max("seen_to").alias("seen_to"),
        )
        .select("domain_key", "first.*", "seen_from", "seen_to")
    )
    known = existing.filter(F.col("domain").isNotNull()).select(
        F.lower("domain").alias("domain_key"), F.col("id").alias("known_id")
    )
    placed = domains.join(known, "domain_key", "left")
    fresh = placed.filter(F.col("known_id").isNull())

    # Per name: the first new domain, the first mention without a domain, and what is stored.
    by_new_domain = fresh.groupBy("norm_key").agg(F.min(F.struct("seq", "domain_key")).alias("new_domain"))
    without = keyed.filter(F.col("domain_key").isNull()).select(
        "norm_key", F.struct("seq", "name", "seen_from", "seen_to").alias("plain")
    )
    stored = existing.groupBy(F.col("normalized_name").alias("norm_key")).agg(
        F.min(F.struct("first_seen_at", "first_mention", "id")).alias("oldest"),
        F.min(F.when(F.col("domain").isNull(), F.col("id"))).alias("open_id"),
    )
    names = by_new_domain.join(without, "norm_key", "full").join(stored, "norm_key", "left")
    plain_first = F.col("plain.seq").isNotNull() & (
        F.col("new_domain").isNull() | (F.col("plain.seq") < F.col("new_domain.seq"))
    )
    names = landed(
        names.select(
            "norm_key", "plain", "new_domain", "oldest", "open_id",
            (F.col("oldest").isNull() & plain_first).alias("opens"),
        ).withColumn(
            "anchor_id",
            F.coalesce(
                "oldest.id",
                F.when(F.col("opens"), company_key("n", F.col("norm_key"))),
                company_key("d", F.col("new_domain.domain_key")),
            ),
        )
    )
    # A company without a domain, stored or just opened, goes to the first new domain of its name.
    adopting = names.filter(
        F.col("new_domain").isNotNull() & (F.col("open_id").isNotNull() | F.col("opens"))
    ).select(
        F.col("new_domain.domain_key").alias("domain_key"),
        F.coalesce("open_id", "anchor_id").alias("adopted_id"),
    )
    resolved = landed(
        placed.join(adopting, "domain_key", "left")
        .withColumn("company_id", F.coalesce("known_id", "adopted_id", company_key("d", F.col("domain_key"))))
    )
    by_domain = resolved.select("domain_key", "company_id")
    by_name = names.filter(F.col("plain").isNotNull()).select("norm_key", F.col("anchor_id").alias("company_id"))

    new_by_domain = resolved.filter(F.col("known_id").isNull() & F.col("adopted_id").isNull()).select(
        F.col("company_id").alias("id"), "name", F.col("norm_key").alias("normalized_name"),
        F.col("domain_key").alias("domain"), F.col("seen_from").alias("first_seen_at"),
        F.col("seen_to").alias("last_seen_at"), _mention_order(F.col("seq")).alias("first_mention"),
    )
    opened = names.filter("opens").select(
        F.col("anchor_id").alias("id"), F.col("plain.name").alias("name"),
        F.col("norm_key").alias("normalized_name"),
        F.when(F.col("new_domain").isNotNull(), F.col("new_domain.domain_key")).alias("domain"),
        F.col("plain.seen_from").alias("first_seen_at"), F.col("plain.seen_to").alias("last_seen_at"),
        _mention_order(F.col("plain.seq")).alias("first_mention"),
    )
    created = new_by_domain.unionByName(opened)
    blank = {
        "industry": F.lit(None).cast("string"), "employee_count": F.lit(None).cast("string"),
        "description": F.lit(None).cast("string"), "verified": F.lit(False),
    }
    taken = adopting.select(F.col("adopted_id").alias("id"), F.col("domain_key").alias("_taken"))
    seen = (
        resolved.select(F.col("company_id").alias("id"), "seen_to")
        .unionByName(
            names.filter(F.col("plain").isNotNull()).select(
                F.col("anchor_id").alias("id"), F.col("plain.seen_to").alias("seen_to")
            )
        )
        .groupBy("id")
        .agg(F.max("seen_to").alias("_seen"))
    )
    companies = (
        existing.select(COMPANY_FIELDS)
        .join(taken, "id", "left")
        .withColumn("domain", F.coalesce("domain", "_taken"))
        .drop("_taken")
        .unionByName(created.withColumns(blank).select(COMPANY_FIELDS))
        .join(seen, "id", "left")
        .withColumn("last_seen_at", F.greatest("last_seen_at", "_seen"))
        .select(COMPANY_FIELDS)
    )
    return Identity(companies, by_domain, by_name, created)


def assign(rows: DataFrame, identity: Identity, name: str = "name", domain: str = "domain") -> DataFrame:
    """Add ``company_id``: rows with a domain by domain, the others by name. Two equi-joins."""
    keyed = with_identity_keys(rows, name, domain)
    columns = [*rows.columns, "company_id"]
    named = keyed.filter(F.col("domain_key").isNotNull()).join(identity.by_domain, "domain_key")
    plain = keyed.filter(F.col("domain_key").isNull()).join(identity.by_name, "norm_key")
    return named.select(columns).unionByName(plain.select(columns))


def aliases(existing: DataFrame, identity: Identity) -> DataFrame:
    """One source-name alias per created company, next to the stored ones."""
    fresh = identity.created.select(
        F.col("id").alias("company_id"), F.col("name").alias("alias"),
        F.col("normalized_name").alias("normalized_alias"), F.lit("source_name").alias("alias_type"),
    )
    keys = ["company_id", "normalized_alias", "alias_type"]
    return existing.unionByName(fresh.join(existing, keys, "left_anti"))


def domains(existing: DataFrame, identity: Identity, mentioned: DataFrame) -> DataFrame:
    """One primary domain row per (company, domain), first and last sight kept."""
    seen = (
        (mentioned if "domain_key" in mentioned.columns else mentioned.withColumn("domain_key", clean_domain(F.col("domain"))))
        .filter(F.col("domain_key").isNotNull())
        .groupBy("domain_key")
        .agg(F.min("observed_at").alias("first_seen_at"), F.max("observed_at").alias("last_seen_at"))
        .join(identity.by_domain, "domain_key")
        .select(
            "company_id", F.col("domain_key").alias("normalized_domain"), F.lit("primary").alias("domain_type"),
            F.lit(True).alias("is_primary"), "first_seen_at", "last_seen_at",
        )
    )
    return (
        existing.unionByName(seen)
        .groupBy("company_id", "normalized_domain")
        .agg(
            F.min("domain_type").alias("domain_type"), F.bool_or("is_primary").alias("is_primary"),
            F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"),
        )
    )
