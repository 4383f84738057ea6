"""Small evidence records for tests."""

from nearby_engine.schemas import EVIDENCE_BATCH
from nearby_engine.sources.evidence import with_batch_id

DAY = "2026-09-01T00:00:00Z"


def company(name, **more):
    base = dict(
        name=name, source_record_id=None, evidence_url=None, domain=None, address="", lat=None, lng=None,
        phone=None, content_hash="", metadata="{}",
    )
    return {**base, **more}


def job(company_name, title, **more):
    base = dict(
        company_name=company_name, title=title, source_job_id=None, canonical_url="", company_domain=None,
        description_excerpt=None, content_hash="", location_raw="", lat=None, lng=None, coordinate_source="unknown",
        work_arrangement="unknown", publication_state="observed_recently", posted_at=None, posted_at_confidence=0.0,
        first_seen_at=DAY, last_seen_at=DAY, technical_classification="", rule_version="v1",
        classification_reasons=[], metadata="{}", remote_scopes=[],
    )
    return {**base, **more}


def batch(companies=(), jobs=(), observed_at=DAY, source="openstreetmap", family="open_dataset"):
    return dict(
        contract_version=1, discovery_job_id="run1", source=source, source_family=family, observed_at=observed_at,
        companies=list(companies), jobs=list(jobs),
    )


def frame(spark, batches):
    return with_batch_id(spark.createDataFrame(list(batches), EVIDENCE_BATCH))
