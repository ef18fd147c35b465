"""Schemas of the catalogue's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

HOPS = "array<struct<url:string,status:int>>"
TABLES = {
    "organizers": "organizer_id string, name string, official_domain string, verified boolean, social_accounts array<string>, trust_score int, created_at timestamp",
    "events": "event_id string, title string, normalized_title string, description string, organizer_id string, organizer_name string, format string, country string, city string, city_original string, state string, venue string, address string, timezone string, start_date timestamp, end_date timestamp, "
    "registration_deadline timestamp, categories array<string>, technologies array<string>, event_url string, registration_url string, registration_status string, registration_unverified_note string, prize string, eligibility string, team_size string, "
    "status string, verification_decision string, verification_score int, publishing_tier string, source_trust_score int, freshness_score int, relevance_score int, dedupe_key string, first_seen timestamp, last_seen timestamp, last_verified timestamp, last_link_check timestamp",
    "event_sources": "id long, event_id string, source_id string, source_url string, source_level int, observed_at timestamp",
    "source_registry": "source_id string, name string, source_type string, base_url string, level int, trust_score int, enabled boolean, rate_limit_ms long, last_run timestamp, last_status string",
    "source_runs": "run_id long, source_id string, started_at timestamp, finished_at timestamp, discovered long, verified long, rejected long, error string",
    "event_changes": "change_id long, event_id string, field string, old_value string, new_value string, detected_at timestamp",
    "event_links": f"link_id long, event_id string, url_type string, original_url string, canonical_url string, final_url string, domain string, is_https boolean, redirect_count int, redirect_chain {HOPS}, domain_relationship string, provider_category string, security_status string, verification_status string, last_checked timestamp, first_seen timestamp",
    "link_checks": "check_id long, link_id long, checked_at timestamp, http_status int, final_url string, error string",
    "verification_evidence": "evidence_id long, event_id string, source_url string, evidence_type string, evidence_text string, observed_at timestamp, source_trust int, supports_claim boolean",
    "notification_targets": "target_id string, channel string, destination string, enabled boolean, filter string",
    "notifications": "notification_id long, event_id string, target_id string, template string, status string, created_at timestamp, sent_at timestamp, error string",
    "review_queue": "review_id long, event_id string, reason string, score int, created_at timestamp, resolved boolean, resolution string",
    "security_flags": "flag_id long, event_id string, link_id long, flag_type string, severity string, details string, resolved boolean, created_at timestamp",
    "domain_reputation": "domain string, reputation int, verdict string, provider string, checked_at timestamp",
    "source_reputation": "source_id string, valid_events long, dead_links long, fake_events long, duplicates long, updated_at timestamp",
    "dead_letter_queue": "id long, queue string, payload string, error string, attempts int, created_at timestamp",
    "schema_version": "version int, applied_at timestamp",
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(TABLES[name])


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], schema(name))


def upgraded(df: DataFrame, name: str) -> DataFrame:
    """A table of an older version with the columns it lacks as nulls, in the schema's order."""
    have = set(df.columns)
    return df.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(name)))
