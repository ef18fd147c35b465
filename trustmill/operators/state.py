"""The catalogue's tables after a flow, and the flow and its tables as one commit.

Each function takes the tables that a flow touches, in the columns of trustmill.schemas, and the flow's outputs, and gives
the tables that changed. Rows that are appended are numbered after those there are, in an order that does not depend on
how they were dealt. `discover`, `verify_events` and `recheck_links` read a store's latest snapshot, run the flow and
commit all tables together; a batch that was committed is not run again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trustmill import schemas
from trustmill.operators import discovery, links, verification
from trustmill.operators.commits import Snapshot, transact
from trustmill.operators.transitions import add_counters, count_outcomes, fold_trust, insert_or_ignore, merge_snapshot, next_ids

Tables = dict[str, DataFrame]
#: The column that numbers the rows of each table that only grows.
NUMBERS = {
    "event_sources": "id", "source_runs": "run_id", "event_changes": "change_id", "event_links": "link_id", "link_checks": "check_id", "verification_evidence": "evidence_id",
    "review_queue": "review_id", "security_flags": "flag_id", "dead_letter_queue": "id", "notifications": "notification_id",
}


def shaped(df: DataFrame, name: str) -> DataFrame:
    """df in the columns and types of a table; what it lacks is null."""
    return schemas.upgraded(df, name)


def appended(tables: Tables, name: str, rows: DataFrame, order: list[str]) -> DataFrame:
    """A table with rows numbered after its own."""
    number = NUMBERS[name]
    last = tables[name].agg(F.max(number)).first()[0] or 0
    fresh = next_ids(last, shaped(rows.drop(number), name).drop(number), [F.col(c) for c in order], number)
    return tables[name].unionByName(fresh.select(*tables[name].columns))


def learned(tables: Tables, outcomes: DataFrame, now: Column) -> Tables:
    """source_registry and source_reputation after outcomes (source_id, outcome, seq) in order."""
    steps = outcomes.withColumn("observed_at", now)
    trust = fold_trust(steps, tables["source_registry"]).withColumnRenamed("trust", "_trust")
    registry = tables["source_registry"].join(trust, "source_id", "left").withColumn("trust_score", F.coalesce("_trust", "trust_score")).select(*tables["source_registry"].columns)
    counted = count_outcomes(outcomes)
    counters = [c for c in counted.columns if c != "source_id"]
    before = tables["source_reputation"].select("source_id", *counters)
    touched = counted.select("source_id", F.lit(True).alias("_touched"))
    stamps = tables["source_reputation"].select("source_id", "updated_at")
    summed = add_counters(before, counted, "source_id").join(stamps, "source_id", "left").join(touched, "source_id", "left").withColumn("updated_at", F.when(F.col("_touched"), now).otherwise(F.col("updated_at")))
    return {"source_registry": registry, "source_reputation": shaped(summed, "source_reputation")}


def after_discovery(tables: Tables, out: dict[str, DataFrame], now: Column) -> Tables:
    """events, event_sources, event_links, source_registry, source_runs, source_reputation, security_flags and
    dead_letter_queue after `discovery.run`."""
    seen = out["seen"].withColumnRenamed("last_seen", "_seen")
    known = tables["events"].join(seen, "event_id", "left").withColumn("last_seen", F.greatest("last_seen", "_seen")).select(*tables["events"].columns)
    changed = {
        "events": insert_or_ignore(known, shaped(out["events"], "events"), ["event_id"], [F.col("event_id")]),
        "event_sources": appended(tables, "event_sources", out["event_sources"], ["event_id", "source_url"]),
        "event_links": appended(tables, "event_links", out["links"], ["event_id", "url_type"]),
        "source_runs": appended(tables, "source_runs", out["runs"], ["source_id"]),
        "security_flags": appended(tables, "security_flags", out["flags"].withColumn("resolved", F.lit(False)).withColumn("created_at", now), ["event_id", "flag_type", "details"]),
        "dead_letter_queue": appended(tables, "dead_letter_queue", out["dead_letters"].withColumn("created_at", now), ["queue", "payload"]),
    }
    registry = tables["source_registry"]
    refreshed = merge_snapshot(registry, shaped(out["registry"], "source_registry"), ["source_id"])
    return changed | learned({"source_registry": refreshed, "source_reputation": tables["source_reputation"]}, out["outcomes"], now)


def after_verification(tables: Tables, out: dict[str, DataFrame], now: Column, threats: DataFrame | None = None) -> Tables:
    """events, event_changes, event_links, link_checks, verification_evidence, security_flags, review_queue,
    source_registry and source_reputation after `verification.outputs`; with threats (domain) of hits also
    domain_reputation."""
    own = out["events"].withColumnsRenamed({"score": "verification_score", "decision": "verification_decision", "tier": "publishing_tier"})
    events = _updated(tables["events"], own, "event_id")
    refreshed = _updated(tables["event_links"], out["links"].drop("event_id"), "link_id")
    stamped = lambda df: df.withColumn("resolved", F.lit(False)).withColumn("created_at", now)
    evidence = out["evidence"].withColumnsRenamed({"type": "evidence_type", "text": "evidence_text", "supports": "supports_claim"}).withColumn("observed_at", now)
    changed = {
        "events": events, "event_links": refreshed,
        "event_changes": appended(tables, "event_changes", out["changes"], ["event_id", "field"]),
        "link_checks": appended(tables, "link_checks", out["checks"], ["link_id"]),
        "verification_evidence": appended(tables, "verification_evidence", evidence, ["event_id", "evidence_type", "evidence_text"]),
        "security_flags": appended(tables, "security_flags", stamped(out["flags"]), ["event_id", "flag_type"]),
        "review_queue": appended(tables, "review_queue", stamped(out["reviews"]), ["event_id"]),
    }
    if threats is not None:
        hit = threats.where("domain is not null").select("domain").distinct().select("domain", F.lit(0).alias("reputation"), F.lit("HIT").alias("verdict"), now.alias("checked_at"))
        changed["domain_reputation"] = merge_snapshot(tables["domain_reputation"], shaped(hit, "domain_reputation"), ["domain"])
    return changed | learned(tables, out["outcomes"].withColumn("seq", F.xxhash64("event_id")), now)


def after_recheck(tables: Tables, out: dict[str, DataFrame], now: Column) -> Tables:
    """events, event_links, link_checks, security_flags, event_changes and review_queue after `links.recheck`."""
    stamped = lambda df: df.withColumn("resolved", F.lit(False)).withColumn("created_at", now)
    return {
        "events": _updated(tables["events"], out["events"].select("event_id", "status", "registration_url", "registration_unverified_note"), "event_id"),
        "event_links": _updated(tables["event_links"], out["links"].drop("event_id", "url_type"), "link_id"),
        "link_checks": appended(tables, "link_checks", out["checks"].withColumnRenamed("status", "http_status"), ["link_id"]),
        "security_flags": appended(tables, "security_flags", stamped(out["flags"]), ["event_id", "link_id"]),
        "event_changes": appended(tables, "event_changes", out["changes"], ["event_id", "field"]),
        "review_queue": appended(tables, "review_queue", stamped(out["reviews"]), ["event_id", "reason"]),
    }


def _updated(current: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of current with the columns of their row in changes, nulls included; types stay."""
    kinds, names = dict(current.dtypes), [c for c in changes.columns if c != key and c in current.columns]
    told = changes.select(key, F.lit(True).alias("_told"), *(F.col(c).cast(kinds[c]).alias(f"_{c}") for c in names))
    values = {c: F.when(F.col("_told"), F.col(f"_{c}")).otherwise(F.col(c)) for c in names}
    return current.join(told, key, "left").withColumns(values).select(*current.columns)


def tables_of(spark: SparkSession, snapshot: Snapshot) -> Tables:
    """All tables of a snapshot; those that no commit has written are empty."""
    return {name: snapshot.table(spark, name) if name in snapshot.tables else schemas.empty(spark, name) for name in schemas.TABLES}


def flow(spark: SparkSession, folder: str, name: str, batch: int, step: Callable[[Tables], Tables]) -> Snapshot:
    """The snapshot after a flow's batch: step(tables) gives the tables that change."""
    return transact(spark, folder, lambda before: step(tables_of(spark, before)), name, batch)


def discover(spark: SparkSession, folder: str, batch: int, items: DataFrame, failures: DataFrame, now: Column, connectors: DataFrame | None = None) -> Snapshot:
    def step(tables: Tables) -> Tables:
        out = discovery.run(items, tables["source_registry"], tables["events"].select("event_id", "dedupe_key"), tables["event_sources"], failures, now, connectors)
        return after_discovery(tables, out, now)

    return flow(spark, folder, "discovery", batch, step)


def verify_events(spark: SparkSession, folder: str, batch: int, observed: Callable[[Tables], DataFrame], now: Column) -> Snapshot:
    """observed(tables) gives the events to verify with all that `verification.verify` reads."""

    def step(tables: Tables) -> Tables:
        verified = verification.verify(observed(tables))
        hits = verified.where("threat").select(F.col("link.host").alias("domain"))
        return after_verification(tables, verification.outputs(verified, tables["event_links"], tables["event_sources"], now), now, hits)

    return flow(spark, folder, "verification", batch, step)


def recheck_links(spark: SparkSession, folder: str, batch: int, resolved: Callable[[DataFrame], DataFrame], now: Column) -> Snapshot:
    """resolved(links) says where the links lead now (see `links.recheck`)."""

    def step(tables: Tables) -> Tables:
        return after_recheck(tables, links.recheck(tables["event_links"], resolved(tables["event_links"]), now, tables["events"]), now)

    return flow(spark, folder, "recheck", batch, step)
