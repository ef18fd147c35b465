"""A discovery run as one transition: what connectors found becomes events, provenance, run records and dead letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustmill.functions.binding import let
from trustmill.functions.matching import dedupe_key
from trustmill.functions.text import trimmed
from trustmill.functions.urls import normalize_url
from trustmill.operators.links import run_gate
from trustmill.operators.transitions import cluster
from trustmill.session import stored
from trustmill.sources.sinks import dead_letters

STATUS = {"RUN": "OK", "DISABLED": "SKIPPED_DISABLED", "RATE_LIMITED": "SKIPPED_RATE_LIMIT"}


def event_id(key: Column) -> Column:
    """The id of the event with this key; the same in every run, so that a run can be repeated."""
    return F.concat(F.lit("evt_"), F.left(F.sha2(key, 256), F.lit(20)))


def keyed(items: DataFrame) -> DataFrame:
    """items with their key and event id. Titles of white space are none."""
    title = F.nullif(trimmed(F.col("title")), F.lit(""))
    key = let(title, lambda t: dedupe_key(t, F.col("organizer"), F.col("start_date"), F.coalesce("event_url", "source_url"), F.col("registration_url")))
    found = let(key, lambda k: F.struct(k.alias("dedupe_key"), event_id(k).alias("event_id")))
    return items.select("*", title.alias("_title"), found.alias("_key")).withColumn("title", F.col("_title")).select("*", "_key.*").drop("_title", "_key")


#: What a source gets that has no entry in the registry: fixed values.
NEW_TRUST, NEW_RATE_MS = 50, 2000


def registered(registry: DataFrame, seen: DataFrame, connectors: DataFrame | None = None) -> DataFrame:
    """The registry with a row for each source in `seen` (source_id) and each connector that has none, enabled and never
    run. connectors: source_id and what is known of source_type, trust_score, rate_limit_ms."""
    told = connectors.select("source_id", *(c for c in ("source_type", "trust_score", "rate_limit_ms") if c in connectors.columns)) if connectors is not None else None
    ids = seen.select("source_id") if told is None else seen.select("source_id").unionByName(told.select("source_id"))
    new = ids.where("source_id is not null").distinct().join(registry.select("source_id"), "source_id", "left_anti")
    if told is not None:
        new = new.join(told.dropDuplicates(["source_id"]), "source_id", "left")
    given = lambda c, default: F.coalesce(c, F.lit(default)) if c in new.columns else F.lit(default)
    values = {"name": F.col("source_id"), "source_type": given("source_type", "unknown"), "trust_score": given("trust_score", NEW_TRUST), "rate_limit_ms": given("rate_limit_ms", NEW_RATE_MS), "enabled": F.lit(True)}
    kinds = dict(registry.dtypes)
    rows = new.select("source_id", *(v.cast(kinds[c]).alias(c) for c, v in values.items() if c in kinds))
    return registry.unionByName(rows, allowMissingColumns=True)


def new_links(events: DataFrame, now: Column) -> DataFrame:
    """The link rows of new events: the event's page and its registration, where an address is given."""
    rows = events.select("event_id", F.explode(F.array(*(F.struct(F.lit(kind).alias("url_type"), F.col(c).alias("original_url")) for kind, c in (("EVENT_PAGE", "event_url"), ("REGISTRATION", "registration_url"))))).alias("l")).select("event_id", "l.*")
    link = normalize_url(F.col("original_url"))
    told = rows.where("original_url <> ''").select("*", link.alias("_u"))
    return told.select(
        "event_id", "url_type", "original_url", F.col("_u.canonical").alias("canonical_url"), F.col("_u.host").alias("domain"), F.coalesce("_u.is_https", F.lit(False)).alias("is_https"), F.lit(0).alias("redirect_count"),
        F.lit("PENDING").alias("security_status"), F.lit("UNVERIFIED").alias("verification_status"), now.alias("first_seen"),
    )


def run(items: DataFrame, registry: DataFrame, events: DataFrame, event_sources: DataFrame, failures: DataFrame, now: Column, connectors: DataFrame | None = None) -> dict[str, DataFrame]:
    """The outputs of a run: new events, links, event_sources, outcomes, flags, runs, registry, dead_letters and results.

    items: source_id, seq, source_url, title, organizer, format, start_date, event_url, registration_url, source_level,
    security_note; registry: source_id, enabled, rate_limit_ms, last_run, last_status; events: event_id, dedupe_key;
    event_sources: event_id, source_url; failures: source_id, error, of the sources that could not be read.

    Sources without an entry in the registry get one first (`registered`); items without a source are left out. Items of
    disabled and rate-limited sources are left out, items without a title counted and left out; of items with one new
    key the first (by source and seq) is a new event, all others attach to it or to the event known. An event has each
    address that it was seen at once, from the source that showed it first.
    """
    registry = registered(registry, items.select("source_id").unionByName(failures.select("source_id")), connectors)
    sources = registry.join(failures.select("source_id", "error"), "source_id", "left").withColumn("gate", run_gate(F.col("enabled"), F.col("last_run"), F.col("rate_limit_ms"), now))
    sources = sources.withColumn("status", F.when((F.col("gate") == "RUN") & F.col("error").isNotNull(), "FAILED").otherwise(_mapped(F.col("gate"))))
    ran = sources.where("status = 'OK'").select("source_id")
    taken = keyed(items.join(ran, "source_id", "left_semi"))
    told = cluster(taken.where("title is not null"), events, [F.col("source_id"), F.col("seq")])
    ids = events.groupBy("dedupe_key").agg(F.min("event_id").alias("_known_id"))
    told = stored(told.join(ids, "dedupe_key", "left").withColumn("event_id", F.coalesce("_known_id", "event_id")).drop("_known_id"), "discovered")
    new = told.where("action = 'INSERT'")
    pairs = told.groupBy("event_id", "source_url").agg(F.min_by(F.struct("source_id", "source_level"), F.struct("source_id", "seq")).alias("_s")).select("event_id", "_s.source_id", "source_url", "_s.source_level")
    counts = taken.groupBy("source_id").agg(F.count(F.lit(1)).alias("discovered"), F.count_if(F.col("title").isNull()).alias("rejected"))
    actions = told.groupBy("source_id").agg(F.count_if(F.col("action") == "INSERT").alias("inserted"), F.count_if(F.col("action") == "ATTACH").alias("attached"))
    numbers = ("discovered", "inserted", "attached", "rejected")
    results = sources.join(counts, "source_id", "left").join(actions, "source_id", "left").select("source_id", "status", "error", *(F.coalesce(c, F.lit(0)).alias(c) for c in numbers))
    done = results.where(F.col("status").isin("OK", "FAILED"))
    last = done.select("source_id", F.col("status").alias("_status"))
    failed = results.where("status = 'FAILED'").select("source_id", F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"), "error")
    found = new.select(
        "event_id", "dedupe_key", "title", F.left(F.lower("title"), F.lit(512)).alias("normalized_title"), F.col("organizer").alias("organizer_name"), F.coalesce("format", F.lit("UNKNOWN")).alias("format"), "start_date",
        F.coalesce("event_url", "source_url").alias("event_url"), "registration_url", F.lit("DISCOVERED").alias("status"), F.lit(0).alias("verification_score"), now.alias("first_seen"), now.alias("last_seen"),
    )
    ran_now = F.col("_status").isNotNull()
    return {
        "events": found,
        "links": new_links(found, now),
        "seen": told.where("action = 'ATTACH'").select("event_id", now.alias("last_seen")).distinct(),
        "event_sources": pairs.join(event_sources.select("event_id", "source_url"), ["event_id", "source_url"], "left_anti").withColumn("observed_at", now),
        "outcomes": told.where("action = 'ATTACH'").select("source_id", F.lit("duplicate").alias("outcome"), "seq"),
        "flags": new.where("security_note is not null").select("event_id", F.lit("EXTRACTION_WARNING").alias("flag_type"), F.lit("warning").alias("severity"), F.left("security_note", F.lit(500)).alias("details")),
        "runs": done.select("source_id", now.alias("started_at"), now.alias("finished_at"), "discovered", F.lit(0).cast("long").alias("verified"), "rejected", "error"),
        "registry": registry.join(last, "source_id", "left").withColumns({"last_run": F.when(ran_now, now).otherwise(F.col("last_run")), "last_status": F.coalesce("_status", "last_status")}).select(*registry.columns),
        "dead_letters": dead_letters(failed.select("source_id", "at", "error"), "discovery", F.col("error")),
        "results": results,
    }


def _mapped(gate: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, status in STATUS.items():
        out = F.when(gate == name, status).otherwise(out)
    return out
