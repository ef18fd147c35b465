"""Verification of events: link verdict, evidence, score, gate and status in one projection, and its outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustmill.functions.binding import let
from trustmill.functions.html import page_links
from trustmill.functions.dates import freshness
from trustmill.functions.scoring import flag_severity, next_status, publishing_gate, region_relevance, score_signals, verify_link
from trustmill.functions.text import significant_tokens, token_overlap
from trustmill.functions.urls import canonical_url, host_of, registrable_domain

FIRST_PARTY_LEVEL = 3
HOPS = "array<struct<url:string,status:int>>"


def official_context(events: DataFrame, pages: DataFrame) -> DataFrame:
    """events with official_page, official_domain, official_links, identity and event_page_dead from page snapshots.

    events: event_id, title, organizer_name, event_url, registration_url, best_level; optional final_url, where the
    registration leads; pages: url, status, body. Only sources of the first levels speak for the organizer. identity is
    null where the registration page was not seen; an event page is dead if it was asked for and did not answer well.
    """
    address = canonical_url(F.col("url")).alias("page_url")
    good = F.coalesce(F.col("status").between(200, 299), F.lit(False)) & (F.coalesce("body", F.lit("")) != "")
    seen = pages.select(address, F.when(good, F.col("body")).alias("body")).groupBy("page_url").agg(F.max("body").alias("body"))
    first_party = F.col("best_level") <= FIRST_PARTY_LEVEL
    keyed = events.withColumn("_page", canonical_url(F.col("event_url"))).withColumn("_form", canonical_url(F.col("registration_url")))
    asked = seen.select(F.col("page_url").alias("_page"), F.col("body").alias("_own"), F.lit(True).alias("_asked"))
    own = keyed.join(asked, "_page", "left").join(seen.withColumnsRenamed({"page_url": "_form", "body": "_target"}), "_form", "left")
    links = F.transform(page_links(F.col("_own"), F.col("event_url")), canonical_url)
    shown = F.regexp_replace(F.regexp_replace("_target", r"(?is)<(script|style).*?</\1\s*>", " "), "<[^>]*>", " ")
    text, tokens = F.lower(shown), significant_tokens(F.col("title"))
    overlap, named = token_overlap(tokens, text), F.size(tokens)
    alike = F.when(named == 0, False).when(named <= 2, overlap > 0).otherwise((overlap >= 0.4) & (overlap * named >= 2))
    organizer = token_overlap(significant_tokens(F.coalesce("organizer_name", F.lit(""))), text) > 0
    whole = (F.length("title") > 8) & F.contains(text, F.lower("title"))
    domain = registrable_domain(host_of(F.col("_page")))
    targets = F.array_compact(F.array(F.col("_form"), canonical_url(F.col("final_url")) if "final_url" in events.columns else F.lit(None).cast("string")))
    return own.select(
        *events.columns, (first_party & F.col("_own").isNotNull()).alias("official_page"), F.when(first_party, domain).alias("official_domain"),
        F.coalesce(first_party & F.arrays_overlap(links, targets), F.lit(False)).alias("official_links"), F.when(F.col("_target").isNotNull(), alike | organizer | whole).alias("identity"),
        (F.coalesce("_asked", F.lit(False)) & F.col("_own").isNull()).alias("event_page_dead"),
    )


def verify(events: DataFrame) -> DataFrame:
    """events with link, score, gate (blocking reasons), evidence and new_status. Columns needed: event_id, title,
    organizer_name, event_url, registration_url, source_url, source_trust, official_domain, official_page,
    official_links, identity, source_count, platform_listed, social, dates_consistent, organizer_consistent, recent,
    conflict, threat, has_date, classification, status; optional: final_url, redirects, resolve_error."""
    own = {c: F.col(c) for c in events.columns}
    link = verify_link(own["registration_url"], own["official_domain"], own["official_links"], own["identity"], own["threat"], own.get("final_url"), own.get("redirects"), own.get("resolve_error"))
    # one nested expression: as columns of their own, the parts would be computed again wherever a filter is pushed down
    whole = let(link, lambda v: let(score_signals(_signals(v)), lambda s: let(_gate(v, s), lambda g: F.struct(v.alias("link"), s.alias("score"), g.alias("gate"), _evidence(v).alias("evidence"), _status(v, s, g).alias("new_status")))))
    return events.select("*", whole.alias("_v")).select(*events.columns, "_v.*")


def _flags(link):
    return F.coalesce(link["flags"], F.array().cast("array<string>"))


def _signals(link) -> dict:
    flags, given = _flags(link), link.isNotNull()
    odd = F.exists(flags, lambda f: f.isin("EXCESSIVE_REDIRECTS", "SHORT_URL") | f.startswith("LOOKALIKE"))
    return {
        "officialOrganizerPage": F.col("official_page"), "officialRegistrationLink": F.coalesce((link["outcome"] == "APPROVE") & F.col("official_links"), F.lit(False)),
        "organizerSocialConfirmation": F.col("social"), "trustedEventPlatform": F.col("platform_listed"), "secondIndependentSource": F.col("source_count") >= 2,
        "validHttps": F.when(given, link["is_https"]).otherwise(F.coalesce(F.col("event_url").startswith("https://"), F.lit(False))), "consistentDates": F.col("dates_consistent"),
        "consistentOrganizer": F.col("organizer_consistent"), "recentConfirmation": F.col("recent"), "suspiciousRedirect": odd, "unknownRegistrationDomain": F.array_contains(flags, "UNKNOWN_REGISTRATION_DOMAIN"),
        "conflictingOfficialInfo": F.col("conflict"), "phishingMalwareReputation": F.col("threat"), "impersonationIndicators": F.coalesce(F.size(link["lookalikes"]) > 0, F.lit(False)),
    }


def _gate(link, score):
    critical = F.array_contains(_flags(link), "THREAT_REPUTATION_HIT") | F.coalesce(F.array_contains(link["lookalikes"], "PUNYCODE"), F.lit(False))
    return publishing_gate(F.col("title"), F.coalesce("organizer_name", "source_url"), F.coalesce("event_url", "source_url"), F.col("has_date"), F.col("classification"), score["decision"], F.lit(True), critical)


def _status(link, score, gate):
    changed = ~F.coalesce(link["final_url"] == F.col("registration_url"), F.lit(True)) & F.coalesce(link["outcome"] == "APPROVE", F.lit(False))
    return let(_flags(link), lambda f: next_status(score["decision"], score["tier"], F.size(gate) == 0, F.col("status"), changed, f, F.col("threat")))


def _evidence(link):
    """array of struct(type, text, supports). The texts are fixed values."""
    item = lambda c, kind, text, supports: F.when(c, F.struct(F.lit(kind).alias("type"), text.alias("text"), F.lit(supports).alias("supports")) if isinstance(supports, bool) else F.struct(F.lit(kind).alias("type"), text.alias("text"), supports.alias("supports")))
    given = link.isNotNull()
    verdict = F.format_string("Registration link %s (confidence %s): %s. final=%s", link["outcome"], link["confidence"], link["reason"], F.coalesce(link["final_url"], F.lit("null")))
    return F.array_compact(F.array(
        item(given, "LINK_VERIFICATION", verdict, link["outcome"] == "APPROVE"), item(~given, "LINK_VERIFICATION", F.lit("No registration URL provided; event may publish without one."), True),
        item(given & (F.size(link["lookalikes"]) > 0), "LOOKALIKE_DOMAIN", F.concat(F.lit("Lookalike signals: "), F.array_join(link["lookalikes"], ", ")), False),
        item(F.col("official_page"), "OFFICIAL_PAGE", F.lit("Official organizer page located."), True), item(F.col("social"), "SOCIAL_CONFIRMATION", F.lit("Organizer social account confirms event."), True),
        item(F.col("platform_listed"), "PLATFORM_LISTING", F.lit("Listed on trusted event platform."), True),
        item(F.col("source_count") >= 2, "CROSS_SOURCE", F.concat(F.col("source_count").cast("string"), F.lit(" independent sources agree.")), True),
        item(F.col("conflict"), "CONFLICT", F.lit("Official sources conflict; value withheld as fact."), False),
    ))


def outputs(verified: DataFrame, links: DataFrame, event_sources: DataFrame, now: Column) -> dict[str, DataFrame]:
    """The tables that a verification writes: events, changes, links, checks, evidence, flags, reviews and outcomes.

    links: link_id, event_id, url_type; event_sources: event_id, source_id. A registration link's latest row is refreshed;
    approved addresses that differ from the event's are a change; every source of an event learns from its outcome, or
    from a dead event page. verified may have event_page_dead (see `official_context`), first_seen and last_seen (for
    the freshness), and http_status, what the registration's last address answered, with the redirect_chain to it.
    """
    have = set(verified.columns)
    given_or = lambda c, kind: F.col(c) if c in have else F.lit(None).cast(kind)
    text = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    flags, approved = text(F.col("link.flags")), F.coalesce(F.col("link.outcome") == "APPROVE", F.lit(False))
    given = F.col("link").isNotNull()
    form = F.when(approved, F.col("link.final_url"))
    note = F.when(F.col("registration_url").isNotNull() & form.isNull(), "Registration link could not be independently verified.")
    latest = links.where("url_type = 'REGISTRATION'").groupBy("event_id").agg(F.max("link_id").alias("link_id"))
    seen = verified.where(given).join(latest, "event_id")
    checked = F.when(F.col("link.outcome") == "APPROVE", "VERIFIED").when(F.col("link.outcome") == "REJECT", "REJECTED").otherwise("PENDING")
    suspicious = F.concat(F.lit("SUSPICIOUS_FLAGS:"), F.when(F.size(flags) > 0, F.array_join(flags, ",")).otherwise(F.col("score.decision")))
    gated = F.concat(F.lit("TIER_"), "score.tier", F.lit("_GATE_"), F.when(F.size("gate") == 0, "PASS").otherwise(F.concat(F.lit("BLOCKED:"), F.array_join("gate", ","))))
    outcome = F.when(F.col("new_status").isin("VERIFIED", "UPDATED"), "valid").when(F.col("new_status") == "REJECTED", "fake").when(F.coalesce(given_or("event_page_dead", "boolean"), F.lit(False)), "dead_link")
    none = F.lit(None).cast("string")
    relevance = region_relevance(none, none, F.col("official_domain"), F.col("organizer_name"), none, none, F.lit(None).cast("boolean"))["score"]
    fresh = freshness(given_or("first_seen", "timestamp"), given_or("last_seen", "timestamp"), now, now) if {"first_seen", "last_seen"} & have else F.lit(None).cast("int")
    return {
        "events": verified.select("event_id", F.col("new_status").alias("status"), "score.score", "score.decision", "score.tier", form.alias("registration_url"), note.alias("registration_unverified_note"), now.alias("last_verified"), now.alias("last_link_check"), now.alias("last_seen"), relevance.alias("relevance_score"), fresh.alias("freshness_score"), F.col("source_trust").alias("source_trust_score")),
        "changes": verified.where(approved & (F.col("link.final_url") != F.col("registration_url"))).select("event_id", F.lit("registration_url").alias("field"), F.col("registration_url").alias("old_value"), F.col("link.final_url").alias("new_value"), now.alias("detected_at")),
        "links": seen.select(
            "link_id", "event_id", "link.canonical_url", "link.final_url", F.col("link.host").alias("domain"), "link.is_https", F.col("link.redirects").alias("redirect_count"), F.col("link.relationship").alias("domain_relationship"), F.col("link.category").alias("provider_category"),
            F.when(F.size(flags) > 0, "FLAGGED").otherwise("CLEAR_LOCAL_CHECKS").alias("security_status"), checked.alias("verification_status"), given_or("redirect_chain", HOPS).alias("redirect_chain"), now.alias("last_checked"),
        ),
        "checks": seen.select("link_id", now.alias("checked_at"), given_or("http_status", "int").alias("http_status"), F.col("link.final_url").alias("final_url"), F.lit(None).cast("string").alias("error")),
        "evidence": verified.select("event_id", "source_url", "source_trust", F.explode("evidence").alias("e")).select("event_id", "source_url", "source_trust", "e.*"),
        "flags": verified.select("event_id", F.explode(flags).alias("flag_type"), F.concat(F.lit("link="), F.coalesce("link.final_url", F.lit("n/a"))).alias("details")).withColumn("severity", flag_severity(F.col("flag_type"))),
        "reviews": verified.where(F.col("new_status").isin("NEEDS_REVIEW", "SUSPICIOUS")).select("event_id", F.left(F.when(F.col("new_status") == "SUSPICIOUS", suspicious).otherwise(gated), F.lit(500)).alias("reason"), F.col("score.score").alias("score")),
        "outcomes": verified.select("event_id", outcome.alias("outcome")).where("outcome is not null").join(event_sources.select("event_id", "source_id").distinct(), "event_id"),
    }
