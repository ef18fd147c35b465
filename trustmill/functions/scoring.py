"""Link verdicts, event scores, publication gates and messages as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trustmill.config import INDIAN_CITIES, PUBLISH_AT, REVIEW_AT, SIGNAL_WEIGHTS, TIER_A_AT, TRACKED_FIELDS, TRUST_STEPS
from trustmill.functions.binding import let
from trustmill.functions.domains import domain_relationship, lookalike_signals
from trustmill.functions.urls import normalize_url


def listed(named: dict[str, Column]) -> Column:
    """The names whose condition holds, in order."""
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in named.items())))


def clamp(c: Column, low: int, high: int) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def score_signals(signals: dict[str, Column], weights: dict[str, int] | None = None) -> Column:
    """struct(score, decision, tier, breakdown) from the signals; absent ones are false."""
    weights = weights or SIGNAL_WEIGHTS
    on = {k: F.coalesce(signals.get(k, F.lit(False)), F.lit(False)) for k in weights}
    entry = "struct<signal:string,delta:int>"
    breakdown = F.array_compact(F.array(*(F.when(on[k], F.struct(F.lit(k).alias("signal"), F.lit(w).alias("delta"))).cast(entry) for k, w in weights.items())))

    def decided(found: Column) -> Column:
        score = clamp(F.aggregate(found, F.lit(0), lambda a, b: a + b["delta"]), -100, 100)
        return let(score, lambda s: _decision(s, on, found))

    return let(breakdown, decided)


def _decision(score: Column, on: dict[str, Column], breakdown: Column) -> Column:
    bad, odd = on["confirmedMalicious"] | on["phishingMalwareReputation"], on["impersonationIndicators"] | on["suspiciousRedirect"]
    official = on["officialOrganizerPage"] & on["officialRegistrationLink"] & (score >= TIER_A_AT)
    low = (score < 0) | ((score < 10) & on["unknownRegistrationDomain"])
    decision = (
        F.when(bad, "REJECTED").when(odd, "SUSPICIOUS").when(official, "VERIFIED_OFFICIAL")
        .when((score >= PUBLISH_AT) & on["secondIndependentSource"], "VERIFIED_BY_MULTIPLE_SOURCES").when(score >= PUBLISH_AT, "LIKELY_LEGITIMATE")
        .when(score >= REVIEW_AT, "UNVERIFIED").when(low, "SUSPICIOUS").otherwise("UNVERIFIED")
    )
    listed_platform = on["trustedEventPlatform"]
    tier = (
        F.when(bad | odd, "E").when(official, "A").when((score >= PUBLISH_AT) & on["secondIndependentSource"], "B")
        .when(score >= PUBLISH_AT, F.when(listed_platform, "C").otherwise("B")).when(score >= REVIEW_AT, F.when(listed_platform, "C").otherwise("D"))
        .when(low, "E").otherwise("D")
    )
    return F.struct(score.cast("int").alias("score"), decision.alias("decision"), tier.alias("tier"), breakdown.alias("breakdown"))


def publishing_gate(title: Column, organizer: Column, page: Column, dated: Column, classification: Column, decision: Column, registration_ok: Column, critical: Column) -> Column:
    """The reasons that keep an event from being published; none, and it may be."""
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return listed({
        "MISSING_TITLE": blank(title), "MISSING_ORGANIZER_OR_SOURCE": blank(organizer), "MISSING_EVENT_PAGE_OR_SOURCE": blank(page),
        "MISSING_DATE_AND_DEADLINE": no(dated), "MISSING_CLASSIFICATION": blank(classification),
        "NO_VERIFICATION_DECISION": blank(decision) | (decision == "REJECTED"), "REGISTRATION_UNRESOLVED": no(registration_ok),
        "UNRESOLVED_CRITICAL_SECURITY_FLAGS": ~no(critical),
    })


def verify_link(raw_url: Column, official_domain: Column, official_links: Column, identity: Column, threat: Column,
                resolved_url: Column | None = None, redirects: Column | None = None, error: Column | None = None) -> Column:
    """struct of the verdict on a registration link. resolved_url, redirects, error: where it leads (itself by default)."""
    given = lambda c, default: F.coalesce(c, default) if c is not None else default
    hops, error = given(redirects, F.lit(0)), given(error, F.lit(None).cast("string"))
    inputs = F.struct(hops.alias("hops"), error.alias("error"), F.coalesce(official_links, F.lit(False)).alias("linked"), identity.alias("identity"), F.coalesce(threat, F.lit(False)).alias("threat"))

    def destination(link: Column) -> Column:
        url = given(resolved_url, link["canonical"])
        final = normalize_url(url) if resolved_url is not None else link
        host = F.coalesce(final["host"], link["host"])
        parts = F.struct(url.alias("url"), host.alias("host"), F.coalesce(final["is_https"], F.lit(False)).alias("https"))
        return let(parts, lambda d: let(F.struct(domain_relationship(d["host"], official_domain).alias("related"), lookalike_signals(d["host"], official_domain).alias("signals")), lambda r: let(inputs, lambda i: _verdict(link, d, r, i))))

    return F.when(raw_url.isNotNull(), let(normalize_url(raw_url), destination))


def _verdict(link: Column, final: Column, about: Column, given: Column) -> Column:
    relation, signals, https = about["related"]["relationship"], about["signals"], final["https"]
    hops, linked, threat = given["hops"], given["linked"], given["threat"]
    own, platform = relation.isin("SAME_DOMAIN", "SUBDOMAIN"), relation == "KNOWN_EVENT_PLATFORM"
    no_match, match = given["identity"].eqNullSafe(False), given["identity"].eqNullSafe(True)
    flags = F.concat(
        listed({"NON_HTTPS": ~link["is_https"], "SHORT_URL": link["is_short_url"], "EXCESSIVE_REDIRECTS": hops >= 4, "RESOLUTION_ERROR": given["error"].isNotNull()}),
        F.transform(signals, lambda s: F.concat(F.lit("LOOKALIKE:"), s)),
        listed({"UNKNOWN_REGISTRATION_DOMAIN": relation == "UNKNOWN_DOMAIN", "THREAT_REPUTATION_HIT": threat, "EVENT_IDENTITY_MISMATCH": no_match}),
    )
    step = lambda c, n: F.when(c, n).otherwise(0)
    confidence = clamp(
        50 + F.when(https, 10).otherwise(-25) + F.when(own, 25).when(platform, 15).when(relation == "EXTERNAL_REGISTRATION_PROVIDER", 5).otherwise(-25)
        + step(linked, 20) + step(match, 5) - step(no_match, 20) - step(link["is_short_url"], 10) - step(hops >= 4, 20) - step(F.size(signals) > 0, 30) - step(threat, 60),
        0, 100,
    )
    unsafe = threat | F.array_contains(signals, "PUNYCODE")

    def outcome(sure: Column) -> Column:
        approved = (sure >= 70) & (linked | own | (platform & match))
        weak = (sure < 35) | (~https & (relation == "UNKNOWN_DOMAIN"))
        named = F.when(unsafe, F.struct(F.lit("REJECT").alias("outcome"), F.lit("SECURITY_REPUTATION_OR_IMPERSONATION").alias("reason")))
        for c, verdict, reason in ((approved, "APPROVE", "OFFICIALLY_REFERENCED_OR_TRUSTED_DESTINATION"), (weak, "REJECT", "LOW_CONFIDENCE_OR_INSECURE_UNKNOWN"), (F.lit(True), "REVIEW", "NEEDS_REVIEW")):
            named = named.when(c, F.struct(F.lit(verdict).alias("outcome"), F.lit(reason).alias("reason")))
        return F.struct(
            link["canonical"].alias("canonical_url"), final["url"].alias("final_url"), final["host"].alias("host"), https.alias("is_https"), hops.alias("redirects"), relation.alias("relationship"),
            about["related"]["category"].alias("category"), signals.alias("lookalikes"), flags.alias("flags"), sure.alias("confidence"), named["outcome"].alias("outcome"), named["reason"].alias("reason"),
        )

    text = F.lit(None).cast("string")
    bad = F.struct(
        link["canonical"].alias("canonical_url"), text.alias("final_url"), link["host"].alias("host"), F.lit(False).alias("is_https"), F.lit(0).alias("redirects"), text.alias("relationship"), text.alias("category"),
        F.array().cast("array<string>").alias("lookalikes"), F.array(F.lit("UNPARSABLE_URL")).alias("flags"), F.lit(0).alias("confidence"), F.lit("REJECT").alias("outcome"), F.coalesce(link["reason"], F.lit("UNPARSABLE_URL")).alias("reason"),
    )
    return F.when(link["valid"], let(confidence, outcome)).otherwise(bad)


def flag_severity(flag: Column) -> Column:
    return F.when(flag.rlike("THREAT|PUNYCODE"), "critical").when(flag.rlike("LOOKALIKE|UNKNOWN_REGISTRATION"), "warning").otherwise("info")


def next_status(decision: Column, tier: Column, gate_passed: Column, old_status: Column, url_changed: Column, flags: Column, threat: Column) -> Column:
    """The status after a verification: changed registration links show as UPDATED, and verified or published events
    without any new finding against them keep theirs."""
    fresh = F.when(decision == "REJECTED", "REJECTED").when((decision == "SUSPICIOUS") | (tier == "E"), "SUSPICIOUS").when(tier.isin("A", "B") & gate_passed, "VERIFIED").otherwise("NEEDS_REVIEW")
    published = old_status.isin("VERIFIED", "PUBLISHED")
    keeps = published & (fresh == "NEEDS_REVIEW") & (F.size(flags) == 0) & ~threat
    return F.when((published | (old_status == "UPDATED")) & (fresh == "VERIFIED") & url_changed, "UPDATED").when(keeps, old_status).otherwise(fresh)


def region_relevance(country: Column, city: Column, organizer_domain: Column, mentions: Column, currency: Column, timezone: Column, online: Column) -> Column:
    """struct(score, indian, reasons)."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    named = {
        "COUNTRY_INDIA": (low(country).isin("in", "india"), 35), "INDIAN_CITY": (low(city).isin(list(INDIAN_CITIES)), 25),
        "INDIAN_ORGANIZER_DOMAIN": (low(organizer_domain).endswith(".in"), 20),
        "INDIAN_ACADEMIC_OR_GOV_DOMAIN": (low(organizer_domain).rlike(r"\.(ac|edu|gov|nic)\.in$"), 15),
        "INDIA_MENTIONED": (low(mentions).rlike("india|bharat"), 10), "INR_PRIZE": (low(currency).rlike(r"\x{20B9}|inr|rs\.?\s?[0-9]|lakh"), 5),
        "IST_TIMEZONE": (low(timezone) == "asia/kolkata", 5), "ONLINE_FROM_INDIA": (F.coalesce(online, F.lit(False)), 5),
    }
    score = F.least(sum((F.when(c, n).otherwise(0) for c, n in named.values()), F.lit(0)), F.lit(100))
    return F.struct(score.cast("int").alias("score"), (score >= 30).alias("indian"), listed({k: c for k, (c, _) in named.items()}).alias("reasons"))


def trust_step(trust: Column, outcome: Column) -> Column:
    """Trust after one outcome: a valid event counts less from 90 on; 0 to 100."""
    base = clamp(trust, 0, 100)
    change = F.when((outcome == "valid") & (base >= 90), 1)
    for name, step in TRUST_STEPS.items():
        change = change.when(outcome == name, step)
    return clamp(base + change.otherwise(0), 0, 100)


def field_diffs(before: dict[str, Column], after: dict[str, Column]) -> Column:
    """array of struct(field, old, new) of the fields that differ, nulls being equal."""
    rows = [F.when(~before[f].eqNullSafe(after[f]), F.struct(F.lit(f).alias("field"), before[f].cast("string").alias("old"), after[f].cast("string").alias("new"))) for f in before]
    return F.array_compact(F.array(*rows))


def tracked_diffs(before: Column, after: Column) -> Column:
    """`field_diffs` of two structs over the fields whose changes are recorded."""
    return field_diffs({f: before[f] for f in TRACKED_FIELDS}, {f: after[f] for f in TRACKED_FIELDS})


def resolve_conflict(old: Column, new: Column, first_party: Column) -> Column:
    """struct(value, needs_review) of a field seen anew: an official source wins, others need a person."""
    unclear = old.isNotNull() & new.isNotNull() & (old != new) & ~first_party
    return F.struct(F.when(unclear, old).otherwise(F.coalesce(new, old)).alias("value"), F.coalesce(unclear, F.lit(False)).alias("needs_review"))


def verification_label(decision: Column) -> Column:
    return (
        F.when(decision == "VERIFIED_OFFICIAL", "✅ Official organizer source confirmed").when(decision == "VERIFIED_BY_MULTIPLE_SOURCES", "✅ Confirmed by multiple independent sources")
        .when(decision == "LIKELY_LEGITIMATE", "⚠️ Likely legitimate — review evidence before registering").when(decision == "SUSPICIOUS", "⛔ Suspicious — do not register")
        .when(decision == "REJECTED", "⛔ Rejected").otherwise("❓ Unverified — registration link could not be independently verified")
    )


def _lines(*parts: Column) -> Column:
    return F.array_join(F.array_compact(F.array(*parts)), "\n")


def _line(head: str, c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(head), c))


def event_alert(title: Column, organizer: Column, form: Column, city: Column, start: Column, deadline: Column, page: Column, registration: Column, label: Column) -> Column:
    """The text of an alert; callers pass only events that may be published."""
    return _lines(
        F.concat(F.lit("\U0001F680 "), title), F.lit(""), F.concat(F.lit("\U0001F3E2 Organizer: "), F.coalesce(organizer, F.lit("Unknown"))),
        F.concat(F.lit("\U0001F4CD "), form, F.coalesce(_line(" · ", city), F.lit(""))), _line("\U0001F4C5 Event date: ", start), _line("⏰ Registration deadline: ", deadline),
        F.coalesce(_line("\U0001F517 Official event page: ", page), F.lit("\U0001F517 Source: see evidence trail")),
        F.concat(F.lit("\U0001F4DD Registration: "), F.coalesce(registration, F.lit("Registration link could not be independently verified."))), F.concat(F.lit("\U0001F50E Verification: "), label),
    )


def correction(title: Column, note: Column, page: Column) -> Column:
    return _lines(F.concat(F.lit("⚠️ EVENT UPDATE: "), title), F.lit(""), note, _line("Official event page: ", page))
