"""Link health and run gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustmill.functions.dates import micros
from trustmill.functions.domains import domain_relationship
from trustmill.functions.urls import host_of
from trustmill.session import dealt, stored

MIN_INTERVAL_MS = 60_000


def recheck_outcome(old_final_url: Column, known_host: Column, new_final_url: Column, failed: Column) -> Column:
    """error (to be tried again), unreachable, host_changed or unchanged."""
    return _outcome(_host(old_final_url, known_host), host_of(new_final_url), new_final_url, failed)


def _outcome(before: Column, after: Column, new_final_url: Column, failed: Column) -> Column:
    return F.when(failed, "error").when(new_final_url.isNull(), "unreachable").when(before != after, "host_changed").otherwise("unchanged")


def _host(final_url: Column, known_host: Column) -> Column:
    return F.when(final_url.isNotNull(), host_of(final_url)).otherwise(known_host)


#: Reasons and notes as they are shown.
CHANGED_HOST = "LINK_REVIEW_REQUIRED: advertised link now resolves to a different host"
UNVERIFIED_NOTE = "Registration link changed destination and requires re-verification."


def recheck(links: DataFrame, resolved: DataFrame, now: Column, events: DataFrame | None = None) -> dict[str, DataFrame]:
    """The outputs of a round of rechecks: links (new state), checks, flags, changes, reviews and, given events, events.

    links: link_id, event_id, url_type, final_url, domain, last_checked; optional verification_status, security_status,
    redirect_count, redirect_chain, domain_relationship; resolved: link_id, new_url, status, error, failed, for the links
    that were due; optional chain, the hops (url, status). events: event_id, status, registration_url,
    registration_unverified_note.

    A link that now leads to another host is flagged and waits for a review; if it is the registration, the event no
    longer advertises it, and a verified or published event waits for a review too. A link that leads nowhere is
    unreachable and keeps its address. Errors of the check itself leave the link as it is, to be tried again.
    """
    have, told = set(links.columns), set(resolved.columns)
    old = lambda c, kind: F.col(c) if c in have else F.lit(None).cast(kind)
    # hosts are taken out of each side's own rows, before the join
    before = links.withColumn("_before", _host(F.col("final_url"), F.col("domain")))
    asked, answers = dealt(before, resolved.withColumn("_after", host_of(F.col("new_url"))), "link_id", links.count())
    met = asked.join(answers, "link_id").withColumn("outcome", _outcome(F.col("_before"), F.col("_after"), F.col("new_url"), F.col("failed")))
    # joined and told once, for six outputs
    due = stored(met, "rechecked")
    changed, gone = due.where("outcome = 'host_changed'"), due.where("outcome = 'unreachable'")
    moved, dead, ok = F.col("outcome") == "host_changed", F.col("outcome") == "unreachable", F.col("outcome").isin("host_changed", "unchanged")
    chain = F.col("chain") if "chain" in told else F.lit(None).cast("array<struct<url:string,status:int>>")
    host = F.col("_after")
    relationship = domain_relationship(host, F.lit(None).cast("string"))["relationship"]
    state = due.select(
        "link_id", "event_id", "url_type", F.when(ok, F.col("new_url")).otherwise(F.col("final_url")).alias("final_url"), F.when(ok, host).otherwise(F.col("domain")).alias("domain"),
        F.when(F.col("outcome") == "error", F.col("last_checked")).otherwise(now).alias("last_checked"),
        F.when(moved | dead, "REVIEW").otherwise(old("verification_status", "string")).alias("verification_status"), F.when(moved, "FLAGGED").when(dead, "UNREACHABLE").otherwise(old("security_status", "string")).alias("security_status"),
        F.when(ok & chain.isNotNull(), F.greatest(F.size(chain) - 1, F.lit(0))).otherwise(old("redirect_count", "int")).alias("redirect_count"), F.when(ok, F.coalesce(chain, old("redirect_chain", "array<struct<url:string,status:int>>"))).otherwise(old("redirect_chain", "array<struct<url:string,status:int>>")).alias("redirect_chain"),
        F.when(ok, relationship).otherwise(old("domain_relationship", "string")).alias("domain_relationship"),
    )
    field = F.when(F.col("url_type") == "REGISTRATION", "registration_url").otherwise("event_url")
    cause = F.coalesce("error", F.lit("UNRESOLVABLE"))
    failure = F.when(F.col("outcome") == "unreachable", cause).when(F.col("outcome") == "error", F.coalesce("error", F.lit("RECHECK_FAILED"))).otherwise(F.col("error"))
    out = {
        "links": state,
        # an unreachable link is checked against the address that it had
        "checks": due.select("link_id", now.alias("checked_at"), F.when(ok, F.col("status")).alias("status"), F.when(dead, F.col("final_url")).when(ok, F.col("new_url")).alias("final_url"), failure.alias("error")),
        "flags": changed.select("event_id", "link_id", F.lit("HOST_CHANGED").alias("flag_type"), F.lit("warning").alias("severity"), F.concat("_before", F.lit(" -> "), host).alias("details")),
        "changes": changed.select("event_id", field.alias("field"), F.col("final_url").alias("old_value"), F.col("new_url").alias("new_value"), now.alias("detected_at")),
        "reviews": changed.select("event_id", F.lit(CHANGED_HOST).alias("reason")).unionByName(gone.select("event_id", F.concat(F.lit("LINK_REVIEW_REQUIRED: link unresolvable ("), cause, F.lit(")")).alias("reason"))),
    }
    if events is not None:
        hit = changed.where("url_type = 'REGISTRATION'").select("event_id", F.lit(True).alias("_moved")).distinct()
        no_longer = F.coalesce("_moved", F.lit(False))
        values = {
            "registration_url": F.when(~no_longer, F.col("registration_url")), "registration_unverified_note": F.when(no_longer, UNVERIFIED_NOTE).otherwise(F.col("registration_unverified_note")),
            "status": F.when(no_longer & F.col("status").isin("VERIFIED", "PUBLISHED"), "NEEDS_REVIEW").otherwise(F.col("status")),
        }
        held, hit = dealt(events, hit, "event_id", events.count())
        out["events"] = held.join(hit, "event_id", "left").withColumns(values).select(*events.columns)
    return out


def run_gate(enabled: Column, last_run: Column, interval_ms: Column, now: Column) -> Column:
    """DISABLED, RATE_LIMITED or RUN."""
    waited = (micros(now) - micros(last_run)) / 1000
    return F.when(~enabled, "DISABLED").when(waited < F.greatest(interval_ms, F.lit(MIN_INTERVAL_MS)), "RATE_LIMITED").otherwise("RUN")
