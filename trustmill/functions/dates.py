"""Lenient dates, ages, freshness, staleness and reminders as column expressions. The clock is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trustmill.config import GRACE_HOURS
from trustmill.functions.text import trimmed

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def parse_date(text: Column) -> Column:
    """A timestamp from ISO 8601 or mail dates, null if it is neither. No zone means UTC."""
    own = trimmed(text)
    mail = F.regexp_replace(F.regexp_replace(own, r"^[A-Za-z]{3,9},?\s+", ""), r"\s+(GMT|UT|UTC|Z)$", " +0000")
    attempts = [F.try_to_timestamp(mail, F.lit(f)) for f in ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z", "d MMM yyyy HH:mm:ss", "d MMM yyyy")]
    return F.when(own.rlike(r"^\d{4}-\d{2}"), F.try_to_timestamp(own)).otherwise(F.coalesce(*attempts))


def iso(ts: Column) -> Column:
    return F.date_format(ts, ISO)


def micros(ts: Column) -> Column:
    """Microseconds since 1970; timestamps without a zone are UTC."""
    return F.unix_micros(ts.cast("timestamp"))


def age_hours(ts: Column, now: Column) -> Column:
    """Hours since then, fractions kept, at least 0."""
    return F.when(ts.isNotNull(), F.greatest((micros(now) - micros(ts)) / 3.6e9, F.lit(0.0)))


def freshness(first_seen: Column, last_seen: Column, last_verified: Column, now: Column) -> Column:
    seen, verified = age_hours(F.coalesce(last_seen.cast("timestamp"), first_seen.cast("timestamp")), now), age_hours(last_verified, now)
    unverified = F.when(seen <= 24, 40).when(seen <= 72, 25).when(seen <= 168, 10).otherwise(0)
    late = lambda c, h, n: F.when(c > h, n).otherwise(0)
    score = 100 - late(verified, 24, 20) - late(verified, 72, 25) - late(verified, 168, 30) - late(seen, 168, 15)
    return F.when(verified.isNull(), unverified).otherwise(F.greatest(score, F.lit(0))).cast("int")


def stale_reason(status: Column, end_date: Column, deadline: Column, now: Column) -> Column:
    """PAST_END_DATE or PAST_DEADLINE once the grace is over, null else and for events that ended their way already."""
    past = lambda ts: (micros(now) - micros(ts)) > GRACE_HOURS * 3_600_000_000
    open_ = F.coalesce(~status.isin("EXPIRED", "CANCELLED", "REJECTED"), F.lit(True))
    return F.when(open_ & past(end_date), "PAST_END_DATE").when(open_ & past(deadline), "PAST_DEADLINE")


def due_reminders(deadline: Column, start: Column, now: Column) -> Column:
    """The reminders due: one of the two before the deadline, and one before the start."""
    hours = lambda ts: (micros(ts) - micros(now)) / 3.6e9
    to_deadline, to_start = hours(deadline), hours(start)
    first = F.when((to_deadline > 0) & (to_deadline < 24), "REMINDER_24").when((to_deadline >= 24) & (to_deadline < 48), "REMINDER_48")
    return F.array_compact(F.array(first, F.when((to_start > 0) & (to_start < 72), F.lit("REMINDER_START"))))
