"""What several sources say about one event, and how it changes: conflicts, values that may be shown, kinds of change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fields that sources are compared in, and the name of a conflict in each.
COMPARED = {
    "title": "TITLE", "organizer_name": "ORGANIZER", "start_date": "START_DATE", "end_date": "END_DATE", "registration_deadline": "DEADLINE", "venue": "LOCATION", "format": "FORMAT",
    "prize": "PRIZE", "eligibility": "ELIGIBILITY", "team_size": "TEAM_SIZE", "registration_url": "REGISTRATION_URL",
}
#: Fields whose changes are told, and the kind of change.
CHANGES = {
    "start_date": "DATE_CHANGED", "end_date": "DATE_CHANGED", "registration_deadline": "DEADLINE_CHANGED", "venue": "VENUE_CHANGED", "prize": "PRIZE_CHANGED", "eligibility": "ELIGIBILITY_CHANGED",
    "team_size": "TEAM_SIZE_CHANGED", "registration_url": "NEW_REGISTRATION_URL", "organizer_name": "ORGANIZER_CHANGED",
}
#: Values that are a change of their own when they come.
CLOSED, ENDED = "CLOSED", {"CANCELLED": "CANCELLATION", "POSTPONED": "POSTPONEMENT"}
OFFICIAL_LEVEL = 3


def consistency(observations: DataFrame, order: list[str], fields: dict[str, str] = COMPARED) -> DataFrame:
    """event_id, conflicts, unresolved and, for each field, the value that may be shown.

    observations: event_id, source_level, the fields and the columns of order, by which one is newer than another. Values
    differ where the least and the greatest do, which is combined before the shuffle. The newest official value stands
    (levels up to OFFICIAL_LEVEL); without one a value stands if all agree, and a conflict is unresolved."""
    official = F.col("source_level") <= OFFICIAL_LEVEL
    text = lambda f: F.col(f).cast("string")
    given = lambda f: F.when(official & F.col(f).isNotNull(), F.struct(*order))
    spread = [agg for f in fields for agg in (F.min(text(f)).alias(f"_least_{f}"), F.max(text(f)).alias(f"_most_{f}"), F.max_by(text(f), given(f)).alias(f"_own_{f}"))]
    told = observations.groupBy("event_id").agg(*spread)
    differ = lambda f: F.coalesce(F.col(f"_least_{f}") != F.col(f"_most_{f}"), F.lit(False))
    named = lambda c: F.array_compact(F.array(*(F.when(c(f), F.lit(f"{n}_CONFLICT")) for f, n in fields.items())))
    values = [F.coalesce(f"_own_{f}", F.when(~differ(f), F.col(f"_least_{f}"))).alias(f) for f in fields]
    return told.select("event_id", named(differ).alias("conflicts"), named(lambda f: differ(f) & F.col(f"_own_{f}").isNull()).alias("unresolved"), *values)


def changes(observations: DataFrame, order: list[str]) -> DataFrame:
    """event_id, the order's columns, kind, field, old_value and new_value of every change from one observation of an event
    to the next. observations: event_id, the fields of CHANGES, registration_status, status. A value that was not seen
    is no change."""
    fields = [*CHANGES, "registration_status", "status"]
    before = Window.partitionBy("event_id").orderBy(*order)
    now = F.struct(*(F.col(f).cast("string").alias(f) for f in fields))
    both = observations.select("event_id", *order, now.alias("_now")).withColumn("_old", F.lag("_now").over(before)).where("_old is not null")

    def entry(field: str, kind: Column, when: Column) -> Column:
        old, new = F.col("_old")[field], F.col("_now")[field]
        return F.when(old.isNotNull() & new.isNotNull() & (old != new) & when, F.struct(kind.alias("kind"), F.lit(field).alias("field"), old.alias("old_value"), new.alias("new_value")))

    found = [entry(f, F.lit(k), F.lit(True)) for f, k in CHANGES.items()]
    found.append(entry("registration_status", F.lit("REGISTRATION_CLOSED"), F.col("_now")["registration_status"] == CLOSED))
    ended = F.col("_now")["status"]
    kind = F.lit(None).cast("string")
    for status, name in ENDED.items():
        kind = F.when(ended == status, name).otherwise(kind)
    found.append(entry("status", kind, ended.isin(*ENDED)))
    return both.select("event_id", *order, F.explode(F.array_compact(F.array(*found))).alias("_c")).select("event_id", *order, "_c.*")
