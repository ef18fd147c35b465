"""Alerts, corrections and reminders: who is due what, without sending anything twice."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustmill.functions.dates import due_reminders
from trustmill.functions.matching import wanted


def latest(rows: DataFrame, key: list[str], order: Column, *values: str) -> DataFrame:
    """The values of each key's last row; combined before the shuffle."""
    return rows.groupBy(*key).agg(F.max_by(F.struct(*values), order).alias("_last")).select(*key, "_last.*")


#: Parts into which the events are dealt that meet targets without a filter.
PARTS = 64


def subscriptions(events: DataFrame, targets: DataFrame) -> DataFrame:
    """Events and the targets whose filter lets them through. targets: target_id, filter.

    A filter's lists become rows of (category, city) values, which meet the events in equi-joins; dimensions are joined by
    and, values by or, and an empty list lets nothing through. Targets without any list take every event, which is as many
    rows as they are owed: they are repeated for each of PARTS parts of the events and meet these part by part.
    """
    asked = targets.select("target_id", wanted(F.col("filter")).alias("_w"))
    both = F.col("_w.categories").isNotNull(), F.col("_w.cities").isNotNull()
    rows = lambda where, **values: asked.where(where).select("target_id", *(c.alias(k) for k, c in values.items()))
    category, city = F.explode("_w.categories"), F.explode("_w.cities")
    by_category, by_city = rows(both[0] & ~both[1], category=category), rows(~both[0] & both[1], city=city)
    by_both = rows(both[0] & both[1], category=category, _cities=F.col("_w.cities")).select("target_id", "category", F.explode("_cities").alias("city"))
    part = F.pmod(F.xxhash64(*(F.col(c) for c in events.columns)), F.lit(PARTS)).cast("int")
    every = rows(~both[0] & ~both[1], _part=F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    found = [events.join(by_category, "category"), events.join(by_city, "city"), events.join(by_both, ["category", "city"]), events.withColumn("_part", part).join(every, "_part")]
    return reduce(DataFrame.unionByName, (f.select(*events.columns, "target_id") for f in found))


def queue_alerts(events: DataFrame, targets: DataFrame, notifications: DataFrame) -> DataFrame:
    """event_id, target_id, template to queue: ALERT unless one is queued or sent, CORRECTION for updated events whose last
    message was sent and was none."""
    open_ = events.where(F.col("status").isin("VERIFIED", "UPDATED") & F.col("publishing_tier").isin("A", "B"))
    last = latest(notifications, ["event_id", "target_id"], F.col("notification_id"), "status", "template").withColumnsRenamed({"status": "last_status", "template": "last_template"})
    due = subscriptions(open_, targets).join(last, ["event_id", "target_id"], "left")
    template = F.when(F.col("last_status") == "SENT", F.when((F.col("status") == "UPDATED") & (F.col("last_template") != "CORRECTION"), "CORRECTION")).when(F.coalesce("last_status", F.lit("")) != "QUEUED", "ALERT")
    return due.select("event_id", "target_id", template.alias("template")).where("template is not null")


def queue_reminders(events: DataFrame, targets: DataFrame, notifications: DataFrame, now: Column) -> DataFrame:
    """event_id, target_id, template of reminders that are due and were never queued."""
    due = events.where(F.col("status").isin("VERIFIED", "PUBLISHED", "UPDATED")).withColumn("template", F.explode(due_reminders(F.col("registration_deadline"), F.col("start_date"), now)))
    wanted = subscriptions(due, targets).select("event_id", "target_id", "template")
    return wanted.join(notifications.select("event_id", "target_id", "template"), ["event_id", "target_id", "template"], "left_anti")


def dispatch(queue: DataFrame, events: DataFrame, targets: DataFrame, results: DataFrame) -> DataFrame:
    """Queued notifications after a round of sending. events: event_id, gate_passed, status; results: notification_id,
    ok, retryable, error (what the channels answered)."""
    known = queue.join(targets.select("target_id", F.lit(True).alias("_target")), "target_id", "left").join(events.select("event_id", "gate_passed"), "event_id", "left").join(results, "notification_id", "left")
    missing = F.col("_target").isNull() | F.col("gate_passed").isNull()
    status = F.when(missing, "FAILED").when(~F.col("gate_passed"), "SUPPRESSED").when(F.col("ok"), "SENT").when(F.coalesce("retryable", F.lit(False)), "QUEUED").otherwise("FAILED")
    error = F.when(missing, "UNKNOWN_TARGET_OR_EVENT").when(F.col("gate_passed") & ~F.coalesce("ok", F.lit(False)), F.left(F.coalesce("error", F.lit("NO_RESULT")), F.lit(200)))
    return known.select("notification_id", "event_id", "target_id", "template", status.alias("status"), error.alias("error"))


def status_after_sending(events: DataFrame, sent: DataFrame) -> DataFrame:
    """events with status: updated events about which a message was sent are VERIFIED again. sent: the result of
    `dispatch`."""
    told = sent.where("status = 'SENT'").select("event_id", F.lit(True).alias("_told")).distinct()
    return events.join(told, "event_id", "left").withColumn("status", F.when(F.coalesce("_told", F.lit(False)) & (F.col("status") == "UPDATED"), "VERIFIED").otherwise(F.col("status"))).select(*events.columns)
