"""A queue whose work is tried again: leases, attempts, back-off and dead letters as transitions of a snapshot.

An entry is QUEUED until it is due, LEASED by a worker for a while, and ends DONE or DEAD. A worker that is lost gives
nothing back: its lease runs out and the entry is due again, with the attempt counted. Results of a lease that ran out and
was given to another worker change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustmill.session import dealt

QUEUE = "id long, queue string, payload string, status string, attempts int, due_at timestamp, lease string, leased_until timestamp, error string"
MOST_ATTEMPTS, FIRST_WAIT_S, LONGEST_WAIT_S, LEASE_S = 5, 60, 6 * 3600, 900


def _later(at: Column, seconds: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(at.cast("timestamp")) + (seconds * 1_000_000).cast("long"))


def due(queue: DataFrame, now: Column) -> Column:
    """Entries that may be leased: queued ones whose time has come, and those whose lease ran out."""
    waiting = (F.col("status") == "QUEUED") & (F.coalesce("due_at", now) <= now)
    return waiting | ((F.col("status") == "LEASED") & (F.col("leased_until") <= now))


def lease(queue: DataFrame, worker: str, now: Column, budget: int | None = None, seconds: int = LEASE_S, most: int = MOST_ATTEMPTS) -> dict[str, DataFrame]:
    """queue (the next state), leased and dead_letters. With a budget the entries that have been due longest are leased.
    Each lease counts as an attempt; an entry whose last lease ran out is dead. Only a budget needs a join: all else is
    told by an entry's own row."""
    open_ = F.coalesce(due(queue, now), F.lit(False))
    ready = open_ & (F.col("attempts") < most)
    marked = queue.withColumn("_spent", open_ & (F.col("attempts") >= most))
    if budget is None:
        marked = marked.withColumn("_chosen", ready)
    else:
        chosen = queue.where(ready).orderBy(F.asc_nulls_first("due_at"), "id").limit(budget).select("id").withColumn("_chosen", F.lit(True))
        marked = marked.join(chosen, "id", "left")
    dead, taken = F.coalesce("_spent", F.lit(False)), F.coalesce("_chosen", F.lit(False))
    after = marked.withColumns(
        {
            "status": F.when(dead, "DEAD").when(taken, "LEASED").otherwise(F.col("status")), "attempts": F.when(taken, F.col("attempts") + 1).otherwise(F.col("attempts")),
            "lease": F.when(taken, worker).when(~dead, F.col("lease")), "leased_until": F.when(taken, _later(now, F.lit(seconds))).when(~dead, F.col("leased_until")),
            "error": F.when(dead, F.coalesce("error", F.lit("LEASE_EXPIRED"))).otherwise(F.col("error")),
        }
    )
    state = after.select(*queue.columns)
    return {"queue": state, "leased": after.where("_chosen").select(*queue.columns), "dead_letters": letters(after.where("_spent"))}


def settle(queue: DataFrame, results: DataFrame, worker: str, now: Column, most: int = MOST_ATTEMPTS, first_wait: int = FIRST_WAIT_S, longest_wait: int = LONGEST_WAIT_S) -> dict[str, DataFrame]:
    """queue and dead_letters after a worker's results. results: id, ok, retryable, error; optional retry_after_s.

    What failed and can be tried again is due after first_wait seconds, twice as long after each further attempt, at most
    longest_wait and at least as long as was asked for; after the last attempt, or if it cannot be tried again, it is dead.
    """
    asked = F.col("retry_after_s") if "retry_after_s" in results.columns else F.lit(0)
    told = results.select("id", F.col("ok").alias("_ok"), F.col("retryable").alias("_retryable"), F.left("error", F.lit(500)).alias("_error"), F.coalesce(asked, F.lit(0)).alias("_asked"))
    entries, told = dealt(queue, told, "id", queue.count())
    marked = entries.join(told, "id", "left")
    held = F.coalesce((F.col("status") == "LEASED") & (F.col("lease") == worker) & F.col("_ok").isNotNull(), F.lit(False))
    again = held & ~F.col("_ok") & F.coalesce("_retryable", F.lit(False)) & (F.col("attempts") < most)
    dead = held & ~F.col("_ok") & ~again
    wait = F.greatest(F.least(F.lit(float(first_wait)) * F.pow(F.lit(2.0), F.col("attempts") - 1), F.lit(float(longest_wait))), F.col("_asked").cast("double"))
    after = marked.withColumn("_dead", dead).withColumns(
        {
            "status": F.when(held & F.col("_ok"), "DONE").when(again, "QUEUED").when(dead, "DEAD").otherwise(F.col("status")), "due_at": F.when(again, _later(now, wait)).otherwise(F.col("due_at")),
            "lease": F.when(~held, F.col("lease")), "leased_until": F.when(~held, F.col("leased_until")), "error": F.when(held, F.col("_error")).otherwise(F.col("error")),
        }
    )
    return {"queue": after.select(*queue.columns), "dead_letters": letters(after.where("_dead"))}


def letters(dead: DataFrame) -> DataFrame:
    return dead.select("queue", "payload", "error", "attempts")
