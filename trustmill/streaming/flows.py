"""Streams: trust as running state, event-time windows, and the micro-batch loop."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from trustmill.config import TRUST_STEPS
from trustmill.operators import state
from trustmill.operators.state import Tables

START_TRUST = 50


class TrustState(StatefulProcessor):
    """One trust value a source. Rows of a batch are applied in the order of observation, for which a source's rows of one
    batch are held in one task; `trust_loop` folds sources with very many rows a batch in parts."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.trust = handle.getValueState("trust", "trust int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        trust = self.trust.get()[0] if self.trust.exists() else START_TRUST
        seen = sorted((r.observed_at, r.seq, r.outcome) for batch in rows for r in batch.itertuples())
        for _, _, outcome in seen:
            step = TRUST_STEPS.get(outcome, 0)
            trust = max(0, min(100, trust + (1 if step > 0 and trust >= 90 else step)))
        self.trust.update((trust,))
        yield pd.DataFrame({"source_id": [key[0]], "trust": pd.array([trust], dtype="int32"), "steps": pd.array([len(seen)], dtype="int32")})

    def close(self) -> None:
        pass


def trust_stream(outcomes: DataFrame) -> DataFrame:
    """source_id, trust, steps after each batch. outcomes (a stream): source_id long, observed_at, seq, outcome.

    The session needs the RocksDB state store (trustmill.session sets it).
    """
    return outcomes.groupBy("source_id").transformWithStateInPandas(TrustState(), "source_id long, trust int, steps int", "update", "None")


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by type in tumbling windows; rows later than the watermark are left out once a window is closed."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "10 minutes") -> DataFrame:
    counted = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("user_id", F.col("s.start").alias("session_start"), "n")


def first_sightings(items: DataFrame, late: str = "1 day") -> DataFrame:
    """Each dedupe_key once within the watermark, as idempotent delivery needs it."""
    return items.withWatermark("observed_at", late).dropDuplicatesWithinWatermark(["dedupe_key"])


Stage = tuple[str, Callable[[DataFrame, int], None]]


def run_stages(stages: list[Stage], batch: DataFrame, epoch: int) -> dict[str, str]:
    """Runs the stages on a batch one after another. A stage that fails does not keep the others from running; its error
    is in the report."""
    batch.persist()
    report = {}
    try:
        for name, stage in stages:
            try:
                stage(batch, epoch)
                report[name] = "OK"
            except Exception as e:  # a stage's failure is a result of the loop, which reports it
                report[name] = f"FAILED: {str(e).splitlines()[0][:300]}"
    finally:
        batch.unpersist()
    return report


def start_loop(items: DataFrame, stages: list[Stage], checkpoint: str, report: Callable[[int, dict[str, str]], None], every: str | None = None) -> StreamingQuery:
    """The loop over what has arrived: once with all that is there, or again every so often."""
    writer = items.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, epoch: report(epoch, run_stages(stages, df, epoch)))
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def flow_loop(rows: DataFrame, folder: str, name: str, step: Callable[[Tables, DataFrame], Tables], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """A flow on what has arrived, each micro-batch one commit of all tables that it changes. The batch's number goes with
    the commit, so a batch that is run again after a crash changes nothing."""

    def each(batch: DataFrame, epoch: int) -> None:
        state.flow(batch.sparkSession, folder, name, epoch, lambda tables: step(tables, batch))

    writer = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def trust_loop(outcomes: DataFrame, folder: str, now: Column, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Registry and reputation of a store after each micro-batch of outcomes (source_id, outcome, seq, in order of seq)."""
    return flow_loop(outcomes, folder, "trust", lambda tables, batch: state.learned(tables, batch, now), checkpoint, every)
