"""Clustering of a stream of sightings: the first of a key is a new event, late ones attach to it in any later batch.

State is one value a key, the event's id, when it was first and last seen, and the sightings so far; it begins with the
snapshot of known events. Rows of a key pass by in Arrow batches and are given out as they come, so a key with very many
rows takes no more memory than others. A micro-batch that is run again gives the same rows: ids come from the key, and
which of a batch's rows was the first is decided by source and number, not by the order of arrival in the batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: One row a sighting (kind ITEM), and for each key and batch a row (kind EVENT) with what became of its event.
OUT = (
    "kind string, dedupe_key string, event_id string, is_new boolean, source_id string, seq long, source_url string, observed_at timestamp, first_seen timestamp, last_seen timestamp, sightings long"
)
COLUMNS = [c.split()[0] for c in OUT.split(", ")]


def event_id(key: str) -> str:
    """As operators.discovery.event_id."""
    return "evt_" + hashlib.sha256(key.encode()).hexdigest()[:20]


class Sightings(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.event = handle.getValueState("event", "event_id string, first_seen timestamp, last_seen timestamp, sightings long")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        known = initialState.iloc[0]
        self.event.update((known.event_id, known.first_seen.to_pydatetime(), known.last_seen.to_pydatetime(), 0))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        is_new = not self.event.exists()
        known, first_seen, last_seen, before = (event_id(key[0]), None, None, 0) if is_new else self.event.get()
        least, n = None, 0
        for batch in rows:
            n += len(batch)
            seen = batch["observed_at"]
            first_seen = min(x for x in (first_seen, seen.min().to_pydatetime()) if x is not None)
            last_seen = max(x for x in (last_seen, seen.max().to_pydatetime()) if x is not None)
            own = batch.sort_values(["source_id", "seq"]).iloc[0]
            least = min(x for x in (least, (own.source_id, int(own.seq), own.source_url)) if x is not None)
            yield self._rows(batch, kind="ITEM", dedupe_key=key[0], event_id=known, is_new=is_new, first_seen=None, last_seen=None, sightings=None)
        self.event.update((known, first_seen, last_seen, before + n))
        one = pd.DataFrame({"source_id": [least[0]], "seq": [least[1]], "source_url": [least[2]], "observed_at": [last_seen]})
        yield self._rows(one, kind="EVENT", dedupe_key=key[0], event_id=known, is_new=is_new, first_seen=first_seen, last_seen=last_seen, sightings=before + n)

    def _rows(self, batch: pd.DataFrame, **values) -> pd.DataFrame:
        out = batch[["source_id", "seq", "source_url", "observed_at"]].assign(**values)[COLUMNS]
        return out.astype({"first_seen": "datetime64[us]", "last_seen": "datetime64[us]", "observed_at": "datetime64[us]", "sightings": "Int64"})

    def close(self) -> None:
        pass


def sightings(items: DataFrame, known: DataFrame) -> DataFrame:
    """OUT rows of a stream of items (dedupe_key, source_id, seq, source_url, observed_at), clustered onto the known events
    (dedupe_key, event_id, first_seen, last_seen) and all that the stream has shown. The session needs the RocksDB state
    store. Rows without a key are left out, as titleless items are."""
    initial = known.groupBy("dedupe_key").agg(F.min("event_id").alias("event_id"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")).where("dedupe_key is not null")
    rows = items.where("dedupe_key is not null").select("dedupe_key", "source_id", "seq", "source_url", "observed_at")
    return rows.groupBy("dedupe_key").transformWithStateInPandas(Sightings(), OUT, "update", "None", initialState=initial.groupBy("dedupe_key"))


def actions(out: DataFrame) -> dict[str, DataFrame]:
    """What a batch of OUT rows means: items with action, new events, and the events seen again with last_seen."""
    events = out.where("kind = 'EVENT'")
    # one row a key, with the batch's first sighting
    first = events.select("dedupe_key", F.struct("source_id", "seq").alias("_first"))
    items = out.where("kind = 'ITEM'").join(first, "dedupe_key").withColumn("action", F.when(F.col("is_new") & (F.struct("source_id", "seq") == F.col("_first")), "INSERT").otherwise("ATTACH"))
    return {
        "items": items.select("dedupe_key", "event_id", "source_id", "seq", "source_url", "observed_at", "action"),
        "events": events.where("is_new").select("event_id", "dedupe_key", "first_seen", "last_seen"),
        "seen": events.where("not is_new").select("event_id", "dedupe_key", "last_seen"),
    }


def merged(events: DataFrame, batch: dict[str, DataFrame]) -> DataFrame:
    """The snapshot of events (event_id, dedupe_key, first_seen, last_seen) after a batch; a batch that is delivered again
    changes nothing, and late sightings never lower last_seen."""
    all_ = events.select("event_id", "dedupe_key", "first_seen", "last_seen").unionByName(batch["events"]).unionByName(batch["seen"].withColumn("first_seen", F.lit(None).cast("timestamp")))
    return all_.groupBy("event_id").agg(F.max("dedupe_key").alias("dedupe_key"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
