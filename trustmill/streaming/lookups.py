"""Answers that hold for a while, kept in the state of a stream: robots files by host for an hour, threats by URL for a day.

The state store drops an answer when its time is over (processing time), so that the next row with the key asks again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

HOUR_MS = 3_600_000
ROBOTS_MS, THREATS_MS = HOUR_MS, 24 * HOUR_MS


class Lookup(StatefulProcessor):
    """One answer a key. ask is called in the task, once a key while its answer holds."""

    def __init__(self, ask: Callable[[str], str | None], ttl_ms: int):
        self.ask, self.ttl_ms = ask, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.answer = handle.getValueState("answer", "text string", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = sum(len(batch) for batch in rows)
        held = self.answer.exists()
        text = self.answer.get()[0] if held else self.ask(key[0])
        if not held:
            self.answer.update((text,))
        yield pd.DataFrame({"key": [key[0]], "answer": [text], "asked": [not held], "rows": pd.array([n], dtype="Int64")})

    def close(self) -> None:
        pass


def lookups(rows: DataFrame, key: str, ask: Callable[[str], str | None], ttl_ms: int) -> DataFrame:
    """key, answer, asked, rows for each key of a micro-batch (asked: the answer was not held). The session needs the
    RocksDB state store. Rows without a key are left out."""
    keyed = rows.where(rows[key].isNotNull()).select(rows[key].alias("key"))
    return keyed.groupBy("key").transformWithStateInPandas(Lookup(ask, ttl_ms), "key string, answer string, asked boolean, rows long", "update", "ProcessingTime")


def robots(urls: DataFrame, fetch: Callable[[str], str | None], ttl_ms: int = ROBOTS_MS) -> DataFrame:
    """Robots files of the hosts of a stream of addresses (host)."""
    return lookups(urls, "host", fetch, ttl_ms)


def threats(urls: DataFrame, ask: Callable[[str], str | None], ttl_ms: int = THREATS_MS) -> DataFrame:
    """Verdicts on a stream of addresses (url)."""
    return lookups(urls, "url", ask, ttl_ms)
