"""Channels as a data source that Spark writes to, and sources that Spark reads as a stream.

    messages.write.format("channel").option("channel", "TELEGRAM").option("state", "hdfs://.../sent").mode("append").save()

posts each row (notification_id, template, url, payload) once. The key of a message is made of its id and template and
goes along as a header, so that a receiver can tell repeats; a mark in the state folder, which all executors share, says
that it was taken, so that a task that is run again posts only what was not. Results are written beside the marks by each
task; the commit lists the files of the tasks that were committed, and only those count (`results`). No message and no
result passes through the driver.
"""

from __future__ import annotations

import hashlib
import json
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from trustmill.sources.sinks import TIMEOUT_S, answer
from trustmill.sources.web import SNAPSHOT, fetch_text

MESSAGES = "notification_id long, template string, url string, payload string"
RESULT = "notification_id long, template string, status int, body string, repeated boolean"
BODY_SIGNS = 2000


def message_key(notification_id: int, template: str) -> str:
    return hashlib.sha256(f"{notification_id}|{template}".encode()).hexdigest()


def post(url: str, payload: str, key: str, token: str | None = None) -> tuple[int | None, str]:
    headers = {"Content-Type": "application/json", "Idempotency-Key": key} | ({"Authorization": f"Bearer {token}"} if token else {})
    request = urllib.request.Request(url, data=payload.encode(), headers=headers, method="POST")
    try:
        with urllib.request.urlopen(request, timeout=TIMEOUT_S) as reply:
            return reply.status, reply.read(BODY_SIGNS).decode("utf-8", "replace")
    except urllib.error.HTTPError as e:
        return e.code, e.read(BODY_SIGNS).decode("utf-8", "replace")
    except OSError as e:
        return None, str(e)[:200]


class Folder:
    """Files of a folder that all executors share, by URI."""

    def __init__(self, uri: str):
        self.system, self.path = pyarrow.fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")

    def has(self, name: str) -> bool:
        return self.system.get_file_info(f"{self.path}/{name}").type == pyarrow.fs.FileType.File

    def write(self, name: str, data: str) -> None:
        folder = f"{self.path}/{name}".rsplit("/", 1)[0]
        self.system.create_dir(folder, recursive=True)
        with self.system.open_output_stream(f"{self.path}/{name}") as out:
            out.write(data.encode())

    def read(self, name: str) -> str:
        with self.system.open_input_stream(f"{self.path}/{name}") as f:
            return f.read().decode()


@dataclass
class Sent(WriterCommitMessage):
    file: str
    messages: int


class ChannelWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.state, self.token = options["state"], options.get("token")

    def write(self, iterator: Iterator) -> Sent:
        folder, name, lines, n = Folder(self.state), f"results/{uuid.uuid4().hex}.json", [], 0
        for row in iterator:
            key = message_key(row.notification_id, row.template)
            mark = f"sent/{key[:2]}/{key}"
            repeated = folder.has(mark)
            status, body = tuple(json.loads(folder.read(mark))) if repeated else post(row.url, row.payload, key, self.token)
            if not repeated and status is not None and 200 <= status < 300:
                folder.write(mark, json.dumps([status, body]))
            lines.append(json.dumps({"notification_id": row.notification_id, "template": row.template, "status": status, "body": body, "repeated": repeated}))
            n += 1
        folder.write(name, "\n".join(lines) + "\n" if lines else "")
        return Sent(name, n)

    def commit(self, messages: list[Sent | None]) -> None:
        files = [m.file for m in messages if m is not None and m.messages]
        Folder(self.state).write(f"commits/{uuid.uuid4().hex}.json", "".join(json.dumps({"file": f}) + "\n" for f in files))

    def abort(self, messages: list[Sent | None]) -> None:
        """Marks stay: what was taken was taken, and the next write posts the rest."""


class Channel(DataSource):
    @classmethod
    def name(cls) -> str:
        return "channel"

    def schema(self) -> str:
        return MESSAGES

    def writer(self, schema, overwrite: bool) -> ChannelWriter:
        return ChannelWriter(dict(self.options))


def results(spark: SparkSession, state: str, channel: str | None = None) -> DataFrame:
    """notification_id, template, ok, retryable, error, retry_after_s, repeated of all committed writes."""
    from pyspark.sql import functions as F

    listed = spark.read.schema("file string").json(f"{state}/commits").select(F.col("file")).distinct()
    rows = spark.read.schema(RESULT).json(f"{state}/results").withColumn("file", F.concat(F.lit("results/"), F.element_at(F.split(F.input_file_name(), "/"), -1)))
    told = rows.join(listed, "file", "left_semi").select("notification_id", "template", "repeated", answer(F.col("status"), F.col("body"), channel).alias("a"))
    return told.select("notification_id", "template", "a.ok", "a.retryable", "a.error", "a.retry_after_s", "repeated")


# Sources as a stream


class Turn(InputPartition):
    def __init__(self, source_id: str, url: str, turn: int):
        self.source_id, self.url, self.turn = source_id, url, turn


class SourceStreamReader(DataSourceStreamReader):
    """The offset of a source is the number of the interval that the clock is in, so a source is read once in each of its
    intervals however often the stream is triggered or started again, and not at all while it is disabled."""

    def __init__(self, options: dict[str, str]):
        self.sources = {s["source_id"]: s for s in json.loads(options["sources"])}
        self.clock = options.get("clock")

    def _now(self) -> float:
        if self.clock:  # a file with seconds since 1970, for runs that set the time themselves
            with open(self.clock) as f:
                return float(f.read())
        return time.time()

    def initialOffset(self) -> dict:
        return dict.fromkeys(self.sources, -1)

    def latestOffset(self) -> dict:
        now = self._now()
        return {k: int(now // max(s.get("interval_s", 60), 60)) if s.get("enabled", True) else -1 for k, s in self.sources.items()}

    def partitions(self, start: dict, end: dict) -> list[Turn]:
        return [Turn(k, self.sources[k]["url"], turn) for k, turn in end.items() if k in self.sources and turn > start.get(k, -1)]

    def read(self, partition: Turn) -> Iterator[tuple]:
        yield (partition.source_id, partition.turn, *fetch_text(partition.url))

    def commit(self, end: dict) -> None:
        pass


class SourceStream(DataSource):
    """spark.readStream.format("source_stream").option("sources", '[{"source_id": ..., "url": ..., "interval_s": ...}]')"""

    @classmethod
    def name(cls) -> str:
        return "source_stream"

    def schema(self) -> str:
        return f"source_id string, turn long, {SNAPSHOT}"

    def streamReader(self, schema) -> SourceStreamReader:
        return SourceStreamReader(dict(self.options))


