import datetime as dt
import http.server
import json
import random
import threading

import pytest
from pyspark.sql import functions as F

from trustmill.operators import discovery, transitions
from trustmill.sources import channel
from trustmill.streaming import clusters, lookups

T0 = dt.datetime(2026, 1, 1)
ITEM = "dedupe_key string, source_id string, seq long, source_url string, observed_at timestamp"


@pytest.fixture(autouse=True)
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def run(stream, checkpoint, each, **trigger):
    query = stream.writeStream.outputMode("update").option("checkpointLocation", str(checkpoint)).trigger(**(trigger or {"availableNow": True})).foreachBatch(each).start()
    assert query.awaitTermination(240) is not False


def test_a_stream_in_any_order_clusters_as_a_batch_does(spark, tmp_path):
    r = random.Random(4)
    items = [(f"key{r.randrange(12)}", f"s{r.randrange(3)}", k, f"https://s.org/{k}", T0 + dt.timedelta(hours=r.randrange(500))) for k in range(90)] + [(None, "s0", 99, "https://s.org/99", T0)]
    r.shuffle(items)
    known = spark.createDataFrame([("key1", "k-1", T0 - dt.timedelta(days=9), T0 - dt.timedelta(days=8)), ("gone", "k-2", T0, T0)], "dedupe_key string, event_id string, first_seen timestamp, last_seen timestamp")
    source, events, told = str(tmp_path / "in"), [known], []

    def each(out, epoch):
        batch = {k: spark.createDataFrame(df.collect(), df.schema) for k, df in clusters.actions(out).items()}
        events.append(spark.createDataFrame((merged := clusters.merged(events[-1], batch)).collect(), merged.schema))
        again = clusters.merged(events[-1], batch)
        assert sorted(map(str, again.collect())) == sorted(map(str, events[-1].collect()))  # delivered again, nothing changes
        told.extend(batch["items"].collect())

    for n in range(3):  # late sightings come in later batches, and in other runs of the query
        spark.createDataFrame(items[n::3], ITEM).coalesce(2).write.mode("append").parquet(source)
        run(clusters.sightings(spark.readStream.schema(ITEM).parquet(source), known), tmp_path / "ck", each)

    given = [x for x in items if x[0]]
    assert sorted(x.seq for x in told) == sorted(x[2] for x in given)
    inserted = [x.dedupe_key for x in told if x.action == "INSERT"]
    batch = transitions.cluster(spark.createDataFrame(given, ITEM), known, [F.col("observed_at"), F.col("seq")])
    assert sorted(inserted) == sorted(x.dedupe_key for x in batch.where("action = 'INSERT'").collect()) and len(set(inserted)) == len(inserted)
    ids = {x.k: x.id for x in spark.createDataFrame([(k,) for k in set(inserted)], "k string").select("k", discovery.event_id(F.col("k")).alias("id")).collect()} | {"key1": "k-1", "gone": "k-2"}
    assert all(x.event_id == ids[x.dedupe_key] for x in told)
    want = {"key1": [T0 - dt.timedelta(days=9), T0 - dt.timedelta(days=8)], "gone": [T0, T0]}
    for key, *_, at in given:
        lo, hi = want.get(key, (at, at))
        want[key] = [min(lo, at), max(hi, at)]
    got = {x.dedupe_key: (x.event_id, x.last_seen) for x in events[-1].collect()}
    assert got == {k: (ids[k], hi) for k, (_, hi) in want.items()}  # last_seen is raised, never lowered
    first = {x.dedupe_key: x.first_seen for x in events[-1].collect()}
    assert first["key1"] == T0 - dt.timedelta(days=9) and all(first[k] >= want[k][0] for k in want)


def test_answers_hold_until_their_time_is_over(spark, tmp_path):
    source, asked = str(tmp_path / "in"), str(tmp_path / "asked")

    def ask(key):
        with open(asked, "a") as f:
            f.write(key + "\n")
        return None if key == "c.org" else key.upper()

    def batches(name, ttl_ms):
        out = []
        for _ in range(2):
            spark.createDataFrame([("a.org",), ("a.org",), ("c.org",), (None,)], "host string").coalesce(1).write.mode("append").parquet(f"{source}-{name}")
            stream = lookups.robots(spark.readStream.schema("host string").parquet(f"{source}-{name}"), ask, ttl_ms)
            # a stream on the clock always has another batch
            run(stream, tmp_path / name, lambda df, _: out.append(sorted(map(tuple, df.collect()))), once=True)
        return out

    assert batches("long", 3_600_000) == [[("a.org", "A.ORG", True, 2), ("c.org", None, True, 1)], [("a.org", "A.ORG", False, 2), ("c.org", None, False, 1)]]
    assert batches("short", 1) == [[("a.org", "A.ORG", True, 2), ("c.org", None, True, 1)]] * 2
    with open(asked) as f:
        assert sorted(f.read().split()) == ["a.org"] * 3 + ["c.org"] * 3


class Inbox(http.server.BaseHTTPRequestHandler):
    taken: list = []  # noqa: RUF012
    busy: set = set()  # noqa: RUF012

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        busy = body["n"] in self.busy
        if not busy:
            self.taken.append((body["n"], self.headers["Idempotency-Key"]))
        self.send_response(429 if busy else 200)
        self.end_headers()
        self.wfile.write(b'{"parameters": {"retry_after": 17}}' if busy else b"{}")

    def do_GET(self):
        self.send_response(200)
        self.end_headers()
        self.wfile.write(b"feed " + self.path.encode())

    def log_message(self, *args):
        pass


@pytest.fixture
def inbox():
    Inbox.taken, Inbox.busy = [], set()
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Inbox)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_a_task_that_is_run_again_sends_nothing_twice(spark, tmp_path, inbox):
    spark.dataSource.register(channel.Channel)
    state = f"file://{tmp_path}/sent"
    messages = spark.createDataFrame([(n, "ALERT", inbox, json.dumps({"n": n})) for n in range(6)], channel.MESSAGES).repartition(2)
    Inbox.busy = {5}
    write = lambda: messages.write.format("channel").option("channel", "TELEGRAM").option("state", state).mode("append").save()
    # a task posts half of its messages and is lost before it is committed
    lost = channel.ChannelWriter({"state": state})
    lost.write(iter(messages.limit(3).collect()))
    write()
    assert sorted(n for n, _ in Inbox.taken) == [0, 1, 2, 3, 4] and len({k for _, k in Inbox.taken}) == 5
    got = {r.notification_id: (r.ok, r.retryable, r.retry_after_s) for r in channel.results(spark, state, "TELEGRAM").collect()}
    assert got == {n: (True, False, 0) for n in range(5)} | {5: (False, True, 17)}
    Inbox.busy = set()
    write()  # the queue is sent again: only what was not taken is posted
    assert sorted(n for n, _ in Inbox.taken) == list(range(6))
    assert channel.results(spark, state, "TELEGRAM").where("ok and notification_id = 5").count() == 1
    assert channel.results(spark, state, "TELEGRAM").where("error is not null").first().error.startswith("TELEGRAM_HTTP_429:")


def test_a_source_is_read_once_in_each_of_its_intervals(spark, tmp_path, inbox):
    spark.dataSource.register(channel.SourceStream)
    clock = tmp_path / "clock"
    sources = json.dumps([{"source_id": "a", "url": f"{inbox}/a", "interval_s": 60}, {"source_id": "b", "url": f"{inbox}/b", "interval_s": 600}, {"source_id": "off", "url": f"{inbox}/off", "enabled": False}])
    seen = []

    def at(seconds):
        clock.write_text(str(seconds))
        seen.clear()
        stream = spark.readStream.format("source_stream").option("sources", sources).option("clock", str(clock)).load()
        query = stream.writeStream.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).foreachBatch(lambda df, _: seen.extend((r.source_id, r.turn, r.body) for r in df.collect())).start()
        query.awaitTermination(120)
        return sorted(seen)

    assert at(6000) == [("a", 100, "feed /a"), ("b", 10, "feed /b")]
    assert at(6030) == []  # started again in the same interval
    assert at(6060) == [("a", 101, "feed /a")]
    assert at(6600) == [("a", 110, "feed /a"), ("b", 11, "feed /b")]


def test_batches_of_outcomes_are_committed_once(spark, tmp_path):
    from trustmill import schemas
    from trustmill.operators import commits, state
    from trustmill.streaming import flows

    folder, source = str(tmp_path / "store"), str(tmp_path / "in")
    registry = schemas.upgraded(spark.createDataFrame([("a", 60), ("b", 90)], "source_id string, trust_score int"), "source_registry")
    commits.commit(spark, commits.latest(spark, folder), {"source_registry": registry})
    now = F.expr("TIMESTAMP '2026-01-01 00:00:00'")
    kinds = "source_id string, outcome string, seq long"
    for part in ([("a", "valid", 2), ("a", "fake", 1), ("b", "valid", 3)], [("a", "dead_link", 4)]):
        spark.createDataFrame(part, kinds).coalesce(1).write.mode("append").parquet(source)
        flows.trust_loop(spark.readStream.schema(kinds).parquet(source), folder, now, str(tmp_path / "ck")).awaitTermination(120)
    last = commits.latest(spark, folder)
    tables = state.tables_of(spark, last)
    assert {r.source_id: r.trust_score for r in tables["source_registry"].collect()} == {"a": 53, "b": 91} and last.applied == {"trust": 1}
    assert {r.source_id: (r.valid_events, r.dead_links, r.fake_events) for r in tables["source_reputation"].collect()} == {"a": (1, 1, 1), "b": (1, 0, 0)}
    # a checkpoint that was lost delivers the first batches again
    flows.trust_loop(spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(source), folder, now, str(tmp_path / "ck2")).awaitTermination(120)
    assert commits.latest(spark, folder) == last
