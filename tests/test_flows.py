import collections
import datetime as dt
import http.server
import random
import threading

import pytest
from pyspark.sql import functions as F

from trustmill import schemas
from trustmill.functions import matching
from trustmill.operators import links, notify, transitions, verification
from trustmill.sources import seeds, sinks, web
from trustmill.streaming import flows

T0 = dt.datetime(2026, 1, 1, tzinfo=dt.UTC)


def step(trust, outcome):
    change = {"valid": 3, "dead_link": -2, "fake": -8, "duplicate": -1}[outcome]
    return max(0, min(100, trust + (1 if change > 0 and trust >= 90 else change)))


def test_trust_fold_keeps_the_order(spark):
    r = random.Random(1)
    rows = [(s, T0 + dt.timedelta(hours=r.randrange(2000)), k, r.choice(["valid", "valid", "valid", "fake", "dead_link", "duplicate"])) for s in range(4) for k in range(s * 100)]
    trust = {0: 60, 1: 88, 2: 5}
    want = {}
    for s, _, _, o in sorted(rows, key=lambda x: (x[0], x[1], x[2])):
        want[s] = step(want.get(s, trust.get(s, 50)), o)
    r.shuffle(rows)
    outcomes = spark.createDataFrame(rows, "source_id long, observed_at timestamp, seq long, outcome string")
    sources = spark.createDataFrame(list(trust.items()), "source_id long, trust_score int")
    assert {x.source_id: x.trust for x in transitions.fold_trust(outcomes, sources).collect()} == want


def test_clusters_follow_arrival(spark):
    r = random.Random(2)
    items = [(k, f"key{r.randrange(15)}") for k in range(60)]
    seen, want = {"key1", "key2"}, {}
    for k, key in items:
        want[k] = "ATTACH" if key in seen else "INSERT"
        seen.add(key)
    shuffled = items[:]
    r.shuffle(shuffled)
    known = spark.createDataFrame([("key1",), ("key2",)], "dedupe_key string")
    got = transitions.cluster(spark.createDataFrame(shuffled, "pos int, dedupe_key string"), known, [F.col("pos")])
    assert {x.pos: x.action for x in got.collect()} == want
    again = transitions.cluster(spark.createDataFrame(shuffled, "pos int, dedupe_key string"), got.select("dedupe_key"), [F.col("pos")])
    assert {x.action for x in again.collect()} == {"ATTACH"}


def test_snapshots(spark, tmp_path):
    one = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    folder = str(tmp_path / "t")
    transitions.publish(spark, one, folder)
    merged = transitions.merge_snapshot(transitions.current(spark, folder), spark.createDataFrame([(2, "B"), (3, "c")], "k int, v string"), ["k"])
    transitions.publish(spark, merged, folder)
    assert sorted(map(tuple, transitions.current(spark, folder).collect())) == [(1, "a"), (2, "B"), (3, "c")]
    more = transitions.insert_or_ignore(one, spark.createDataFrame([(2, "x"), (5, "z"), (5, "y")], "k int, v string"), ["k"], [F.col("v")])
    assert sorted(map(tuple, more.collect())) == [(1, "a"), (2, "b"), (5, "y")]
    ids = transitions.next_ids(10, spark.range(50).withColumn("o", F.col("id") * 7 % 50), [F.col("o")], "n")
    assert [r.n for r in ids.orderBy("o").collect()] == list(range(11, 61))
    added = transitions.add_counters(spark.createDataFrame([(1, 2)], "k int, c int"), spark.createDataFrame([(1, 3), (2, 1)], "k int, c int"), "k")
    assert sorted(map(tuple, added.collect())) == [(1, 5), (2, 1)]


def test_feedback(spark):
    sources = spark.createDataFrame([(1, 60), (2, 99)], "source_id int, trust_score int")
    feedback = spark.createDataFrame([(1, 1, "WRONG_DATE"), (1, 2, "LEGITIMATE"), (2, 3, "LEGITIMATE"), (2, 4, "DUPLICATE")], "source_id int, seq int, label string")
    assert sorted(map(tuple, transitions.apply_feedback(sources, feedback).collect())) == [(1, 55, 1, 1), (2, 100, 0, 1)]


def test_feedback_of_a_large_source_is_folded_in_bounded_runs(spark, monkeypatch):
    monkeypatch.setattr(transitions, "RUN", 50)
    kinds = ["LEGITIMATE", "WRONG_DATE", "LEGITIMATE", "DUPLICATE", "LEGITIMATE", "LEGITIMATE", "FALSE_LINK"]
    rows = [(1 if i % 3 else 2 + i % 5, (i * 7919) % 3001, kinds[(i * i) % 7]) for i in range(3000)]
    sources = spark.createDataFrame([(k, 60 + k) for k in range(1, 9)], "source_id int, trust_score int")
    feedback = spark.createDataFrame(rows, "source_id int, seq int, label string")
    want = {}
    for k in range(1, 9):
        trust, labels = 60 + k, [x for s, _, x in sorted(rows, key=lambda r: r[1:]) if s == k]
        for x in labels:
            trust = max(trust - 8, 0) if x in ("WRONG_DATE", "FALSE_LINK") else min(trust + 3, 100) if x == "LEGITIMATE" else trust
        want[k] = (trust, sum(x in ("WRONG_DATE", "FALSE_LINK") for x in labels), labels.count("LEGITIMATE"))
    sizes = []
    aggregate = transitions.F.aggregate
    monkeypatch.setattr(transitions.F, "aggregate", lambda c, *rest: (sizes.append(c), aggregate(c, *rest))[1])
    got = transitions.apply_feedback(sources, feedback)
    assert {r.source_id: tuple(r)[1:] for r in got.collect()} == want
    assert sizes[0] == "_steps" and "_run" in got._jdf.queryExecution().optimizedPlan().toString()



def test_redirects(spark):
    hops = spark.createDataFrame([(f"u{k}", f"u{k + 1}") for k in range(9)], "url string, target string")
    got = transitions.follow_redirects(spark.createDataFrame([("u0",), ("u7",), ("x",)], "url string"), hops)
    assert sorted(map(tuple, got.collect())) == [("u0", "u5", 5), ("u7", "u9", 2), ("x", "x", 0)]


EVENTS = "event_id long, category string, city string, status string, publishing_tier string, registration_deadline timestamp, start_date timestamp"
TARGETS = [(1, ""), (2, '{"categories":["AI"]}'), (3, '{"cities":["Pune"]}')]


def test_alerts_are_queued_once(spark):
    events = spark.createDataFrame([(1, "AI", "Pune", "VERIFIED", "A", None, None), (2, "Web", None, "UPDATED", "B", None, None), (3, "AI", "Pune", "VERIFIED", "C", None, None)], EVENTS)
    targets = spark.createDataFrame(TARGETS, "target_id int, filter string")
    schema = "notification_id long, event_id long, target_id int, template string, status string"
    none = spark.createDataFrame([], schema)
    first = sorted(map(tuple, notify.queue_alerts(events, targets, none).collect()))
    assert first == [(1, 1, "ALERT"), (1, 2, "ALERT"), (1, 3, "ALERT"), (2, 1, "ALERT")]
    queued = spark.createDataFrame([(k, e, t, x, "QUEUED") for k, (e, t, x) in enumerate(first)], schema)
    assert notify.queue_alerts(events, targets, queued).count() == 0
    sent = queued.withColumn("status", F.lit("SENT"))
    assert [tuple(r) for r in notify.queue_alerts(events, targets, sent).collect()] == [(2, 1, "CORRECTION")]
    failed = queued.withColumn("status", F.lit("FAILED"))
    assert notify.queue_alerts(events, targets, failed).count() == 4


def test_reminders_are_queued_once(spark):
    now = F.expr("TIMESTAMP '2026-01-01 00:00:00'")
    events = spark.createDataFrame([(1, "AI", "Pune", "VERIFIED", "A", T0 + dt.timedelta(hours=10), T0 + dt.timedelta(hours=60)), (2, "AI", "Pune", "VERIFIED", "A", T0 + dt.timedelta(hours=30), None), (3, "AI", None, "EXPIRED", "A", T0 + dt.timedelta(hours=1), None)], EVENTS)
    targets = spark.createDataFrame(TARGETS[:1], "target_id int, filter string")
    none = spark.createDataFrame([], "event_id long, target_id int, template string")
    first = notify.queue_reminders(events, targets, none, now)
    assert sorted(map(tuple, first.collect())) == [(1, 1, "REMINDER_24"), (1, 1, "REMINDER_START"), (2, 1, "REMINDER_48")]
    assert notify.queue_reminders(events, targets, first, now).count() == 0


def test_dispatch(spark):
    queue = spark.createDataFrame([(k, k, 1 if k < 5 else 9, "ALERT") for k in range(6)], "notification_id long, event_id long, target_id int, template string")
    events = spark.createDataFrame([(k, k != 3) for k in range(5)], "event_id long, gate_passed boolean")
    results = spark.createDataFrame([(0, True, False, None), (1, False, True, "429"), (2, False, False, "400")], "notification_id long, ok boolean, retryable boolean, error string")
    got = {r.notification_id: (r.status, r.error) for r in notify.dispatch(queue, events, spark.createDataFrame([(1,)], "target_id int"), results).collect()}
    assert got == {0: ("SENT", None), 1: ("QUEUED", "429"), 2: ("FAILED", "400"), 3: ("SUPPRESSED", None), 4: ("FAILED", "NO_RESULT"), 5: ("FAILED", "UNKNOWN_TARGET_OR_EVENT")}


def test_copies_are_compared_once_and_paired_by_their_ids(spark, monkeypatch):
    kinds = [("open data day", "Club", "2026-01-01", None), ("open data days", "Club", "2026-01-02", None), ("robot", None, None, "https://x.org/1"), ("cloud", "IIT", None, "https://x.org/1"), ("", "IIT", None, None)]
    rows = [(k, *kinds[k % 5][:3], None, kinds[k % 5][3], None) for k in range(100)]
    events = spark.createDataFrame(rows, "id int, title string, organizer string, start_date string, city string, event_url string, registration_url string")
    p = matching.prepared(events)
    told = matching.duplicate_reason("a", "b")
    want = p.alias("a").crossJoin(p.alias("b")).where("a.id < b.id").select(F.col("a.id"), F.col("b.id"), told["reason"].alias("reason"), F.round(told["similarity"], 6)).where("reason is not null")
    stored, held = matching.stored, {}
    monkeypatch.setattr(matching, "stored", lambda df, name: held.update({name: stored(df, name)}) or held[name])
    monkeypatch.setattr(matching, "PACK", 1000)
    got = matching.duplicate_pairs(events, digits=6)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert held["links"].count() == 6  # two kinds of titles, two at one address: three links each, and not one a pair
    monkeypatch.setattr(matching, "stored", stored)
    monkeypatch.setattr(matching, "PACK", 3)  # several lists a class
    monkeypatch.setattr(matching, "TASK_ID_PAIRS", 50)
    assert sorted(map(tuple, matching.duplicate_pairs(events, digits=6).collect())) == sorted(map(tuple, got.collect()))


def test_duplicates_equal_brute_force(spark):
    r = random.Random(3)
    words = ["open", "data", "code", "cloud", "robot", "day"]
    rows = [(k, " ".join(r.choice(words) for _ in range(r.randint(1, 3))), r.choice(["Club", "IIT", None]), r.choice(["2026-01-01", "2026-01-02", None]), r.choice(["Pune", "poona", None]), r.choice([None, None, f"https://x.org/{r.randrange(30)}"]), None) for k in range(70)]
    events = spark.createDataFrame(rows, "id int, title string, organizer string, start_date string, city string, event_url string, registration_url string")
    p = matching.prepared(events)
    want = p.alias("a").crossJoin(p.alias("b")).where("a.id < b.id").select(F.col("a.id"), F.col("b.id"), matching.duplicate_reason("a", "b")["reason"].alias("reason")).where("reason is not null")
    pairs = sorted(map(tuple, want.collect()))
    assert sorted(map(tuple, matching.duplicate_pairs(events).select("id_a", "id_b", "reason").collect())) == pairs
    degree = collections.Counter(k for a, b, _ in pairs for k in (a, b))
    counts = matching.duplicate_counts(events).collect()
    assert {x.id: x.n_links for x in counts} == {k: degree[k] for k, *_ in rows}
    found = matching.duplicate_classes(events)
    of = {x.id: x.class_id for x in found["members"].collect()}
    assert {x.id: x.class_id for x in counts} == of and len(set(of.values())) < len(of)
    links = [(x.class_a, x.class_b) for x in found["links"].collect()]
    near = {frozenset((of[a], of[b])) for a, b, r in pairs if r.startswith("TITLE")}
    assert near <= {frozenset(x) for x in links} <= {frozenset((of[a], of[b])) for a, b, _ in pairs}

    def groups(edges, name):
        parent = {}

        def find(k):
            while parent.get(k, k) != k:
                k = parent[k]
            return k

        for x, y in edges:
            parent[max(find(x), find(y))] = min(find(x), find(y))
        out = collections.defaultdict(set)
        for k in of:
            if degree[k]:
                out[find(name(k))].add(k)
        return sorted(map(sorted, out.values()))

    assert groups([(x, y) for x, y, _ in pairs], lambda k: k) == groups(links, of.get)


BASE = dict(title="T", organizer_name="Club", event_url="https://example.com/e", registration_url="https://example.com/r", source_url="https://s.org", source_trust=60, official_domain="example.com", official_page=True, official_links=True, identity=True, source_count=1, platform_listed=False, social=False, dates_consistent=True, organizer_consistent=True, recent=True, conflict=False, threat=False, has_date=True, classification="Hackathon", status="DISCOVERED")  # noqa: C408


@pytest.mark.parametrize(
    ("change", "decisions", "outcome", "status"),
    [
        ({}, {"VERIFIED_OFFICIAL"}, "APPROVE", "VERIFIED"),
        ({"registration_url": "https://devfolio.co/x"}, {"VERIFIED_OFFICIAL", "VERIFIED_BY_MULTIPLE_SOURCES"}, "APPROVE", "VERIFIED"),
        ({"registration_url": "https://forms.gle/x"}, {"VERIFIED_OFFICIAL", "LIKELY_LEGITIMATE"}, "APPROVE", "VERIFIED"),
        ({"registration_url": "https://examp1e.com/r", "official_links": False, "identity": False}, {"SUSPICIOUS", "REJECTED", "UNVERIFIED"}, "REJECT", "SUSPICIOUS"),
        ({"registration_url": "https://xn--exmple-cua.com/r", "official_links": False, "threat": True}, {"REJECTED"}, "REJECT", "REJECTED"),
        ({"registration_url": "http://evil.org/r", "official_links": False, "official_page": False, "identity": None}, {"SUSPICIOUS", "UNVERIFIED"}, "REJECT", "SUSPICIOUS"),
        ({"has_date": False}, {"VERIFIED_OFFICIAL"}, "APPROVE", "NEEDS_REVIEW"),
        ({"conflict": True}, {"UNVERIFIED"}, "APPROVE", "NEEDS_REVIEW"),
        ({"registration_url": None}, {"UNVERIFIED"}, None, "NEEDS_REVIEW"),
        ({"status": "PUBLISHED", "classification": None}, {"VERIFIED_OFFICIAL"}, "APPROVE", "PUBLISHED"),
    ],
)
def test_verification(spark, change, decisions, outcome, status):
    row = {**BASE, **change}
    kinds = {bool: "boolean", int: "int", str: "string", type(None): "string"}
    schema = "event_id long, " + ", ".join(f"{k} {'boolean' if k == 'identity' else kinds[type(v)]}" for k, v in row.items())
    events = spark.createDataFrame([(1, *row.values())], schema)
    verified = verification.verify(events)
    r = verified.first()
    assert r.score.decision in decisions and r.new_status == status and r.evidence
    assert (r.link.outcome if r.link else None) == outcome
    rows = spark.createDataFrame([(7, 1, "REGISTRATION"), (9, 1, "REGISTRATION"), (11, 1, "EVENT_PAGE")], "link_id long, event_id long, url_type string")
    out = verification.outputs(verified, rows, spark.createDataFrame([(1, "a"), (1, "a"), (1, "b")], "event_id long, source_id string"), F.expr("TIMESTAMP '2026-02-01 00:00:00'"))
    assert out["evidence"].count() == len(r.evidence)
    reviews = [x.reason for x in out["reviews"].collect()]
    assert (len(reviews) == 1) == (status in ("NEEDS_REVIEW", "SUSPICIOUS")) and all(x.startswith("SUSPICIOUS_FLAGS:" if status == "SUSPICIOUS" else "TIER_") for x in reviews)
    assert [x.link_id for x in out["links"].collect()] == [x.link_id for x in out["checks"].collect()] == ([9] if r.link else [])
    assert sorted(tuple(x) for x in out["outcomes"].select("source_id", "outcome").collect()) == [(k, v) for k in "ab" for v in {"VERIFIED": ["valid"], "REJECTED": ["fake"]}.get(status, [])]


def test_official_context(spark):
    events = spark.createDataFrame([(1, "Spring Robot Contest", "Robot Club", "https://c.org/e", "https://f.org/r", 2), (2, "Spring Robot Contest", None, "https://c.org/e", "https://none.org/r", 6)], "event_id long, title string, organizer_name string, event_url string, registration_url string, best_level int")
    pages = spark.createDataFrame([("https://c.org/e", 200, '<a href="https://f.org/r?utm_source=a">go</a>'), ("https://f.org/r", 200, "<p>robot contest form</p>")], "url string, status int, body string")
    a, b = verification.official_context(events, pages).orderBy("event_id").collect()
    assert (a.official_page, a.official_domain, a.official_links, a.identity) == (True, "c.org", True, True)
    assert (b.official_page, b.official_domain, b.official_links, b.identity) == (False, None, False, None)


def test_link_rechecks(spark):
    rows = spark.createDataFrame([(1, 1, "REGISTRATION", "https://a.org/x", "a.org", T0), (2, 1, "EVENT_PAGE", "https://a.org/x", "a.org", T0), (3, 2, "REGISTRATION", None, "b.org", None), (4, 2, "REGISTRATION", "https://a.org", "a.org", T0)], "link_id long, event_id long, url_type string, final_url string, domain string, last_checked timestamp")
    resolved = spark.createDataFrame([(1, "https://evil.org", 200, None, False), (2, "https://a.org/y", 200, None, False), (3, None, None, "DNS", False), (4, None, None, "boom", True)], "link_id long, new_url string, status int, error string, failed boolean")
    out = links.recheck(rows, resolved, F.expr("TIMESTAMP '2026-02-01 00:00:00'"))
    assert [tuple(r) for r in out["flags"].collect()] == [(1, 1, "HOST_CHANGED", "warning", "a.org -> evil.org")]
    assert [r.field for r in out["changes"].collect()] == ["registration_url"] and out["reviews"].count() == 2 and out["checks"].count() == 4
    state = {r.link_id: r for r in out["links"].collect()}
    assert state[4].last_checked.replace(tzinfo=dt.UTC) == T0 or state[4].last_checked == T0.replace(tzinfo=None)
    assert state[2].final_url == "https://a.org/y" and state[3].domain == "b.org"


def test_seeds_and_schemas(spark):
    rows = spark.createDataFrame([("a", "rss", 3, "https://a", None, 50, True, 60_000, 8), ("a", "rss", 3, "https://b", "https://b/f", 101, True, 1, 8), ("c", "sitemap", 3, "http://c", None, 50, True, 60_000, 8)], seeds.SEED)
    got = sorted((r.slug, r.errors) for r in seeds.validate(rows).select("slug", "errors").collect())
    assert got == [("a", ["DUPLICATE_SLUG", "BAD_TRUST", "RATE_LIMIT_TOO_LOW"]), ("a", ["RSS_WITHOUT_FEED"]), ("c", ["NON_HTTPS_BASE"])]
    registry = spark.createDataFrame([("a", "rss", 3, "https://old", 77, True, 1, T0, "OK"), ("z", "rss", 1, "https://z", 10, True, 1, None, None)], "slug string, kind string, level int, base_url string, trust int, enabled boolean, rate_limit_ms long, last_run timestamp, last_status string")
    fresh = {r.slug: r for r in seeds.refresh_registry(registry, rows.limit(1)).collect()}
    assert fresh["a"].trust == 50 and fresh["a"].last_status == "OK" and fresh["z"].trust == 10
    assert len(schemas.TABLES) == 17 and all(schemas.empty(spark, t).count() == 0 for t in schemas.TABLES)
    old = spark.createDataFrame([("t", "telegram", "d", True)], "target_id string, channel string, destination string, enabled boolean")
    assert schemas.upgraded(old, "notification_targets").first().filter is None


class Site(http.server.BaseHTTPRequestHandler):
    def do_GET(self):
        code = {"/ok": 200, "/moved": 302, "/blocked": 403}.get(self.path, 404)
        self.send_response(code)
        if code == 302:
            self.send_header("Location", "/ok")
        self.end_headers()
        self.wfile.write(b"x" * 50 if code == 200 else b"")

    do_HEAD = do_GET

    def log_message(self, *args):
        pass


def test_web_source(spark):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    try:
        spark.dataSource.register(web.WebSnapshot)
        names = ["/ok", "/blocked", "/gone"]
        df = spark.read.format("web_snapshot").option("urls", "\n".join([*(base + n for n in names), "ftp://x/y", "nothing"])).load()
        got = {r.url.removeprefix(base): (r.status, r.error) for r in df.collect()}
        assert got == {"/ok": (200, None), "/blocked": (403, "BLOCKED_HTTP_403"), "/gone": (404, "HTTP_404"), "ftp://x/y": (None, "UNSUPPORTED_SCHEME"), "nothing": (None, "INVALID_URL")}
        assert web.fetch_text(base + "/ok", most=10)[4] == "RESPONSE_TOO_LARGE"
        assert web.resolve_redirects(base + "/moved") == (base + "/ok", [(base + "/moved", 302), (base + "/ok", 200)], None)
    finally:
        server.shutdown()
    snapshot = spark.createDataFrame([("https://a.org/robots.txt", 404, None, "HTTP_404"), ("https://b.org/robots.txt", 500, None, "HTTP_500"), ("https://c.org/robots.txt", 200, "User-agent: *", None)], "url string, status int, body string, error string")
    assert sorted(map(tuple, web.robots_text(snapshot).collect())) == [("a.org", ""), ("b.org", "User-agent: *\nDisallow: /"), ("c.org", "User-agent: *")]


def test_sinks(spark):
    field, button = F.array(F.struct(F.lit("n").alias("name"), F.lit("").alias("value"), F.lit(True).alias("inline"))), F.array(*(F.struct(F.lit("b" * 100).alias("label"), F.lit("u").alias("url")) for _ in range(7)))
    payload = spark.range(1).select(sinks.discord_payload(F.lit("t" * 2000), F.lit("x"), F.lit("d"), field, button).alias("p")).select(F.from_json("p", "content string, embeds array<struct<fields:array<struct<value:string>>>>, components array<struct<components:array<struct<label:string>>>>").alias("p")).first().p
    assert len(payload.content) == 1500 and payload.embeds[0].fields[0].value == "—" and [len(c.label) for c in payload.components[0].components] == [80] * 5
    messages = spark.createDataFrame([(1, "ok", "{}"), (2, "busy", "{}"), (3, "bad", "{}")], "notification_id long, url string, payload string")
    sent = sinks.send(messages, lambda url, _: {"ok": (200, ""), "busy": (429, "slow"), "bad": (400, "no")}[url])
    assert sorted(map(tuple, sent.drop("retry_after_s").collect())) == [(1, True, False, None), (2, False, True, "slow"), (3, False, False, "no")]
    letters = sinks.dead_letters(spark.createDataFrame([(1, "x")], "a int, b string"), "discovery", F.lit("boom")).first()
    assert (letters.payload, letters.attempts) == ('{"a":1,"b":"x"}', 1)


def test_streams(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source, sink = str(tmp_path / "in"), {}
    schema = "source_id long, observed_at timestamp, seq long, outcome string"
    batches = [[(1, T0, 1, "fake"), (1, T0, 0, "valid"), (2, T0, 2, "valid")], [(1, T0 + dt.timedelta(hours=1), 3, "valid")]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = flows.trust_stream(spark.readStream.schema(schema).parquet(source))
        writer = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True)
        query = writer.foreachBatch(lambda df, _: sink.update({r.source_id: r.trust for r in df.collect()})).start()
        query.awaitTermination(180)
    want = {1: step(step(step(50, "valid"), "fake"), "valid"), 2: 53}
    assert sink == want
    reports = {}

    def fails(df, epoch):
        raise ValueError("no luck")

    seen = []
    query = flows.start_loop(spark.readStream.schema(schema).parquet(source), [("count", lambda df, epoch: seen.append(df.count())), ("fail", fails), ("after", lambda df, epoch: None)], str(tmp_path / "ck2"), lambda epoch, r: reports.update({epoch: r}))
    query.awaitTermination(180)
    assert sum(seen) == 4 and reports[0] == {"count": "OK", "fail": "FAILED: no luck", "after": "OK"}
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert flows.windowed_counts(events).count() > 0 and flows.sessions(events).count() > 0


def test_discovery_run(spark):
    from trustmill.operators import discovery

    none = "format string, start_date string"
    schema = f"source_id string, seq long, source_url string, title string, organizer string, {none}, event_url string, registration_url string, source_level int, security_note string"
    item = lambda s, k, title, url, note=None: (s, k, f"https://s.org/{k}", title, None, None, None, url, None, 5, note)
    items = spark.createDataFrame([item("a", 1, "Robot Contest", "https://e.org/1", "x" * 600), item("a", 2, " \u00a0 ", None), item("a", 3, "robot  contest!", "https://e.org/1?utm_source=a"), item("b", 1, "Robot contest", "https://E.org/1/"), item("b", 2, "Known", None), item("off", 1, "Other", None), item("soon", 1, "Other", None)], schema)
    registry = spark.createDataFrame([("a", True, 1, None, None), ("b", True, 1, None, None), ("off", False, 1, None, "OK"), ("soon", True, 3_600_000, T0, "OK"), ("bad", True, 1, None, None)], "source_id string, enabled boolean, rate_limit_ms long, last_run timestamp, last_status string")
    known = discovery.keyed(items.where("seq = 2 and source_id = 'b'")).select(F.lit("k1").alias("event_id"), "dedupe_key")
    now = F.lit(T0) + F.expr("INTERVAL '10' MINUTE")
    out = discovery.run(items, registry, known, spark.createDataFrame([("k1", "https://s.org/9")], "event_id string, source_url string"), spark.createDataFrame([("bad", "HTTP_500")], "source_id string, error string"), now)
    got = {r.source_id: (r.status, r.discovered, r.inserted, r.attached, r.rejected, r.error) for r in out["results"].collect()}
    assert got == {"a": ("OK", 3, 1, 1, 1, None), "b": ("OK", 2, 0, 2, 0, None), "off": ("SKIPPED_DISABLED", 0, 0, 0, 0, None), "soon": ("SKIPPED_RATE_LIMIT", 0, 0, 0, 0, None), "bad": ("FAILED", 0, 0, 0, 0, "HTTP_500")}
    assert [r.title for r in out["events"].collect()] == ["Robot Contest"] and [len(r.details) for r in out["flags"].collect()] == [500]
    # each address once, from the source that showed it first
    assert sorted((r.source_id, r.source_url, r.event_id == "k1") for r in out["event_sources"].collect()) == [("a", "https://s.org/1", False), ("a", "https://s.org/3", False), ("b", "https://s.org/2", True)]
    assert out["runs"].count() == 3 and out["dead_letters"].first().error == "HTTP_500" and out["outcomes"].count() == 3
    assert {r.source_id: r.last_status for r in out["registry"].collect()} == {"a": "OK", "b": "OK", "off": "OK", "soon": "OK", "bad": "FAILED"}
    again = discovery.run(items, registry, known.unionByName(out["events"].select("event_id", "dedupe_key")), out["event_sources"].select("event_id", "source_url"), out["dead_letters"].select(F.lit("none").alias("source_id"), "error"), now)
    assert again["events"].count() == 0 and again["event_sources"].count() == 0  # delivered again, nothing is new


def test_administrators(spark):
    from trustmill.operators import admin

    events = spark.createDataFrame([("e1", "NEEDS_REVIEW", None, "X", 10), ("e2", "VERIFIED", None, "X", 10), ("e3", "VERIFIED", None, "X", 10)], "event_id string, status string, last_seen timestamp, verification_decision string, verification_score int")
    reviews = spark.createDataFrame([("e1", False, None), ("e1", True, "OLD"), ("e2", False, None)], "event_id string, resolved boolean, resolution string")
    decisions = spark.createDataFrame([(1, "e1", "approve", None), (2, "e2", "approve", None), (3, "e3", "recheck", None), (4, "none", "reject", None)], "seq int, event_id string, action string, reason string")
    out = admin.decide(events, reviews, decisions, F.lit(T0))
    assert {r.event_id: (r.status, r.verification_decision, r.verification_score) for r in out["events"].collect()} == {"e1": ("VERIFIED", "X", 10), "e2": ("VERIFIED", "X", 10), "e3": ("DISCOVERED", None, 0)}
    assert sorted((r.event_id, r.resolved, r.resolution) for r in out["reviews"].collect() if r.resolved) == [("e1", True, "APPROVED"), ("e1", True, "OLD")]
    assert {r.event_id: r.done for r in out["results"].collect()} == {"e1": True, "e2": False, "e3": True, "none": False}
    told = {r.text: r.reply for r in admin.commands(spark.createDataFrame([(7, "/help"), (7, "/approve"), (7, "what"), (7, None), (8, "/help")], "chat_id long, text string"), ["7"]).collect()}
    assert told == {"/help": admin.HELP, "/approve": "Usage: /approve EVENT_ID", "what": "Unknown command. Send /help.", None: "Unknown command. Send /help."}
    switched = admin.set_enabled(spark.createDataFrame([("a", True), ("b", True)], "source_id string, enabled boolean"), spark.createDataFrame([("b", False)], "source_id string, on boolean"))
    assert {r.source_id: r.enabled for r in switched.collect()} == {"a": True, "b": False}
    assert admin.reset({"events": events, "notifications": reviews}, False)["events"].count() == 0
    with pytest.raises(PermissionError):
        admin.reset({}, True)


def test_connectors(spark):
    from trustmill.sources import connectors

    found = seeds.first_seeds(spark)
    assert found.count() == 30 and seeds.validate(found).where("size(errors) > 0").count() == 0
    sites = spark.createDataFrame([("site", "sitemap", 3, "https://s.org/", None, 80, True, 60_000, 2), ("none", "sitemap", 3, "https://n.org", None, 80, True, 60_000, 2)], seeds.SEED)
    robots = spark.createDataFrame([("s.org", "User-agent: *\nDisallow: /private\nSitemap: https://s.org/index.xml")], "host string, text string")
    maps = connectors.map_addresses(sites, robots)
    assert sorted((r.source_id, r.url) for r in maps.collect()) == [("none", "https://n.org/sitemap.xml"), ("site", "https://s.org/index.xml")]
    index = "<sitemapindex><sitemap><loc>https://s.org/a.xml</loc></sitemap></sitemapindex>"
    urls = "<urlset>" + "".join(f"<url><loc>https://s.org/{x}</loc></url>" for x in ("about", "hackathon/1", "hackathon/1", "event.pdf", "private/hackathon", "challenge", "event/9")) + "</urlset>"
    page = "<h1>Hack 1</h1>"
    rows = [("https://s.org/index.xml", 200, None, index, None), ("https://s.org/a.xml", 200, None, urls, None), ("https://s.org/hackathon/1", 200, "https://s.org/h1", page, None), ("https://s.org/private/hackathon", 200, None, page, None)]
    snapshot = connectors.guarded(spark.createDataFrame(rows, web.SNAPSHOT), robots, "trustmill")
    assert {r.url: r.error for r in snapshot.collect()}["https://s.org/private/hackathon"] == "BLOCKED_BY_ROBOTS_TXT"
    pages = connectors.page_addresses(sites, maps, snapshot)
    assert [(r.pos, r.url) for r in pages.orderBy("pos").collect()] == [(0, "https://s.org/hackathon/1"), (1, "https://s.org/private/hackathon")]
    items = connectors.from_pages(sites, pages, snapshot).collect()
    assert [(r.source_id, r.source_level, r.source_url, r.title) for r in items] == [("site", 3, "https://s.org/h1", "Hack 1")]
    search = spark.createDataFrame([("q", "search", 7, None, None, 40, True, 60_000, None), ("off", "search", 7, None, None, 40, False, 60_000, None)], seeds.SEED)
    body = '{"results":[{"title":"T","url":"https://t.org"},{"title":"F","url":"ftp://t.org"},{"url":"https://u.org","snippet":"s"}]}'
    answers = spark.createDataFrame([("q", 0, body), ("q", 1, "no json"), ("off", 0, body)], "source_id string, seq int, body string")
    assert sorted((r.source_url, r.title, r.raw) for r in connectors.from_search(search, answers).collect()) == [("https://t.org", "T", "T\n"), ("https://u.org", None, "\ns")]


def test_threats_and_states_after_sending(spark):
    now = F.lit(T0)
    cached = spark.createDataFrame([("https://old.org", ["MALWARE"], dt.datetime(2020, 1, 1)), ("https://a.org", ["MALWARE"], T0)], "url string, threat_types array<string>, fetched_at timestamp")
    urls = spark.createDataFrame([("https://a.org",), ("https://old.org",), ("https://b.org",)], "url string")
    asked = []

    def ask(df):
        asked.extend(sorted(r.url for r in df.collect()))
        return df.select("url", F.lit(200).alias("status"), F.when(F.col("url") == "https://b.org", '{"matches":[{"threatType":"SOCIAL_ENGINEERING"}]}').otherwise("{}").alias("body"))

    found = web.checked_threats(urls, cached, ask, now)
    verdicts = {r.url: r.verdict for r in web.threat_verdicts(urls, found).collect()}
    assert verdicts == {"https://a.org": "HIT", "https://b.org": "HIT", "https://old.org": "UNKNOWN"} and asked == ["https://b.org", "https://old.org"]
    known = spark.createDataFrame([("b.org", 90, None, None), ("c.org", 50, None, None)], "domain string, reputation int, verdict string, checked_at timestamp")
    assert {r.domain: r.reputation for r in web.domain_verdicts(known, found, now).collect()} == {"a.org": 0, "b.org": 0, "c.org": 50}
    from trustmill.operators.notify import status_after_sending

    events = spark.createDataFrame([(1, "UPDATED"), (2, "UPDATED"), (3, "PUBLISHED")], "event_id long, status string")
    sent = spark.createDataFrame([(1, "SENT"), (2, "QUEUED"), (3, "SENT")], "event_id long, status string")
    assert {r.event_id: r.status for r in status_after_sending(events, sent).collect()} == {1: "VERIFIED", 2: "UPDATED", 3: "PUBLISHED"}


def test_alike_pairs_equal_brute_force(spark):
    import random

    from trustmill.functions import matching

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    r = random.Random(3)
    base = ["".join(r.choice("abcde ") for _ in range(n)) for n in (1, 3, 6, 7, 13, 20, 27, 34, 41)]
    names = ["", "a"]
    for b in base:
        for _ in range(14):
            s = list(b)
            for _ in range(r.randint(0, 1 + len(b) // 6)):
                k = r.randrange(len(s) + 1)
                s[k : k + r.choice((0, 1))] = r.choice(("", "x", "e"))
            names.append("".join(s))
    rows = [(i, n, "v" if i % 3 else "w") for i, n in enumerate(names)] + [(900, base[5], None)]
    got = {(p.id_a, p.id_b): p.distance for p in matching.alike_pairs(spark.createDataFrame(rows, "id long, name string, org string"), "org").collect()}
    want = {(i, j): d for i, a, x in rows for j, b, y in rows if i < j and x and x == y and a and b and 1 - (d := distance(a, b)) / max(len(a), len(b)) >= 0.85}
    assert got == want and len(want) > 50
