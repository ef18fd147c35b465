import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from trustmill import schemas
from trustmill.operators import admin, commits, discovery, isolation, links, retries, state, transitions, verification
from trustmill.sources import web

T0 = dt.datetime(2026, 1, 1)
def now():
    return F.expr("TIMESTAMP '2026-01-01 00:00:00'")

ITEM = "source_id string, seq long, source_url string, title string, organizer string, format string, start_date string, event_url string, registration_url string, source_level int, security_note string"


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


# Commits


def numbers(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "n long")


def test_a_commit_changes_all_its_tables_or_none(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "store")
    first = commits.commit(spark, commits.latest(spark, folder), {"a": numbers(spark, 1), "b": numbers(spark, 10)}, "flow", 0)
    assert commits.latest(spark, folder) == first and first.number == 1
    second = commits.commit(spark, first, {"a": numbers(spark, 1, 2)}, "flow", 1)
    assert rows(second.table(spark, "a")) == [(1,), (2,)] and rows(second.table(spark, "b")) == [(10,)]
    assert rows(first.table(spark, "a")) == [(1,)]  # readers of the old snapshot are not disturbed

    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:  # a crash after the tables were written and before the manifest
        m.setattr(commits, "_publish", dies)
        with pytest.raises(RuntimeError, match="lost"):
            commits.commit(spark, second, {"a": numbers(spark, 7), "b": numbers(spark, 7)}, "flow", 2)
    assert commits.latest(spark, folder) == second and rows(commits.latest(spark, folder).table(spark, "b")) == [(10,)]
    again = commits.commit(spark, commits.latest(spark, folder), {"a": numbers(spark, 3), "b": numbers(spark, 30)}, "flow", 2)
    assert rows(again.table(spark, "a")) == [(3,)] and again.applied == {"flow": 2}
    empty = commits.commit(spark, again, {"c": numbers(spark)})
    assert commits.latest(spark, folder).table(spark, "c").count() == 0 and empty.applied == {"flow": 2}


def test_of_two_writers_one_wins_and_the_other_computes_again(spark, tmp_path):
    folder = str(tmp_path / "store")
    start = commits.commit(spark, commits.Snapshot(folder), {"a": numbers(spark, 1)})
    commits.commit(spark, start, {"a": numbers(spark, 1, 2)})
    with pytest.raises(commits.Conflict):
        commits.commit(spark, start, {"a": numbers(spark, 1, 3)})
    tries = []

    def step(before):
        tries.append(before.number)
        if len(tries) == 1:  # another writer commits while this one computes
            commits.commit(spark, before, {"a": before.table(spark, "a").union(numbers(spark, 4))})
        return {"a": before.table(spark, "a").union(numbers(spark, 5))}

    after = commits.transact(spark, folder, step, "flow", 7)
    assert tries == [2, 3] and rows(after.table(spark, "a")) == [(1,), (2,), (4,), (5,)]
    assert commits.transact(spark, folder, step, "flow", 7) == after and len(tries) == 2  # delivered again
    assert [p.name for p in (tmp_path / "store" / "manifests").iterdir() if "draft" in p.name and not p.name.endswith(".crc")] == []


def test_vacuum_keeps_what_the_last_manifests_refer_to(spark, tmp_path):
    folder = str(tmp_path / "store")
    snapshot = commits.Snapshot(folder)
    for n in range(4):
        snapshot = commits.commit(spark, snapshot, {"a": numbers(spark, n)} | ({"b": numbers(spark, 9)} if n == 0 else {}))
    gone = commits.vacuum(spark, folder, keep=2)
    assert len(gone) == 2 and all(g.startswith("a/") for g in gone)
    latest = commits.latest(spark, folder)
    assert rows(latest.table(spark, "a")) == [(3,)] and rows(latest.table(spark, "b")) == [(9,)]
    assert commits.vacuum(spark, str(tmp_path / "none")) == []


# Flows as commits


def item(source, seq, title, url, registration=None, note=None):
    return (source, seq, f"https://s.org/{source}/{seq}", title, "Robot Club", None, "2026-09-01", url, registration, 3, note)


def test_discovery_and_verification_commit_all_their_tables(spark, tmp_path):
    folder = str(tmp_path / "store")
    items = spark.createDataFrame([item("a", 1, "Spring Robot Contest", "https://c.org/e", "https://c.org/form", "odd"), item("b", 1, "spring robot contest!", "https://c.org/e/", "https://c.org/form"), item("b", 2, None, None), item(None, 3, "No source", None)], ITEM)
    connectors = spark.createDataFrame([("a", "RSS", 80)], "source_id string, source_type string, trust_score int")
    failures = spark.createDataFrame([("bad", "HTTP_500")], "source_id string, error string")
    one = state.discover(spark, folder, 0, items, failures, now(), connectors)
    assert state.discover(spark, folder, 0, items, failures, now(), connectors) == one
    t = lambda name, *columns: rows(one.table(spark, name), *columns)
    key = one.table(spark, "events").first()
    assert (key.title, key.normalized_title, key.status, key.format, key.verification_score) == ("Spring Robot Contest", "spring robot contest", "DISCOVERED", "UNKNOWN", 0)
    assert t("event_links", "link_id", "url_type", "canonical_url", "domain", "is_https", "security_status", "verification_status") == [(1, "EVENT_PAGE", "https://c.org/e", "c.org", True, "PENDING", "UNVERIFIED"), (2, "REGISTRATION", "https://c.org/form", "c.org", True, "PENDING", "UNVERIFIED")]
    assert t("event_sources", "id", "source_id", "source_level") == [(1, "a", 3), (2, "b", 3)]
    assert t("source_registry", "source_id", "source_type", "trust_score", "enabled", "last_status") == [("a", "RSS", 80, True, "OK"), ("b", "unknown", 49, True, "OK"), ("bad", "unknown", 50, True, "FAILED")]
    assert t("source_runs", "run_id", "source_id", "discovered", "rejected", "error") == [(1, "a", 1, 0, None), (2, "b", 2, 1, None), (3, "bad", 0, 0, "HTTP_500")]
    assert t("source_reputation", "source_id", "duplicates") == [("b", 1)] and len(t("dead_letter_queue")) == 1 and t("security_flags", "flag_type", "resolved") == [("EXTRACTION_WARNING", False)]

    pages = spark.createDataFrame([("https://c.org/e", 200, '<a href="https://c.org/form?utm_source=x">go</a>'), ("https://c.org/form", 200, "<p>Spring robot contest</p>")], "url string, status int, body string")

    def observed(tables):
        known = tables["events"].withColumns({"best_level": F.lit(3), "source_url": F.lit("https://s.org"), "source_trust": F.lit(80)})
        told = verification.official_context(known, pages)
        flags = {"platform_listed": False, "social": False, "dates_consistent": True, "organizer_consistent": True, "recent": True, "conflict": False, "threat": False, "has_date": True}
        return told.withColumns({k: F.lit(v) for k, v in flags.items()} | {"source_count": F.lit(2), "classification": F.lit("Hackathon"), "http_status": F.lit(200)})

    two = state.verify_events(spark, folder, 0, observed, now())
    e = two.table(spark, "events").first()
    assert (e.status, e.verification_decision, e.publishing_tier, e.registration_url, e.source_trust_score, e.freshness_score, e.relevance_score) == ("VERIFIED", "VERIFIED_OFFICIAL", "A", "https://c.org/form", 80, 100, 0)
    assert e.last_verified == e.last_link_check == T0 and e.dedupe_key == key.dedupe_key
    assert rows(two.table(spark, "link_checks"), "check_id", "link_id", "http_status", "final_url") == [(1, 2, 200, "https://c.org/form")]
    assert rows(two.table(spark, "event_links"), "link_id", "verification_status", "security_status") == [(1, "UNVERIFIED", "PENDING"), (2, "VERIFIED", "CLEAR_LOCAL_CHECKS")]
    assert rows(two.table(spark, "source_registry"), "source_id", "trust_score") == [("a", 83), ("b", 52), ("bad", 50)]
    assert rows(two.table(spark, "source_reputation"), "source_id", "valid_events", "duplicates") == [("a", 1, 0), ("b", 1, 1)]
    assert two.table(spark, "verification_evidence").count() == 3 and two.table(spark, "review_queue").count() == 0

    def resolved(found):
        return found.where("url_type = 'REGISTRATION'").select("link_id", F.lit("https://evil.org/x").alias("new_url"), F.lit(200).alias("status"), F.lit(None).cast("string").alias("error"), F.lit(False).alias("failed"))

    three = state.recheck_links(spark, folder, 0, resolved, now())
    e = three.table(spark, "events").first()
    assert (e.status, e.registration_url, e.registration_unverified_note) == ("NEEDS_REVIEW", None, links.UNVERIFIED_NOTE)
    assert rows(three.table(spark, "security_flags"), "flag_id", "flag_type", "link_id") == [(1, "EXTRACTION_WARNING", None), (2, "HOST_CHANGED", 2)]
    assert rows(three.table(spark, "review_queue"), "review_id", "reason", "resolved") == [(1, links.CHANGED_HOST, False)]
    assert rows(three.table(spark, "event_changes"), "field", "old_value", "new_value") == [("registration_url", "https://c.org/form", "https://evil.org/x")]
    assert set(three.tables) <= set(schemas.TABLES) and three.applied == {"discovery": 0, "verification": 0, "recheck": 0}


def test_dead_event_pages_teach_their_sources(spark):
    events = spark.createDataFrame([(k, "Some Contest", None, f"https://c.org/{k}", None, 2) for k in range(3)], "event_id long, title string, organizer_name string, event_url string, registration_url string, best_level int")
    pages = spark.createDataFrame([("https://c.org/0", 404, None), ("https://c.org/1", 200, "<h1>x</h1>")], "url string, status int, body string")
    told = verification.official_context(events, pages)
    assert rows(told, "event_id", "event_page_dead", "official_page", "official_domain") == [(0, True, False, "c.org"), (1, False, True, "c.org"), (2, False, False, "c.org")]
    flags = {"official_links": False, "platform_listed": False, "social": False, "dates_consistent": True, "organizer_consistent": True, "recent": True, "conflict": False, "threat": False, "has_date": True}
    whole = told.withColumns({k: F.lit(v) for k, v in flags.items()} | {"source_count": F.lit(1), "classification": F.lit("x"), "status": F.lit("DISCOVERED"), "source_url": F.lit("u"), "source_trust": F.lit(1), "identity": F.lit(None).cast("boolean")})
    out = verification.outputs(verification.verify(whole), spark.createDataFrame([], "link_id long, event_id long, url_type string"), events.select("event_id", F.lit("s").alias("source_id")), now())
    assert rows(out["outcomes"], "event_id", "outcome") == [(0, "dead_link")]


def test_unregistered_sources_get_a_row_first(spark):
    items = spark.createDataFrame([item("new", 1, "Talk", "https://e.org/1")], ITEM)
    registry = spark.createDataFrame([("old", False, 5, None, None)], "source_id string, enabled boolean, rate_limit_ms long, last_run timestamp, last_status string")
    out = discovery.run(items, registry, spark.createDataFrame([], "event_id string, dedupe_key string"), spark.createDataFrame([], "event_id string, source_url string"), spark.createDataFrame([], "source_id string, error string"), now())
    assert rows(out["results"], "source_id", "status", "inserted") == [("new", "OK", 1), ("old", "SKIPPED_DISABLED", 0)]
    assert rows(out["registry"], "source_id", "enabled", "rate_limit_ms", "last_status") == [("new", True, 2000, "OK"), ("old", False, 5, None)]


def test_equal_sightings_insert_once(spark):
    items = spark.createDataFrame([("k", 1), ("k", 1), ("k", 1), (None, 2), (None, 2)], "dedupe_key string, pos int")
    got = transitions.cluster(items, spark.createDataFrame([], "dedupe_key string"), [F.col("pos")])
    assert rows(got, "dedupe_key", "action") == [("k", "ATTACH"), ("k", "ATTACH"), ("k", "INSERT"), (None, "ATTACH"), (None, "INSERT")]


# Administrators


def test_decisions_in_turn(spark):
    events = spark.createDataFrame([(k, "NEEDS_REVIEW", T0, "X", 50) for k in "abcd"], "event_id string, status string, last_seen timestamp, verification_decision string, verification_score int")
    reviews = spark.createDataFrame([(k, False, None) for k in "abcd"], "event_id string, resolved boolean, resolution string")
    taken = [(1, "a", "approve"), (2, "a", "reject"), (1, "b", "reject"), (2, "b", "approve"), (1, "c", "reject"), (2, "c", "recheck"), (3, "c", "approve"), (4, "c", "approve"), (1, "z", "reject")]
    decisions = spark.createDataFrame([(*d, None) for d in taken], "seq int, event_id string, action string, reason string")
    out = admin.decide(events, reviews, decisions, now())
    assert rows(out["events"], "event_id", "status", "verification_score") == [("a", "REJECTED", 50), ("b", "REJECTED", 50), ("c", "VERIFIED", 0), ("d", "NEEDS_REVIEW", 50)]
    assert rows(out["reviews"]) == [("a", True, "APPROVED"), ("b", True, "REJECTED_BY_ADMIN"), ("c", True, "REJECTED_BY_ADMIN"), ("d", False, None)]
    assert rows(out["results"], "event_id", "seq", "done") == [("a", 1, True), ("a", 2, True), ("b", 1, True), ("b", 2, False), ("c", 1, True), ("c", 2, True), ("c", 3, True), ("c", 4, False), ("z", 1, False)]


def test_every_command_is_answered(spark):
    events = spark.createDataFrame([("e1", "Contest", "NEEDS_REVIEW", 50, None, None, None)], "event_id string, title string, status string, verification_score int, publishing_tier string, registration_url string, registration_unverified_note string")
    reviews = spark.createDataFrame([(4, "e1", "why " * 40, None, T0, False), (5, "e1", "late", 7, T0 + dt.timedelta(1), False), (6, "e1", "done", 1, T0, True)], "review_id long, event_id string, reason string, score int, created_at timestamp, resolved boolean")
    registry = spark.createDataFrame([("s2", 40, False, None), ("s1", 60, True, "OK")], "source_id string, trust_score int, enabled boolean, last_status string")
    empty = spark.createDataFrame([], "status string")
    shown = admin.reports(events, reviews, registry, empty, empty)
    texts = ["/help", "/review", "/approve e1", "/reject e9", "/recheck e1", "/event e1", "/feedback e1 LEGITIMATE", "/source-status", "/stats"]
    updates = spark.createDataFrame([(k, 7, t) for k, t in enumerate(texts)], "seq int, chat_id long, text string")
    told = admin.commands(updates, ["7"])
    results = spark.createDataFrame([(2, "e1", "approve", True), (3, "e9", "reject", False), (4, "e1", "recheck", True)], "seq int, event_id string, action string, done boolean")
    got = [r.reply for r in admin.answered(told, results, events, shown).orderBy("seq").collect()]
    assert got == [
        admin.HELP, f"5 e1 [7] Contest — late\n4 e1 [null] Contest — {('why ' * 40)[:80]}", "Approved e1.", "Unknown event e9.", "e1 queued for re-verification.", "Contest\nstatus=NEEDS_REVIEW score=50 tier=?\nreg=none",
        "Feedback LEGITIMATE recorded for e1.", "s1 trust=60 on last=OK\ns2 trust=40 off last=-", 'events=[{"status":"NEEDS_REVIEW","c":1}] tiers=[{"t":"NONE","c":1}] reviewOpen=2 dlq=0 sent=0',
    ]
    none = admin.reports(events, reviews.limit(0), registry.limit(0), empty, empty)
    assert {r.command: r.text for r in none.collect()}["/review"] == "Review queue is empty." and {r.command: r.text for r in none.collect()}["/source-status"] == "No sources."


def test_feedback_on_events(spark):
    events = spark.createDataFrame([("e1",), ("e2",)], "event_id string")
    sources = spark.createDataFrame([("a", 60), ("b", 2)], "source_id string, trust_score int")
    seen = spark.createDataFrame([("e1", "a"), ("e1", "a"), ("e1", "b"), ("e2", "a")], "event_id string, source_id string")
    reviews = spark.createDataFrame([("e1", False, None), ("e2", False, None)], "event_id string, resolved boolean, resolution string")
    feedback = spark.createDataFrame([(1, "e1", "WRONG_DATE"), (2, "e1", "LEGITIMATE"), (3, "e9", "LEGITIMATE")], "seq long, event_id string, label string")
    out = admin.record_feedback(events, seen, reviews, sources, feedback)
    assert rows(out["sources"]) == [("a", 55, 1, 1), ("b", 3, 1, 1)]
    assert rows(out["reviews"]) == [("e1", True, "WRONG_DATE"), ("e2", False, None)] and rows(out["results"], "event_id", "done") == [("e1", True), ("e1", True), ("e9", False)]


def test_reset_takes_all_that_refers_to_events(spark):
    tables = {
        "events": spark.createDataFrame([(1,), (2,)], "event_id long"), "event_links": spark.createDataFrame([(5, 1), (6, 2)], "link_id long, event_id long"), "link_checks": spark.createDataFrame([(1, 5), (2, 6)], "check_id long, link_id long"),
        "security_flags": spark.createDataFrame([(1, 1, 5), (2, None, 5), (3, None, 6), (4, 2, None)], "flag_id long, event_id long, link_id long"), "source_runs": spark.createDataFrame([(1,)], "run_id long"),
        "source_registry": spark.createDataFrame([("a", T0, "OK")], "source_id string, last_run timestamp, last_status string"),
    }
    out = admin.delete_rows(tables, "events", spark.createDataFrame([(1,)], "event_id long"))
    assert rows(out["event_links"]) == [(6, 2)] and rows(out["link_checks"]) == [(2, 6)] and rows(out["security_flags"]) == [(2, None, None), (3, None, 6), (4, 2, None)] and out["source_runs"].count() == 1
    out = admin.reset(tables, False)
    assert {k: v.count() for k, v in out.items()} == {"events": 0, "event_links": 0, "link_checks": 0, "security_flags": 2, "source_runs": 0, "source_registry": 1}
    assert rows(out["source_registry"]) == [("a", None, None)]


# Queues and stages


def test_retries(spark):
    later = lambda s: T0 + dt.timedelta(seconds=s)
    at = lambda s: F.expr(f"TIMESTAMP '{later(s)}'")
    queue = spark.createDataFrame([(k, "mail", "{}", "QUEUED", 0, T0 - dt.timedelta(seconds=10 - k), None, None, None) for k in range(4)] + [(9, "mail", "{}", "QUEUED", 0, later(500), None, None, None)], retries.QUEUE)
    one = retries.lease(queue, "w1", at(0), budget=3, seconds=100, most=2)
    assert rows(one["leased"], "id", "attempts", "lease") == [(k, 1, "w1") for k in range(3)]
    assert retries.lease(one["queue"], "w2", at(50), seconds=100, most=2)["leased"].select("id").collect() == [(3,)]
    results = spark.createDataFrame([(0, True, False, None, 0), (1, False, True, "busy", 300), (3, True, False, None, 0)], "id long, ok boolean, retryable boolean, error string, retry_after_s int")
    two = retries.settle(one["queue"], results, "w1", at(20), most=2)
    assert rows(two["queue"], "id", "status", "due_at") == [(0, "DONE", T0 - dt.timedelta(seconds=10)), (1, "QUEUED", later(320)), (2, "LEASED", T0 - dt.timedelta(seconds=8)), (3, "QUEUED", T0 - dt.timedelta(seconds=7)), (9, "QUEUED", later(500))]
    # the worker is lost: its lease runs out, the entry is tried again and is dead after its last attempt
    three = retries.lease(two["queue"], "w2", at(150), most=2, seconds=100)
    assert rows(three["leased"], "id", "attempts") == [(2, 2), (3, 1)]
    late = retries.settle(three["queue"], spark.createDataFrame([(2, True, False, None)], "id long, ok boolean, retryable boolean, error string"), "w1", at(160), most=2)
    assert rows(late["queue"].where("id = 2"), "status", "lease") == [("LEASED", "w2")]  # another's result
    four = retries.lease(late["queue"], "w3", at(260), most=2)
    assert rows(four["queue"].where("id = 2"), "status", "error") == [("DEAD", "LEASE_EXPIRED")] and rows(four["dead_letters"]) == [("mail", "{}", "LEASE_EXPIRED", 2)]
    five = retries.settle(three["queue"], spark.createDataFrame([(2, False, True, "busy"), (3, False, False, "no")], "id long, ok boolean, retryable boolean, error string"), "w2", at(170), most=2)
    assert rows(five["dead_letters"], "error", "attempts") == [("busy", 2), ("no", 1)]


def test_one_bad_row_does_not_stop_the_others(spark):
    data = spark.createDataFrame([(k, T0 + dt.timedelta(hours=-k)) for k in range(10)], "id long, waited timestamp")

    def step(row):
        if row["id"] == 7:
            raise ValueError("poison")
        return {"double": row["id"] * 2, "name": f"n{row['id']}"}

    stages = [
        isolation.Stage("work", isolation.by_row(step, "double long, name string"), 5, (F.col("waited"),)),
        isolation.Stage("check", isolation.by_columns({"half": F.col("double") / 4}, F.when(F.col("double") == 18, "TOO_MUCH"))),
    ]
    out = isolation.run(data, stages, ["id"])
    assert rows(out["done"], "id", "name", "half") == [(5, "n5", 2.5), (6, "n6", 3.0), (8, "n8", 4.0)]
    assert [(r.queue, json.loads(r.payload)["id"], r.error) for r in out["dead_letters"].orderBy("queue").collect()] == [("check", 9, "TOO_MUCH"), ("work", 7, "ValueError: poison")]
    assert rows(out["left"]) == [(k, "work") for k in range(5)]
    told = isolation.report_map(out["report"]).first().stages
    assert {k: tuple(v) for k, v in told.items()} == {"work": (5, 4, 1, 5), "check": (4, 3, 1, 0)}


# The web


@pytest.mark.parametrize(
    ("text", "agent", "url", "allowed"),
    [
        ("User-agent: *\nDisallow: /\nAllow: /events", "bot", "https://a.org/events/1", True), ("User-agent: *\nDisallow: /\nAllow: /events", "bot", "https://a.org/x", False), ("", "bot", "https://a.org", True),
        ("User-agent: other\nDisallow: /\nUser-agent: *\nDisallow: /private # no\nDisallow:", "bot", "https://a.org/private?x", False), ("User-agent: bot\nUser-agent: cat\nDisallow: /a\n\nUser-agent: *\nDisallow: /b", "bot", "https://a.org/b", True),
        ("User-agent: *\nDisallow: /a?b\nAllow: /a?b", "bot", "https://a.org/a?bc", True), ("Disallow: /\nUser-agent: x\nDisallow: /x", "bot", "https://a.org/x", True),
    ],
)
def test_robots_rules_decide_as_columns_do(spark, text, agent, url, allowed):
    from trustmill.functions.feeds import is_allowed, robots_rules

    assert web.robots_allow(web.robots_rules_of(text, agent), url) == allowed
    rules = robots_rules(spark.createDataFrame([("a.org", text)], "host string, text string"), agent)
    assert rules.select(is_allowed(F.col("allows"), F.col("disallows"), F.lit(url))).first()[0] == allowed


def test_robots_files_hold_for_an_hour(spark):
    cached = spark.createDataFrame([("a.org", "A", T0 - dt.timedelta(minutes=59)), ("b.org", "B", T0 - dt.timedelta(minutes=61))], "host string, text string, fetched_at timestamp")
    hosts = spark.createDataFrame([("a.org",), ("b.org",), ("c.org",), ("c.org",), (None,)], "host string")
    fetch = lambda urls: urls.select("url", F.lit(200).alias("status"), F.lit(None).cast("string").alias("final_url"), F.lit("new").alias("body"), F.lit(None).cast("string").alias("error"))
    assert rows(web.checked_robots(hosts, cached, fetch, now()), "host", "text") == [("a.org", "A"), ("b.org", "new"), ("c.org", "new")]


def test_redirect_chains(spark):
    hops = [(f"https://h.org/{k}", 301, f"/{k + 1}") for k in range(9)] + [("https://a.org", 302, "javascript:alert(1)"), ("https://l.org/1", 302, "https://l.org/2"), ("https://l.org/2", 302, "https://l.org/1"), ("https://x.org", 404, None), ("https://n.org", 302, None)]
    urls = ["https://h.org/0", "https://h.org/6", "https://a.org", "https://l.org/1", "https://x.org", "https://n.org", "https://unknown.org", "https://unknown.org"]
    got = transitions.redirect_chains(spark.createDataFrame([(u,) for u in urls], "url string"), spark.createDataFrame(hops, "url string, status int, target string"))
    by = {r.url: r for r in got.collect()}
    assert len(by) == 7 and got.count() == 7
    first = by["https://h.org/0"]
    assert (first.final_url, first.redirects, first.error, first.loops) == ("https://h.org/5", 5, "TOO_MANY_REDIRECTS", False) and [tuple(c) for c in first.chain] == [(f"https://h.org/{k}", 301) for k in range(6)]
    assert (by["https://h.org/6"].final_url, by["https://h.org/6"].redirects, by["https://h.org/6"].error, by["https://h.org/6"].chain[-1].status) == ("https://h.org/9", 3, None, 200)
    assert (by["https://a.org"].final_url, by["https://a.org"].error) == ("https://a.org", "DANGEROUS_REDIRECT_SCHEME") and (by["https://l.org/1"].error, by["https://l.org/1"].loops) == ("TOO_MANY_REDIRECTS", True)
    assert (by["https://x.org"].chain[0].status, by["https://x.org"].error) == (404, None) and by["https://n.org"].redirects == 0 and by["https://unknown.org"].chain[0].status == 200
