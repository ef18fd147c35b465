"""Queries over whole flows: discovery, connectors, verification outputs and what administrators do."""

from __future__ import annotations

from pyspark.sql import functions as F

from trustmill.plans.bridge import NOW, table, view, with_views
from trustmill.plans.catalogue import ORG_SQL, TITLE_SQL, now, query

ITEMS = """SELECT source || '-' || doc_id % 6 AS source_id, doc_id AS seq, CASE WHEN doc_id % 11 = 0 THEN '  ' ELSE lang || ' talk ' || CAST(floor(n_chars / 100) AS BIGINT) END AS title, source AS organizer,
  'https://e.org/' || lang AS event_url FROM documents"""
FOUND = f"""WITH i AS ({ITEMS}), k AS (SELECT *, CASE WHEN trim(title) <> '' THEN {TITLE_SQL.format(c='title')} || '|' || {ORG_SQL.format(c='organizer')} || '||' || event_url END AS key FROM i),
known AS (SELECT DISTINCT key FROM k WHERE seq % 50 = 1 AND key IS NOT NULL),
r AS (SELECT DISTINCT source_id, CASE right(source_id, 1) WHEN '2' THEN 'SKIPPED_DISABLED' WHEN '3' THEN 'SKIPPED_RATE_LIMIT' WHEN '4' THEN 'FAILED' ELSE 'OK' END AS status FROM k WHERE source_id IS NOT NULL),
t AS (SELECT k.*, CASE WHEN k.key IS NULL THEN NULL WHEN n.key IS NULL AND row_number() OVER (PARTITION BY k.key ORDER BY k.source_id, k.seq) = 1 THEN 'INSERT' ELSE 'ATTACH' END AS action FROM k JOIN r ON k.source_id = r.source_id LEFT JOIN known n ON k.key = n.key WHERE r.status = 'OK')
"""


def _discovery(spark, d) -> dict:
    from trustmill.operators import discovery

    none = F.lit(None).cast("string")
    docs = table(spark, d, "documents")
    items = spark.sql(ITEMS.replace("FROM documents", "FROM {documents}"), documents=docs).select(
        "source_id", "seq", F.concat(F.lit("https://s.org/"), "seq").alias("source_url"), "title", "organizer", none.alias("format"), none.alias("start_date"), "event_url", none.alias("registration_url"), F.lit(5).alias("source_level"),
        F.when(F.col("seq") % 13 == 0, "INJECTION_PATTERNS_NEUTRALIZED:x").alias("security_note"),
    )
    kind = F.right("source_id", F.lit(1))
    # the sources numbered 1 are not in the registry
    registry = items.where("source_id is not null").select("source_id").distinct().where(kind != "1").select("source_id", (kind != "2").alias("enabled"), F.lit(3_600_000).alias("rate_limit_ms"), F.when(kind == "3", now() - F.expr("INTERVAL '30' MINUTE")).when(kind == "5", now() - F.expr("INTERVAL '2' HOUR")).alias("last_run"), none.alias("last_status"))
    known = discovery.keyed(items).where("seq % 50 = 1 and title is not null").select("dedupe_key").distinct().select(F.concat(F.lit("known-"), F.sha2("dedupe_key", 256)).alias("event_id"), "dedupe_key")
    failures = registry.where(kind == "4").select("source_id", F.lit("TIMEOUT").alias("error"))
    return discovery.run(items, registry, known, spark.createDataFrame([], "event_id string, source_url string"), failures, now())


@query(FOUND + """SELECT r.source_id, r.status, CASE WHEN r.status = 'FAILED' THEN 'TIMEOUT' END AS error, count(t.seq) AS discovered, count(*) FILTER (t.action = 'INSERT') AS inserted, count(*) FILTER (t.action = 'ATTACH') AS attached, count(*) FILTER (t.seq IS NOT NULL AND t.action IS NULL) AS rejected
FROM r LEFT JOIN t ON r.source_id = t.source_id GROUP BY r.source_id, r.status""")
def discovery_run(spark, d):
    return _discovery(spark, d)["results"]


@query(FOUND + """, e AS (SELECT key, seq FROM t WHERE action = 'INSERT') SELECT 'events' AS output, count(*) AS n, CAST(sum(seq) AS BIGINT) AS total FROM e
UNION ALL SELECT 'event_sources', count(*), CAST(sum(seq) AS BIGINT) FROM t WHERE key IS NOT NULL
UNION ALL SELECT 'outcomes', count(*), CAST(sum(seq) AS BIGINT) FROM t WHERE action = 'ATTACH' UNION ALL SELECT 'flags', count(*), NULL FROM e WHERE seq % 13 = 0
UNION ALL SELECT 'runs', count(*), NULL FROM r WHERE status IN ('OK', 'FAILED') UNION ALL SELECT 'dead_letters', count(*), NULL FROM r WHERE status = 'FAILED'""")
def discovery_outputs(spark, d):
    out = _discovery(spark, d)
    number = F.regexp_extract("source_url", "([0-9]+)$", 1).cast("long")
    seqs = out["outcomes"].select(F.sum("seq").alias("total"), F.count(F.lit(1)).alias("n"))
    firsts = out["event_sources"].select(F.sum(number).alias("total"), F.count(F.lit(1)).alias("n"))
    # a new event's own item is the first of its key
    sizes = {"flags": out["flags"], "runs": out["runs"], "dead_letters": out["dead_letters"]}
    none = F.lit(None).cast("long")
    rows = [seqs.select(F.lit("outcomes").alias("output"), "n", "total"), firsts.select(F.lit("event_sources").alias("output"), "n", "total")]
    rows += [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("output"), "n", none.alias("total")) for k, df in sizes.items()]
    new = out["events"].select("event_id").join(out["event_sources"], "event_id").groupBy("event_id").agg(F.min_by(number, F.struct("source_id", number)).alias("seq"))
    rows.append(new.agg(F.count(F.lit(1)).alias("n"), F.sum("seq").alias("total")).select(F.lit("events").alias("output"), "n", "total"))
    union = rows[0]
    for r in rows[1:]:
        union = union.unionByName(r)
    return union


ROWS = """, ids AS (SELECT t.*, CASE WHEN n.key IS NULL THEN 'evt_' || left(sha256(t.key), 20) ELSE 'known-' || sha256(t.key) END AS event_id FROM t LEFT JOIN known n ON t.key = n.key WHERE t.key IS NOT NULL)
SELECT 'events' AS output, event_id AS id, title AS a, event_url AS b, CAST(NULL AS BIGINT) AS n FROM ids WHERE action = 'INSERT'
UNION ALL SELECT 'links', event_id, 'EVENT_PAGE', event_url, 0 FROM ids WHERE action = 'INSERT'
UNION ALL SELECT 'event_sources', event_id, source_id, 'https://s.org/' || seq, 5 FROM ids
UNION ALL SELECT 'outcomes', source_id, 'duplicate', NULL, seq FROM ids WHERE action = 'ATTACH'
UNION ALL SELECT DISTINCT 'seen', event_id, NULL, NULL, CAST(NULL AS BIGINT) FROM ids WHERE action = 'ATTACH'
UNION ALL SELECT 'flags', event_id, 'EXTRACTION_WARNING', 'INJECTION_PATTERNS_NEUTRALIZED:x', NULL FROM ids WHERE action = 'INSERT' AND seq % 13 = 0
UNION ALL SELECT 'runs', r.source_id, NULL, CASE WHEN r.status = 'FAILED' THEN 'TIMEOUT' END, count(t.seq) FROM r LEFT JOIN t ON r.source_id = t.source_id WHERE r.status IN ('OK', 'FAILED') GROUP BY 2, r.status
UNION ALL SELECT 'registry', source_id, CASE WHEN status IN ('OK', 'FAILED') THEN status END, 'true', CASE WHEN right(source_id, 1) = '1' THEN 2000 ELSE 3600000 END FROM r WHERE status <> 'SKIPPED_DISABLED'
UNION ALL SELECT 'dead_letters', source_id, 'discovery', 'TIMEOUT', 1 FROM r WHERE status = 'FAILED'"""


@query(FOUND + ROWS)
def discovery_rows(spark, d):
    out, none, number = _discovery(spark, d), F.lit(None).cast("string"), F.lit(None).cast("long")
    long = lambda c: F.col(c).cast("long")
    shown = {
        "events": ("event_id", "title", "event_url", number), "links": ("event_id", "url_type", "canonical_url", long("redirect_count")), "event_sources": ("event_id", "source_id", "source_url", long("source_level")),
        "outcomes": ("source_id", "outcome", none, long("seq")), "seen": ("event_id", none, none, number), "flags": ("event_id", "flag_type", "details", number), "runs": ("source_id", none, "error", long("discovered")),
        "registry": ("source_id", "last_status", F.col("enabled").cast("string"), long("rate_limit_ms")), "dead_letters": (F.get_json_object("payload", "$.source_id"), "queue", "error", long("attempts")),
    }
    rows = [out[k].select(F.lit(k).alias("output"), *((c if isinstance(c, F.Column) else F.col(c)).alias(x) for c, x in zip(v, ("id", "a", "b", "n"), strict=True))) for k, v in shown.items()]
    whole = rows[0]
    for r in rows[1:]:
        whole = whole.unionByName(r)
    # the disabled sources are left as they are
    return whole.where("output <> 'registry' or b = 'true'")


DECIDED = """e AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'NEEDS_REVIEW' ELSE status END AS status, first_seen AS last_seen, 'UNVERIFIED' AS verification_decision, 50 AS verification_score FROM m_events)"""
TAKEN = f"""{DECIDED}, raw AS (SELECT *, CASE event_id % 5 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' WHEN 2 THEN 'recheck' END AS one, CASE WHEN event_id % 5 < 3 AND event_id % 9 = 0 THEN CASE event_id % 4 WHEN 1 THEN 'reject' WHEN 2 THEN 'recheck' ELSE 'approve' END END AS two FROM e),
x AS (SELECT *, CASE WHEN one <> 'approve' OR status IN ('NEEDS_REVIEW', 'SUSPICIOUS', 'DISCOVERED') THEN one END AS first, CASE WHEN two <> 'approve' OR one = 'recheck' THEN two END AS second FROM raw),
y AS (SELECT *, coalesce(second, first) AS act, coalesce(first = 'recheck' OR second = 'recheck', false) OR coalesce(second = 'recheck', false) AS rechecked, CASE WHEN first IN ('approve', 'reject') THEN first WHEN second IN ('approve', 'reject') THEN second END AS closing FROM x)"""


@query(with_views("m_events") + f""", {TAKEN}
SELECT event_id, CASE act WHEN 'approve' THEN 'VERIFIED' WHEN 'reject' THEN 'REJECTED' WHEN 'recheck' THEN 'DISCOVERED' ELSE status END AS status, CAST(CASE WHEN rechecked THEN 0 ELSE 50 END AS INT) AS verification_score, CASE WHEN NOT rechecked THEN 'UNVERIFIED' END AS verification_decision,
  CASE WHEN act IS NULL THEN last_seen ELSE {NOW} END AS last_seen, CASE WHEN event_id % 2 = 0 THEN event_id % 4 = 0 OR closing IS NOT NULL END AS resolved, CASE WHEN event_id % 4 = 2 AND closing = 'approve' THEN 'APPROVED' WHEN event_id % 4 = 2 AND closing = 'reject' THEN CASE WHEN event_id % 7 = 0 THEN 'SPAM' ELSE 'REJECTED_BY_ADMIN' END END AS resolution FROM y""")
def admin_decisions(spark, d):
    from trustmill.operators.admin import decide

    e = view(spark, d, "m_events")
    events = e.select("event_id", F.when(F.col("event_id") % 3 == 0, "NEEDS_REVIEW").otherwise(F.col("status")).alias("status"), F.col("first_seen").alias("last_seen"), F.lit("UNVERIFIED").alias("verification_decision"), F.lit(50).alias("verification_score"))
    reviews = e.where("event_id % 2 = 0").select("event_id", (F.col("event_id") % 4 == 0).alias("resolved"), F.lit(None).cast("string").alias("resolution"))
    k = F.col("event_id") % 5
    reason = F.when(F.col("event_id") % 7 == 0, "SPAM").alias("reason")
    again = F.col("event_id") % 4
    one = e.where(k < 3).select(F.lit(1).alias("seq"), "event_id", F.when(k == 0, "approve").when(k == 1, "reject").otherwise("recheck").alias("action"), reason)
    two = e.where((k < 3) & (F.col("event_id") % 9 == 0)).select(F.lit(2).alias("seq"), "event_id", F.when(again == 1, "reject").when(again == 2, "recheck").otherwise("approve").alias("action"), reason)
    out = decide(events, reviews, one.unionByName(two), now())
    return out["events"].join(out["reviews"], "event_id", "left")


@query(with_views("m_events", "m_sources", "m_notifications") + """, r AS (SELECT event_id, 'Event ' || event_id AS title, first_seen FROM m_events WHERE event_id % 3 = 0 ORDER BY first_seen DESC, event_id LIMIT 10),
s AS (SELECT status, count(*) AS c FROM m_events GROUP BY status), t AS (SELECT publishing_tier AS t, count(*) AS c FROM m_events GROUP BY 1)
SELECT '/review' AS command, string_agg(event_id || ' ' || event_id || ' [' || CASE WHEN event_id % 2 = 0 THEN '50' ELSE 'null' END || '] ' || title || ' — ' || left('waits ' || repeat('x', 100), 80), chr(10) ORDER BY first_seen DESC, event_id) AS text FROM r
UNION ALL SELECT '/source-status', string_agg('s' || source_id || ' trust=' || trust_score || CASE WHEN enabled = 1 THEN ' on' ELSE ' off' END || ' last=' || CASE WHEN source_id % 2 = 0 THEN 'OK' ELSE '-' END, chr(10) ORDER BY 's' || source_id) FROM m_sources
UNION ALL SELECT '/stats', 'events=[' || (SELECT string_agg('{"status":"' || status || '","c":' || c || '}', ',' ORDER BY status) FROM s) || '] tiers=[' || (SELECT string_agg('{"t":"' || t || '","c":' || c || '}', ',' ORDER BY t) FROM t) || '] reviewOpen=' || (SELECT count(*) FROM m_events WHERE event_id % 3 = 0)
  || ' dlq=' || (SELECT count(*) FROM events WHERE event_type = 'error') || ' sent=' || (SELECT count(*) FROM m_notifications WHERE status = 'SENT')""")
def admin_reports(spark, d):
    from trustmill.operators.admin import reports

    e = view(spark, d, "m_events").withColumn("title", F.concat(F.lit("Event "), "event_id"))
    reviews = e.select(F.col("event_id").alias("review_id"), "event_id", F.concat(F.lit("waits "), F.repeat(F.lit("x"), 100)).alias("reason"), F.when(F.col("event_id") % 2 == 0, 50).alias("score"), F.col("first_seen").alias("created_at"), (F.col("event_id") % 3 != 0).alias("resolved"))
    registry = view(spark, d, "m_sources").select(F.concat(F.lit("s"), "source_id").alias("source_id"), "trust_score", "enabled", F.when(F.col("source_id") % 2 == 0, "OK").alias("last_status"))
    return reports(e, reviews, registry, table(spark, d, "events").where("event_type = 'error'"), view(spark, d, "m_notifications"))


@query("""WITH u AS (SELECT event_id AS update_id, user_id % 3 AS chat_id, event_id % 8 AS k, event_id % 400 AS id, row_number() OVER (PARTITION BY event_id % 400, user_id % 3 IN (1, 2) ORDER BY event_id) AS turn FROM events), o AS (SELECT o_orderkey AS id, o_orderstatus AS s FROM orders)
SELECT update_id, CASE k WHEN 0 THEN 'Commands:' || chr(10) || '/review' || chr(10) || '/approve EVENT_ID' || chr(10) || '/reject EVENT_ID' || chr(10) || '/recheck EVENT_ID' || chr(10) || '/event EVENT_ID' || chr(10) || '/feedback EVENT_ID LABEL' || chr(10) || '/source-status' || chr(10) || '/stats'
  WHEN 1 THEN CASE WHEN s = 'O' AND turn = 1 THEN 'Approved ' || u.id || '.' ELSE 'Nothing to approve for ' || u.id || '.' END WHEN 2 THEN CASE WHEN s IS NOT NULL THEN 'Rejected ' || u.id || '.' ELSE 'Unknown event ' || u.id || '.' END WHEN 3 THEN 'Usage: /recheck EVENT_ID'
  WHEN 4 THEN 'LABEL must be one of: FALSE_POSITIVE, FALSE_LINK, WRONG_EVENT, WRONG_DATE, DUPLICATE, LEGITIMATE' WHEN 5 THEN CASE WHEN s IS NOT NULL THEN 'Feedback DUPLICATE recorded for ' || u.id || '.' ELSE 'Unknown event ' || u.id || '.' END
  WHEN 6 THEN 'Unknown command. Send /help.' ELSE CASE WHEN s IS NOT NULL THEN 'Order ' || u.id || chr(10) || 'status=' || s || ' score=50 tier=?' || chr(10) || 'reg=none' ELSE 'Unknown event ' || u.id || '.' END END AS reply
FROM u LEFT JOIN o ON u.id = o.id WHERE chat_id IN (1, 2)""")
def admin_commands(spark, d):
    from trustmill.operators import admin

    none = F.lit(None).cast("string")
    o = table(spark, d, "orders")
    shown = o.select(F.col("o_orderkey").cast("string").alias("event_id"), F.concat(F.lit("Order "), "o_orderkey").alias("title"), F.col("o_orderstatus").alias("status"), F.lit(50).alias("verification_score"), none.alias("publishing_tier"), none.alias("registration_url"), none.alias("registration_unverified_note"))
    k, e = F.col("event_id") % 8, (F.col("event_id") % 400).cast("string")
    text = F.when(k == 0, " /help ").when(k == 1, F.concat(F.lit("/approve  "), e)).when(k == 2, F.concat(F.lit("/reject "), e)).when(k == 3, "/recheck").when(k == 4, F.concat(F.lit("/feedback "), e, F.lit(" NOPE"))).when(k == 5, F.concat(F.lit("/feedback "), e, F.lit(" DUPLICATE"))).when(k == 6, "hello").otherwise(F.concat(F.lit("/event "), e))
    updates = table(spark, d, "events").select(F.col("event_id").alias("update_id"), (F.col("user_id") % 3).alias("chat_id"), text.alias("text"))
    told = admin.commands(updates, ["1", "2"])
    told = told.withColumnRenamed("update_id", "seq")
    decisions = told.where(F.col("command").isin("/approve", "/reject") & F.col("reply").isNull()).select("seq", "event_id", F.substring("command", 2, 20).alias("action"), none.alias("reason"))
    # the orders that are open wait for an approval
    waiting = shown.select("event_id", F.when(F.col("status") == "O", "NEEDS_REVIEW").otherwise("VERIFIED").alias("status"), now().alias("last_seen"), none.alias("verification_decision"), "verification_score")
    reviews = spark.createDataFrame([], "event_id string, resolved boolean, resolution string")
    results = admin.decide(waiting, reviews, decisions, now())["results"]
    return admin.answered(told, results, shown).select(F.col("seq").alias("update_id"), "reply")


@query("""WITH p AS (SELECT page_id, page_id // 40 AS k, 'feed-' || page_id // 40 AS source_id, row_number() OVER (PARTITION BY page_id // 40 ORDER BY page_id) - 1 AS pos, replace(url, '&', '&amp;') AS url FROM pages)
SELECT source_id, CAST(pos AS INT) AS seq, CASE WHEN page_id % 5 = 0 THEN 'https://f.org/' || source_id ELSE url END AS source_url, 'Talk ' || page_id AS title, CAST(0.4 AS DOUBLE) AS confidence, NULL AS error FROM p WHERE pos < 20 AND NOT starts_with(source_id, 'feed-5') AND k % 7 <> 6
UNION ALL SELECT DISTINCT source_id, NULL, NULL, NULL, NULL, CASE WHEN starts_with(source_id, 'feed-5') THEN 'RSS fetch failed (https://f.org/' || source_id || '): BLOCKED_BY_ROBOTS_TXT' ELSE 'RSS parse failed: UNRECOGNIZED_FEED' END FROM p WHERE starts_with(source_id, 'feed-5') OR k % 7 = 6""")
def feed_connector(spark, d):
    from trustmill.sources import connectors

    none = F.lit(None).cast("string")
    link = F.when(F.col("page_id") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("<link>"), F.replace("url", F.lit("&"), F.lit("&amp;amp;")), F.lit("</link>")))
    item = F.concat(F.lit("<item><title>Talk "), "page_id", F.lit("</title>"), link, F.lit("</item>"))
    # feeds of 40 items each, as many as there are pages for
    pages = table(spark, d, "pages").select(F.expr("page_id div 40").alias("k"), F.struct("page_id", item.alias("item")).alias("i"))
    body = F.concat(F.lit("<rss><channel>"), F.array_join(F.transform(F.array_sort(F.collect_list("i")), lambda i: i["item"]), ""), F.lit("</channel></rss>"))
    feeds = pages.groupBy("k").agg(body.alias("body")).select(F.concat(F.lit("https://f.org/feed-"), "k").alias("url"), F.lit(200).alias("status"), none.alias("final_url"), F.when(F.col("k") % 7 == 6, "<html>").otherwise(F.col("body")).alias("body"), none.alias("error"))
    robots = spark.createDataFrame([("f.org", "User-agent: *\nDisallow: /feed-5")], "host string, text string")
    seeds = feeds.select(F.regexp_extract("url", "(feed-[0-9]+)$", 1).alias("slug"), F.col("url").alias("feed_url"))
    items, failures = connectors.from_feeds(seeds, connectors.guarded(feeds, robots, "trustmill"))
    told = items.select("source_id", "seq", "source_url", "title", "confidence", none.alias("error"))
    return told.unionByName(failures, allowMissingColumns=True)


@query("""WITH s AS (SELECT s_suppkey AS k, 's' || s_suppkey % 70 AS slug, CASE s_suppkey % 3 WHEN 0 THEN 'rss' WHEN 1 THEN 'sitemap' ELSE 'search' END AS kind, CASE WHEN s_suppkey % 11 = 0 THEN 'http' ELSE 'https' END || '://' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') || '.org' AS base_url,
  CAST(floor(abs(s_acctbal)) AS INT) % 110 AS trust, CASE WHEN s_suppkey % 13 = 0 THEN 1000 ELSE 3600000 END AS rate FROM supplier)
SELECT slug, base_url, kind, trust, concat_ws(',', CASE WHEN row_number() OVER (PARTITION BY slug ORDER BY base_url) > 1 THEN 'DUPLICATE_SLUG' END, CASE WHEN trust > 100 THEN 'BAD_TRUST' END, CASE WHEN starts_with(base_url, 'http:') THEN 'NON_HTTPS_BASE' END, CASE WHEN kind = 'rss' AND k % 17 = 0 THEN 'RSS_WITHOUT_FEED' END, CASE WHEN rate < 60000 THEN 'RATE_LIMIT_TOO_LOW' END) AS errors FROM s""")
def registry_seeds(spark, d):
    from trustmill.sources.seeds import validate

    k = F.col("s_suppkey")
    seeds = table(spark, d, "supplier").select(
        F.concat(F.lit("s"), k % 70).alias("slug"), F.when(k % 3 == 0, "rss").when(k % 3 == 1, "sitemap").otherwise("search").alias("kind"), F.concat(F.when(k % 11 == 0, "http").otherwise("https"), F.lit("://"), F.lpad(k.cast("string"), 9, "0"), F.lit(".org")).alias("base_url"),
        F.when(k % 17 != 0, "https://f.org").alias("feed_url"), (F.floor(F.abs("s_acctbal")).cast("int") % 110).alias("trust"), F.when(k % 13 == 0, 1000).otherwise(3_600_000).alias("rate_limit_ms"),
    )
    return validate(seeds).select("slug", "base_url", "kind", "trust", F.concat_ws(",", "errors").alias("errors"))


@query("""WITH l AS (SELECT o_orderkey * 2 + k AS link_id, o_orderkey AS event_id, CASE WHEN k = 1 THEN 'REGISTRATION' ELSE 'EVENT_PAGE' END AS url_type, 'https://h' || (o_custkey + k) % 10 || '.org/x' AS old,
  CASE WHEN o_custkey % 7 <> 0 THEN 'https://h' || o_orderkey % 10 || '.org/x' END AS new, o_custkey % 13 = 0 AS failed, 'h' || (o_custkey + k) % 10 || '.org' AS a, 'h' || o_orderkey % 10 || '.org' AS b FROM orders, (VALUES (0), (1)) AS two(k)),
o AS (SELECT *, CASE WHEN failed THEN 'error' WHEN new IS NULL THEN 'unreachable' WHEN a <> b THEN 'host_changed' ELSE 'unchanged' END AS outcome FROM l), moved AS (SELECT DISTINCT event_id FROM o WHERE outcome = 'host_changed' AND url_type = 'REGISTRATION')
SELECT 'links' AS output, link_id AS id, CASE WHEN outcome IN ('host_changed', 'unchanged') THEN new ELSE old END AS a, CASE outcome WHEN 'host_changed' THEN 'FLAGGED' WHEN 'unreachable' THEN 'UNREACHABLE' ELSE 'PENDING' END AS b FROM o
UNION ALL SELECT 'checks', link_id, CASE WHEN outcome = 'unreachable' THEN old WHEN outcome <> 'error' THEN new END, CASE outcome WHEN 'unreachable' THEN 'UNRESOLVABLE' WHEN 'error' THEN 'boom' END FROM o
UNION ALL SELECT 'flags', link_id, 'HOST_CHANGED', a || ' -> ' || b FROM o WHERE outcome = 'host_changed'
UNION ALL SELECT 'changes', event_id, CASE WHEN url_type = 'REGISTRATION' THEN 'registration_url' ELSE 'event_url' END, old || ' -> ' || new FROM o WHERE outcome = 'host_changed'
UNION ALL SELECT 'reviews', event_id, CASE outcome WHEN 'host_changed' THEN 'LINK_REVIEW_REQUIRED: advertised link now resolves to a different host' ELSE 'LINK_REVIEW_REQUIRED: link unresolvable (UNRESOLVABLE)' END, NULL FROM o WHERE outcome IN ('host_changed', 'unreachable')
UNION ALL SELECT 'events', o_orderkey, CASE WHEN m.event_id IS NOT NULL AND o_orderstatus = 'F' THEN 'NEEDS_REVIEW' WHEN o_orderstatus = 'F' THEN 'VERIFIED' ELSE 'UPDATED' END, CASE WHEN m.event_id IS NULL THEN 'form' ELSE 'Registration link changed destination and requires re-verification.' END FROM orders LEFT JOIN moved m ON o_orderkey = m.event_id""")
def link_recheck_rows(spark, d):
    from trustmill.operators.links import recheck

    host = lambda n: F.concat(F.lit("https://h"), n % 10, F.lit(".org/x"))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), "o_custkey", "o_orderdate", F.explode(F.array(F.lit(0), F.lit(1))).alias("k")).withColumn("link_id", F.col("event_id") * 2 + F.col("k"))
    links = orders.select("link_id", "event_id", F.when(F.col("k") == 1, "REGISTRATION").otherwise("EVENT_PAGE").alias("url_type"), host(F.col("o_custkey") + F.col("k")).alias("final_url"), F.lit(None).cast("string").alias("domain"), F.col("o_orderdate").alias("last_checked"), F.lit("PENDING").alias("security_status"))
    failed = F.col("o_custkey") % 13 == 0
    resolved = orders.select("link_id", F.when(F.col("o_custkey") % 7 != 0, host(F.col("event_id"))).alias("new_url"), F.lit(200).alias("status"), F.when(failed, "boom").alias("error"), failed.alias("failed"))
    events = table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), F.when(F.col("o_orderstatus") == "F", "VERIFIED").otherwise("UPDATED").alias("status"), F.lit("form").alias("registration_url"), F.lit(None).cast("string").alias("registration_unverified_note"))
    out = recheck(links, resolved, now(), events)
    none = F.lit(None).cast("string")
    shown = {
        "links": ("link_id", F.col("final_url"), F.col("security_status")), "checks": ("link_id", F.col("final_url"), F.col("error")), "flags": ("link_id", F.col("flag_type"), F.col("details")),
        "changes": ("event_id", F.col("field"), F.concat("old_value", F.lit(" -> "), "new_value")), "reviews": ("event_id", F.col("reason"), none), "events": ("event_id", F.col("status"), F.coalesce("registration_url", "registration_unverified_note")),
    }
    rows = [out[k].select(F.lit(k).alias("output"), F.col(i).alias("id"), a.alias("a"), b.alias("b")) for k, (i, a, b) in shown.items()]
    whole = rows[0]
    for r in rows[1:]:
        whole = whole.unionByName(r)
    return whole


@query("""WITH RECURSIVE hops AS (SELECT 'https://p.org/' || p_partkey AS url, CASE WHEN p_partkey % 2 = 0 THEN 302 WHEN p_partkey % 5 = 0 THEN 404 ELSE 200 END AS status,
  CASE WHEN p_partkey % 2 = 0 THEN CASE WHEN p_partkey % 22 = 0 THEN 'ftp://p.org/x' WHEN p_partkey % 64 = 0 THEN 'https://p.org/' || p_partkey WHEN p_partkey % 3 = 0 THEN '/' || p_partkey // 2 ELSE 'https://p.org/' || p_partkey // 2 END END AS target FROM part),
w AS (SELECT url, url AS cur, 0 AS k, '' AS chain, 0 AS n, CAST(NULL AS VARCHAR) AS error, false AS over FROM hops
UNION ALL SELECT w.url, CASE WHEN leads AND web AND k < 5 THEN nxt ELSE cur END, k + 1, chain || CASE WHEN k = 0 THEN '' ELSE ' ' END || coalesce(status, 200) || ' ' || cur, n + 1,
  CASE WHEN leads AND NOT web THEN 'DANGEROUS_REDIRECT_SCHEME' WHEN leads AND k = 5 THEN 'TOO_MANY_REDIRECTS' END, NOT (leads AND web AND k < 5)
  FROM (SELECT w.*, h.status, coalesce(h.status BETWEEN 300 AND 399, false) AS leads, coalesce(target NOT LIKE 'ftp:%', true) AS web, CASE WHEN target LIKE '/%' THEN 'https://p.org' || target ELSE target END AS nxt FROM w LEFT JOIN hops h ON w.cur = h.url WHERE NOT over) w)
SELECT url, cur AS final_url, chain, n - 1 AS redirects, error, len(list_distinct(list_filter(string_split(chain, ' '), lambda x: starts_with(x, 'http')))) < n AS loops FROM w WHERE over""")
def redirect_chains(spark, d):
    from trustmill.operators.transitions import redirect_chains as f

    k = F.col("p_partkey")
    url = F.concat(F.lit("https://p.org/"), k)
    half = F.expr("p_partkey div 2").cast("string")
    target = F.when(k % 22 == 0, "ftp://p.org/x").when(k % 64 == 0, url).when(k % 3 == 0, F.concat(F.lit("/"), half)).otherwise(F.concat(F.lit("https://p.org/"), half))
    hops = table(spark, d, "part").select(url.alias("url"), F.when(k % 2 == 0, 302).when(k % 5 == 0, 404).otherwise(200).alias("status"), F.when(k % 2 == 0, target).alias("target"))
    shown = F.array_join(F.transform("chain", lambda c: F.concat_ws(" ", c["status"].cast("string"), c["url"])), " ")
    return f(hops.select("url"), hops).select("url", "final_url", shown.alias("chain"), "redirects", "error", "loops")


QUEUED = """q AS (SELECT event_id AS id, event_type AS queue, CASE WHEN event_id % 6 = 0 THEN 'LEASED' WHEN event_id % 6 = 1 THEN 'DONE' ELSE 'QUEUED' END AS status, CAST(event_id % 6 AS INT) AS attempts, ts AS due_at, CASE WHEN event_id % 12 = 0 THEN ts WHEN event_id % 6 = 0 THEN TIMESTAMP '2030-01-01 00:00:00' END AS leased_until FROM events)"""


@query(f"""WITH {QUEUED}, o AS (SELECT *, (status = 'QUEUED' AND due_at <= TIMESTAMP '2024-01-20 00:00:00') OR coalesce(status = 'LEASED' AND leased_until <= TIMESTAMP '2024-01-20 00:00:00', false) AS due FROM q),
l AS (SELECT *, due AND attempts >= 5 AS dead, due AND attempts < 5 AS taken FROM o), s AS (SELECT *, CASE WHEN taken THEN attempts + 1 ELSE attempts END AS tries, taken AND id % 4 <> 0 AS told, id % 4 = 1 AS ok, id % 4 = 2 AS again FROM l),
r AS (SELECT *, told AND NOT ok AND again AND tries < 5 AS later FROM s)
SELECT id, CASE WHEN dead THEN 'DEAD' WHEN told AND ok THEN 'DONE' WHEN later THEN 'QUEUED' WHEN told THEN 'DEAD' WHEN taken THEN 'LEASED' ELSE status END AS status, CAST(tries AS INT) AS attempts,
  CASE WHEN later THEN TIMESTAMP '2024-01-20 00:00:00' + greatest(60 * CAST(pow(2, tries - 1) AS INT), CASE WHEN id % 10 = 0 THEN 300 ELSE 0 END) * INTERVAL '1' SECOND ELSE due_at END AS due_at, dead OR (told AND NOT ok AND NOT later) AS letter FROM r""")
def retry_queue(spark, d):
    from trustmill.operators import retries

    sql = QUEUED.split("AS (", 1)[1][:-1].replace("FROM events", "FROM {events}")
    queue = spark.sql(sql, events=table(spark, d, "events")).select("id", "queue", F.lit("{}").alias("payload"), "status", "attempts", "due_at", F.when(F.col("status") == "LEASED", "gone").alias("lease"), "leased_until", F.lit(None).cast("string").alias("error"))
    at = F.expr("TIMESTAMP '2024-01-20 00:00:00'")
    taken = retries.lease(queue, "w1", at)
    k = F.col("id") % 4
    results = taken["leased"].where(k != 0).select("id", (k == 1).alias("ok"), (k == 2).alias("retryable"), F.lit("no").alias("error"), F.when(F.col("id") % 10 == 0, 300).alias("retry_after_s"))
    done = retries.settle(taken["queue"], results, "w1", at)
    # what the lease declared dead stays so when results come in: the last state names all letters
    return done["queue"].select("id", "status", "attempts", "due_at", (F.col("status") == "DEAD").alias("letter"))


@query(with_views("m_events") + """, p AS (SELECT *, row_number() OVER (ORDER BY last_verified NULLS FIRST, event_id) AS turn FROM m_events), v AS (SELECT *, event_id % 97 = 0 AS bad FROM p WHERE turn <= 500), k AS (SELECT * FROM v WHERE NOT bad)
SELECT stage, taken, ok, failed, "left" FROM (SELECT 'parse' AS stage, count(*) AS taken, count(*) FILTER (NOT bad) AS ok, count(*) FILTER (bad) AS failed, (SELECT count(*) FROM p WHERE turn > 500) AS "left" FROM v
UNION ALL SELECT 'score', count(*), count(*) FILTER (category IS NOT NULL AND category <> 'BUILDING'), count(*) FILTER (category IS NULL OR category = 'BUILDING'), 0 FROM k)""")
def isolated_stages(spark, d):
    from trustmill.operators import isolation

    def parse(row: dict) -> dict:
        return {"half": 100 // (row["event_id"] % 97)}

    stages = [
        isolation.Stage("parse", isolation.by_row(parse, "half int"), 500, (F.asc_nulls_first("last_verified"),)),
        isolation.Stage("score", isolation.by_columns({"score": F.col("half") + 1}, F.when(F.coalesce("category", F.lit("BUILDING")) == "BUILDING", "no score"))),
    ]
    rows = view(spark, d, "m_events").select("event_id", "category", "last_verified")
    return isolation.run(rows, stages, ["event_id"])["report"].select("stage", "taken", "ok", "failed", "left")


@query("""WITH gone AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 5 = 0), l AS (SELECT l_orderkey AS event_id, l_orderkey * 8 + l_linenumber AS link_id, l_partkey FROM lineitem)
SELECT 'events' AS name, count(*) AS n, 0 AS nulled FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT 'event_links', count(*), 0 FROM l WHERE event_id % 5 <> 0 UNION ALL SELECT 'link_checks', count(*), 0 FROM l WHERE event_id % 5 <> 0
UNION ALL SELECT 'security_flags', count(*), count(*) FILTER (link_id IS NULL) FROM (SELECT CASE WHEN l_partkey % 2 = 0 THEN event_id END AS event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE link_id END AS link_id FROM l) WHERE event_id IS NULL OR event_id % 5 <> 0""")
def cascading_delete(spark, d):
    from trustmill.operators.admin import delete_rows

    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("event_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("link_id"), "l_partkey")
    events = table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"))
    tables = {
        "events": events, "event_links": lines.select("link_id", "event_id"), "link_checks": lines.select("link_id"),
        "security_flags": lines.select(F.when(F.col("l_partkey") % 2 == 0, F.col("event_id")).alias("event_id"), "link_id"),
    }
    out = delete_rows(tables, "events", events.where("event_id % 5 = 0"))
    nulled = lambda name: F.count_if(F.col("link_id").isNull()) if name == "security_flags" else F.lit(0).cast("long")
    rows = [df.agg(F.count(F.lit(1)).alias("n"), nulled(name).alias("nulled")).select(F.lit(name).alias("name"), "n", "nulled") for name, df in out.items()]
    whole = rows[0]
    for r in rows[1:]:
        whole = whole.unionByName(r)
    return whole


@query("""WITH i AS (SELECT doc_id, source || '|' || lang || '|' || n_chars // 50 AS dedupe_key, TIMESTAMP '2026-01-01 00:00:00' + (doc_id * 7919 % 5000) * INTERVAL '1' MINUTE AS seen FROM documents), k AS (SELECT dedupe_key, max(seen) AS seen FROM i WHERE doc_id % 10 = 0 GROUP BY 1)
SELECT i.dedupe_key, CASE WHEN any_value(k.seen) IS NULL THEN 'evt_' || left(sha256(i.dedupe_key), 20) ELSE 'known-' || i.dedupe_key END AS event_id, count(*) AS sightings, CAST(CASE WHEN any_value(k.seen) IS NULL THEN 1 ELSE 0 END AS BIGINT) AS inserted, greatest(max(i.seen), coalesce(any_value(k.seen), max(i.seen))) AS last_seen
FROM i LEFT JOIN k ON i.dedupe_key = k.dedupe_key WHERE i.doc_id % 10 <> 0 AND i.dedupe_key IS NOT NULL GROUP BY i.dedupe_key""")
def streamed_sightings(spark, d):
    """Documents that arrive in three parts, clustered by a stream with state; what it gave out, by key."""
    from trustmill.session import shared_path
    from trustmill.streaming import clusters

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    at = F.expr("timestamp_micros(unix_micros(TIMESTAMP '2026-01-01 00:00:00') + (doc_id * 7919 % 5000) * 60000000L)")
    key = F.concat(F.col("source"), F.lit("|"), F.col("lang"), F.lit("|"), F.expr("n_chars div 50"))
    docs = table(spark, d, "documents").select("doc_id", key.alias("dedupe_key"), F.col("source").alias("source_id"), F.col("doc_id").alias("seq"), F.concat(F.lit("https://s.org/"), "doc_id").alias("source_url"), at.alias("observed_at"))
    known = docs.where("doc_id % 10 = 0").select("dedupe_key", F.concat(F.lit("known-"), "dedupe_key").alias("event_id"), F.col("observed_at").alias("first_seen"), F.col("observed_at").alias("last_seen"))
    source = shared_path(spark, "sightings")
    out = source + "-out"
    parts = docs.where("doc_id % 10 <> 0").withColumn("part", F.pmod(F.col("doc_id"), F.lit(3)))
    for part in range(3):  # arrivals of as many files as tasks that read the table
        parts.where(F.col("part") == part).write.mode("append").parquet(source)
    files = len(spark.read.schema(parts.schema).parquet(source).inputFiles())

    def each(batch, epoch):
        done = clusters.actions(batch)
        batch.persist()
        done["items"].select("dedupe_key", "event_id", F.lit(1).alias("sightings"), (F.col("action") == "INSERT").cast("int").alias("inserted"), F.lit(None).cast("timestamp").alias("last_seen")).write.mode("overwrite").parquet(f"{out}/items/{epoch}")
        seen = done["events"].select("dedupe_key", "event_id", "last_seen").unionByName(done["seen"].select("dedupe_key", "event_id", "last_seen"))
        seen.select("dedupe_key", "event_id", F.lit(0).alias("sightings"), F.lit(0).alias("inserted"), "last_seen").write.mode("overwrite").parquet(f"{out}/seen/{epoch}")
        batch.unpersist()

    stream = clusters.sightings(spark.readStream.schema(parts.schema).option("maxFilesPerTrigger", max(1, -(-files // 3))).parquet(source), known)
    stream.writeStream.outputMode("update").option("checkpointLocation", source + "-checkpoint").trigger(availableNow=True).foreachBatch(each).start().awaitTermination()
    kinds = "dedupe_key string, event_id string, sightings int, inserted int, last_seen timestamp"
    rows = spark.read.schema(kinds).parquet(f"{out}/items/*", f"{out}/seen/*")
    return rows.groupBy("dedupe_key", "event_id").agg(F.sum("sightings").alias("sightings"), F.sum("inserted").alias("inserted"), F.max("last_seen").alias("last_seen"))
