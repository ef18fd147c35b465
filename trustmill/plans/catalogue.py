"""Named queries: each operator on the driver's tables, with the same in another engine's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustmill.operators.consistency import CHANGES, COMPARED
from trustmill.plans.bridge import NOW, STREAM_NOW, TABLES, table, view, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def now() -> F.Column:
    return F.expr(NOW)


# Scans, filters and top-k


@query(with_views("m_events") + "SELECT event_id, first_seen FROM m_events WHERE status = 'DISCOVERED' ORDER BY first_seen, event_id LIMIT 10")
def pending_topk(spark, d):
    return view(spark, d, "m_events").where("status = 'DISCOVERED'").orderBy("first_seen", "event_id").limit(10).select("event_id", "first_seen")


@query(with_views("m_events") + "SELECT event_id, first_seen FROM m_events WHERE status = 'DISCOVERED' ORDER BY first_seen DESC, event_id LIMIT 20")
def newest_pending_topk(spark, d):
    return view(spark, d, "m_events").where("status = 'DISCOVERED'").orderBy(F.desc("first_seen"), "event_id").limit(20).select("event_id", "first_seen")


@query(with_views("m_events") + "SELECT event_id, last_verified FROM m_events WHERE status IN ('VERIFIED','PUBLISHED') ORDER BY last_verified NULLS FIRST, event_id LIMIT 5")
def reverify_topk(spark, d):
    rows = view(spark, d, "m_events").where(F.col("status").isin("VERIFIED", "PUBLISHED"))
    return rows.orderBy(F.asc_nulls_first("last_verified"), "event_id").limit(5).select("event_id", "last_verified")


STALE = "CASE WHEN end_date < {now} - INTERVAL '26' HOUR THEN 'PAST_END_DATE' WHEN registration_deadline < {now} - INTERVAL '26' HOUR THEN 'PAST_DEADLINE' END"


@query(with_views("m_events") + f"SELECT event_id, {STALE.format(now=NOW)} AS reason FROM m_events WHERE status NOT IN ('EXPIRED','CANCELLED','REJECTED') AND {STALE.format(now=NOW)} IS NOT NULL")
def stale_candidates(spark, d):
    from trustmill.functions.dates import stale_reason

    rows = view(spark, d, "m_events").where(~F.col("status").isin("EXPIRED", "CANCELLED", "REJECTED"))
    return rows.select("event_id", stale_reason(F.col("status"), F.col("end_date"), F.col("registration_deadline"), now()).alias("reason")).where("reason is not null")


@query(with_views("m_events") + "SELECT event_id, status, publishing_tier FROM m_events WHERE status IN ('VERIFIED','UPDATED') AND publishing_tier IN ('A','B') AND organizer_name IS NOT NULL AND category IS NOT NULL AND (start_date IS NOT NULL OR registration_deadline IS NOT NULL)")
def alert_eligible(spark, d):
    rows = view(spark, d, "m_events").where(F.col("status").isin("VERIFIED", "UPDATED") & F.col("publishing_tier").isin("A", "B"))
    return rows.where(F.size(_gate(rows)) == 0).select("event_id", "status", "publishing_tier")


def _gate(rows: DataFrame) -> F.Column:
    from trustmill.functions.scoring import publishing_gate

    dated = F.col("start_date").isNotNull() | F.col("registration_deadline").isNotNull()
    return publishing_gate(F.col("event_id").cast("string"), F.col("organizer_name"), F.col("event_id").cast("string"), dated, F.col("category"), F.lit("UNVERIFIED"), F.lit(True), F.lit(False))


@query(with_views("m_events") + """SELECT event_id, concat_ws(',', CASE WHEN event_id % 11 = 0 THEN 'MISSING_TITLE' END, CASE WHEN organizer_name IS NULL OR event_id % 13 = 0 THEN 'MISSING_ORGANIZER_OR_SOURCE' END, CASE WHEN event_id % 17 = 0 THEN 'MISSING_EVENT_PAGE_OR_SOURCE' END,
  CASE WHEN start_date IS NULL AND registration_deadline IS NULL THEN 'MISSING_DATE_AND_DEADLINE' END, CASE WHEN category IS NULL OR event_id % 19 = 0 THEN 'MISSING_CLASSIFICATION' END, CASE WHEN publishing_tier = 'E' OR event_id % 23 = 0 THEN 'NO_VERIFICATION_DECISION' END,
  CASE WHEN event_id % 5 = 0 THEN 'REGISTRATION_UNRESOLVED' END, CASE WHEN event_id % 29 = 0 THEN 'UNRESOLVED_CRITICAL_SECURITY_FLAGS' END) AS reasons FROM m_events""")
def publishing_gate(spark, d):
    from trustmill.functions.scoring import publishing_gate as f

    k, text = F.col("event_id"), lambda c, n: F.when(F.col("event_id") % n != 0, c)
    decision = F.when(F.col("publishing_tier") == "E", "REJECTED").when(k % 23 != 0, "UNVERIFIED")
    dated = F.col("start_date").isNotNull() | F.col("registration_deadline").isNotNull()
    reasons = f(text(k.cast("string"), 11), text(F.col("organizer_name"), 13), text(F.lit("https://e.org"), 17), dated, text(F.col("category"), 19), decision, F.when(k % 5 != 0, True), F.when(k % 29 == 0, True))
    return view(spark, d, "m_events").select("event_id", F.array_join(reasons, ",").alias("reasons"))


DUE = f"(url_type = 'REGISTRATION' AND (last_checked IS NULL OR last_checked < {NOW} - INTERVAL '6' HOUR)) OR (url_type = 'EVENT_PAGE' AND (last_checked IS NULL OR last_checked < {NOW} - INTERVAL '24' HOUR))"
LINK_KEY = "event_id, l_partkey, l_suppkey, l_linenumber, l_shipdate, l_extendedprice"


@query(with_views("m_links") + f"SELECT event_id, l_partkey, l_suppkey, l_linenumber, url_type, last_checked FROM m_links WHERE {DUE} ORDER BY last_checked NULLS FIRST, {LINK_KEY} LIMIT 50")
def due_links_topk(spark, d):
    rows = view(spark, d, "m_links").where(DUE).orderBy(F.asc_nulls_first("last_checked"), *LINK_KEY.split(", "))
    return rows.limit(50).select("event_id", "l_partkey", "l_suppkey", "l_linenumber", "url_type", "last_checked")


@query(with_views("m_notifications") + "SELECT notification_id, event_id, target_id FROM m_notifications WHERE status = 'QUEUED' ORDER BY notification_id LIMIT 100")
def queue_order(spark, d):
    return view(spark, d, "m_notifications").where("status = 'QUEUED'").orderBy("notification_id").limit(100).select("notification_id", "event_id", "target_id")


# Joins


@query("SELECT o.o_orderkey AS event_id, o.o_orderstatus AS status FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R' AND l.l_linestatus = 'F')")
def critical_flag_semi(spark, d):
    flags = table(spark, d, "lineitem").where("l_returnflag = 'R' AND l_linestatus = 'F'")
    orders = table(spark, d, "orders")
    return orders.join(flags, orders["o_orderkey"] == flags["l_orderkey"], "left_semi").select(F.col("o_orderkey").alias("event_id"), F.col("o_orderstatus").alias("status"))


@query("SELECT o.o_orderkey AS event_id, o.o_orderstatus AS status FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R' AND l.l_linestatus = 'F')")
def critical_flag_anti(spark, d):
    flags = table(spark, d, "lineitem").where("l_returnflag = 'R' AND l_linestatus = 'F'")
    orders = table(spark, d, "orders")
    return orders.join(flags, orders["o_orderkey"] == flags["l_orderkey"], "left_anti").select(F.col("o_orderkey").alias("event_id"), F.col("o_orderstatus").alias("status"))


@query("SELECT e.event_id AS review_id, o.o_orderkey AS event_id, e.event_type AS reason, e.ts AS created_at FROM events e JOIN orders o ON e.event_id = o.o_orderkey WHERE e.event_type = 'error' ORDER BY e.ts DESC, e.event_id LIMIT 20")
def review_join(spark, d):
    reviews = table(spark, d, "events").where("event_type = 'error'")
    joined = reviews.join(table(spark, d, "orders"), F.col("event_id") == F.col("o_orderkey"))
    return joined.orderBy(F.desc("ts"), "event_id").limit(20).select(F.col("event_id").alias("review_id"), F.col("o_orderkey").alias("event_id"), F.col("event_type").alias("reason"), F.col("ts").alias("created_at"))


COUNTS = "count(*) FILTER (outcome = 'valid') AS valid_events, count(*) FILTER (outcome = 'dead_link') AS dead_links, count(*) FILTER (outcome = 'fake') AS fake_events, count(*) FILTER (outcome = 'duplicate') AS duplicates"


@query(with_views("m_outcomes", "m_sources") + f""", r AS (SELECT source_id, {COUNTS} FROM m_outcomes GROUP BY source_id)
SELECT s.source_id, s.name, s.trust_score, s.enabled, coalesce(valid_events, 0) AS valid_events, coalesce(dead_links, 0) AS dead_links, coalesce(fake_events, 0) AS fake_events, coalesce(duplicates, 0) AS duplicates
FROM m_sources s LEFT JOIN r ON s.source_id = r.source_id""")
def source_status(spark, d):
    from trustmill.operators.transitions import count_outcomes

    names = ["valid_events", "dead_links", "fake_events", "duplicates"]
    joined = view(spark, d, "m_sources").join(count_outcomes(view(spark, d, "m_outcomes")), "source_id", "left")
    return joined.select("source_id", "name", "trust_score", "enabled", *(F.coalesce(c, F.lit(0)).alias(c) for c in names))


@query(with_views("m_outcomes") + f"SELECT source_id, {COUNTS} FROM m_outcomes GROUP BY source_id")
def outcome_counters(spark, d):
    from trustmill.operators.transitions import count_outcomes

    return count_outcomes(view(spark, d, "m_outcomes"))


@query(with_views("m_events", "m_event_sources") + "SELECT DISTINCT e.event_id, e.first_seen FROM m_events e JOIN m_event_sources s ON e.event_id = s.event_id AND s.source_id = 7 WHERE e.status = 'DISCOVERED' ORDER BY e.first_seen DESC, e.event_id LIMIT 25")
def events_for_source(spark, d):
    own = view(spark, d, "m_event_sources").where("source_id = 7").select("event_id").distinct()
    return view(spark, d, "m_events").where("status = 'DISCOVERED'").join(own, "event_id").orderBy(F.desc("first_seen"), "event_id").limit(25).select("event_id", "first_seen")


@query(with_views("m_events", "m_targets") + """SELECT e.event_id, t.target_id FROM m_events e, m_targets t WHERE e.status IN ('VERIFIED','PUBLISHED','UPDATED') AND (t.target_id IN (0, 3)
  OR t.target_id = 1 AND e.category IN ('BUILDING','MACHINERY') OR t.target_id = 2 AND e.category = 'BUILDING' AND e.city IN ('INDIA','CHINA'))""")
def subscription_match(spark, d):
    from trustmill.operators.notify import subscriptions

    rows = view(spark, d, "m_events").where(F.col("status").isin("VERIFIED", "PUBLISHED", "UPDATED")).select("event_id", "category", "city")
    return subscriptions(rows, view(spark, d, "m_targets")).select("event_id", "target_id")


TITLE_SQL = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9\s]', ' ', 'g'), '\b(20[0-9]{{2}}|2k[0-9]{{2}})\b', ' ', 'g'), '\b([0-9]+(st|nd|rd|th)\s+edition|edition|hackathon|hack|summit|fest|challenge)\b', ' ', 'g'), '\s+', ' ', 'g'))"
ORG_SQL = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({c}), '\bgovt\.?\b', 'government', 'g'), '\b(univ\.|univ|university|institute of technology|institute|college|official)\b', ' ', 'g'), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def ascii_sql(c: str) -> str:
    return f"regexp_full_match({c}, '[\\x00-\\x7F]*')"


@query(f"SELECT p_partkey AS id, {TITLE_SQL.format(c='p_name')} AS name FROM part")
def normalize_title(spark, d):
    from trustmill.functions.text import normalize_title as f

    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), f(F.col("p_name")).alias("name"))


@query(f"SELECT s_suppkey AS id, {ORG_SQL.format(c=chr(39) + 'Govt. Univ. of ' + chr(39) + ' || s_name || ' + chr(39) + ' Official College' + chr(39))} AS name FROM supplier")
def normalize_organizer(spark, d):
    from trustmill.functions.text import normalize_organizer as f

    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), f(F.concat(F.lit("Govt. Univ. of "), "s_name", F.lit(" Official College"))).alias("name"))


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey % 5 = 0 THEN 'Bengaluru' WHEN n_nationkey % 5 = 1 THEN 'Delhi' ELSE n_name END AS city FROM nation")
def normalize_city(spark, d):
    from trustmill.functions.text import normalize_city as f

    raw = F.when(F.col("n_nationkey") % 5 == 0, F.lit(" Bangalore ")).when(F.col("n_nationkey") % 5 == 1, F.lit("NEW DELHI")).otherwise(F.col("n_name"))
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), f(raw).alias("city"))


@query(f"SELECT p_partkey AS id, {TITLE_SQL.format(c='p_name')} || '|' || {ORG_SQL.format(c='p_brand')} || '|2026-01-01|https://example.org/' || p_size AS key FROM part")
def dedupe_key(spark, d):
    from trustmill.functions.matching import dedupe_key as f

    url = F.concat(F.lit("HTTPS://Example.org/"), F.col("p_size"), F.lit("/?utm_source=x#top"))
    # a small file is one task's to read; the work on its rows is all tasks'
    rows = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size").repartition(4 * spark.sparkContext.defaultParallelism)
    return rows.select(F.col("p_partkey").alias("id"), f(F.col("p_name"), F.col("p_brand"), F.lit("2026-01-01T00:00"), url, F.lit(None).cast("string")).alias("key"))


@query("""SELECT a.p_partkey AS a, b.p_partkey AS b, CAST(levenshtein(a.p_name, b.p_name) AS INT) AS distance FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey
WHERE 1.0 - CAST(levenshtein(a.p_name, b.p_name) AS DOUBLE) / greatest(length(a.p_name), length(b.p_name)) >= 0.85""")
def levenshtein_pairs(spark, d):
    from trustmill.functions.matching import alike_pairs

    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))
    return alike_pairs(rows, "brand").select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), "distance")


PART_EVENTS = f"p AS (SELECT p_partkey AS id, {TITLE_SQL.format(c='p_name')} AS name, {ORG_SQL.format(c='p_brand')} AS org, '2026-01-' || lpad(CAST(1 + p_partkey % 28 AS VARCHAR), 2, '0') AS day, CASE WHEN p_partkey % 10 = 0 THEN 'p/' || p_size || p_type END AS page FROM part)"


DUPLICATES = f"""WITH {PART_EVENTS}, pairs AS (
  SELECT a.id AS id_a, b.id AS id_b, a.page = b.page AS same_page, a.org = b.org AS same_org, a.day = b.day AS same_day,
    CASE WHEN a.name = '' OR b.name = '' THEN 0.0 WHEN a.name = b.name THEN 1.0 ELSE 1.0 - CAST(levenshtein(a.name, b.name) AS DOUBLE) / greatest(length(a.name), length(b.name)) END AS sim
  FROM p a JOIN p b ON a.id < b.id AND (a.page = b.page OR a.org = b.org OR a.day = b.day)), reasons AS (
  SELECT id_a, id_b, CASE WHEN same_page THEN 'SAME_CANONICAL_EVENT_URL' WHEN sim >= 0.85 AND same_org AND same_day THEN 'TITLE_ORGANIZER_DATE_MATCH' WHEN sim >= 0.85 AND same_org THEN 'TITLE_ORGANIZER_MATCH'
    WHEN sim >= 0.85 AND same_day THEN 'TITLE_DATE_MATCH' WHEN sim >= 0.7 AND same_org AND same_day THEN 'TITLE_ORGANIZER_GEO_MATCH' END AS reason, sim FROM pairs)"""


@query(DUPLICATES + """
SELECT id_a, id_b, reason, round(CAST(CASE WHEN reason LIKE 'SAME%' THEN 1.0 ELSE sim END AS DOUBLE), 6) AS similarity FROM reasons WHERE reason IS NOT NULL""")
def fuzzy_duplicates(spark, d):
    from trustmill.functions.matching import duplicate_pairs

    return duplicate_pairs(_part_events(spark, d), digits=6)


@query(DUPLICATES + """, l AS (SELECT id_a AS id FROM reasons WHERE reason IS NOT NULL UNION ALL SELECT id_b FROM reasons WHERE reason IS NOT NULL), c AS (SELECT name, org, day, page, min(id) AS class_id, count(*) AS copies FROM p GROUP BY ALL)
SELECT p.id, c.class_id, c.copies, (SELECT count(*) FROM l WHERE l.id = p.id) AS n_links FROM p JOIN c ON p.name = c.name AND p.org = c.org AND p.day = c.day AND p.page IS NOT DISTINCT FROM c.page""")
def duplicate_counts(spark, d):
    from trustmill.functions.matching import duplicate_counts as f

    return f(_part_events(spark, d))


def _part_events(spark, d):
    none = F.lit(None).cast("string")
    day = F.concat(F.lit("2026-01-"), F.lpad((1 + F.col("p_partkey") % 28).cast("string"), 2, "0"), F.lit("T10:00"))
    page = F.when(F.col("p_partkey") % 10 == 0, F.concat(F.lit("https://e.org/"), F.col("p_size"), F.replace("p_type", F.lit(" "), F.lit("_"))))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("organizer"), day.alias("start_date"), none.alias("city"), page.alias("event_url"), none.alias("registration_url"))


@query("""WITH t AS (SELECT p_partkey AS id, list_filter(regexp_split_to_array(regexp_replace(lower(p_name), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > 3) AS tokens, lower(p_type || ' ' || p_brand || CASE WHEN p_partkey % 3 = 0 THEN ' ' || reverse(p_name) ELSE substr(p_name, 1 + CAST(p_partkey % 17 AS INT)) END) AS page FROM part)
SELECT id, CAST(len(tokens) AS INT) AS n_tokens, round(CASE WHEN len(tokens) = 0 THEN 0.0 ELSE CAST(len(list_filter(tokens, lambda w: contains(page, w))) AS DOUBLE) / len(tokens) END, 6) AS overlap FROM t""")
def token_overlap(spark, d):
    from trustmill.functions.text import significant_tokens
    from trustmill.functions.text import token_overlap as f

    page = F.expr("lower(p_type || ' ' || p_brand || CASE WHEN p_partkey % 3 = 0 THEN ' ' || reverse(p_name) ELSE substr(p_name, 1 + CAST(p_partkey % 17 AS INT)) END)")
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), significant_tokens(F.col("p_name")).alias("tokens"), page.alias("page"))
    return rows.select("id", F.size("tokens").alias("n_tokens"), F.round(f(F.col("tokens"), F.col("page")), 6).alias("overlap"))


@query("""WITH RECURSIVE hop AS (SELECT p_partkey AS url, p_partkey AS cur, 0 AS n FROM part UNION ALL
  SELECT h.url, h.cur // 2, h.n + 1 FROM hop h WHERE h.n < 5 AND h.cur % 2 = 0)
SELECT url, max_by(cur, n) AS final_url, CAST(max(n) AS INT) AS redirects FROM hop GROUP BY url""")
def redirect_chain(spark, d):
    from trustmill.operators.transitions import follow_redirects

    urls = table(spark, d, "part").select(F.col("p_partkey").alias("url"))
    hops = urls.where("url % 2 = 0").select("url", F.expr("url div 2").alias("target"))
    halves = urls.where("url % 2 = 0").selectExpr("url div 2 AS url").where("url % 2 = 0").select("url", F.expr("url div 2").alias("target"))
    return follow_redirects(urls, hops.union(halves).distinct())


@query("""SELECT o.o_orderkey AS event_id, count(l.l_orderkey) AS sources, count(DISTINCT l.l_suppkey) AS distinct_sources, coalesce(string_agg(DISTINCT l.l_returnflag, ',' ORDER BY l.l_returnflag), '') AS flags
FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY o.o_orderkey""")
def event_detail(spark, d):
    joined = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    flags = F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",")
    return joined.groupBy(F.col("o_orderkey").alias("event_id")).agg(F.count("l_orderkey").alias("sources"), F.count_distinct("l_suppkey").alias("distinct_sources"), flags.alias("flags"))


# Aggregations


@query(with_views("m_events") + "SELECT status, count(*) AS n FROM m_events GROUP BY status")
def status_counts(spark, d):
    return view(spark, d, "m_events").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(with_views("m_events") + "SELECT coalesce(category, 'NONE') AS category, publishing_tier, count(*) AS n FROM m_events GROUP BY 1, 2")
def tier_counts(spark, d):
    return view(spark, d, "m_events").groupBy(F.coalesce("category", F.lit("NONE")).alias("category"), "publishing_tier").agg(F.count(F.lit(1)).alias("n"))


@query(with_views("m_notifications") + "SELECT count(*) FILTER (status = 'SENT') AS sent, count(*) FILTER (status = 'QUEUED') AS queued, count(*) FILTER (status = 'FAILED') AS failed, count(*) FILTER (status = 'SUPPRESSED') AS suppressed FROM m_notifications")
def admin_stats(spark, d):
    kinds = ("SENT", "QUEUED", "FAILED", "SUPPRESSED")
    return view(spark, d, "m_notifications").agg(*(F.count_if(F.col("status") == k).alias(k.lower()) for k in kinds))


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in TABLES))
def table_counts(spark, d):
    counts = [table(spark, d, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("table_name"), "n") for t in TABLES]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionAll(c)
    return out


@query(with_views("m_event_sources", "m_sources") + """SELECT e.event_id, max(s.trust_score) AS trust, coalesce(min(e.source_level), 7) AS best_level, greatest(count(DISTINCT e.source_id), 1) AS sources,
  CAST(min_by(e.source_url_id, e.source_id * 100000000 + e.source_url_id) AS BIGINT) AS primary_url FROM m_event_sources e LEFT JOIN m_sources s ON e.source_id = s.source_id GROUP BY e.event_id""")
def source_level_trust(spark, d):
    rows = view(spark, d, "m_event_sources").join(view(spark, d, "m_sources"), "source_id", "left")
    return rows.groupBy("event_id").agg(
        F.max("trust_score").alias("trust"), F.coalesce(F.min("source_level"), F.lit(7)).alias("best_level"), F.greatest(F.count_distinct("source_id"), F.lit(1)).alias("sources"),
        F.min_by("source_url_id", F.struct("source_id", "source_url_id")).alias("primary_url"),
    )


@query("SELECT source, count(*) AS discovered, count(DISTINCT text) AS inserted, count(*) - count(DISTINCT text) AS attached, count(*) FILTER (n_chars < 200) AS short FROM documents GROUP BY source")
def discovery_totals(spark, d):
    own = table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("discovered"), F.count_distinct(F.sha2("text", 256)).alias("inserted"), F.count_if(F.col("n_chars") < 200).alias("short"))
    return own.select("source", "discovered", "inserted", (F.col("discovered") - F.col("inserted")).alias("attached"), "short")


@query(with_views("m_events") + "SELECT status, string_agg(publishing_tier || '=' || n, ',' ORDER BY publishing_tier) AS tiers FROM (SELECT status, publishing_tier, count(*) AS n FROM m_events GROUP BY 1, 2) GROUP BY status")
def decision_histogram(spark, d):
    counts = view(spark, d, "m_events").groupBy("status", "publishing_tier").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("status").agg(F.array_join(F.array_sort(F.collect_list(F.concat("publishing_tier", F.lit("="), "n"))), ",").alias("tiers"))


SIGNALS = {
    "officialOrganizerPage": "l_returnflag = 'N'", "officialRegistrationLink": "l_linestatus = 'O'", "trustedEventPlatform": "l_quantity > 40", "secondIndependentSource": "l_linenumber > 3",
    "validHttps": "l_discount < 0.05", "consistentDates": "l_tax < 0.04", "consistentOrganizer": "l_tax >= 0.02", "recentConfirmation": "l_quantity > 10", "suspiciousRedirect": "l_partkey % 11 = 0",
    "unknownRegistrationDomain": "l_partkey % 5 = 0", "conflictingOfficialInfo": "l_partkey % 7 = 0", "phishingMalwareReputation": "l_partkey % 23 = 0",
}


def _score_sql() -> str:
    from trustmill.config import SIGNAL_WEIGHTS

    on = {k: f"({v})" for k, v in SIGNALS.items()}
    total = " + ".join(f"CASE WHEN {c} THEN {SIGNAL_WEIGHTS[k]} ELSE 0 END" for k, c in on.items())
    bad, odd = on["phishingMalwareReputation"], on["suspiciousRedirect"]
    second, page, link, platform, unknown = (on[k] for k in ("secondIndependentSource", "officialOrganizerPage", "officialRegistrationLink", "trustedEventPlatform", "unknownRegistrationDomain"))
    names = ", ".join(f"CASE WHEN {on[k]} THEN '{k}' END" for k in SIGNAL_WEIGHTS if k in on)
    return f"""WITH s AS (SELECT *, greatest(-100, least(100, {total})) AS score, concat_ws(',', {names}) AS signals FROM lineitem)
SELECT score, signals, CASE WHEN {bad} THEN 'REJECTED' WHEN {odd} THEN 'SUSPICIOUS' WHEN {page} AND {link} AND score >= 60 THEN 'VERIFIED_OFFICIAL' WHEN score >= 70 AND {second} THEN 'VERIFIED_BY_MULTIPLE_SOURCES'
  WHEN score >= 70 THEN 'LIKELY_LEGITIMATE' WHEN score >= 45 THEN 'UNVERIFIED' WHEN score < 0 OR score < 10 AND {unknown} THEN 'SUSPICIOUS' ELSE 'UNVERIFIED' END AS decision,
  CASE WHEN {bad} OR {odd} THEN 'E' WHEN {page} AND {link} AND score >= 60 THEN 'A' WHEN score >= 70 AND {second} THEN 'B' WHEN score >= 70 THEN CASE WHEN {platform} THEN 'C' ELSE 'B' END
  WHEN score >= 45 THEN CASE WHEN {platform} THEN 'C' ELSE 'D' END WHEN score < 0 OR score < 10 AND {unknown} THEN 'E' ELSE 'D' END AS tier, count(*) AS n FROM s GROUP BY 1, 2, 3, 4"""


@query(_score_sql())
def score_signals(spark, d):
    from trustmill.functions.scoring import score_signals as f

    scored = table(spark, d, "lineitem").select(f({k: F.expr(v) for k, v in SIGNALS.items()}).alias("s"))
    signals = F.array_join(F.transform("s.breakdown", lambda b: b["signal"]), ",")
    return scored.groupBy("s.score", signals.alias("signals"), "s.decision", "s.tier").agg(F.count(F.lit(1)).alias("n"))


FOLD = "greatest(0, least(100, a + CASE WHEN b = 1000 AND a >= 90 THEN 1 WHEN b = 1000 THEN 3 ELSE b END))"


@query(with_views("m_outcomes", "m_sources") + f""", steps AS (SELECT source_id, list(CASE outcome WHEN 'valid' THEN 1000 WHEN 'dead_link' THEN -2 WHEN 'fake' THEN -8 ELSE -1 END ORDER BY observed_at, seq) AS l FROM m_outcomes GROUP BY source_id)
SELECT t.source_id, CAST(list_reduce(list_prepend(coalesce(s.trust_score, 50), t.l), lambda a, b: {FOLD}) AS INT) AS trust FROM steps t LEFT JOIN m_sources s ON t.source_id = s.source_id""")
def trust_fold(spark, d):
    from trustmill.operators.transitions import fold_trust

    return fold_trust(view(spark, d, "m_outcomes"), view(spark, d, "m_sources"))


# Windows and sets


@query(with_views("m_notifications") + "SELECT event_id, target_id, status, template FROM m_notifications QUALIFY row_number() OVER (PARTITION BY event_id, target_id ORDER BY notification_id DESC) = 1")
def latest_notification(spark, d):
    from trustmill.operators.notify import latest

    return latest(view(spark, d, "m_notifications"), ["event_id", "target_id"], F.col("notification_id"), "status", "template")


@query(with_views("m_links") + f"SELECT event_id, l_partkey, l_shipdate FROM m_links WHERE url_type = 'REGISTRATION' QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_linenumber DESC, l_extendedprice DESC) = 1")
def latest_link(spark, d):
    from trustmill.operators.notify import latest

    rows = view(spark, d, "m_links").where("url_type = 'REGISTRATION'")
    return latest(rows, ["event_id"], F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"), "l_partkey", "l_shipdate")


@query("""WITH items AS (SELECT doc_id, source || '|' || lang || '|' || (n_chars // 50) AS dedupe_key FROM documents), known AS (SELECT DISTINCT dedupe_key FROM items WHERE doc_id % 10 = 0)
SELECT i.doc_id, i.dedupe_key, CASE WHEN k.dedupe_key IS NULL AND row_number() OVER (PARTITION BY i.dedupe_key ORDER BY i.doc_id) = 1 THEN 'INSERT' ELSE 'ATTACH' END AS action
FROM items i LEFT JOIN known k ON i.dedupe_key = k.dedupe_key WHERE i.doc_id % 10 <> 0""")
def cluster_insert_attach(spark, d):
    from trustmill.operators.transitions import cluster

    items = table(spark, d, "documents").select("doc_id", F.concat_ws("|", "source", "lang", F.expr("n_chars div 50")).alias("dedupe_key"))
    return cluster(items.where("doc_id % 10 <> 0"), items.where("doc_id % 10 = 0"), [F.col("doc_id")]).select("doc_id", "dedupe_key", "action")


@query(with_views("m_event_sources") + """, have AS (SELECT DISTINCT event_id, source_id FROM m_event_sources WHERE source_level <= 3)
SELECT event_id, source_id, 0 AS added FROM have UNION ALL SELECT DISTINCT n.event_id, n.source_id, 1 FROM m_event_sources n WHERE source_level > 3 AND NOT EXISTS (SELECT 1 FROM have h WHERE h.event_id = n.event_id AND h.source_id = n.source_id)""")
def source_set_union(spark, d):
    from trustmill.operators.transitions import insert_or_ignore

    rows = view(spark, d, "m_event_sources")
    part = lambda cond, n: rows.where(cond).select("event_id", "source_id").distinct().withColumn("added", F.lit(n))
    return insert_or_ignore(part("source_level <= 3", 0), part("source_level > 3", 1), ["event_id", "source_id"], [F.col("event_id")])


@query("""WITH q AS (SELECT 0 AS part, 0 AS a, unnest([0, 1]) AS b, unnest(['hackathon', 'hackathon 2026']) AS query UNION ALL
  SELECT 1, n_nationkey, unnest(range(0, 4)), unnest(['hackathon ' || n_name, 'tech event ' || n_name || ' 2026', 'coding competition ' || n_name, 'AI hackathon ' || n_name]) FROM nation)
SELECT CAST(row_number() OVER (ORDER BY part, a, b) - 1 AS INT) AS pos, query FROM (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY lower(trim(query)) ORDER BY part, a, b) = 1) ORDER BY part, a, b LIMIT 120""")
def search_queries(spark, d):
    from trustmill.functions.feeds import search_queries as f

    # the nations are 25 rows
    cities = tuple(r["n_name"] for r in table(spark, d, "nation").orderBy("n_nationkey").collect())
    return f(spark, 2026, ("hackathon",), cities)


# State and flows


@query(with_views("m_events") + f""", r AS (SELECT event_id, CASE WHEN registration_deadline > {NOW} AND registration_deadline < {NOW} + INTERVAL '24' HOUR THEN 'REMINDER_24' WHEN registration_deadline >= {NOW} + INTERVAL '24' HOUR AND registration_deadline < {NOW} + INTERVAL '48' HOUR THEN 'REMINDER_48' END AS a,
  CASE WHEN start_date > {NOW} AND start_date < {NOW} + INTERVAL '72' HOUR THEN 'REMINDER_START' END AS b FROM m_events WHERE status IN ('VERIFIED','PUBLISHED','UPDATED'))
SELECT event_id, a AS template FROM r WHERE a IS NOT NULL UNION ALL SELECT event_id, b FROM r WHERE b IS NOT NULL""")
def reminder_buckets(spark, d):
    from trustmill.functions.dates import due_reminders

    rows = view(spark, d, "m_events").where(F.col("status").isin("VERIFIED", "PUBLISHED", "UPDATED"))
    return rows.select("event_id", F.explode(due_reminders(F.col("registration_deadline"), F.col("start_date"), now())).alias("template"))


SUBSCRIBED_SQL = "(t.target_id IN (0, 3) OR t.target_id = 1 AND e.category IN ('BUILDING','MACHINERY') OR t.target_id = 2 AND e.category = 'BUILDING' AND e.city IN ('INDIA','CHINA'))"
REMIND_NOW = "TIMESTAMP '1995-06-15 12:00:00'"


@query(with_views("m_events", "m_targets", "m_notifications") + f""", r AS (SELECT *, unnest([CASE WHEN registration_deadline > {REMIND_NOW} AND registration_deadline < {REMIND_NOW} + INTERVAL '24' HOUR THEN 'REMINDER_24' WHEN registration_deadline >= {REMIND_NOW} + INTERVAL '24' HOUR AND registration_deadline < {REMIND_NOW} + INTERVAL '48' HOUR THEN 'REMINDER_48' END,
  CASE WHEN start_date > {REMIND_NOW} AND start_date < {REMIND_NOW} + INTERVAL '72' HOUR THEN 'REMINDER_START' END]) AS template FROM m_events WHERE status IN ('VERIFIED','PUBLISHED','UPDATED'))
SELECT e.event_id, t.target_id, e.template FROM r e, m_targets t WHERE e.template IS NOT NULL AND {SUBSCRIBED_SQL} AND NOT EXISTS (SELECT 1 FROM m_notifications n WHERE n.event_id = e.event_id AND n.target_id = t.target_id AND n.template = e.template)""")
def reminder_queue(spark, d):
    from trustmill.operators.notify import queue_reminders

    return queue_reminders(view(spark, d, "m_events"), view(spark, d, "m_targets"), view(spark, d, "m_notifications"), F.expr(REMIND_NOW))


@query(with_views("m_events", "m_targets", "m_notifications") + f""", last AS (SELECT event_id, target_id, status AS ls, template AS lt FROM m_notifications QUALIFY row_number() OVER (PARTITION BY event_id, target_id ORDER BY notification_id DESC) = 1),
q AS (SELECT e.event_id, t.target_id, CASE WHEN ls = 'SENT' THEN CASE WHEN e.status = 'UPDATED' AND lt <> 'CORRECTION' THEN 'CORRECTION' END WHEN coalesce(ls, '') <> 'QUEUED' THEN 'ALERT' END AS template
  FROM m_events e JOIN m_targets t ON {SUBSCRIBED_SQL} LEFT JOIN last l ON l.event_id = e.event_id AND l.target_id = t.target_id WHERE e.status IN ('VERIFIED','UPDATED') AND e.publishing_tier IN ('A','B'))
SELECT * FROM q WHERE template IS NOT NULL""")
def queue_decision(spark, d):
    from trustmill.operators.notify import queue_alerts

    return queue_alerts(view(spark, d, "m_events"), view(spark, d, "m_targets"), view(spark, d, "m_notifications"))


@query(with_views("m_notifications", "m_events") + """, q AS (SELECT * FROM m_notifications WHERE status = 'QUEUED'),
g AS (SELECT event_id, publishing_tier <> 'E' AS gate FROM m_events)
SELECT q.notification_id, CASE WHEN q.target_id = 3 OR g.event_id IS NULL THEN 'FAILED' WHEN NOT g.gate THEN 'SUPPRESSED' WHEN q.notification_id % 3 = 0 THEN 'SENT' WHEN q.notification_id % 3 = 1 THEN 'QUEUED' ELSE 'FAILED' END AS status,
  CASE WHEN q.target_id = 3 OR g.event_id IS NULL THEN 'UNKNOWN_TARGET_OR_EVENT' WHEN g.gate AND q.notification_id % 3 <> 0 THEN 'HTTP ' || (500 + q.notification_id % 3) END AS error
FROM q LEFT JOIN g ON q.event_id = g.event_id""")
def dispatch_outcomes(spark, d):
    from trustmill.operators.notify import dispatch

    queue = view(spark, d, "m_notifications").where("status = 'QUEUED'")
    events = view(spark, d, "m_events").select("event_id", (F.col("publishing_tier") != "E").alias("gate_passed"))
    third = F.col("notification_id") % 3
    results = queue.select("notification_id", (third == 0).alias("ok"), (third == 1).alias("retryable"), F.concat(F.lit("HTTP "), 500 + third).alias("error"))
    return dispatch(queue.drop("status"), events, view(spark, d, "m_targets").where("target_id < 3"), results).select("notification_id", "status", "error")


@query(with_views("m_events") + f"SELECT status, stale_reason, count(*) AS n FROM (SELECT CASE WHEN {STALE.format(now=NOW)} IS NOT NULL THEN 'EXPIRED' ELSE status END AS status, {STALE.format(now=NOW)} AS stale_reason FROM m_events) GROUP BY 1, 2")
def expire_transition(spark, d):
    from trustmill.operators.transitions import expire

    return expire(view(spark, d, "m_events"), now()).groupBy("status", "stale_reason").agg(F.count(F.lit(1)).alias("n"))


FRESH = """CASE WHEN last_verified IS NULL THEN CASE WHEN s <= 24 THEN 40 WHEN s <= 72 THEN 25 WHEN s <= 168 THEN 10 ELSE 0 END
  ELSE greatest(0, 100 - CASE WHEN v > 24 THEN 20 ELSE 0 END - CASE WHEN v > 72 THEN 25 ELSE 0 END - CASE WHEN v > 168 THEN 30 ELSE 0 END - CASE WHEN s > 168 THEN 15 ELSE 0 END) END"""


@query(with_views("m_events") + f", a AS (SELECT event_id, last_verified, greatest(0, epoch({NOW} - first_seen) / 3600) AS s, greatest(0, epoch({NOW} - last_verified) / 3600) AS v FROM m_events) SELECT event_id, CAST({FRESH} AS INT) AS freshness FROM a")
def freshness_scores(spark, d):
    from trustmill.functions.dates import freshness

    none = F.lit(None).cast("timestamp")
    return view(spark, d, "m_events").select("event_id", freshness(F.col("first_seen"), none, F.col("last_verified"), now()).alias("freshness"))


LAGGED = "SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, l_linestatus, lag(l_returnflag) OVER w AS old_flag, lag(l_linestatus) OVER w AS old_status FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice)"


def _lagged(spark, d) -> DataFrame:
    from pyspark.sql.window import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus", F.lag("l_returnflag").over(w).alias("old_flag"), F.lag("l_linestatus").over(w).alias("old_status"))


#: What stands for each tracked field of an order's successive lines, as text in both engines.
TRACKED = {
    "title": "l_returnflag", "organizer_name": "l_linestatus", "start_date": "CAST(l_partkey AS STRING)", "end_date": "CASE WHEN l_suppkey % 3 > 0 THEN CAST(l_suppkey AS STRING) END",
    "registration_deadline": "CAST(l_linenumber AS STRING)", "city": "CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag END", "venue": "CAST(l_partkey % 5 AS STRING)", "registration_url": "CAST(l_suppkey % 7 AS STRING)",
}
LINE_ORDER = "PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice"


@query("WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, " + ", ".join(f"{c} AS new_{f}, lag({c}) OVER w AS old_{f}" for f, c in TRACKED.items()) + f" FROM lineitem WINDOW w AS ({LINE_ORDER}))\n" + " UNION ALL ".join(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, '{f}' AS field, old_{f} AS old, new_{f} AS new FROM x WHERE old_{f} IS DISTINCT FROM new_{f}" for f in TRACKED))
def field_diffs(spark, d):
    from trustmill.functions.scoring import tracked_diffs

    lines = table(spark, d, "lineitem").select("*", F.struct(*(F.expr(c).alias(f) for f, c in TRACKED.items())).alias("after"))
    both = lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "after", F.expr(f"lag(after) OVER ({LINE_ORDER})").alias("before"))
    return both.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.explode(tracked_diffs(F.col("before"), F.col("after"))).alias("x")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "x.*")


@query(f"WITH x AS ({LAGGED}) SELECT CASE WHEN old_flag <> l_returnflag AND l_partkey % 3 <> 0 THEN old_flag ELSE coalesce(l_returnflag, old_flag) END AS value, coalesce(old_flag <> l_returnflag AND l_partkey % 3 <> 0, false) AS needs_review, count(*) AS n FROM x GROUP BY 1, 2")
def conflict_resolution(spark, d):
    from trustmill.functions.scoring import resolve_conflict

    r = resolve_conflict(F.col("old_flag"), F.col("l_returnflag"), F.col("l_partkey") % 3 == 0)
    return _lagged(spark, d).select(r.alias("r")).groupBy("r.value", "r.needs_review").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT s.s_suppkey AS id, CAST(least(100, CASE WHEN n.n_name = 'INDIA' THEN 35 ELSE 0 END + CASE WHEN s.s_suppkey % 3 = 0 THEN 25 ELSE 0 END + CASE WHEN s.s_suppkey % 4 = 0 THEN 35 ELSE 0 END + CASE WHEN s.s_suppkey % 5 = 0 THEN 5 ELSE 0 END) AS INT) AS score,
  concat_ws(',', CASE WHEN n.n_name = 'INDIA' THEN 'COUNTRY_INDIA' END, CASE WHEN s.s_suppkey % 3 = 0 THEN 'INDIAN_CITY' END, CASE WHEN s.s_suppkey % 4 = 0 THEN 'INDIAN_ORGANIZER_DOMAIN' END, CASE WHEN s.s_suppkey % 4 = 0 THEN 'INDIAN_ACADEMIC_OR_GOV_DOMAIN' END, CASE WHEN s.s_suppkey % 5 = 0 THEN 'INR_PRIZE' END) AS reasons
FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey""")
def region_relevance(spark, d):
    from trustmill.functions.scoring import region_relevance as f

    k, none = F.col("s_suppkey"), F.lit(None).cast("string")
    r = f(F.col("n_name"), F.when(k % 3 == 0, "Pune"), F.when(k % 4 == 0, "iit.ac.in").otherwise("x.com"), F.lit("some club"), F.when(k % 5 == 0, "Rs. 5 lakh"), none, F.lit(False))
    joined = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.select(k.alias("id"), r.alias("r")).select("id", "r.score", F.array_join("r.reasons", ",").alias("reasons"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 13 = 0 THEN 'error' WHEN l_partkey % 7 = 0 THEN 'unreachable' WHEN l_suppkey % 10 <> l_partkey % 10 THEN 'host_changed' ELSE 'unchanged' END AS outcome FROM lineitem)
SELECT outcome, count(*) AS links, count(DISTINCT l_orderkey) AS events FROM l GROUP BY outcome""")
def link_health_outcomes(spark, d):
    from trustmill.operators.links import recheck_outcome

    rows = table(spark, d, "lineitem").select(
        "l_orderkey", F.concat(F.lit("https://h"), F.col("l_suppkey") % 10, F.lit(".org/x")).alias("old_url"),
        F.when(F.col("l_partkey") % 7 != 0, F.concat(F.lit("https://h"), F.col("l_partkey") % 10, F.lit(".org/x"))).alias("new_url"), (F.col("l_partkey") % 13 == 0).alias("failed"),
    )
    outcome = recheck_outcome(F.col("old_url"), F.lit(None).cast("string"), F.col("new_url"), F.col("failed"))
    return rows.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("links"), F.count_distinct("l_orderkey").alias("events"))


FEEDBACK = "CASE WHEN event_type = 'error' THEN 'FALSE_POSITIVE' WHEN event_type = 'click' THEN 'DUPLICATE' ELSE 'LEGITIMATE' END"


@query(with_views("m_sources") + f""", f AS (SELECT user_id AS source_id, list(CASE {FEEDBACK} WHEN 'FALSE_POSITIVE' THEN -8 WHEN 'LEGITIMATE' THEN 3 ELSE 0 END ORDER BY event_id) AS l, count(*) FILTER ({FEEDBACK} = 'FALSE_POSITIVE') AS fake_events, count(*) FILTER ({FEEDBACK} = 'LEGITIMATE') AS valid_events FROM events GROUP BY user_id)
SELECT s.source_id, CAST(CASE WHEN l IS NULL THEN s.trust_score ELSE list_reduce(list_prepend(s.trust_score, l), lambda a, b: greatest(0, least(100, a + b))) END AS INT) AS trust_score, coalesce(fake_events, 0) AS fake_events, coalesce(valid_events, 0) AS valid_events FROM m_sources s LEFT JOIN f ON s.source_id = f.source_id""")
def feedback_transition(spark, d):
    from trustmill.operators.transitions import apply_feedback

    feedback = table(spark, d, "events").select(F.col("user_id").alias("source_id"), F.col("event_id").alias("seq"), F.expr(FEEDBACK).alias("label"))
    return apply_feedback(view(spark, d, "m_sources"), feedback)


@query(with_views("m_sources") + "SELECT source_id, CASE WHEN source_id % 4 = 0 THEN 1 ELSE trust_score END AS trust_score FROM m_sources UNION ALL SELECT source_id + 1000000, 1 FROM m_sources WHERE source_id % 4 = 0")
def merge_upsert(spark, d):
    from trustmill.operators.transitions import merge_snapshot

    rows = view(spark, d, "m_sources").select("source_id", "trust_score")
    quarter = rows.where("source_id % 4 = 0").select("source_id", F.lit(1).alias("trust_score"))
    return merge_snapshot(rows, quarter.unionByName(quarter.select((F.col("source_id") + 1_000_000).alias("source_id"), "trust_score")), ["source_id"])


@query(with_views("m_sources") + """, r AS (SELECT l_suppkey AS source_id, max(l_shipdate) AS last_run FROM lineitem GROUP BY 1)
SELECT s.source_id, CASE WHEN s.enabled = 0 THEN 'DISABLED' WHEN r.last_run + INTERVAL '30' DAY > TIMESTAMP '1998-11-30 00:00:00' THEN 'RATE_LIMITED' ELSE 'RUN' END AS gate FROM m_sources s LEFT JOIN r ON s.source_id = r.source_id""")
def rate_limit_gate(spark, d):
    from trustmill.operators.links import run_gate

    runs = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("source_id")).agg(F.max("l_shipdate").alias("last_run"))
    rows = view(spark, d, "m_sources").join(runs, "source_id", "left")
    return rows.select("source_id", run_gate(F.col("enabled") == 1, F.col("last_run"), F.lit(30 * 86_400_000), F.expr("TIMESTAMP '1998-11-30 00:00:00'")).alias("gate"))


@query(with_views("m_events") + "SELECT event_id, '🚀 Event ' || event_id || chr(10) || chr(10) || '🏢 Organizer: ' || coalesce(organizer_name, 'Unknown') || chr(10) || '📍 ONLINE' || coalesce(' · ' || city, '') || coalesce(chr(10) || '📅 Event date: ' || strftime(start_date, '%Y-%m-%d'), '') || coalesce(chr(10) || '⏰ Registration deadline: ' || strftime(registration_deadline, '%Y-%m-%d'), '') || chr(10) || '🔗 Source: see evidence trail' || chr(10) || '📝 Registration: Registration link could not be independently verified.' || chr(10) || '🔎 Verification: ✅ Official organizer source confirmed' AS text FROM m_events WHERE publishing_tier = 'A'")
def alert_payload(spark, d):
    from trustmill.functions.scoring import event_alert, verification_label

    none, day = F.lit(None).cast("string"), lambda c: F.date_format(c, "yyyy-MM-dd")
    text = event_alert(F.concat(F.lit("Event "), "event_id"), F.col("organizer_name"), F.lit("ONLINE"), F.col("city"), day("start_date"), day("registration_deadline"), none, none, verification_label(F.lit("VERIFIED_OFFICIAL")))
    return view(spark, d, "m_events").where("publishing_tier = 'A'").select("event_id", text.alias("text"))


@query(with_views("m_events") + "SELECT category, status, count(*) AS events, min(first_seen) AS oldest, max(first_seen) AS newest FROM m_events GROUP BY category, status")
def admin_review_report(spark, d):
    return view(spark, d, "m_events").groupBy("category", "status").agg(F.count(F.lit(1)).alias("events"), F.min("first_seen").alias("oldest"), F.max("first_seen").alias("newest"))


# Native extras and spec extras


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_counts(spark, d):
    return table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL '6 hours' OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k""")
def session_counts(spark, d):
    return table(spark, d, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("s")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("s.start").alias("session_start"), "n")


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ROLLUP (CAST(ts AS DATE), event_type)")
def quality_metrics_daily(spark, d):
    return table(spark, d, "events").rollup(F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))


#: What sources say about an order, by field, in both engines; lines are observations, ordered by OBSERVED.
SAID = {
    "title": "l_returnflag", "organizer_name": "l_linestatus", "start_date": "CAST(l_partkey % 3 AS STRING)", "end_date": "CASE WHEN l_suppkey % 3 > 0 THEN CAST(l_suppkey % 4 AS STRING) END", "registration_deadline": "CAST(l_linenumber % 2 AS STRING)",
    "venue": "CAST(l_partkey % 5 AS STRING)", "format": "'ONLINE'", "prize": "CASE WHEN l_linenumber > 2 THEN CAST(l_suppkey % 4 AS STRING) END", "eligibility": "CASE WHEN l_linenumber > 3 THEN 'students' END", "team_size": "CAST(l_suppkey % 2 AS STRING)",
    "registration_url": "CAST(l_suppkey % 7 AS STRING)", "registration_status": "CASE WHEN l_partkey % 4 = 0 THEN 'CLOSED' ELSE 'OPEN' END", "status": "CASE l_partkey % 9 WHEN 0 THEN 'CANCELLED' WHEN 1 THEN 'POSTPONED' ELSE 'VERIFIED' END",
}
OBSERVED = ["l_shipdate", "l_suppkey", "l_partkey", "l_linenumber", "l_extendedprice"]
SAID_SQL = f"s AS (SELECT l_orderkey AS event_id, 1 + l_linenumber % 7 AS source_level, {', '.join(OBSERVED)}, {', '.join(f'{c} AS {f}' for f, c in SAID.items())} FROM lineitem)"
NEWEST = ", ".join(f"{c} DESC" for c in OBSERVED)


def _said(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("event_id"), (1 + F.col("l_linenumber") % 7).alias("source_level"), *OBSERVED, *(F.expr(c).alias(f) for f, c in SAID.items()))


def _conflicts_sql(fields: dict[str, str], open_only: bool) -> str:
    cond = lambda f: f"count(DISTINCT {f}) > 1" + (f" AND count({f}) FILTER (source_level <= 3) = 0" if open_only else "")
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {cond(f)} THEN '{n}_CONFLICT' END" for f, n in fields.items()) + ")"


@query(f"WITH {SAID_SQL} SELECT event_id, {_conflicts_sql(COMPARED, False)} AS conflicts, {_conflicts_sql(COMPARED, True)} AS unresolved, " + ", ".join(f"coalesce((list({f} ORDER BY {NEWEST}) FILTER (source_level <= 3 AND {f} IS NOT NULL))[1], CASE WHEN count(DISTINCT {f}) = 1 THEN min({f}) END) AS {f}" for f in COMPARED) + " FROM s GROUP BY event_id")
def field_conflicts(spark, d):
    from trustmill.operators.consistency import consistency

    found = consistency(_said(spark, d), OBSERVED)
    return found.withColumns({c: F.array_join(c, ",") for c in ("conflicts", "unresolved")})


@query(f"WITH {SAID_SQL}, x AS (SELECT *, " + ", ".join(f"lag({f}) OVER w AS old_{f}" for f in [*CHANGES, "registration_status", "status"]) + f" FROM s WINDOW w AS (PARTITION BY event_id ORDER BY {', '.join(OBSERVED)})), c AS (" + " UNION ALL ".join(f"SELECT event_id, '{k}' AS kind, '{f}' AS field, old_{f} AS old_value, {f} AS new_value FROM x WHERE old_{f} <> {f}" for f, k in CHANGES.items())
+ " UNION ALL SELECT event_id, 'REGISTRATION_CLOSED', 'registration_status', old_registration_status, registration_status FROM x WHERE old_registration_status <> registration_status AND registration_status = 'CLOSED' UNION ALL SELECT event_id, CASE status WHEN 'CANCELLED' THEN 'CANCELLATION' ELSE 'POSTPONEMENT' END, 'status', old_status, status FROM x WHERE old_status <> status AND status IN ('CANCELLED', 'POSTPONED')) SELECT event_id, kind, field, old_value, new_value, count(*) AS n FROM c GROUP BY ALL")
def change_log(spark, d):
    from trustmill.operators.consistency import changes

    found = changes(_said(spark, d), OBSERVED)
    return found.groupBy("event_id", "kind", "field", "old_value", "new_value").agg(F.count(F.lit(1)).alias("n"))


@query(with_views("m_events") + "SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(first_seen, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(first_seen, '%a, %d %b %Y %H:%M:%S GMT') WHEN 2 THEN strftime(first_seen, '%Y-%m-%d') ELSE 'soon' END AS raw, CASE WHEN event_id % 4 < 3 THEN strftime(first_seen, '%Y-%m-%dT00:00:00.000Z') END AS parsed FROM m_events")
def normalized_dates(spark, d):
    from trustmill.functions.dates import iso, parse_date

    k, at = F.col("event_id") % 4, F.col("first_seen").cast("timestamp")
    raw = F.when(k == 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 1, F.concat(F.element_at(F.array(*map(F.lit, ("Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat"))), F.dayofweek(at)), F.date_format(at, ", dd MMM yyyy HH:mm:ss 'GMT'"))).when(k == 2, F.date_format(at, "yyyy-MM-dd")).otherwise("soon")
    return view(spark, d, "m_events").select("event_id", raw.alias("raw")).select("event_id", "raw", iso(parse_date(F.col("raw"))).alias("parsed"))


@query(with_views("m_events") + "SELECT event_id, '⚠️ EVENT UPDATE: Event ' || event_id || chr(10) || chr(10) || 'Registration moved.' || CASE WHEN event_id % 2 = 0 THEN chr(10) || 'Official event page: https://e.org/' || event_id ELSE '' END AS text FROM m_events WHERE status = 'UPDATED'")
def corrections(spark, d):
    from trustmill.functions.scoring import correction

    e = F.col("event_id")
    text = correction(F.concat(F.lit("Event "), e), F.lit("Registration moved."), F.when(e % 2 == 0, F.concat(F.lit("https://e.org/"), e)))
    return view(spark, d, "m_events").where("status = 'UPDATED'").select("event_id", text.alias("text"))


@query(with_views("m_event_sources") + """, s AS (SELECT event_id, string_agg(source_id || '@' || source_url_id, ',' ORDER BY source_id, source_url_id) AS sources FROM m_event_sources GROUP BY 1),
f AS (SELECT l_orderkey AS event_id, string_agg('L' || l_linenumber || ':' || CASE WHEN l_partkey % 2 = 0 THEN 'info' ELSE 'warning' END, ',' ORDER BY l_linenumber, l_partkey % 2) AS flags FROM lineitem GROUP BY 1),
v AS (SELECT l_orderkey AS event_id, string_agg(l_returnflag || l_linenumber || CASE WHEN l_suppkey % 2 = 0 THEN '+' ELSE '-' END, ',' ORDER BY l_returnflag, l_linenumber, l_suppkey % 2 = 0) AS evidence FROM lineitem GROUP BY 1)
SELECT o_orderkey AS event_id, coalesce(sources, '') AS sources, coalesce(evidence, '') AS evidence, coalesce(flags, '') AS flags FROM orders o LEFT JOIN s ON o.o_orderkey = s.event_id LEFT JOIN f ON o.o_orderkey = f.event_id LEFT JOIN v ON o.o_orderkey = v.event_id""")
def event_details(spark, d):
    from trustmill.operators.admin import event_details as f

    lines = table(spark, d, "lineitem").withColumn("event_id", F.col("l_orderkey"))
    events = table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"))
    sources = view(spark, d, "m_event_sources").select("event_id", "source_id", F.col("source_url_id").alias("source_url"), "observed_at")
    evidence = lines.select("event_id", F.col("l_returnflag").alias("evidence_type"), F.col("l_linenumber").alias("evidence_text"), (F.col("l_suppkey") % 2 == 0).alias("supports_claim"))
    flags = lines.select("event_id", F.col("l_linenumber").alias("flag_type"), F.when(F.col("l_partkey") % 2 == 0, "info").otherwise("warning").alias("severity"), F.lit(False).alias("resolved"))
    shown = lambda c, line: F.array_join(F.transform(c, line), ",").alias(c)
    return f(events, sources, evidence, flags).select(
        "event_id", shown("sources", lambda x: F.concat_ws("@", x["source_id"].cast("string"), x["source_url"].cast("string"))), shown("evidence", lambda x: F.concat(x["evidence_type"], x["evidence_text"].cast("string"), F.when(x["supports_claim"], "+").otherwise("-"))),
        shown("flags", lambda x: F.concat(F.lit("L"), x["flag_type"].cast("string"), F.lit(":"), x["severity"])),
    )


from trustmill.plans import edges, flows, pages  # noqa: E402, F401  (they register their queries here)
