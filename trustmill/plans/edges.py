"""Queries over connectors, lookups, channels, the registry, commits and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from trustmill.plans.bridge import table, view, with_views
from trustmill.plans.catalogue import ORACLES, now, query
from trustmill.plans.flows import ITEMS


@query("""WITH u AS (SELECT page_id, page_id // 20 AS k, 'https://site' || page_id // 20 || '.org/' || CASE WHEN page_id % 4 = 3 THEN 'about/' ELSE 'event/' END || page_id || CASE WHEN page_id % 10 = 0 THEN '.pdf' ELSE '' END AS url FROM pages),
w AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY page_id % 2, page_id) - 1 AS pos FROM u WHERE page_id % 4 <> 3 AND page_id % 10 <> 0 AND k % 6 <> 5)
SELECT 's' || k AS source_id, CAST(pos AS INT) AS seq, 3 AS source_level, url AS source_url, 'Talk ' || page_id AS title FROM w WHERE pos < 8 AND page_id % 3 <> 0""")
def sitemap_connector(spark, d):
    from trustmill.sources import connectors

    none, k, p = F.lit(None).cast("string"), F.expr("page_id div 20"), F.col("page_id")
    site = F.concat(F.lit("https://site"), k, F.lit(".org"))
    address = F.concat(site, F.when(p % 4 == 3, "/about/").otherwise("/event/"), p, F.when(p % 10 == 0, ".pdf").otherwise(""))
    pages = table(spark, d, "pages").select("page_id", k.alias("k"), site.alias("site"), address.alias("address"))
    # a site has 20 pages at most
    listed = pages.groupBy("k", "site", (p % 2).alias("half")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "address"))), lambda x: F.concat(F.lit("<url><loc>"), x["address"], F.lit("</loc></url>"))), "").alias("urls"))
    answer = lambda url, body, status=200: (url.alias("url"), F.lit(status).alias("status"), none.alias("final_url"), body.alias("body"), none.alias("error"))
    child = lambda n: F.concat("site", F.lit(f"/{n}.xml"))
    sites = pages.select("k", "site").distinct()
    roots = sites.select(*answer(F.concat("site", F.lit("/sitemap.xml")), F.when(F.col("k") % 6 == 5, "<html>").otherwise(F.concat(F.lit("<sitemapindex><sitemap><loc>"), child("a"), F.lit("</loc></sitemap><sitemap><loc>"), child("b"), F.lit("</loc></sitemap></sitemapindex>")))))
    children = listed.select(*answer(F.when(F.col("half") == 0, child("a")).otherwise(child("b")), F.concat(F.lit("<urlset>"), "urls", F.lit("</urlset>"))))
    bodies = pages.where(p % 3 != 0).select(*answer(F.col("address"), F.concat(F.lit("<h1>Talk "), p, F.lit("</h1>")))).unionByName(pages.where(p % 3 == 0).select(*answer(F.col("address"), F.lit("gone"), 404)))
    snapshot = roots.unionByName(children).unionByName(bodies)
    seeds = sites.select(F.concat(F.lit("s"), "k").alias("slug"), F.lit(3).alias("level"), F.col("site").alias("base_url"), F.lit(8).alias("max_pages"))
    maps = connectors.map_addresses(seeds, spark.createDataFrame([], "host string, text string"))
    return connectors.from_pages(seeds, connectors.page_addresses(seeds, maps, snapshot), snapshot).select("source_id", "seq", "source_level", "source_url", "title")


@query("""WITH p AS (SELECT p_partkey AS id, p_partkey // 7 AS page, row_number() OVER (PARTITION BY p_partkey // 7 ORDER BY p_partkey) - 1 AS pos, p_name FROM part)
SELECT CAST(page * 1000 + pos AS INT) AS seq, 7 AS source_level, 'https://t.org/' || id AS source_url, CASE WHEN id % 6 <> 0 THEN p_name END AS title, CASE WHEN id % 6 <> 0 THEN p_name ELSE '' END || chr(10) || 'about ' || id AS raw FROM p WHERE pos < 5 AND id % 11 <> 0""")
def search_connector(spark, d):
    from trustmill.sources import connectors

    p = F.col("p_partkey")
    result = F.struct(F.when(p % 6 != 0, F.col("p_name")).alias("title"), F.concat(F.when(p % 11 == 0, "ftp").otherwise("https"), F.lit("://t.org/"), p).alias("url"), F.concat(F.lit("about "), p).alias("snippet"))
    # answers of seven results each
    rows = table(spark, d, "part").select(F.expr("p_partkey div 7").alias("seq"), F.struct(p.alias("id"), result.alias("r")).alias("x")).groupBy("seq").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["r"]).alias("results"))
    answers = rows.select(F.explode(F.array(F.lit("q"), F.lit("off"))).alias("source_id"), "seq", F.to_json(F.struct("results")).alias("body"))
    seeds = spark.createDataFrame([("q", 7, True), ("off", 7, False)], "slug string, level int, enabled boolean")
    return connectors.from_search(seeds, answers).select("seq", "source_level", "source_url", "title", "raw")


@query("""SELECT url, CASE WHEN page_id % 3 = 0 THEN CASE WHEN page_id % 6 = 0 THEN 'HIT' ELSE 'UNKNOWN' END WHEN page_id % 5 = 0 AND page_id % 7 <> 0 THEN 'HIT' ELSE 'UNKNOWN' END AS verdict,
  CASE WHEN page_id % 3 = 0 THEN CASE WHEN page_id % 6 = 0 THEN 'MALWARE' ELSE '' END WHEN page_id % 5 = 0 AND page_id % 7 <> 0 THEN 'SOCIAL_ENGINEERING' ELSE '' END AS kinds FROM (SELECT page_id, 'https://h' || page_id || '.org/' AS url FROM pages)""")
def threat_lookups(spark, d):
    from trustmill.sources import web

    p = F.col("page_id")
    urls = table(spark, d, "pages").select("page_id", F.concat(F.lit("https://h"), p, F.lit(".org/")).alias("url"))
    old = F.when(p % 3 == 0, now() - F.expr("INTERVAL '1' HOUR")).otherwise(now() - F.expr("INTERVAL '30' HOUR"))
    cached = urls.where(p % 3 != 2).select("url", F.when(p % 6 == 0, F.array(F.lit("MALWARE"))).when(p % 3 == 1, F.array(F.lit("OLD"))).otherwise(F.array().cast("array<string>")).alias("threat_types"), old.alias("fetched_at"))
    number = F.regexp_extract("url", "h([0-9]+)", 1).cast("long")
    ask = lambda rows: rows.select("url", F.when(number % 7 == 0, 500).otherwise(200).alias("status"), F.when(number % 5 == 0, '{"matches":[{"threatType":"SOCIAL_ENGINEERING"}]}').otherwise("{}").alias("body"))
    told = web.threat_verdicts(urls.select("url"), web.checked_threats(urls, cached, ask, now()))
    return told.select("url", "verdict", F.coalesce(F.array_join("threat_types", ","), F.lit("")).alias("kinds"))


@query("""WITH m AS (SELECT o_orderkey AS event_id, 'to' || o_custkey AS chat, repeat('x', CAST(o_orderkey % 4100 AS INT)) || ' order' AS text, 'Order ' || o_orderkey AS title FROM orders)
SELECT event_id, md5('{"chat_id":"' || chat || '","text":"' || left(text, 4000) || '","disable_web_page_preview":false}') AS telegram, md5('{"messaging_product":"whatsapp","recipient_type":"individual","to":"' || chat || '","type":"text","text":{"preview_url":true,"body":"' || left(text, 4000) || '"}}') AS whatsapp,
  '{"messaging_product":"whatsapp","recipient_type":"individual","to":"' || chat || '","type":"template","template":{"name":"alert","language":{"code":"en"},"components":[{"type":"body","parameters":[{"type":"text","text":"' || title || '"},{"type":"text","text":"' || CASE WHEN event_id % 2 = 0 THEN 'Page: u' || event_id ELSE 'See official event page' END || '"},{"type":"text","text":"Reply STOP to unsubscribe"}]}]}}' AS template FROM m""")
def channel_payloads(spark, d):
    from trustmill.sources import sinks

    k = F.col("o_orderkey")
    chat, text, title = F.concat(F.lit("to"), "o_custkey"), F.concat(F.repeat(F.lit("x"), (k % 4100).cast("int")), F.lit(" order")), F.concat(F.lit("Order "), k)
    buttons = F.when(k % 2 == 0, F.array(F.struct(F.lit("Page").alias("label"), F.concat(F.lit("u"), k).alias("url"))))
    return table(spark, d, "orders").select(k.alias("event_id"), F.md5(sinks.telegram_payload(chat, text)).alias("telegram"), F.md5(sinks.whatsapp_payload(chat, text)).alias("whatsapp"), sinks.whatsapp_payload(chat, text, title, buttons, "alert").alias("template"))


@query("""WITH a AS (SELECT l_orderkey AS id, l_linenumber AS n, CASE l_partkey % 5 WHEN 0 THEN 200 WHEN 1 THEN 429 WHEN 2 THEN 503 WHEN 3 THEN 400 END AS status, l_suppkey % 2 = 0 AS said FROM lineitem)
SELECT status, said, coalesce(status = 200, false) AS ok, coalesce(status IN (429, 503), true) AND coalesce(status <> 200, true) AS retryable, CASE WHEN status = 429 THEN CASE WHEN said THEN 9 ELSE 30 END ELSE 0 END AS retry_after_s, CASE WHEN status IS NULL THEN 'NETWORK_ERROR' WHEN status <> 200 THEN 'WHATSAPP_HTTP_' || status || ':' || CASE WHEN said THEN '{"retry_after": 9.5}' ELSE 'busy' END END AS error, count(*) AS n FROM a GROUP BY status, said""")
def channel_answers(spark, d):
    from trustmill.sources import sinks

    k = F.col("l_partkey") % 5
    status = F.when(k == 0, 200).when(k == 1, 429).when(k == 2, 503).when(k == 3, 400)
    said = F.col("l_suppkey") % 2 == 0
    rows = table(spark, d, "lineitem").select(status.alias("status"), said.alias("said"), F.when(said, '{"retry_after": 9.5}').otherwise("busy").alias("body"))
    return rows.select("status", "said", sinks.answer(F.col("status"), F.col("body"), "WHATSAPP").alias("a")).groupBy("status", "said", "a.ok", "a.retryable", "a.retry_after_s", "a.error").agg(F.count(F.lit(1)).alias("n"))


@query(with_views("m_events") + """SELECT event_id, 'EVENT: Event ' || event_id || chr(10) || 'SCORE: 70 (' || status || ' / Tier ' || publishing_tier || ')' || chr(10) || 'SOURCE: https://s.org/' || event_id || chr(10) || 'REG_URL: ' || CASE WHEN event_id % 2 = 0 THEN 'https://r.org' ELSE 'none' END || chr(10) || 'LINK: APPROVE' || chr(10) || 'REASON: gate=PASS'
  || chr(10) || 'DUPECHECK: ' || CASE WHEN event_id % 3 = 0 THEN 'TITLE_DATE_MATCH' ELSE 'INSUFFICIENT_EVIDENCE' END AS line FROM m_events""")
def report_lines(spark, d):
    from trustmill.sources.sinks import report_line

    e = F.col("event_id")
    score = F.concat(F.lit("70 ("), "status", F.lit(" / Tier "), "publishing_tier", F.lit(")"))
    line = report_line(F.concat(F.lit("Event "), e), score, F.concat(F.lit("https://s.org/"), e), F.when(e % 2 == 0, "https://r.org"), F.lit("APPROVE"), F.lit("gate=PASS"), F.when(e % 3 == 0, "TITLE_DATE_MATCH").otherwise(F.lit(None).cast("string")))
    return view(spark, d, "m_events").select("event_id", line.alias("line"))


@query("""WITH t AS (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'SIH ' || p_name WHEN 1 THEN p_name || ', Sawo' ELSE 'sihx ' || p_name END AS t FROM part)
SELECT id, regexp_replace(regexp_replace(' ' || lower(t) || ' ', '\\bsih\\b', ' smart india hackathon ', 'g'), '\\bsawo\\b', ' smart india hackathon ', 'g') AS title FROM t""")
def expand_abbreviations(spark, d):
    from trustmill.functions.text import expand_abbreviations as f

    k = F.col("p_partkey") % 3
    text = F.when(k == 0, F.concat(F.lit("SIH "), "p_name")).when(k == 1, F.concat("p_name", F.lit(", Sawo"))).otherwise(F.concat(F.lit("sihx "), "p_name"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), f(text).alias("title"))


SECRET = """concat(text, ' bot 123456789:', repeat('a', 35), CASE WHEN turn % 2 = 0 THEN concat(' API_KEY= k', conv_id, '; x') ELSE concat(' ghp_', repeat('Z', 22), ' xoxb-1-a') END)"""


@query(rf"""WITH t AS (SELECT conv_id, turn, {SECRET} AS t FROM conversations)
SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\b[0-9]{{8,10}}:[A-Za-z0-9_-]{{30,}}', '[REDACTED]', 'g'), 'xox[baprs]-[A-Za-z0-9-]+', '[REDACTED]', 'g'), 'gh[pousr]_[A-Za-z0-9]{{20,}}', '[REDACTED]', 'g'), '(?i)(api[_-]?key|token|secret|password)(\s*[=:]\s*)([^\s,;]+)', '\1\2[REDACTED]', 'g') AS t FROM t""")
def redact_secrets(spark, d):
    from trustmill.functions.text import redact_secrets as f

    return table(spark, d, "conversations").select("conv_id", "turn", f(F.expr(SECRET)).alias("t"))


@query("SELECT page_id, CASE WHEN page_id % 3 < 2 THEN 'Talk ' || page_id END AS title, CASE WHEN page_id % 3 = 2 THEN 'about ' || page_id END AS about FROM pages")
def meta_contents(spark, d):
    from trustmill.functions.html import meta_content

    p = F.col("page_id")
    tag = F.when(p % 3 == 0, F.concat(F.lit('<meta property="og:title" content=" Talk '), p, F.lit(' "/>'))).when(p % 3 == 1, F.concat(F.lit("<META content='Talk "), p, F.lit("' property='og:title'>"))).otherwise(F.concat(F.lit('<meta name="description" lang="en" content="about '), p, F.lit('">')))
    html = F.concat(tag, "html")
    return table(spark, d, "pages").select("page_id", meta_content(html, "property", "og:title").alias("title"), meta_content(html, "name", "description").alias("about"))


@query("""WITH h AS (SELECT page_id, array_to_string(list_slice(string_split(lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)), '.'), -2, -1), '.') AS domain FROM pages), r AS (SELECT *, regexp_replace(split_part(domain, '.', 1), '[^a-z0-9]', '', 'g') AS squashed, split_part(domain, '.', 1) AS root FROM h)
SELECT page_id, page_id % 4 < 2 AND squashed IN (root, root || 's') AS names_site FROM r""")
def site_names(spark, d):
    from trustmill.functions.html import is_site_name
    from trustmill.functions.urls import host_of, registrable_domain

    p = F.col("page_id") % 4
    root = F.split(registrable_domain(host_of(F.col("url"))), r"\.")[0]
    title = F.when(p == 0, F.upper(root)).when(p == 1, F.concat(root, F.lit(" !"))).when(p == 2, F.concat(F.lit("My "), root)).otherwise("Robot Contest")
    return table(spark, d, "pages").select("page_id", is_site_name(title, F.col("url")).alias("names_site"))


FLAGS = ("THREAT_REPUTATION_HIT", "LOOKALIKE:PUNYCODE", "LOOKALIKE:UNUSUAL_TLD", "UNKNOWN_REGISTRATION_DOMAIN", "NON_HTTPS", "SHORT_URL")


@query(f"""WITH f AS (SELECT [{', '.join(f"'{x}'" for x in FLAGS)}][1 + l_partkey % 6] AS flag FROM lineitem)
SELECT flag, CASE WHEN flag IN ('THREAT_REPUTATION_HIT', 'LOOKALIKE:PUNYCODE') THEN 'critical' WHEN flag IN ('LOOKALIKE:UNUSUAL_TLD', 'UNKNOWN_REGISTRATION_DOMAIN') THEN 'warning' ELSE 'info' END AS severity, count(*) AS n FROM f GROUP BY flag""")
def flag_severities(spark, d):
    from trustmill.functions.scoring import flag_severity

    flag = F.element_at(F.array(*map(F.lit, FLAGS)), (F.col("l_partkey") % 6 + 1).cast("int"))
    rows = table(spark, d, "lineitem").select(flag.alias("flag")).select("flag", flag_severity(F.col("flag")).alias("severity"))
    return rows.groupBy("flag", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT page_id AS event_id, page_id % 7 < 3 AND page_id % 4 <> 3 AS official_page, CASE WHEN page_id % 7 < 3 THEN 'c' || page_id || '.org' END AS official_domain, page_id % 7 < 3 AND page_id % 4 < 2 AS official_links, CASE WHEN page_id % 5 <> 4 THEN page_id % 5 <> 3 END AS identity, page_id % 4 = 3 AS event_page_dead FROM pages""")
def official_contexts(spark, d):
    from trustmill.operators.verification import official_context

    none, p = F.lit(None).cast("string"), F.col("page_id")
    own, form = F.concat(F.lit("https://site.c"), p, F.lit(".org/e")), F.concat(F.lit("https://f.org/r"), p)
    pages = table(spark, d, "pages")
    events = pages.select(p.alias("event_id"), F.lit("Robot Contest").alias("title"), none.alias("organizer_name"), own.alias("event_url"), form.alias("registration_url"), (1 + p % 7).cast("int").alias("best_level"))
    link = F.concat(F.lit('<a href="'), form, F.lit('?utm_source=x">go</a>'))
    seen = pages.select(own.alias("url"), F.when(p % 4 == 3, 404).otherwise(200).alias("status"), F.when(p % 4 < 2, link).otherwise("<p>none</p>").alias("body"))
    forms = pages.where(p % 5 != 4).select(form.alias("url"), F.lit(200).alias("status"), F.when(p % 5 == 3, "<script>robot contest</script>nothing").otherwise("<p>the robot CONTEST form</p>").alias("body"))
    return official_context(events, seen.unionByName(forms)).select("event_id", "official_page", "official_domain", "official_links", "identity", "event_page_dead")


@query(with_views("m_sources") + """SELECT 's' || coalesce(a.source_id, b.source_id) AS slug, CASE WHEN b.source_id IS NOT NULL THEN 77 ELSE a.trust_score END AS trust, CASE WHEN b.source_id IS NOT NULL THEN true ELSE a.enabled = 1 END AS enabled, CASE WHEN a.source_id IS NOT NULL THEN 'OK' END AS last_status
FROM (SELECT * FROM m_sources WHERE source_id % 3 <> 0) a FULL JOIN (SELECT * FROM m_sources WHERE source_id % 2 = 0) b ON a.source_id = b.source_id""")
def registry_refresh(spark, d):
    from trustmill.sources.seeds import refresh_registry

    rows = view(spark, d, "m_sources").select("source_id", F.concat(F.lit("s"), "source_id").alias("slug"), F.lit("rss").alias("kind"), F.lit(3).alias("level"), F.lit("https://x").alias("base_url"), F.col("trust_score").alias("trust"), (F.col("enabled") == 1).alias("enabled"), F.lit(1).alias("rate_limit_ms"))
    registry = rows.where("source_id % 3 <> 0").withColumns({"last_run": now(), "last_status": F.lit("OK")}).drop("source_id")
    seeds = rows.where("source_id % 2 = 0").withColumns({"trust": F.lit(77), "enabled": F.lit(True)})
    return refresh_registry(registry, seeds).select("slug", "trust", "enabled", "last_status")


@query("SELECT 'github.com/s' || page_id AS a, 's' || page_id || '.org' AS b FROM pages WHERE page_id % 3 <> 0 AND page_id % 2 = 0")
def mutual_profiles(spark, d):
    from trustmill.functions.social import mutual, named_links

    p = F.col("page_id")
    anchor = lambda *url: F.concat(F.lit('<a href="'), *url, F.lit('">x</a>'))
    pages = table(spark, d, "pages")
    sites = pages.select(F.concat(F.lit("https://s"), p, F.lit(".org/about")).alias("url"), F.concat("html", F.when(p % 3 != 0, anchor(F.lit("https://github.com/S"), p)).otherwise(""), anchor(F.lit("https://s"), p + 1, F.lit(".org/"))).alias("html"))
    profiles = pages.select(F.concat(F.lit("https://www.github.com/s"), p, F.lit("/repo")).alias("url"), F.when(p % 2 == 0, anchor(F.lit("https://www.s"), p, F.lit(".org/"))).otherwise("html").alias("html"))
    return mutual(named_links(sites.unionByName(profiles)))


@query(f"""WITH i AS ({ITEMS}), s AS (SELECT DISTINCT source_id FROM i WHERE source_id IS NOT NULL), t AS (SELECT i.* FROM i WHERE source_id IS NOT NULL AND right(source_id, 1) <> '4'), n AS (SELECT * FROM t WHERE trim(title) <> ''), k AS (SELECT DISTINCT regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g') AS title, lower(organizer) AS org, event_url FROM n)
SELECT 'events' AS name, (SELECT count(*) FROM k) AS n, NULL AS last UNION ALL SELECT 'event_links', (SELECT count(*) FROM k), (SELECT count(*) FROM k) UNION ALL SELECT 'event_sources', (SELECT count(*) FROM n), (SELECT count(*) FROM n)
UNION ALL SELECT 'source_registry', (SELECT count(*) FROM s), NULL UNION ALL SELECT 'source_runs', (SELECT count(*) FROM s), (SELECT count(*) FROM s) UNION ALL SELECT 'dead_letter_queue', (SELECT count(*) FROM s WHERE right(source_id, 1) = '4'), (SELECT count(*) FROM s WHERE right(source_id, 1) = '4')""")
def committed_discovery(spark, d):
    """A discovery run committed to a new store, and again, which changes nothing: rows and last numbers of its tables."""
    from trustmill.operators import state
    from trustmill.session import shared_path

    none = F.lit(None).cast("string")
    items = spark.sql(ITEMS.replace("FROM documents", "FROM {documents}"), documents=table(spark, d, "documents")).select("source_id", "seq", F.concat(F.lit("https://s.org/"), "seq").alias("source_url"), "title", "organizer", none.alias("format"), none.alias("start_date"), "event_url", none.alias("registration_url"), F.lit(5).alias("source_level"), none.alias("security_note"))
    failures = items.where("right(source_id, 1) = '4'").select("source_id", F.lit("TIMEOUT").alias("error")).distinct()
    folder = shared_path(spark, "store")
    state.discover(spark, folder, 0, items, failures, now())
    snapshot = state.discover(spark, folder, 0, items, failures, now())
    rows = []
    for name in ("events", "event_links", "event_sources", "source_registry", "source_runs", "dead_letter_queue"):
        number = F.max(state.NUMBERS[name]).cast("long") if name in state.NUMBERS else F.lit(None).cast("long")
        rows.append(snapshot.table(spark, name).agg(F.count(F.lit(1)).alias("n"), number.alias("last")).select(F.lit(name).alias("name"), "n", "last"))
    whole = rows[0]
    for r in rows[1:]:
        whole = whole.unionByName(r)
    return whole


@query(with_views("m_outcomes") + """, steps AS (SELECT source_id, list(CASE outcome WHEN 'valid' THEN 1000 WHEN 'dead_link' THEN -2 WHEN 'fake' THEN -8 ELSE -1 END ORDER BY observed_at, seq) AS l FROM m_outcomes GROUP BY source_id)
SELECT source_id, CAST(list_reduce(list_prepend(50, l), lambda a, b: greatest(0, least(100, a + CASE WHEN b = 1000 AND a >= 90 THEN 1 WHEN b = 1000 THEN 3 ELSE b END))) AS INT) AS trust FROM steps""")
def streamed_trust(spark, d):
    """Trust as the state of a stream of outcomes, as its last batch left it."""
    from trustmill.session import shared_path
    from trustmill.streaming.flows import trust_stream

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source, kinds = shared_path(spark, "outcomes"), "source_id long, observed_at timestamp, seq long, outcome string"
    view(spark, d, "m_outcomes").select(F.col("source_id").cast("long").alias("source_id"), "observed_at", F.col("seq").cast("long").alias("seq"), "outcome").write.parquet(source)
    each = lambda df, epoch: df.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{source}-out/{epoch}")
    trust_stream(spark.readStream.schema(kinds).parquet(source)).writeStream.outputMode("update").option("checkpointLocation", source + "-checkpoint").trigger(availableNow=True).foreachBatch(each).start().awaitTermination()
    out = spark.read.schema("source_id long, trust int, steps int, epoch long").parquet(f"{source}-out/*")
    return out.groupBy("source_id").agg(F.max_by("trust", "epoch").alias("trust"))


@query(ORACLES["tumbling_counts"])
def streamed_windows(spark, d):
    """The tumbling windows as a stream of two batches gives them, late rows included."""
    from trustmill.session import shared_path
    from trustmill.streaming.flows import windowed_counts

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source, events = shared_path(spark, "stream"), table(spark, d, "events")
    # two arrivals, each of as many files as tasks that read the table
    told = events.withColumn("ts", F.col("ts").cast("timestamp"))
    for part in range(2):
        told.where(F.pmod(F.xxhash64("event_id"), F.lit(2)) == part).write.mode("append").parquet(source)
    whole = spark.read.schema(told.schema).parquet(source)
    stream = spark.readStream.schema(told.schema).option("maxFilesPerTrigger", max(1, -(-len(whole.inputFiles()) // 2))).parquet(source)
    out = f"{source}-out"
    each = lambda df, _: df.write.mode("overwrite").parquet(out)
    windowed_counts(stream, late="100 days").writeStream.outputMode("complete").option("checkpointLocation", f"{source}-checkpoint").trigger(availableNow=True).foreachBatch(each).start().awaitTermination()
    found = spark.read.parquet(out)
    return found.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))
