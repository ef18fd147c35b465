"""Connectors: snapshots of feeds, sitemaps and search answers as discovered items.

A connector is described by a row of the registry (slug, kind, level, base_url, feed_url, trust, max_pages); what its
addresses answered is a snapshot table (url, status, final_url, body, error). Reading and finding are apart, so that a
run can be repeated from the snapshot. All kinds give the same columns (ITEM) and failures (source_id, error).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trustmill.config import EVENT_URL_HINTS
from trustmill.functions.feeds import is_allowed, parse_feeds, parse_sitemaps, robots_rules, sitemap_wanted
from trustmill.functions.html import extract_events
from trustmill.functions.urls import host_of

ITEM = ("source_id", "seq", "source_level", "source_url", "title", "organizer", "format", "start_date", "event_url", "registration_url", "confidence", "security_note", "raw")
FEED_ITEMS, FEED_LEVEL, SITEMAPS, CHILD_MAPS, RESULTS, RAW_CHARS = 20, 5, 3, 5, 5, 4000
BLOCKED = "BLOCKED_BY_ROBOTS_TXT"


def kinds(seeds: DataFrame) -> dict[str, DataFrame]:
    """The seeds by the connector that reads them."""
    return {kind: seeds.where(F.col("kind") == kind) for kind in ("rss", "sitemap", "search")}


def guarded(snapshot: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """The snapshot as robots files allow it: addresses that they forbid keep only the error. robots: host, text; hosts
    without an entry allow everything."""
    rules = robots_rules(robots, agent).select(F.col("host").alias("_host"), "allows", "disallows")
    known = snapshot.withColumn("_host", host_of(F.col("url"))).join(rules, "_host", "left")
    blocked = F.col("allows").isNotNull() & ~is_allowed(F.col("allows"), F.col("disallows"), F.col("url"))
    kept = {c: F.when(~blocked, F.col(c)) for c in ("status", "final_url", "body")}
    return known.withColumns({**kept, "error": F.when(blocked, BLOCKED).otherwise(F.col("error"))}).select(*snapshot.columns)


def _told(items: DataFrame) -> DataFrame:
    have = set(items.columns)
    text = lambda c: F.lit(None).cast("string").alias(c)
    return items.select(*(c if c in have else text(c) for c in ITEM))


def _error(prefix: str):
    return F.concat(F.lit(prefix), F.coalesce("error", F.concat(F.lit("HTTP_"), F.coalesce(F.col("status").cast("string"), F.lit("?")))))


def from_feeds(seeds: DataFrame, snapshot: DataFrame, most: int = FEED_ITEMS) -> tuple[DataFrame, DataFrame]:
    """Items and failures of feeds. An item without a link stands at its feed's address."""
    read = seeds.select(F.col("slug").alias("source_id"), "feed_url").join(snapshot.select(F.col("url").alias("feed_url"), "status", "body", F.col("error").alias("error")), "feed_url", "left")
    good = F.col("body").isNotNull() & F.coalesce(F.col("status").between(200, 299), F.lit(False))
    parsed = parse_feeds(read.where(good).select("source_id", "feed_url", "body"), "body").where(f"error is not null or pos < {most}")
    items = parsed.where("error is null and pos is not null").select(
        "source_id", F.col("pos").alias("seq"), F.lit(FEED_LEVEL).alias("source_level"), F.coalesce("link", "feed_url").alias("source_url"), "title", F.col("link").alias("event_url"), F.col("published").alias("start_date"), F.lit(0.4).alias("confidence"),
        F.left(F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("summary", F.lit(""))), F.lit(RAW_CHARS)).alias("raw"),
    )
    unread = read.where(~good).select("source_id", F.concat(F.lit("RSS fetch failed ("), "feed_url", F.lit("): "), _error("")).alias("error"))
    unparsed = parsed.where("error is not null").select("source_id", F.concat(F.lit("RSS parse failed: "), "error").alias("error"))
    return _told(items), unread.unionByName(unparsed)


def map_addresses(seeds: DataFrame, robots: DataFrame) -> DataFrame:
    """source_id, pos, url of the sitemaps to read: the first that the robots file names, or the usual one."""
    named = robots_rules(robots).select(F.col("host").alias("_host"), "sitemaps")
    base = F.regexp_replace("base_url", "/+$", "")
    own = seeds.select(F.col("slug").alias("source_id"), base.alias("base"), host_of(F.col("base_url")).alias("_host")).join(named, "_host", "left")
    maps = F.when(F.size("sitemaps") > 0, F.slice("sitemaps", 1, SITEMAPS)).otherwise(F.array(F.concat("base", F.lit("/sitemap.xml"))))
    return own.select("source_id", F.posexplode(maps).alias("pos", "url"))


def page_addresses(seeds: DataFrame, maps: DataFrame, snapshot: DataFrame, include: tuple[str, ...] = EVENT_URL_HINTS) -> DataFrame:
    """source_id, pos, url of the pages to read: wanted addresses of the sitemaps and of the first children of an index,
    each once, at most max_pages of a source. Maps that are missing or no maps give nothing."""
    bodies = snapshot.where(F.col("status").between(200, 299) & F.col("body").isNotNull()).select("url", "body")
    parsed = parse_sitemaps(maps.select("source_id", "pos", "url").withColumnRenamed("pos", "map_pos").join(bodies, "url"), "body").select("source_id", "map_pos", "kind", "pos", "loc").where("loc is not null")
    children = parsed.where(f"kind = 'index' and pos < {CHILD_MAPS}").select("source_id", "map_pos", F.col("pos").alias("child"), F.col("loc").alias("url"))
    below = parse_sitemaps(children.join(bodies, "url"), "body").where("kind = 'urlset' and loc is not null").select("source_id", "map_pos", "child", "pos", "loc")
    found = parsed.where("kind = 'urlset'").select("source_id", "map_pos", F.lit(-1).alias("child"), "pos", "loc").unionByName(below).where(sitemap_wanted(F.col("loc"), include))
    place = F.struct("map_pos", "child", "pos")
    once = found.groupBy("source_id", F.col("loc").alias("url")).agg(F.min(place).alias("place"))
    ranked = once.withColumn("pos", F.row_number().over(Window.partitionBy("source_id").orderBy("place")) - 1)
    return ranked.join(seeds.select(F.col("slug").alias("source_id"), F.coalesce("max_pages", F.lit(10)).alias("_most")), "source_id").where("pos < _most").select("source_id", "pos", "url")


def from_pages(seeds: DataFrame, addresses: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Items of pages that could be read; a page that failed gives none and stops nothing."""
    good = snapshot.where(F.col("status").between(200, 299) & F.col("body").isNotNull()).select("url", F.coalesce("final_url", "url").alias("source_url"), "body")
    level = seeds.select(F.col("slug").alias("source_id"), F.col("level").alias("source_level"))
    found = extract_events(addresses.join(good, "url").join(level, "source_id"), "body", "source_url")
    note = F.when(F.col("event.flagged"), F.concat(F.lit("INJECTION_PATTERNS_NEUTRALIZED:"), F.array_join("event.flag_details", ",")))
    return _told(found.select("source_id", F.col("pos").alias("seq"), "source_level", "source_url", *(f"event.{c}" for c in ("title", "organizer", "format", "start_date", "event_url", "registration_url", "confidence")), note.alias("security_note"), F.left("body", F.lit(2 * RAW_CHARS)).alias("raw")))


def from_search(seeds: DataFrame, answers: DataFrame) -> DataFrame:
    """Items of a search service's answers: source_id, seq, body ({"results": [{"title", "url", "snippet"}]}). Results
    without an http(s) address and those beyond the first RESULTS of an answer are left out; a source that is not enabled gives nothing."""
    on = seeds.where("enabled").select(F.col("slug").alias("source_id"), F.col("level").alias("source_level"))
    results = F.from_json(F.get_json_object("body", "$.results"), "array<struct<title:string,url:string,snippet:string>>")
    rows = answers.join(on, "source_id").select("source_id", "source_level", F.col("seq").alias("_page"), F.posexplode(F.slice(results, 1, RESULTS)).alias("_pos", "r"))
    kept = rows.where(F.col("r.url").rlike("^https?://"))
    return _told(kept.select("source_id", (F.col("_page") * 1000 + F.col("_pos")).cast("int").alias("seq"), "source_level", F.col("r.url").alias("source_url"), F.col("r.title").alias("title"), F.col("r.url").alias("event_url"), F.lit(0.2).alias("confidence"), F.left(F.concat(F.coalesce("r.title", F.lit("")), F.lit("\n"), F.coalesce("r.snippet", F.lit(""))), F.lit(RAW_CHARS // 2)).alias("raw")))
