"""Feeds, sitemaps, robots rules and search phrases. Texts are taken apart with regular expressions; entities of
documents' own making are never expanded."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trustmill.config import BASE_TOPICS, CITY_TEMPLATES, COVERED_CITIES, SITEMAP_EXCLUDED
from trustmill.functions.dates import iso, parse_date
from trustmill.functions.text import collapsed, fold_confusables, sanitize, trimmed
from trustmill.functions.urls import valid_http_url

FEED_ITEMS, SITEMAP_FILES, SITEMAP_URLS, KEPT_URLS, QUERIES = 200, 1000, 20_000, 50, 120


def _all(c: Column, tag: str) -> Column:
    return F.regexp_extract_all(c, F.lit(rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}\s*>"), F.lit(1))


def _first(c: Column, *tags: str) -> Column:
    return F.coalesce(*(F.try_element_at(_all(c, t), F.lit(1)) for t in tags))


def strip_tags(c: Column) -> Column:
    """Text without scripts, styles, tags and the few entities that feeds use."""
    for tag in ("script", "style"):
        c = F.regexp_replace(c, rf"(?is)<{tag}.*?</{tag}\s*>", " ")
    c = F.regexp_replace(c, "<[^>]*>", " ")
    # one pass over the text: pieces between entities, and what each entity stands for
    pieces = F.split(c, "&(?:amp|lt|gt|quot|#[0-9]+);")
    entities = F.regexp_extract_all(c, F.lit("&(amp|lt|gt|quot|#[0-9]+);"), F.lit(1))
    code = lambda e: F.substring(e, 2, 20).try_cast("long")
    shown = F.transform(entities, lambda e: F.when(e == "amp", "&").when(e == "lt", "<").when(e == "gt", ">").when(e == "quot", '"').when((code(e) > 0) & (code(e) < 0x10FFFF), character(code(e))).otherwise(""))
    return collapsed(F.array_join(F.zip_with(pieces, shown, lambda p, e: F.concat(p, F.coalesce(e, F.lit("")))), ""))


def character(code: Column) -> Column:
    """The character of a code point, by way of its UTF-32 bytes."""
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def parse_feeds(feeds: DataFrame, xml: str = "xml") -> DataFrame:
    """One row an item (one with a null position for a feed without items): kind, pos, title, link, published, summary,
    flagged, error, next to the feed's own columns."""
    text = F.col(xml)
    head = F.lower(F.left(text, F.lit(2000)))
    kind = F.when(head.rlike(r"<(rss|channel)[\s>]"), "rss").when(head.rlike(r"<feed[\s>]"), "atom").otherwise("unknown")
    blocks = F.when(kind == "rss", _all(text, "item")).when(kind == "atom", _all(text, "entry")).otherwise(F.array().cast("array<string>"))
    rows = feeds.select("*", kind.alias("kind"), F.posexplode_outer(F.slice(blocks, 1, FEED_ITEMS)).alias("pos", "block"))
    b, rss = F.col("block"), F.col("kind") == "rss"
    value = lambda c: F.nullif(strip_tags(c), F.lit(""))
    tags = F.regexp_extract_all(b, F.lit(r"(?i)<link\s[^>]*>"), F.lit(0))
    attribute = lambda t, name: F.nullif(F.regexp_extract(t, rf"""(?i){name}\s*=\s*["']([^"']+)["']""", 1), F.lit(""))
    plain = F.filter(tags, lambda t: attribute(t, "href").isNotNull() & F.coalesce(attribute(t, "rel") == "alternate", F.lit(True)))
    href = attribute(F.coalesce(F.try_element_at(plain, F.lit(1)), F.try_element_at(tags, F.lit(1))), "href")
    rows = rows.withColumn("_summary", strip_tags(F.when(rss, _first(b, "description", "content:encoded")).otherwise(_first(b, "summary", "content"))))
    rows = rows.withColumn("_folded", fold_confusables(F.col("_summary")))
    summary = sanitize(F.col("_summary"), F.col("_folded"))
    return rows.select(
        *feeds.columns, "kind", "pos", value(_first(b, "title")).alias("title"), F.when(rss, value(_first(b, "link"))).otherwise(href).alias("link"),
        iso(parse_date(strip_tags(F.when(rss, _first(b, "pubDate", "dc:date")).otherwise(_first(b, "published", "updated"))))).alias("published"),
        F.nullif(summary["text"], F.lit("")).alias("summary"), F.coalesce(summary["flagged"], F.lit(False)).alias("flagged"),
        F.when(F.col("kind") == "unknown", "UNRECOGNIZED_FEED").alias("error"),
    )


def parse_sitemaps(maps: DataFrame, xml: str = "xml") -> DataFrame:
    """One row an address (one with a null position for a map without any): kind, pos, loc, lastmod, error."""
    text = F.col(xml)
    head = F.lower(F.left(text, F.lit(2000)))
    kind = F.when(F.contains(head, F.lit("<sitemapindex")), "index").when(F.contains(head, F.lit("<urlset")), "urlset").otherwise("unknown")
    inner = lambda tag: F.regexp_extract_all(text, F.lit(rf"(?is)<{tag}\s*>(.*?)</{tag}\s*>"), F.lit(1))
    blocks = F.when(kind == "index", F.slice(inner("sitemap"), 1, SITEMAP_FILES)).when(kind == "urlset", F.slice(inner("url"), 1, SITEMAP_URLS)).otherwise(F.array().cast("array<string>"))
    one = lambda b, tag: F.nullif(trimmed(F.regexp_extract(b, rf"(?is)<{tag}\s*>(.*?)</{tag}\s*>", 1)), F.lit(""))
    urls = F.filter(F.transform(blocks, lambda b: F.struct(valid_http_url(one(b, "loc")).alias("loc"), one(b, "lastmod").alias("lastmod"))), lambda u: u["loc"].isNotNull())
    rows = maps.select("*", kind.alias("kind"), F.posexplode_outer(urls).alias("pos", "u"))
    return rows.select(*maps.columns, "kind", "pos", "u.loc", "u.lastmod", F.when(F.col("kind") == "unknown", "UNRECOGNIZED_SITEMAP").alias("error"))


def sitemap_wanted(url: Column, include: tuple[str, ...]) -> Column:
    some = lambda ps: reduce(lambda a, b: a | b, (url.rlike(f"(?i){p}") for p in ps), F.lit(False))
    return ~some(SITEMAP_EXCLUDED) & (some(include) if include else F.lit(True))


def first_wanted(urls: DataFrame, include: tuple[str, ...], limit: int = KEPT_URLS) -> DataFrame:
    """The first wanted addresses of each map. urls: map_id, pos, loc."""
    order = Window.partitionBy("map_id").orderBy("pos")
    return urls.where(sitemap_wanted(F.col("loc"), include)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).drop("rank")


def robots_lines(robots: DataFrame) -> DataFrame:
    """One row a directive: host, pos, field, value. robots: host, text."""
    lines = robots.select("host", F.posexplode(F.split("text", "\r?\n")).alias("pos", "line"))
    own = trimmed(F.split("line", "#")[0])
    at = F.locate(":", own)
    parts = lines.select("host", "pos", own.alias("own"), at.alias("at")).where("at > 0")
    return parts.select("host", "pos", F.lower(trimmed(F.expr("left(own, at - 1)"))).alias("field"), trimmed(F.expr("substring(own, at + 1)")).alias("value"))


def robots_rules(robots: DataFrame, agent: str = "*") -> DataFrame:
    """host, allows, disallows, sitemaps that hold for an agent: the group naming it best, the first among equals.

    A user-agent line that follows a rule begins a new group.
    """
    lines = robots_lines(robots).withColumn("is_agent", F.col("field") == "user-agent").withColumn("is_rule", F.col("field").isin("allow", "disallow"))
    order = Window.partitionBy("host").orderBy("pos")
    relevant = lines.where("is_agent or is_rule").withColumn("begins", F.col("is_agent") & ~F.coalesce(F.lag("is_agent").over(order), F.lit(False)))
    groups = relevant.withColumn("grp", F.sum(F.col("begins").cast("int")).over(order)).where("grp > 0")
    name, own = F.lower("value"), F.lit(agent.lower())
    rank = F.when(name == "*", 0).when(name == own, 2).when(own.startswith(name) | name.startswith(own), 1).otherwise(-1)
    best = groups.where("is_agent").groupBy("host", "grp").agg(F.max(rank).alias("rank")).where("rank >= 0").groupBy("host").agg(F.max_by("grp", F.struct(F.col("rank"), -F.col("grp"))).alias("grp"))
    rules = groups.where("is_rule and value <> ''").join(best, ["host", "grp"])
    lists = rules.groupBy("host").agg(*(F.collect_list(F.when(F.col("field") == f, F.col("value"))).alias(f"{f}s") for f in ("allow", "disallow")))
    maps = lines.where("field = 'sitemap' and value <> ''").groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda s: s["value"]).alias("sitemaps"))
    none = F.array().cast("array<string>")
    return robots.select("host").distinct().join(lists, "host", "left").join(maps, "host", "left").select("host", *(F.coalesce(c, none).alias(c) for c in ("allows", "disallows", "sitemaps")))


def is_allowed(allows: Column, disallows: Column, url: Column) -> Column:
    """The longest rule that begins the path decides, allowing on a tie."""
    path = F.concat(F.coalesce(F.nullif(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+([^?#]*)", 1), F.lit("")), F.lit("/")), F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1))
    longest = lambda rules: F.coalesce(F.array_max(F.transform(F.filter(rules, lambda r: (r != "") & path.startswith(r)), F.length)), F.lit(-1))
    absolute = url.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+")
    return F.coalesce(absolute & ((longest(disallows) < 0) | (longest(allows) >= longest(disallows))), F.lit(False))


def search_queries(spark: SparkSession, year: int, topics: tuple[str, ...] = BASE_TOPICS, cities: tuple[str, ...] = COVERED_CITIES, most: int = QUERIES) -> DataFrame:
    """pos, query: topics as they are and with the year, then cities in every template; the first of equal ones."""
    t = spark.createDataFrame(list(enumerate(topics)), "a int, topic string")
    dated = F.when(F.col("topic").rlike(r"\b20[0-9]{2}\b"), F.regexp_replace("topic", "20[0-9]{2}", str(year))).otherwise(F.concat("topic", F.lit(f" {year}")))
    by_topic = t.select(F.lit(0).alias("part"), "a", F.posexplode(F.array("topic", dated)).alias("b", "query"))
    c = spark.createDataFrame(list(enumerate(cities)), "a int, city string")
    filled = F.transform(F.array(*map(F.lit, CITY_TEMPLATES)), lambda x: F.replace(x, F.lit("{city}"), F.col("city")))
    by_city = c.select(F.lit(1).alias("part"), "a", F.posexplode(filled).alias("b", "query"))
    return first_phrases(by_topic.unionByName(by_city), most)


def first_phrases(phrases: DataFrame, most: int) -> DataFrame:
    """The first of equal phrases, in the order of part, a, b, at most so many. The number of phrases is that of a list
    in the settings, so one task may order them."""
    key = F.lower(trimmed(F.col("query")))
    first = Window.partitionBy(key).orderBy("part", "a", "b")
    kept = phrases.withColumn("rank", F.row_number().over(first)).where((F.col("rank") == 1) & (key != ""))
    ordered = kept.orderBy("part", "a", "b").limit(most)
    return ordered.select((F.row_number().over(Window.orderBy("part", "a", "b")) - 1).alias("pos"), trimmed(F.col("query")).alias("query"))
