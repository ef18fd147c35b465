"""Table functions for SQL: extract_links(html, base), parse_feed(xml) and parse_sitemap(xml).

They take a row's text apart as the column functions of html and feeds do and are meant for SQL users; flows use the
column forms, which stay in the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from trustmill.functions.feeds import FEED_ITEMS, SITEMAP_FILES, SITEMAP_URLS
from trustmill.functions.html import MOST_LINKS, QUOTED, SCANNED_LINKS

FLAGS = re.IGNORECASE | re.DOTALL
#: Signs that tell a document's kind stand at its head.
HEAD_SIGNS = 2000


def _first(text: str, *tags: str) -> str | None:
    for tag in tags:
        if found := re.search(rf"<{tag}(?:\s[^>]*)?>(.*?)</{tag}\s*>", text, FLAGS):
            return " ".join(re.sub("<[^>]*>", " ", found[1]).split()) or None
    return None


class ExtractLinks:
    def eval(self, html: str, base: str) -> Iterator[tuple[int, str]]:
        for tag in ("script", "style", "iframe"):
            html = re.sub(rf"<{tag}.*?</{tag}\s*>", " ", html or "", flags=FLAGS)
        html = re.sub("<!--.*?-->", " ", html, flags=FLAGS)
        seen: dict[str, None] = {}
        for n, found in enumerate(re.finditer(rf"<a\s[^>]*href\s*=\s*{QUOTED}[^>]*>.*?</a\s*>", html, FLAGS)):
            href = found[1].strip()
            link = urljoin(base or "", href) if href and not re.match("#|javascript:|mailto:|data:", href) else ""
            if re.match("https?://", link, re.IGNORECASE):
                seen.setdefault(link)
            if n + 1 >= SCANNED_LINKS or len(seen) >= MOST_LINKS:
                break
        yield from enumerate(seen)


class ParseFeed:
    def eval(self, xml: str) -> Iterator[tuple]:
        xml = xml or ""
        head = xml[:HEAD_SIGNS].lower()
        kind = "rss" if re.search(r"<(rss|channel)[\s>]", head) else "atom" if re.search(r"<feed[\s>]", head) else None
        if kind is None:
            yield None, None, None, None, "UNRECOGNIZED_FEED"
            return
        tag = "item" if kind == "rss" else "entry"
        for pos, found in enumerate(re.finditer(rf"<{tag}(?:\s[^>]*)?>(.*?)</{tag}\s*>", xml, FLAGS)):
            if pos >= FEED_ITEMS:
                break
            block = found[1]
            tags = [t for t in re.findall(r"<link\s[^>]*>", block, re.IGNORECASE)]
            attribute = lambda t, name: (m := re.search(rf"""{name}\s*=\s*["']([^"']+)["']""", t, re.IGNORECASE)) and m[1]
            plain = [t for t in tags if attribute(t, "href") and attribute(t, "rel") in (None, "alternate")]
            href = next((attribute(t, "href") for t in plain + tags[:1]), None)
            yield kind, pos, _first(block, "title"), _first(block, "link") if kind == "rss" else href, None


class ParseSitemap:
    def eval(self, xml: str) -> Iterator[tuple]:
        xml = xml or ""
        head = xml[:HEAD_SIGNS].lower()
        kind, tag, most = ("index", "sitemap", SITEMAP_FILES) if "<sitemapindex" in head else ("urlset", "url", SITEMAP_URLS) if "<urlset" in head else (None, "", 0)
        if kind is None:
            yield None, None, None, None, "UNRECOGNIZED_SITEMAP"
            return
        blocks = re.findall(rf"<{tag}\s*>(.*?)</{tag}\s*>", xml, FLAGS)[:most]
        found = [(loc, _first(b, "lastmod")) for b in blocks if (loc := _first(b, "loc")) and re.match(r"https?://[^/\s]+\.[^/\s]+", loc, re.IGNORECASE)]
        for pos, (loc, lastmod) in enumerate(found):
            yield kind, pos, loc, lastmod, None


def register(spark: SparkSession) -> None:
    for name, handler, kinds in (
        ("extract_links", ExtractLinks, "pos int, link string"), ("parse_feed", ParseFeed, "kind string, pos int, title string, link string, error string"),
        ("parse_sitemap", ParseSitemap, "kind string, pos int, loc string, lastmod string, error string"),
    ):
        spark.udtf.register(name, udtf(handler, returnType=kinds))
