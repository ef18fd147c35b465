"""Fetching texts with limits, as tasks do it, and as a Spark data source.

    spark.read.format("web_snapshot").option("urls", "https://a.org/feed\\nhttps://b.org/sitemap.xml").load()

gives one row an address, one partition a host: url, status, final_url, body, error. Everything after that is columns
(see trustmill.functions.feeds and html), so that flows can be run again from a stored snapshot.
"""

from __future__ import annotations

import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from itertools import groupby
from urllib.parse import urljoin, urlsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from trustmill.functions.urls import host_of

TIMEOUT_S, MOST_BYTES, MOST_HOPS = 12, 2_000_000, 5
SNAPSHOT = "url string, status int, final_url string, body string, error string"
AGENT = "trustmill/1.0"
#: Signs of a robots file that are read, and hours for which it holds.
ROBOTS_SIGNS, ROBOTS_HOURS = 100_000, 1


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args):
        return None


def fetch_text(url: str, timeout: float = TIMEOUT_S, most: int = MOST_BYTES) -> tuple[str, int | None, str | None, str | None, str | None]:
    """(url, status, final_url, body, error); errors are codes, never exceptions."""
    parts = urlsplit(url)
    if not parts.scheme or not parts.netloc:
        return url, None, None, None, "INVALID_URL"
    if parts.scheme not in ("http", "https"):
        return url, None, None, None, "UNSUPPORTED_SCHEME"
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": AGENT}), timeout=timeout) as answer:
            if int(answer.headers.get("Content-Length") or 0) > most:
                return url, answer.status, answer.url, None, "RESPONSE_TOO_LARGE"
            data = answer.read(most + 1)
            if len(data) > most:
                return url, answer.status, answer.url, None, "RESPONSE_TOO_LARGE"
            return url, answer.status, answer.url, data.decode(answer.headers.get_content_charset() or "utf-8", "replace"), None
    except urllib.error.HTTPError as e:
        return url, e.code, None, None, f"{'BLOCKED_' if e.code in (403, 429, 503) else ''}HTTP_{e.code}"
    except TimeoutError:
        return url, None, None, None, "TIMEOUT"
    except (OSError, ValueError) as e:
        return url, None, None, None, "TIMEOUT" if "timed out" in str(e) else f"NETWORK_ERROR: {str(e)[:200]}"


def resolve_redirects(url: str, timeout: float = 8, most: int = MOST_HOPS) -> tuple[str | None, list[tuple[str, int]], str | None]:
    """(final url, hops with their status, error): HEAD, then GET where that is refused."""
    opener, hops = urllib.request.build_opener(_NoRedirect), []
    for _ in range(most + 1):
        if urlsplit(url).scheme not in ("http", "https"):
            return None, hops, "DANGEROUS_REDIRECT_SCHEME"
        status, target = None, None
        for method in ("HEAD", "GET"):
            try:
                with opener.open(urllib.request.Request(url, method=method, headers={"User-Agent": AGENT}), timeout=timeout) as answer:
                    status = answer.status
                break
            except urllib.error.HTTPError as e:
                status, target = e.code, e.headers.get("Location") if 300 <= e.code < 400 else None
                if status not in (403, 405, 501):
                    break
            except (OSError, ValueError) as e:
                return None, hops, str(e)[:200]
        hops.append((url, status))
        if target is None:
            return url, hops, None
        url = urljoin(url, target)
    return None, hops, "TOO_MANY_REDIRECTS"


Rules = list[tuple[bool, str]]
#: What a robots file that could not be read allows.
NOTHING: Rules = [(False, "/")]


def robots_rules_of(text: str, agent: str) -> Rules:
    """The rules (allowing or not, beginning of a path) for an agent, by the same choice as functions.feeds.robots_rules: the
    group naming it best, the first among equals; a user-agent line after a rule begins a new group."""
    groups: list[tuple[list[str], Rules]] = []
    in_rules = True
    for line in text[:ROBOTS_SIGNS].splitlines():
        name, colon, value = line.split("#", 1)[0].partition(":")
        name, value = name.strip().lower(), value.strip()
        if not colon or name not in ("user-agent", "allow", "disallow"):
            continue
        if name == "user-agent":
            if in_rules:
                groups.append(([], []))
            in_rules = False
            groups[-1][0].append(value.lower())
        elif groups:
            in_rules = True
            if value:
                groups[-1][1].append((name == "allow", value))
    own = agent.lower()
    rank = lambda n: 0 if n == "*" else 2 if n == own else 1 if own.startswith(n) or n.startswith(own) else -1
    ranked = [(max((rank(n) for n in names), default=-1), -k) for k, (names, _) in enumerate(groups)]
    best = max(ranked, default=(-1, 0))
    return groups[-best[1]][1] if best[0] >= 0 else []


def robots_allow(rules: Rules, url: str) -> bool:
    """The longest rule that begins the path decides, allowing on a tie."""
    parts = urlsplit(url)
    path = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    longest = {kind: max((len(p) for allows, p in rules if allows == kind and path.startswith(p)), default=-1) for kind in (True, False)}
    return longest[False] < 0 or longest[True] >= longest[False]


def host_robots(url: str) -> Rules:
    """The rules of a host: a missing robots file allows everything, other failures nothing."""
    parts = urlsplit(url)
    _, status, _, body, error = fetch_text(f"{parts.scheme}://{parts.netloc}/robots.txt", timeout=10)
    return [] if status in (404, 410) else NOTHING if error else robots_rules_of(body or "", AGENT)


class HostPartition(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class WebReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.urls = sorted({u.strip() for u in options.get("urls", "").split("\n") if u.strip()}, key=lambda u: (urlsplit(u).netloc, u))

        self.polite = options.get("robots", "true").lower() != "false"

    def partitions(self) -> list[HostPartition]:
        return [HostPartition(list(group)) for _, group in groupby(self.urls, key=lambda u: urlsplit(u).netloc)]

    def read(self, partition: HostPartition) -> Iterator[tuple]:
        # one host a partition, so its robots file is read once
        known = self.polite and [u for u in partition.urls if urlsplit(u).scheme in ("http", "https") and urlsplit(u).netloc]
        robots = host_robots(known[0]) if known else None
        for url in partition.urls:
            yield fetch_text(url) if robots is None or url not in known or robots_allow(robots, url) else (url, None, None, None, "BLOCKED_BY_ROBOTS_TXT")


class WebSnapshot(DataSource):
    @classmethod
    def name(cls) -> str:
        return "web_snapshot"

    def schema(self) -> str:
        return SNAPSHOT

    def reader(self, schema) -> WebReader:
        return WebReader(dict(self.options))


def robots_text(snapshot: DataFrame) -> DataFrame:
    """host, text: missing robots files allow everything, other failures nothing."""
    failed, gone = F.col("error").isNotNull(), F.col("status").isin(404, 410)
    text = F.when(gone, "").when(failed, "User-agent: *\nDisallow: /").otherwise(F.left("body", F.lit(ROBOTS_SIGNS)))
    host = F.lower(F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1))
    return snapshot.where(F.col("url").endswith("/robots.txt")).select(host.alias("host"), text.alias("text"))


def fresh(cached: DataFrame, now: Column, hours: int) -> DataFrame:
    """Cached rows that may still be used. cached has fetched_at."""
    return cached.where((F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("fetched_at").cast("timestamp"))) < hours * 3_600_000_000)


def checked_robots(hosts: DataFrame, cached: DataFrame, fetch: Callable[[DataFrame], DataFrame], now: Column, hours: int = ROBOTS_HOURS) -> DataFrame:
    """host, text, fetched_at: robots files that were read lately, and those that `fetch` gives for the rest, as a snapshot
    (SNAPSHOT) of their addresses. hosts: host; cached: host, text, fetched_at."""
    wanted = hosts.select("host").where("host is not null").distinct()
    known = fresh(cached, now, hours).join(wanted, "host", "left_semi").select("host", "text", "fetched_at")
    asked = fetch(wanted.join(known, "host", "left_anti").select(F.concat(F.lit("https://"), "host", F.lit("/robots.txt")).alias("url")))
    return known.unionByName(robots_text(asked).select("host", "text", now.cast("timestamp").alias("fetched_at")))


def threat_verdicts(urls: DataFrame, threats: DataFrame) -> DataFrame:
    """url, verdict (HIT or UNKNOWN) and threat_types. threats: url, threat_types."""
    return urls.join(threats, "url", "left").select("url", F.when(F.size(F.coalesce("threat_types", F.array())) > 0, "HIT").otherwise("UNKNOWN").alias("verdict"), "threat_types")


def threat_payload(url: Column, client: str) -> Column:
    """The question to a lookup service of the common kind about one address."""
    kinds = ("MALWARE", "SOCIAL_ENGINEERING", "UNWANTED_SOFTWARE", "POTENTIALLY_HARMFUL_APPLICATION")
    info = F.struct(F.array(*map(F.lit, kinds)).alias("threatTypes"), F.array(F.lit("ANY_PLATFORM")).alias("platformTypes"), F.array(F.lit("URL")).alias("threatEntryTypes"), F.array(F.struct(url.alias("url"))).alias("threatEntries"))
    return F.to_json(F.struct(F.struct(F.lit(client).alias("clientId"), F.lit("1").alias("clientVersion")).alias("client"), info.alias("threatInfo")))


def threat_types(status: Column, body: Column) -> Column:
    """What an answer says; failures and unreadable answers say nothing, and so are no hit and no clearance."""
    matches = F.from_json(F.get_json_object(body, "$.matches"), "array<struct<threatType:string>>")
    return F.when(status.between(200, 299), F.transform(matches, lambda m: F.coalesce(m["threatType"], F.lit("UNKNOWN"))))


def checked_threats(urls: DataFrame, cached: DataFrame, ask: Callable[[DataFrame], DataFrame], now: Column, hours: int = 24) -> DataFrame:
    """url, threat_types, fetched_at: fresh cached answers, and those that `ask` gives (url, status, body) for the rest."""
    known = fresh(cached, now, hours).join(urls.select("url").distinct(), "url", "left_semi").select("url", "threat_types", "fetched_at")
    asked = ask(urls.select("url").distinct().join(known, "url", "left_anti"))
    return known.unionByName(asked.select("url", threat_types(F.col("status"), F.col("body")).alias("threat_types"), now.cast("timestamp").alias("fetched_at")))


def domain_verdicts(reputation: DataFrame, threats: DataFrame, now: Column) -> DataFrame:
    """domain, reputation, verdict, checked_at after lookups: a hit sets a domain to 0, all others stay as they are."""
    hit = threats.where(F.size("threat_types") > 0).select(host_of(F.col("url")).alias("domain")).where("domain is not null").distinct()
    hit = hit.select("domain", F.lit(0).alias("reputation"), F.lit("HIT").alias("verdict"), now.cast("timestamp").alias("checked_at"))
    return reputation.join(hit, "domain", "left_anti").select("domain", "reputation", "verdict", "checked_at").unionByName(hit)
