"""Sites and profiles that name each other: an organizer's page that links to a profile which links back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustmill.functions.html import page_links, without_dangerous
from trustmill.functions.urls import host_of, registrable_domain

#: Hosts whose first path segment names a person or an organization.
NETWORKS = ("facebook.com", "github.com", "instagram.com", "linkedin.com", "t.me", "twitter.com", "x.com", "youtube.com")


def identity(url: Column) -> Column:
    """Who speaks at an address: a network's profile (host and the path's first segment, after company/ or in/ the next),
    or the site as its registrable domain."""
    domain = registrable_domain(host_of(url))
    profile = F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]+/(?:(?:company|in|channel|c)/)?@?([^/?#]+)", 1))
    return F.when(domain.isin(*NETWORKS) & (profile != ""), F.concat(domain, F.lit("/"), profile)).when(~domain.isin(*NETWORKS), domain)


def named_links(pages: DataFrame) -> DataFrame:
    """source, target: who names whom, each once. pages: url, html."""
    links = pages.select(identity(F.col("url")).alias("source"), F.explode(page_links(without_dangerous(F.col("html")), F.col("url"))).alias("link"))
    return links.select("source", identity(F.col("link")).alias("target")).where("source is not null and target is not null and source <> target").distinct()


def mutual(edges: DataFrame) -> DataFrame:
    """a, b (a < b) of those that name each other: both directions meet under the unordered pair."""
    pairs = edges.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), (F.col("source") < F.col("target")).alias("_up")).distinct()
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("_n")).where("_n = 2").select("a", "b")


def confirmed(events: DataFrame, pairs: DataFrame) -> DataFrame:
    """events with social: the official domain and some profile name each other. events: official_domain."""
    profile = lambda c: F.contains(F.col(c), F.lit("/"))
    sites = pairs.where(profile("a") != profile("b")).select(F.when(profile("a"), F.col("b")).otherwise(F.col("a")).alias("official_domain")).distinct()
    return events.join(sites.withColumn("social", F.lit(True)), "official_domain", "left").withColumn("social", F.coalesce("social", F.lit(False))).select(*events.columns, "social")
