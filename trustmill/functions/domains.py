"""How a host relates to an organizer's official domain, and lookalike signals, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from trustmill.config import GOVERNMENT_SUFFIXES, KNOWN_FORM_PROVIDERS, TRUSTED_EVENT_PLATFORMS, UNIVERSITY_SUFFIXES
from trustmill.functions.binding import let
from trustmill.functions.urls import registrable_domain


def _within(host: Column, domains: tuple[str, ...]) -> Column:
    """The host is one of the domains or lies below one."""
    return reduce(lambda a, b: a | b, ((host == d) | host.endswith(f".{d}") for d in domains))


def _ends(host: Column, suffixes: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (host.endswith(s) for s in suffixes))


def is_trusted_platform(host: Column) -> Column:
    return _within(F.lower(host), TRUSTED_EVENT_PLATFORMS)


def provider_category(host: Column) -> Column:
    host = F.lower(host)
    return (
        F.when(_ends(host, UNIVERSITY_SUFFIXES), "UNIVERSITY_DOMAIN")
        .when(_ends(host, GOVERNMENT_SUFFIXES), "GOVERNMENT_DOMAIN")
        .when(_within(host, TRUSTED_EVENT_PLATFORMS), "ESTABLISHED_EVENT_PLATFORM")
        .when(_within(host, KNOWN_FORM_PROVIDERS), "KNOWN_FORM_PROVIDER")
        .otherwise("OFFICIAL_DOMAIN")
    )


def _official(domain: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(domain, F.lit(""))), r"^www\.", "")


def domain_relationship(host: Column, official_domain: Column) -> Column:
    """struct(relationship, category) of a registration host."""
    host, official = F.lower(host), _official(official_domain)
    same = (official != "") & ((host == official) | (host == F.concat(F.lit("www."), official)))
    below = (official != "") & (host.endswith(F.concat(F.lit("."), official)) | F.coalesce(registrable_domain(official) == registrable_domain(host), F.lit(False)))
    relationship = (
        F.when(same, "SAME_DOMAIN").when(below, "SUBDOMAIN").when(_within(host, TRUSTED_EVENT_PLATFORMS), "KNOWN_EVENT_PLATFORM")
        .when(_within(host, KNOWN_FORM_PROVIDERS) | _ends(host, UNIVERSITY_SUFFIXES) | _ends(host, GOVERNMENT_SUFFIXES), "EXTERNAL_REGISTRATION_PROVIDER")
        .otherwise("UNKNOWN_DOMAIN")
    )
    outside = (
        F.when(_within(host, TRUSTED_EVENT_PLATFORMS), "ESTABLISHED_EVENT_PLATFORM").when(_within(host, KNOWN_FORM_PROVIDERS), "KNOWN_FORM_PROVIDER")
        .when(_ends(host, UNIVERSITY_SUFFIXES), "UNIVERSITY_DOMAIN").when(_ends(host, GOVERNMENT_SUFFIXES), "GOVERNMENT_DOMAIN").otherwise("UNKNOWN")
    )
    return F.struct(relationship.alias("relationship"), F.when(same | below, provider_category(host)).otherwise(outside).alias("category"))


def lookalike_signals(host: Column, official_domain: Column) -> Column:
    """The ways in which a host imitates the official domain; none for the domain itself, platforms and form providers."""
    host, official = F.lower(host), _official(official_domain)
    own, target = F.coalesce(registrable_domain(host), host), F.coalesce(registrable_domain(official), official)
    parts = F.struct(host.alias("host"), official.alias("official"), own.alias("own"), F.split(own, r"\.")[0].alias("root"), target.alias("domain"), F.split(target, r"\.")[0].alias("target"))
    return let(parts, lambda p: _signals(p, F.coalesce(official_domain, F.lit(""))))


def _signals(parts: Column, official_domain: Column) -> Column:
    host, official, own_domain, root, official_root_domain, target = (parts[x] for x in ("host", "official", "own", "root", "domain", "target"))
    exempt = (
        (official_domain == "") | (host == official) | host.endswith(F.concat(F.lit("."), official))
        | _within(host, TRUSTED_EVENT_PLATFORMS) | _within(host, KNOWN_FORM_PROVIDERS)
    )
    contains, distance = F.contains(root, target), F.levenshtein(root, target)
    substituted = (F.translate(root, "0153", "olse") == target) & (root != target)
    close = (root != target) & distance.between(1, 2) & (F.length(target) >= 4)
    added = contains & (root != target)
    misleading = F.contains(host, target) & (own_domain != official_root_domain)
    unusual = host.rlike(r"\.(xyz|top|click|buzz|tk|ml)$") & (substituted | close | added | misleading | contains)
    named = {
        "CHARACTER_SUBSTITUTION": substituted, "CLOSE_EDIT_DISTANCE": close, "ADDED_WORDS_OR_HYPHENATION": added,
        "MISLEADING_SUBDOMAIN": misleading, "UNUSUAL_TLD": unusual, "PUNYCODE": F.contains(host, F.lit("xn--")),
    }
    return F.when(exempt, F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in named.items()))))
