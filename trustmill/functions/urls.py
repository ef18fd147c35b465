"""URLs as column expressions: canonical form, hosts, registrable domains and resolution against a base."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trustmill.config import SHORT_URL_HOSTS, TRACKING_PARAMS, TWO_PART_SUFFIXES
from trustmill.functions.binding import let
from trustmill.functions.text import trimmed

SCHEME = "^[a-zA-Z][a-zA-Z0-9+.-]*:"
#: scheme, user, host, port, path, query
WEB = r"^(?i)(https?)://(?:[^/?#@]*@)?(\[[0-9a-f:.]+\]|[^\s/?#:@\[\]<>^|%]+)(?::([0-9]{0,5}))?([/\\][^?#]*)?(?:\?([^#]*))?(?:#.*)?$"


def registrable_domain(host: Column) -> Column:
    """The last two labels, three where the last two are a public suffix; the host itself if it has no more."""

    def shortened(own: Column) -> Column:
        last = lambda labels, n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), F.lit(n)), ".")
        return F.when(own == "", None).otherwise(let(F.split(own, r"\."), lambda x: F.when(F.size(x) <= 2, own).otherwise(let(last(x, 2), lambda two: F.when(two.isin(list(TWO_PART_SUFFIXES)), last(x, 3)).otherwise(two)))))

    return let(F.regexp_replace(F.lower(host), r"\.$", ""), shortened)


def is_short_host(host: Column) -> Column:
    return F.lower(host).isin(list(SHORT_URL_HOSTS))


def without_tracking(query: Column) -> Column:
    """The parameters that do not track, in their order and spelling."""
    key = lambda p: F.lower(F.split(p, "=")[0])
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~key(p).isin(list(TRACKING_PARAMS)))
    return F.array_join(kept, "&")


def _path(path: Column) -> Column:
    """Dot segments resolved; null or empty is the root."""
    start = F.array().cast("array<string>")
    up = lambda kept: F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))

    def resolved(own: Column) -> Column:
        kept = F.aggregate(F.split(F.substring(own, 2, 1 << 30), "/"), start, lambda a, s: F.when(s == "..", up(a)).when(s == ".", a).otherwise(F.concat(a, F.array(s))))
        slash = F.when(own.rlike(r"/\.{1,2}$"), F.lit("/")).otherwise(F.lit(""))
        joined = let(F.concat(F.lit("/"), F.array_join(kept, "/")), lambda r: F.when(r.endswith("/"), r).otherwise(F.concat(r, slash)))
        return F.when(own.rlike(r"/\.{1,2}(/|$)"), joined).otherwise(own)

    return let(F.when(F.coalesce(path, F.lit("")) == "", F.lit("/")).otherwise(F.translate(path, "\\", "/")), resolved)


def normalize_url(raw: Column) -> Column:
    """struct(input, canonical, valid, reason, host, registrable_domain, is_https, is_short_url)."""
    full = lambda g: F.when(g.rlike(SCHEME), g).otherwise(F.concat(F.lit("https://"), g))
    # the parts of a web address by one match; the separator cannot stand in a host or port
    split = lambda f: F.split(F.regexp_replace(f, WEB, "$2\u0001$3\u0001$5\u0001$4"), "\u0001", 4)
    taken = lambda f: F.struct(f.alias("full"), F.lower(F.regexp_extract(f, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1)).alias("scheme"), F.when(f.rlike(WEB), split(f)).alias("parts"))
    return F.when(raw.isNotNull(), let(trimmed(raw), lambda g: let(full(g), lambda f: let(taken(f), lambda t: _normal(g, t)))))


def _normal(given: Column, taken: Column) -> Column:
    scheme, parts, full = taken["scheme"], taken["parts"], taken["full"]
    web, port_number = scheme.isin("http", "https"), F.get(parts, F.lit(1))
    # no cast: one that fails throws and catches within Spark, which costs more than all the rest of an address without a port
    parsed = parts.isNotNull() & (F.lpad(port_number, 5, "0") <= "65535")
    default = ((scheme == "https") & (port_number == "443")) | ((scheme == "http") & (port_number == "80")) | (port_number == "")
    values = F.struct(
        F.when(web & parsed, F.lower(F.get(parts, F.lit(0)))).alias("host"), F.when(default, F.lit("")).otherwise(F.concat(F.lit(":"), port_number)).alias("port"),
        F.regexp_replace(_path(F.get(parts, F.lit(3))), "/+$", "").alias("path"), without_tracking(F.get(parts, F.lit(2))).alias("query"),
        F.when(given == "", "EMPTY").when(~web, "UNSUPPORTED_SCHEME").when(~parsed, "UNPARSABLE").alias("reason"),
    )

    def fields(v: Column) -> Column:
        host, path, query, reason = v["host"], v["path"], v["query"], v["reason"]
        canonical = F.concat(scheme, F.lit("://"), host, v["port"], F.when(path == "", F.lit("/")).otherwise(path), F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)))
        named = {
            "input": given, "canonical": F.coalesce(canonical, F.when(reason == "UNSUPPORTED_SCHEME", full)), "valid": reason.isNull(), "reason": reason, "host": host,
            "registrable_domain": registrable_domain(host), "is_https": F.coalesce(host.isNotNull() & (scheme == "https"), F.lit(False)),
            "is_short_url": F.coalesce(is_short_host(host), F.lit(False)),
        }
        return F.struct(*(c.alias(k) for k, c in named.items()))

    return let(values, fields)


def canonical_url(raw: Column) -> Column:
    return normalize_url(raw)["canonical"]


def host_of(url: Column) -> Column:
    """The lower-case host of an absolute URL, else null."""
    return F.nullif(F.lower(F.regexp_extract(trimmed(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)), F.lit(""))


def valid_http_url(url: Column) -> Column:
    own = trimmed(url)
    return F.when(own.rlike(r"^(?i)https?://[^/\s]+\.[^/\s]+"), own)


def absolutize(href: Column, base: Column) -> Column:
    """A link as an absolute http(s) URL, or null where it leads nowhere."""
    return let(trimmed(href), lambda own: F.when(~((own == "") | own.rlike(r"^(#|javascript:|mailto:|data:)")), let(_joined(own, base), _resolved)))


def _joined(own: Column, base: Column) -> Column:
    base_path = lambda: F.regexp_extract(base, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    origin = lambda: F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    return (
        F.when(own.rlike(SCHEME), own)
        .when(own.startswith("//"), F.concat(F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1), own))
        .when(own.startswith("/"), F.concat(origin(), own))
        .when(own.startswith("?"), F.concat(origin(), let(base_path(), lambda p: F.when(p == "", F.lit("/")).otherwise(p)), own))
        .otherwise(F.concat(origin(), let(base_path(), lambda p: F.when(p == "", F.lit("/")).otherwise(F.regexp_replace(p, "[^/]*$", ""))), own))
    )


def _resolved(joined: Column) -> Column:
    head, tail = F.regexp_extract(joined, r"^(?i)(https?://[^/?#]*)", 1), F.regexp_extract(joined, r"^[^?#]*([?#].*)$", 1)
    path = F.regexp_extract(joined, r"^(?i)https?://[^/?#]*([^?#]*)", 1)
    return F.when(head != "", F.concat(F.lower(head), _path(path), tail))
