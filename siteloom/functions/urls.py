"""URLs as columns, by patterns that Java and RE2 read alike; nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PATTERN = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, PATTERN, group)


def is_absolute(url: Column) -> Column:
    return F.coalesce(part(url, 2) != "", F.lit(False))


def scheme(url: Column) -> Column:
    return F.lower(part(url, 1))


def authority(url: Column) -> Column:
    """Host and port without user and default port, lower case."""
    own = F.lower(F.regexp_replace(part(url, 2), r"^[^@]*@", ""))
    return F.when(scheme(url) == "http", F.regexp_replace(own, ":80$", "")).when(scheme(url) == "https", F.regexp_replace(own, ":443$", "")).otherwise(own)


def host(url: Column) -> Column:
    return F.regexp_replace(authority(url), r":\d+$", "")


def path(url: Column) -> Column:
    return F.when(part(url, 3) == "", F.lit("/")).otherwise(part(url, 3))


def query(url: Column) -> Column:
    """With its question mark; empty where there is none."""
    return part(url, 4)


def bare_host(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def origin(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), authority(url))


def normalize(url: Column) -> Column:
    """Scheme, authority and path in lower case; query and fragment dropped, a trailing slash kept; what is no URL stays as it is."""
    return F.when(is_absolute(url), F.concat(origin(url), F.lower(path(url)))).otherwise(url)


def normalize_with_query(url: Column) -> Column:
    return F.when(is_absolute(url), F.concat(origin(url), F.lower(path(url)), F.lower(query(url)))).otherwise(url)


def comparable(url: Column) -> Column:
    """For comparison of canonicals: with query, without trailing slashes."""
    return F.regexp_replace(normalize_with_query(url), "/+$", "")


def is_external(base: Column, url: Column) -> Column:
    """Another host, ``www.`` aside; what is not absolute is internal."""
    return is_absolute(url) & (bare_host(base) != bare_host(url))


def same_host_exactly(base: Column, url: Column) -> Column:
    return host(base) == host(url)


def is_external_image(base: Column, url: Column) -> Column:
    """As the image rules compare hosts: all leading ``w`` and dots stripped."""
    strip = lambda u: F.regexp_replace(host(u), r"^[w.]+", "")
    return ~is_absolute(base) | (is_absolute(url) & (strip(base) != strip(url)))


def resolve(base: Column, href: Column, scheme_relative: str = "https") -> Column:
    """``href`` seen from ``base``; dot segments stay (pages' own links are resolved in full where they are parsed)."""
    folder = F.regexp_replace(path(base), r"[^/]*$", "")
    lead = F.lit("https:") if scheme_relative == "https" else F.concat(scheme(base), F.lit(":"))
    return (
        F.when(is_absolute(href), href)
        .when(href.startswith("//"), F.concat(lead, href))
        .when(href.startswith("/"), F.concat(origin(base), href))
        .when(href.startswith("?"), F.concat(origin(base), path(base), href))
        .when(href.startswith("#"), F.concat(origin(base), path(base), query(base), href))
        .otherwise(F.concat(origin(base), folder, href))
    )


def extension(url: Column) -> Column:
    """From the last dot, query and fragment aside; empty without one."""
    return F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"(\.[^.]*)$", 1)


def is_static(url: Column) -> Column:
    """A last segment with a dot that is no page's extension."""
    last = F.regexp_extract(F.lower(path(url)), r"([^/]*)$", 1)
    return last.contains(".") & ~last.rlike(r"\.(html?|xhtml|php|aspx?|jspx?|cfm)$")


def is_http(url: Column) -> Column:
    return scheme(url).isin("http", "https")


def variants(url: Column) -> Column:
    """The other three of scheme and www for a base URL."""
    bare, slash = F.regexp_replace(authority(url), r"^www\.", ""), F.lit("/")
    every = F.array(*(F.concat(F.lit(s), bare, slash) for s in ("http://", "http://www.", "https://", "https://www.")))
    return F.filter(every, lambda u: u != F.concat(origin(url), slash))


def host_of_project(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), host(url))
