"""Urls as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import unquote, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/:?]+)(:[0-9]+)?([^?]*)(\?.*)?$"
HREF = r"""(?is)<a\s[^>]*?\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
HREF_ATTRIBUTE = r"""(?is)\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
ANCHOR = r"(?is)<a\b([^>]*)>(.*?)</a>"
#: Endings of links that aren't followed (fixed values).
SKIPPED = (".jpg", ".jpeg", ".gif", ".png", ".txt")
TRAP = r"/[0-9]{4}/[0-9]{1,2}(/|\?|$)|/archive|/calendar|/events|/schedule"


def part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, PARTS, group)


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, an explicit port, a path, no fragment; null without scheme or host."""

    def put_together(bare: Column) -> Column:
        scheme, host, port, path, query = (part(bare, g) for g in range(1, 6))
        given = F.when(port != "", port).when(F.lower(scheme) == "https", ":443").otherwise(":80")
        return F.when(host != "", F.concat(F.lower(scheme), F.lit("://"), F.lower(host), given, F.when(path == "", "/").otherwise(path), query))

    return bound(F.trim(F.substring_index(url, "#", 1)), put_together)


def url_host(url: Column) -> Column:
    return F.lower(F.nullif(part(url, 2), F.lit("")))


def url_path(url: Column) -> Column:
    path = part(F.substring_index(url, "#", 1), 4)
    return F.when(path == "", "/").otherwise(path)


def extract_hrefs(html: Column) -> Column:
    """The href of each anchor, in order, without quotes."""
    return F.transform(F.regexp_extract_all(html, F.lit(HREF), F.lit(1)), lambda h: F.regexp_replace(h, "^[\"']|[\"']$", ""))


def extract_anchors(html: Column) -> Column:
    """(href, text) of each closed anchor; the text without tags, spaces collapsed."""
    attributes = F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(1))
    bodies = F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(2))
    def pair(p: Column) -> Column:
        text = F.trim(F.regexp_replace(F.regexp_replace(p["1"], "(?s)<[^>]*>", " "), r"\s+", " "))
        return F.struct(F.regexp_replace(F.regexp_extract(p["0"], HREF_ATTRIBUTE, 1), "^[\"']|[\"']$", "").alias("href"), text.alias("text"))

    return F.filter(F.transform(F.arrays_zip(attributes.alias("0"), bodies.alias("1")), pair), lambda a: a["href"] != "")


def resolve(base: str | None, href: str | None) -> str | None:
    """A link as an absolute url with an explicit port; null where it isn't to be followed."""
    href = (href or "").strip().partition("#")[0]
    if not base or not href:
        return None
    try:
        u = urlsplit(urljoin(base, href))
        port = u.port
    except ValueError:
        return None
    scheme = u.scheme.lower()
    if scheme not in ("http", "https") or not u.hostname or u.path.lower().endswith(SKIPPED):
        return None
    query = f"?{unquote(u.query)}" if u.query or href.endswith("?") else ""
    return f"{scheme}://{u.hostname.lower()}:{port or (443 if scheme == 'https' else 80)}{unquote(u.path) or '/'}{query}"


@F.pandas_udf(T.StringType())
def resolve_column(base: pd.Series, href: pd.Series) -> pd.Series:
    return pd.Series([resolve(b, h) for b, h in zip(base, href)], dtype=object)


def simple_link(base: Column, href: Column) -> Column:
    """resolve() for absolute, scheme-relative and root-relative links without dots or escapes, as an expression.

    Null for links that it doesn't take; those go to resolve_column().
    """
    origin = F.regexp_extract(base, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+", 0)

    def full(h: Column) -> Column:
        plain = ~h.rlike(r"%|/\.|\s|\?$")
        whole = F.when(h.rlike("(?i)^https?://"), h).when(F.startswith(h, F.lit("//")), F.concat(F.substring_index(base, "//", 1), h)).when(F.startswith(h, F.lit("/")), F.concat(origin, h))
        return F.when(plain & ~F.lower(F.substring_index(h, "?", 1)).rlike(r"\.(jpg|jpeg|gif|png|txt)$"), whole)

    return canonical_url(bound(F.trim(F.substring_index(href, "#", 1)), full))


def is_trap(url: Column) -> Column:
    """Paths of calendars and archives, which never end."""
    return url_path(url).rlike(TRAP)


def bucket_of(url: Column, buckets: int) -> Column:
    """A bucket by the beginning of the SHA-1 of a url: the same in any language."""
    return F.pmod(F.conv(F.substring(F.sha1(url), 1, 13), 16, 10).cast("long"), F.lit(buckets)).cast("int")
