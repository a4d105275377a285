"""URL parts, registrable domain, tracker match and query keys.

``parse_url`` is not used: it drops hosts with ``_`` and whole URLs with blanks or stray ``%``,
and it keeps brackets and upper case. Recordings need the lenient reading below.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Substrings that mark a request as tracking.
TRACKER_PATTERNS = (
    "google-analytics.com",
    "googletagmanager.com",
    "doubleclick.net",
    "googlesyndication.com",
    "facebook.net",
    "facebook.com/tr",
    "connect.facebook.net",
    "analytics.twitter.com",
    "hotjar.com",
    "clarity.ms",
    "segment.io",
    "segment.com",
    "mixpanel.com",
    "amplitude.com",
    "matomo",
    "metrika.yandex",
    "mc.yandex",
    "tiktok.com/i18n/pixel",
)

# Two-label public suffixes that keep a third label.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "com.au", "com.br", "co.jp", "co.in", "com.cn", "com.ru", "co.nz")

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_AFTER_SCHEME = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?"


def url_scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SCHEME, 1))


def url_authority(url: Column) -> Column:
    """User info, host and port as written."""
    return F.regexp_extract(url, _AFTER_SCHEME + r"//([^/?#]*)", 1)


def url_host(url: Column) -> Column:
    """Lower-case host without user info, port and brackets; NULL where there is none."""
    found = _AFTER_SCHEME + r"//(?:[^/?#]*@)?(?:\[([^\]/?#]*)\]?|([^:/?#]*))"
    host = F.concat(F.regexp_extract(url, found, 1), F.regexp_extract(url, found, 2))
    return F.nullif(F.lower(host), F.lit(""))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, _AFTER_SCHEME + r"(?://[^/?#]*)?([^?#]*)", 1)


def url_query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def url_fragment(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^#]*#(.*)$", 1)


def base_domain(host: Column) -> Column:
    """Registrable domain: the last two labels, three below a two-label suffix; addresses stay whole."""
    name = F.regexp_replace(F.lower(F.coalesce(host, F.lit(""))), r"\.+$", "")
    labels = F.split(name, r"\.")
    keep_three = F.substring_index(name, ".", -2).isin(*TWO_LABEL_SUFFIXES)
    return (
        F.when(name.contains(":") | name.rlike(r"^[0-9]+(\.[0-9]+)*$") | (F.size(labels) <= 2), name)
        .when(keep_three, F.substring_index(name, ".", -3))
        .otherwise(F.substring_index(name, ".", -2))
    )


def is_tracker(url: Column, domain: Column, patterns: Sequence[str] = TRACKER_PATTERNS) -> Column:
    """Any pattern occurs in the URL or in the domain, whatever the case."""
    if not patterns:
        return F.lit(False)
    haystack = F.lower(F.concat_ws("\n", url, domain))
    return F.coalesce(haystack.rlike("|".join(re.escape(item) for item in patterns)), F.lit(False))


def percent_decode(text: Column) -> Column:
    """Form decoding; a ``%`` that starts no escape stays as it is."""
    return F.try_url_decode(F.regexp_replace(text, r"%(?![0-9A-Fa-f]{2})", "%25"))


def form_encode(text: Column) -> Column:
    """Form encoding that keeps ``~`` and escapes ``*``."""
    return F.replace(F.replace(F.url_encode(text), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def query_pairs(query: Column) -> Column:
    """Non-empty ``&`` pieces as (key, value) structs, decoded; a key without ``=`` has an empty value."""
    pieces = F.filter(F.split(query, "&"), lambda piece: piece != "")
    return F.transform(
        pieces,
        lambda piece: F.struct(
            percent_decode(F.regexp_extract(piece, "(?s)^([^=]*)", 1)).alias("key"),
            percent_decode(F.regexp_extract(piece, "(?s)^[^=]*=(.*)$", 1)).alias("value"),
        ),
    )


def query_keys(url: Column) -> Column:
    """Sorted distinct query keys."""
    return F.array_sort(F.array_distinct(F.transform(query_pairs(url_query(url)), lambda pair: pair["key"])))


def mime_essence(value: Column) -> Column:
    return F.substring_index(value, ";", 1)
