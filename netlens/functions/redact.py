"""Secret-safe text: URLs, headers, error messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from netlens.functions import url as U

# Key pattern, marker, message pattern and message length.
SENSITIVE_KEY = r"(?i)token|secret|password|passwd|authorization|api[-_]?key|session|cookie|jwt|credential"
MARKER = "[REDACTED]"
SENSITIVE_TEXT = r"(?i)(authorization|token|password)=([^\s&]+)"
MESSAGE_LIMIT = 500

# Headers a proxy keeps, and those that hold a URL.
CAPTURED_HEADERS = ("host", "user-agent", "content-type", "content-length", "referer", "authorization", "cookie")
URL_HEADERS = ("referer", "referrer")

# URL schemes that always carry an authority part.
AUTHORITY_SCHEMES = (
    "ftp", "http", "gopher", "nntp", "telnet", "imap", "wais", "file", "mms", "https", "shttp", "snews",
    "prospero", "rtsp", "rtsps", "rtspu", "rsync", "svn", "svn+ssh", "sftp", "nfs", "git", "git+ssh", "ws", "wss",
)


def redact_query(query: Column, sensitive: str = SENSITIVE_KEY) -> Column:
    """Re-encoded query whose sensitive keys carry the marker."""
    marker = F.lit(MARKER.replace("[", "%5B").replace("]", "%5D"))
    return F.array_join(
        F.transform(
            U.query_pairs(query),
            lambda pair: F.concat(
                U.form_encode(pair["key"]),
                F.lit("="),
                F.when(pair["key"].rlike(sensitive), marker).otherwise(U.form_encode(pair["value"])),
            ),
        ),
        "&",
    )


def redact_url(url: Column, sensitive: str = SENSITIVE_KEY) -> Column:
    """URL without user info and without the values of sensitive query keys.

    A URL whose brackets do not match is returned unchanged.
    """
    scheme, authority, path = U.url_scheme(url), U.url_authority(url), U.url_path(url)
    query, fragment = redact_query(U.url_query(url), sensitive), U.url_fragment(url)
    safe = F.when(
        authority.contains("@"), F.concat(F.lit(MARKER + "@"), F.substring_index(authority, "@", -1))
    ).otherwise(authority)
    rooted = F.when((path == "") | path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    implied = scheme.isin(*AUTHORITY_SCHEMES) & ((path == "") | path.startswith("/")) | path.startswith("//")
    hierarchy = (
        F.when(authority != "", F.concat(F.lit("//"), safe, rooted))
        .when(implied, F.concat(F.lit("//"), path))
        .otherwise(path)
    )
    rebuilt = F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(F.lit("")),
        hierarchy,
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")),
        F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(F.lit("")),
    )
    broken = authority.contains("[") != authority.contains("]")
    return F.when(broken, url).otherwise(rebuilt)


def redact_headers(headers: Column) -> Column:
    return F.transform_values(
        headers, lambda key, value: F.when(key.rlike(SENSITIVE_KEY), F.lit(MARKER)).otherwise(value)
    )


def redact_message(message: Column) -> Column:
    return F.left(F.regexp_replace(message, SENSITIVE_TEXT, "$1=" + MARKER), F.lit(MESSAGE_LIMIT))


def captured_headers(headers: Column) -> Column:
    """The headers a proxy keeps, secrets replaced and referring URLs redacted."""
    kept = F.map_filter(headers, lambda key, value: F.lower(key).isin(*CAPTURED_HEADERS))
    return F.transform_values(
        redact_headers(kept),
        lambda key, value: F.when(F.lower(key).isin(*URL_HEADERS), redact_url(value)).otherwise(value),
    )
