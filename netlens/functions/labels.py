"""Small classifications used by reports and filters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds and class names.
SLOW_MS = 1000
LARGE_BYTES = 1_000_000
LOCAL_HOSTS = ("localhost", "127.0.0.1", "::1")
OLD_TLS = ("tls 1.0", "tls 1.1")
HTTP1 = ("http/1.0", "http/1.1")


def is_error(failed: Column, status: Column) -> Column:
    return F.coalesce(failed, F.lit(False)) | (F.coalesce(status, F.lit(0)) >= 400)


def is_slow(duration_ms: Column) -> Column:
    return F.coalesce(duration_ms, F.lit(0.0)) >= SLOW_MS


def is_large(transfer_bytes: Column) -> Column:
    return F.coalesce(transfer_bytes, F.lit(0)) >= LARGE_BYTES


def is_insecure(scheme: Column, domain: Column) -> Column:
    return F.coalesce((scheme == "http") & ~domain.isin(*LOCAL_HOSTS), F.lit(False))


def is_old_tls(protocol: Column) -> Column:
    return F.coalesce(F.lower(protocol).isin(*OLD_TLS), F.lit(False))


def is_http1(protocol: Column) -> Column:
    return F.coalesce(F.lower(protocol).isin(*HTTP1), F.lit(False))


def score_class(score: Column) -> Column:
    return F.when(score >= 85, "good").when(score >= 60, "warn").otherwise("bad")


def status_class(failed: Column, status: Column) -> Column:
    code = F.coalesce(status, F.lit(0))
    return (
        F.when(is_error(failed, code), "status-bad")
        .when(code.between(200, 399), "status-ok")
        .when(code != 0, "status-warn")
        .otherwise("status-muted")
    )


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "critical", 0).when(severity == "warning", 1).when(severity == "ok", 3).otherwise(2)


def iso_millis(seconds: Column) -> Column:
    """Epoch seconds as ISO-8601 UTC text with milliseconds, cut rather than rounded."""
    moment = F.timestamp_micros(F.floor(seconds * F.lit(1_000_000.0) + F.lit(0.5)).cast("bigint"))
    shown_as_utc = F.to_utc_timestamp(moment, F.current_timezone())
    return F.concat(F.date_format(shown_as_utc, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("+00:00"))


def compression_ratio(body: Column, transfer: Column) -> Column:
    return F.when((transfer > 0) & (body > transfer), F.bround(body / transfer, 2))


def days_between(seconds_now: Column, seconds_then: Column) -> Column:
    """Days from now until then, one decimal."""
    return F.bround((seconds_then - seconds_now) / F.lit(86400.0), 1)
