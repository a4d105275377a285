"""Explainable findings of a session.

One wide row per session decides which rules fire; evidence comes from one ranked pass over the
request rows. Fixed values: codes, titles, recommendations and thresholds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlens.functions import labels as L
from netlens.functions.numbers import decimal_text
from netlens.operators.skew import top_per_group
from netlens.operators.summary import duplicate_urls

EVIDENCE_ROWS = 5
TRACKER_ROWS = 10


def _text(*parts: object) -> Column:
    return F.concat(*[F.lit(part) if isinstance(part, str) else part for part in parts])


def _rule(fires: Column, severity: object, category: str, code: str, title: Column, recommendation: str) -> Column:
    level = F.lit(severity) if isinstance(severity, str) else severity
    return F.when(
        fires,
        F.struct(
            level.alias("severity"),
            F.lit(category).alias("category"),
            F.lit(code).alias("code"),
            title.alias("title"),
            F.lit(recommendation).alias("recommendation"),
        ),
    )


def session_rules() -> tuple[list[Column], list[Column]]:
    """(score rules, general rules) over a session profile row."""
    c = F.col
    score_rules = [
        _rule(
            c("insecure") > 0, "critical", "security", "unencrypted-http",
            _text(c("insecure").cast("string"), " unencrypted HTTP requests"),
            "Use HTTPS for every non-local resource.",
        ),
        _rule(
            c("old_tls") > 0, "critical", "security", "legacy-tls",
            _text(c("old_tls").cast("string"), " requests use legacy TLS"), "Disable TLS 1.0/1.1 on the server.",
        ),
    ]
    general = [
        _rule(
            c("errors") > 0, "warning", "reliability", "request-errors",
            _text(c("errors").cast("string"), " requests failed or returned HTTP errors"),
            "Inspect the failed-request table and fix broken dependencies or blocked resources.",
        ),
        _rule(
            c("slow_requests") > 0, "warning", "performance", "slow-requests",
            _text(c("slow_requests").cast("string"), " requests take at least one second"),
            "Reduce server latency, connection setup, or resource size; prioritize critical resources.",
        ),
        _rule(
            c("large_requests") > 0, "warning", "performance", "large-resources",
            _text(c("large_requests").cast("string"), " resources exceed 1 MB"),
            "Compress, resize, lazy-load, or split large assets.",
        ),
        _rule(
            c("duplicate_requests") > 0, "info", "performance", "duplicate-requests",
            _text(c("duplicate_requests").cast("string"), " duplicate network requests"),
            "Deduplicate application fetches and verify caching headers.",
        ),
        _rule(
            c("trackers") > 0, F.when(c("trackers") >= 3, "warning").otherwise("info"), "privacy", "tracking-requests",
            _text(c("trackers").cast("string"), " likely tracking/analytics requests"),
            "Review consent, necessity, retention, and third-party privacy terms.",
        ),
        _rule(
            c("third_party_percent") >= 50, "warning", "privacy", "third-party-heavy",
            _text(c("third_party_percent").cast("string"), "% of requests are third-party"),
            "Audit third-party dependencies and self-host critical assets where practical.",
        ),
        _rule(
            c("http1") >= 5, "info", "performance", "http1-heavy",
            _text(c("http1").cast("string"), " requests use HTTP/1.x"), "Enable HTTP/2 or HTTP/3 where supported.",
        ),
        _rule(
            (c("cache_percent") < 10) & (c("requests") >= 20), "info", "performance", "low-cache-hit",
            _text("Only ", c("cache_percent").cast("string"), "% of requests were served from cache"),
            "Review Cache-Control, ETag and immutable asset naming.",
        ),
    ]
    return score_rules, general


def fired_rules(profile: DataFrame) -> DataFrame:
    """(session_id, severity, category, code, title, recommendation), one row per fired rule.

    ``clean-session`` appears when no general rule fires, even beside a critical score rule.
    """
    score_rules, general = session_rules()
    clean = _rule(
        F.lit(True), "ok", "overview", "clean-session", F.lit("No major issues detected in this recording"), ""
    )
    found = F.array_compact(F.array(*general))
    listed = F.concat(F.array_compact(F.array(*score_rules)), F.when(F.size(found) > 0, found).otherwise(F.array(clean)))
    return profile.select("session_id", F.inline(listed))


def request_evidence(requests: DataFrame) -> DataFrame:
    """First errors, slowest and largest requests of each session as (session_id, code, rank, text)."""
    url = F.coalesce("url", F.lit(""))
    nothing = F.lit(0.0)
    cells = F.array_compact(
        F.array(
            F.when(
                L.is_error(F.col("failed"), F.col("status")),
                F.struct(F.lit("request-errors").alias("code"), nothing.alias("weight"), url.alias("text")),
            ),
            F.when(
                L.is_slow(F.col("duration_ms")),
                F.struct(
                    F.lit("slow-requests").alias("code"), F.col("duration_ms").alias("weight"),
                    _text(decimal_text(F.col("duration_ms")), "ms ", url).alias("text"),
                ),
            ),
            F.when(
                L.is_large(F.col("transfer_bytes")),
                F.struct(
                    F.lit("large-resources").alias("code"), F.col("transfer_bytes").cast("double").alias("weight"),
                    _text(F.col("transfer_bytes").cast("string"), " bytes ", url).alias("text"),
                ),
            ),
        )
    )
    rows = requests.select("session_id", "seq", F.inline(cells))
    ranked = top_per_group(rows, ["session_id", "code"], [F.desc("weight"), F.asc("seq")], EVIDENCE_ROWS)
    return ranked.select("session_id", "code", "rank", "text")


def all_evidence(requests: DataFrame) -> DataFrame:
    """Evidence lines of every rule that carries some."""
    duplicates = duplicate_urls(requests, EVIDENCE_ROWS).select(
        "session_id", F.lit("duplicate-requests").alias("code"), "rank",
        _text(F.col("count").cast("string"), "× ", F.col("url")).alias("text"),
    )
    domains = requests.where(F.col("tracker")).select("session_id", F.coalesce("domain", F.lit("")).alias("text")).distinct()
    trackers = top_per_group(domains, ["session_id"], [F.asc("text")], TRACKER_ROWS).select(
        "session_id", F.lit("tracking-requests").alias("code"), "rank", "text"
    )
    return request_evidence(requests).unionByName(duplicates).unionByName(trackers)


def session_findings(requests: DataFrame, profile: DataFrame) -> DataFrame:
    """Findings with their evidence list (at most ten lines each by the rules above)."""
    evidence = (
        all_evidence(requests)
        .groupBy("session_id", "code")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("lines"))
        .select("session_id", "code", F.transform("lines", lambda line: line["text"]).alias("evidence"))
    )
    return (
        fired_rules(profile)
        .join(evidence, ["session_id", "code"], "left")
        .withColumn("evidence", F.coalesce("evidence", F.array().cast("array<string>")))
        .select("session_id", "severity", "category", "code", "title", "recommendation", "evidence")
    )


def finding_order() -> list[Column]:
    """Critical first, then warning, info, ok; category and code within."""
    return [L.severity_rank(F.col("severity")).asc(), F.asc("category"), F.asc("code")]
