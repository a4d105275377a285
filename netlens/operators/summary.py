"""Session roll-ups over normalised requests.

Every roll-up is one grouped aggregation, so rows are combined before the shuffle and a session of
any size becomes a handful of partial rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlens.functions import labels as L
from netlens.functions.numbers import half_even, percent_of, text_or
from netlens.operators.skew import top_per_group

SUMMARY_METRICS = (
    "requests", "domains", "transfer_bytes", "body_bytes", "page_span_ms", "failed", "http_errors", "cached",
    "cache_percent", "third_party", "third_party_percent", "trackers", "duplicate_requests", "redirects",
    "slow_requests", "large_requests",
)

# Fixed value: rows kept of the MIME-type table.
MIME_ROWS = 30


def _domain() -> Column:
    return text_or(F.col("domain"), "unknown")


def session_profile(requests: DataFrame) -> DataFrame:
    """The 16 summary metrics and the counts that scores and findings need, one row per session."""
    end = F.coalesce("offset_ms", F.lit(0.0)) + F.coalesce("duration_ms", F.lit(0.0))
    status = F.coalesce("status", F.lit(0))
    counted = requests.select(
        "session_id",
        _domain().alias("_domain"),
        F.coalesce("url", F.lit("")).alias("_url"),
        F.coalesce("transfer_bytes", F.lit(0)).alias("_transfer"),
        F.coalesce("body_bytes", F.lit(0)).alias("_body"),
        end.alias("_end"),
        F.coalesce("failed", F.lit(False)).alias("_failed"),
        (status >= 400).alias("_http_error"),
        L.is_error(F.col("failed"), status).alias("_error"),
        "from_cache", "third_party", "tracker", "redirect",
        L.is_slow(F.col("duration_ms")).alias("_slow"),
        L.is_large(F.col("transfer_bytes")).alias("_large"),
        L.is_insecure(F.col("scheme"), F.col("domain")).alias("_insecure"),
        L.is_old_tls(F.col("tls_protocol")).alias("_old_tls"),
        L.is_http1(F.col("protocol")).alias("_http1"),
    )
    totals = counted.groupBy("session_id").agg(
        F.count("*").alias("requests"),
        F.countDistinct("_domain").alias("domains"),
        F.sum("_transfer").alias("transfer_bytes"),
        F.sum("_body").alias("body_bytes"),
        half_even(F.greatest(F.lit(0.0), F.max("_end")), 2).alias("page_span_ms"),
        F.count_if("_failed").alias("failed"),
        F.count_if("_http_error").alias("http_errors"),
        F.count_if("from_cache").alias("cached"),
        F.count_if("third_party").alias("third_party"),
        F.count_if("tracker").alias("trackers"),
        (F.count("*") - F.countDistinct("_url")).alias("duplicate_requests"),
        F.count_if("redirect").alias("redirects"),
        F.count_if("_slow").alias("slow_requests"),
        F.count_if("_large").alias("large_requests"),
        F.count_if("_error").alias("errors"),
        F.count_if("_insecure").alias("insecure"),
        F.count_if("_old_tls").alias("old_tls"),
        F.count_if("_http1").alias("http1"),
    )
    return totals.withColumns(
        {
            "cache_percent": percent_of(F.col("cached"), F.col("requests")),
            "third_party_percent": percent_of(F.col("third_party"), F.col("requests")),
        }
    )


def session_summary(requests: DataFrame) -> DataFrame:
    return session_profile(requests).select("session_id", *SUMMARY_METRICS)


def domain_rollup(requests: DataFrame) -> DataFrame:
    """Per session and domain: requests, bytes, errors, third-party and tracker flags."""
    return requests.groupBy("session_id", _domain().alias("domain")).agg(
        F.count("*").alias("requests"),
        F.sum(F.coalesce("transfer_bytes", F.lit(0))).alias("bytes"),
        F.count_if(L.is_error(F.col("failed"), F.col("status"))).alias("errors"),
        F.bool_or(F.coalesce("third_party", F.lit(False))).alias("third_party"),
        F.bool_or(F.coalesce("tracker", F.lit(False))).alias("tracker"),
    )


def domain_order() -> list[Column]:
    return [F.desc("bytes"), F.desc("requests"), F.asc("domain")]


def dimensions(requests: DataFrame) -> DataFrame:
    """(session_id, dimension, value, seq): one row per request and frequency table."""
    columns = {
        "resource_types": text_or(F.col("resource_type"), "Other"),
        "protocols": text_or(F.col("protocol"), "unknown"),
        "statuses": F.coalesce("status", F.lit(0)).cast("string"),
        "methods": text_or(F.col("method"), "?"),
        "mime_types": text_or(F.col("mime_type"), "unknown"),
    }
    cells = F.array(
        *[F.struct(F.lit(name).alias("dimension"), value.alias("value")) for name, value in columns.items()]
    )
    return requests.select("session_id", "seq", F.inline(cells))


def frequency_tables(requests: DataFrame, mime_rows: int = MIME_ROWS) -> DataFrame:
    """The five frequency tables in one pass, ranked by count with ties first seen first.

    Only MIME types are cut; the table of counts is small, so ranking it is cheap.
    """
    counts = frequency_counts(dimensions(requests))
    ranked = top_per_group(
        counts.where(F.col("dimension") == "mime_types"),
        ["session_id", "dimension"],
        [F.desc("count"), F.asc("first_seq")],
        mime_rows,
    ).drop("rank")
    return counts.where(F.col("dimension") != "mime_types").unionByName(ranked)


def frequency_counts(cells: DataFrame, seq: str = "seq") -> DataFrame:
    return cells.groupBy("session_id", "dimension", "value").agg(
        F.count("*").alias("count"), F.min(seq).alias("first_seq")
    )


def most_common(rows: DataFrame, key: list[str], value: str, n: int, seq: str = "seq") -> DataFrame:
    """The ``n`` most frequent values per key, ties first seen first."""
    counts = rows.groupBy(*key, value).agg(F.count("*").alias("count"), F.min(seq).alias("first_seq"))
    return top_per_group(counts, key, [F.desc("count"), F.asc("first_seq"), F.asc(value)], n)


def duplicate_urls(requests: DataFrame, n: int = 5) -> DataFrame:
    """The most repeated URLs of each session, repeated ones only."""
    return most_common(requests.select("session_id", "seq", "url"), ["session_id"], "url", n).where(F.col("count") > 1)


# --- browser facts ------------------------------------------------------------------------------


def websocket_totals(events: DataFrame) -> DataFrame:
    """Opened and closed sockets, frames and payload bytes in both directions."""
    method = F.col("method")
    payload = F.coalesce(F.octet_length(F.try_variant_get("body", "$.params.response.payloadData", "string")), F.lit(0))
    kinds = {
        "opened": "Network.webSocketCreated", "closed": "Network.webSocketClosed",
        "sent_frames": "Network.webSocketFrameSent", "received_frames": "Network.webSocketFrameReceived",
    }
    sized = events.where((F.col("type") == "cdp_event") & method.isin(*kinds.values())).select(
        "session_id", "method", payload.alias("size")
    )
    return sized.groupBy("session_id").agg(
        *[F.count_if(method == name).alias(column) for column, name in kinds.items()],
        F.sum(F.when(method == kinds["sent_frames"], F.col("size")).otherwise(0)).alias("sent_bytes"),
        F.sum(F.when(method == kinds["received_frames"], F.col("size")).otherwise(0)).alias("received_bytes"),
    )


def performance_metrics(events: DataFrame) -> DataFrame:
    """Last numeric value of every performance metric."""
    command = F.try_variant_get("body", "$.command", "string")
    listed = F.try_variant_get("body", "$.result.metrics", "array<variant>")
    rows = (
        events.where((F.col("type") == "cdp_command_result") & (command == "Performance.getMetrics"))
        .select("session_id", "seq", F.posexplode(listed).alias("pos", "metric"))
        .select(
            "session_id", "seq", "pos",
            F.coalesce(F.try_variant_get("metric", "$.name", "string"), F.lit("None")).alias("name"),
            F.try_variant_get("metric", "$.value", "double").alias("value"),
        )
    )
    return (
        rows.where(F.col("value").isNotNull())
        .groupBy("session_id", "name")
        .agg(F.max_by("value", F.struct("seq", "pos")).alias("value"))
    )


def lifecycle_events(events: DataFrame) -> DataFrame:
    """Page lifecycle, load and DOM-content events, one row each, in ``seq`` order."""
    kinds = ("Page.lifecycleEvent", "Page.loadEventFired", "Page.domContentEventFired")
    return events.where((F.col("type") == "cdp_event") & F.col("method").isin(*kinds)).select(
        "session_id", "seq", "method", F.to_json(F.try_variant_get("body", "$.params", "variant")).alias("params")
    )


def session_metadata(events: DataFrame) -> DataFrame:
    """Last ``session_start`` record and last ``session_end`` summary, as JSON text."""
    kind = F.col("type")
    rows = events.where(kind.isin("session_start", "session_end")).select(
        "session_id", "seq", "type",
        F.when(kind == "session_start", F.to_json("body"))
        .otherwise(F.coalesce(F.to_json(F.try_variant_get("body", "$.summary", "variant")), F.lit("{}")))
        .alias("text"),
    )
    return rows.groupBy("session_id").agg(
        F.max_by("text", F.when(kind == "session_start", F.col("seq"))).alias("source_metadata"),
        F.max_by("text", F.when(kind == "session_end", F.col("seq"))).alias("recorder_summary"),
    )


def har_summary(entries: DataFrame) -> DataFrame:
    """Archive totals; a status of 0 or from 400 counts as failed."""
    return entries.groupBy("session_id").agg(
        F.count("*").alias("requests"),
        F.count_if((F.col("status") == 0) | (F.col("status") >= 400)).alias("failed"),
        F.countDistinct("domain").alias("domains"),
        F.sum("body_bytes").alias("total_body_bytes"),
        F.sum("transfer_bytes").alias("total_transfer_bytes"),
        half_even(F.max("duration_ms"), 2).alias("longest_request_ms"),
    )


def har_counters(entries: DataFrame) -> DataFrame:
    """The archive's five counters: domains, methods, statuses, protocols, MIME types."""
    columns = {
        "domain_counts": F.col("domain"), "methods": F.col("method"), "statuses": F.col("status").cast("string"),
        "protocols": F.col("protocol"), "mime_types": F.col("mime_type"),
    }
    cells = F.array(*[F.struct(F.lit(name).alias("dimension"), value.alias("value")) for name, value in columns.items()])
    return frequency_counts(entries.select("session_id", "position", F.inline(cells)), "position")


def report_cards(profile: DataFrame) -> DataFrame:
    """Headline values; connection recordings fall back to events and processes."""
    present = set(profile.columns)

    def pick(*names: str) -> Column:
        return F.coalesce(*[F.col(name) for name in names if name in present], F.lit(0))

    return profile.select(
        "session_id",
        pick("requests", "events").cast("bigint").alias("requests"),
        pick("domains", "processes").cast("bigint").alias("domains"),
        pick("transfer_bytes").cast("bigint").alias("transfer_bytes"),
        pick("page_span_ms").cast("double").alias("page_span_ms"),
        (pick("failed") + pick("http_errors")).cast("bigint").alias("errors"),
        pick("third_party_percent").cast("double").alias("third_party_percent"),
    )


def resource_type_list(requests: DataFrame) -> DataFrame:
    """Sorted distinct resource types of each session, one row per type."""
    return requests.select("session_id", F.coalesce("resource_type", F.lit("Other")).alias("resource_type")).distinct()
