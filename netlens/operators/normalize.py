"""Session pass over requests, and the HAR and proxy records as requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens.functions import labels as L
from netlens.functions import url as U
from netlens.functions.numbers import half_even, text_or
from netlens.operators.skew import attach_by_key, row_numbers
from netlens.schemas import conform


def partial_facts(requests: DataFrame) -> DataFrame:
    """Per session what some of its rows say about its first start and its page; rows of this shape can be merged."""
    host = U.url_host(F.col("document_url"))
    return (
        requests.select("session_id", "seq", "started_monotonic", "domain", host.alias("host"))
        .groupBy("session_id")
        .agg(
            F.min("started_monotonic").alias("first_start"),
            F.min(F.when(F.col("host").isNotNull(), F.struct("seq", "host"))).alias("document"),
            F.min(F.struct("seq", "domain")).alias("first"),
            F.count("*").alias("session_rows"),
        )
    )


def merged_facts(partial: DataFrame) -> DataFrame:
    """Per session: first start, base domain of the page, number of requests.

    The page is the first document host in order, else the first request's domain.
    """
    merged = partial.groupBy("session_id").agg(
        F.min("first_start").alias("first_start"), F.min("document").alias("document"), F.min("first").alias("first"),
        F.sum("session_rows").alias("session_rows"),
    )
    return _page(merged)


def session_facts(requests: DataFrame) -> DataFrame:
    """The same straight from all rows of the sessions."""
    return _page(partial_facts(requests))


def _page(facts: DataFrame) -> DataFrame:
    return facts.select(
        "session_id",
        F.coalesce("first_start", F.lit(0.0)).alias("first_start"),
        U.base_domain(F.coalesce("document.host", "first.domain")).alias("page_domain"),
        "session_rows",
    )


def normalize(requests: DataFrame, patterns: Sequence[str] = U.TRACKER_PATTERNS, facts: DataFrame | None = None) -> DataFrame:
    """Add start time text, offset, third-party and tracker flags and compression ratio.

    ``facts`` are the session facts, where they are known already.
    """
    known = session_facts(requests) if facts is None else facts
    attached = attach_by_key(requests, known, ["session_id"], "session_rows", ["seq"])
    start = F.col("started_monotonic")
    return attached.withColumns(
        {
            "started_at": F.coalesce(L.iso_millis(F.col("started_wall_time")), F.col("started_at")),
            "offset_ms": F.coalesce(half_even((start - F.col("first_start")) * 1000, 2), F.lit(0.0)),
            "third_party": (F.col("page_domain") != "") & (U.base_domain(F.col("domain")) != F.col("page_domain")),
            "tracker": U.is_tracker(F.col("url"), F.col("domain"), patterns),
            "compression_ratio": L.compression_ratio(F.col("body_bytes"), F.col("transfer_bytes")),
        }
    ).drop("first_start", "page_domain")


def har_requests(entries: DataFrame) -> DataFrame:
    """REQUEST rows of HAR entries.

    Requests are ordered slowest first (``seq`` is that rank), so the slowest request's domain
    stands for the page.
    """
    timing = F.struct(
        *[
            F.element_at("timings", F.lit(source)).alias(name)
            for name, source in (
                ("queueing_ms", "blocked"), ("dns_ms", "dns"), ("connect_ms", "connect"), ("ssl_ms", "ssl"),
            )
        ],
        F.lit(None).cast("double").alias("worker_ms"),
        F.element_at("timings", F.lit("send")).alias("send_ms"),
        F.element_at("timings", F.lit("wait")).alias("ttfb_ms"),
        F.element_at("timings", F.lit("receive")).alias("receive_ms"),
    )
    url = F.col("url")
    empty = F.create_map().cast("map<string,string>")
    return conform(
        entries.select(
            "session_id",
            F.col("seq"),
            F.concat(F.lit("har-"), F.col("seq")).alias("id"),
            F.lit(0).alias("redirect_index"),
            url,
            U.url_scheme(url).alias("scheme"),
            text_or(F.col("domain"), "unknown").alias("domain"),
            text_or(U.url_path(url), "/").alias("path"),
            U.query_keys(url).alias("query_keys"),
            "method",
            F.col("mime_type").alias("resource_type"),
            F.lit("").alias("document_url"),
            F.col("started").alias("started_at"),
            "duration_ms",
            "status",
            F.lit("").alias("status_text"),
            "protocol",
            "mime_type",
            F.col("server_ip").alias("remote_ip"),
            F.col("connection").alias("connection_id"),
            F.lit(False).alias("connection_reused"),
            "transfer_bytes",
            "body_bytes",
            empty.alias("request_headers"),
            empty.alias("response_headers"),
            F.lit(False).alias("has_post_data"),
            F.lit("{}").alias("initiator"),
            F.col("cached").alias("from_cache"),
            F.lit(False).alias("from_service_worker"),
            F.lit(False).alias("from_prefetch_cache"),
            (F.col("status") == 0).alias("failed"),
            F.lit(False).alias("canceled"),
            timing.alias("timing"),
            F.lit(False).alias("redirect"),
        )
    )


def proxy_requests(events: DataFrame) -> DataFrame:
    """REQUEST rows of proxy events (see ``sources.jsonl.proxy_events``)."""
    target = F.coalesce(F.col("target"), F.lit(""))
    tunnel = F.coalesce(F.col("mode") == "tls_tunnel", F.lit(False))
    down = F.coalesce("download_bytes", F.lit(0).cast("bigint"))
    up = F.coalesce("upload_bytes", F.lit(0).cast("bigint"))
    empty = F.create_map().cast("map<string,string>")
    replies = F.coalesce("response_headers", empty)
    mime = F.coalesce(
        F.nullif(F.element_at(replies, F.lit("Content-Type")), F.lit("")),
        F.nullif(F.element_at(replies, F.lit("content-type")), F.lit("")),
        F.lit("unknown"),
    )
    none = F.lit(None).cast("double")
    timing = F.struct(
        *[none.alias(name) for name in ("queueing_ms", "dns_ms", "connect_ms", "ssl_ms", "worker_ms", "send_ms")],
        F.col("ttfb_ms"),
        none.alias("receive_ms"),
    )
    return conform(
        row_numbers(events, ["session_id"], "seq", "_n").select(
            "session_id",
            "seq",
            F.concat(F.lit("proxy-"), F.col("_n") - 1).alias("id"),
            F.lit(0).alias("redirect_index"),
            target.alias("url"),
            F.when(tunnel, "https").otherwise(text_or(U.url_scheme(target), "http")).alias("scheme"),
            F.coalesce(F.nullif(F.col("host"), F.lit("")), U.url_host(target), F.lit("unknown")).alias("domain"),
            text_or(U.url_path(target), "/").alias("path"),
            F.array().cast("array<string>").alias("query_keys"),
            F.coalesce("method", F.lit("?")).alias("method"),
            F.when(tunnel, "tunnel").otherwise("http").alias("resource_type"),
            F.lit("").alias("document_url"),
            F.col("timestamp").alias("started_at"),
            F.coalesce("duration_ms", F.lit(0.0)).alias("duration_ms"),
            F.coalesce("status", F.lit(0)).alias("status"),
            F.coalesce("reason", F.lit("")).alias("status_text"),
            F.coalesce(
                F.nullif(F.col("response_http_version"), F.lit("")), F.col("http_version"), F.lit("unknown")
            ).alias("protocol"),
            U.mime_essence(mime).alias("mime_type"),
            F.col("port").alias("remote_port"),
            (down + up).alias("transfer_bytes"),
            down.alias("body_bytes"),
            F.coalesce("headers", empty).alias("request_headers"),
            replies.alias("response_headers"),
            F.lit(False).alias("from_cache"),
            (~F.coalesce("ok", F.lit(False))).alias("failed"),
            F.col("error").alias("failure"),
            timing.alias("timing"),
            F.lit(False).alias("redirect"),
        )
    )
