"""Rows behind the reports: listings, filters, waterfall and bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netlens.functions import labels as L
from netlens.functions.numbers import clamp, half_even
from netlens.operators.skew import top_per_group
from netlens.operators.summary import domain_order, domain_rollup

# Rows shown.
WATERFALL_ROWS = 80
DOMAIN_BARS = 25
AGGREGATE_BARS = 15


def request_order(sort: str = "slowest") -> list[Column]:
    """Listing orders; ties keep recording order."""
    seq = F.asc("seq")
    if sort == "largest":
        return [F.coalesce("transfer_bytes", F.lit(0)).desc(), seq]
    if sort == "errors":
        return [L.is_error(F.col("failed"), F.col("status")).desc(), F.coalesce("status", F.lit(0)).desc(), seq]
    if sort == "start":
        return [F.coalesce("offset_ms", F.lit(0.0)).asc(), seq]
    if sort == "slowest":
        return [F.coalesce("duration_ms", F.lit(0.0)).desc(), seq]
    raise ValueError(f"unknown sort {sort!r}")


def top_requests(requests: DataFrame, sort: str = "slowest", n: int = 25) -> DataFrame:
    """The first ``n`` requests of each session in a listing order."""
    return top_per_group(requests, ["session_id"], request_order(sort), n)


def filter_requests(requests: DataFrame, text: str = "", status: str = "all", resource_type: str = "all") -> DataFrame:
    """Report filter: free text, status class and resource type."""
    code = F.coalesce("status", F.lit(0))
    classes = {
        "all": F.lit(True),
        "error": (code == 0) | (code >= 400),
        "success": code.between(200, 399),
        "redirect": code.between(300, 399),
    }
    kept = requests.where(classes[status])
    if resource_type != "all":
        kept = kept.where(F.col("resource_type") == resource_type)
    if text:
        kept = kept.where(search_text().contains(text.lower()))
    return kept


def search_text() -> Column:
    """Lower-case text the free-text filter looks at."""
    fields = ("method", "status", "domain", "url", "resource_type", "mime_type", "protocol")
    return F.lower(F.concat_ws(" ", *[F.coalesce(F.col(name).cast("string"), F.lit("None")) for name in fields]))


def request_details(requests: DataFrame) -> DataFrame:
    """Detail columns and flag tags of each request."""
    flags = F.array_compact(
        F.array(
            F.when(F.col("from_cache"), F.lit("cache")),
            F.when(F.col("third_party"), F.lit("3rd")),
            F.when(F.col("tracker"), F.lit("tracker")),
            F.when(F.col("failed"), F.lit("failed")),
        )
    )
    dash = F.lit("—")
    return requests.select(
        "session_id",
        "seq",
        "url",
        F.concat(
            F.coalesce(F.nullif("remote_ip", F.lit("")), dash), F.lit(":"), F.coalesce(F.nullif("remote_port", F.lit("")), dash)
        ).alias("remote"),
        F.col("connection_id").alias("connection"),
        F.col("connection_reused").alias("reused"),
        F.col("initial_priority").alias("priority"),
        F.col("initiator_type").alias("initiator"),
        "timing",
        F.col("security_details").alias("security"),
        "failure",
        "query_keys",
        flags.alias("flags"),
        L.status_class(F.col("failed"), F.col("status")).alias("status_class"),
    )


def waterfall(requests: DataFrame, rows: int = WATERFALL_ROWS) -> DataFrame:
    """Left edge and width, in percent, of the first requests of each session.

    The span is the latest end among the rows shown.
    """
    offset, duration = F.coalesce("offset_ms", F.lit(0.0)), F.coalesce("duration_ms", F.lit(0.0))
    shown = top_per_group(
        requests.select(
            "session_id", "seq", "method", "domain", "path", "url", offset.alias("offset_ms"), duration.alias("duration_ms"),
            L.is_error(F.col("failed"), F.col("status")).alias("is_error"),
        ),
        ["session_id"],
        [F.asc("offset_ms"), F.asc("seq")],
        rows,
    )
    # At most ``rows`` rows per session are left, so a plain window over the session stays small.
    latest = F.max(F.col("offset_ms") + F.col("duration_ms")).over(Window.partitionBy("session_id"))
    left = clamp(F.col("offset_ms") / F.col("_span") * 100, 0.0, 99.0)
    width = F.greatest(F.lit(0.4), F.least(F.lit(100.0) - F.col("left_percent"), F.col("duration_ms") / F.col("_span") * 100))
    return (
        shown.withColumn("_latest", latest)
        .withColumn("_span", F.when(F.col("_latest") != 0, F.col("_latest")).otherwise(1.0))
        .withColumn("left_percent", left)
        .withColumn("width_percent", width)
        .drop("_latest", "_span")
    )


def _bar(value: Column, peak: Column) -> Column:
    base = F.when(peak != 0, peak).otherwise(1)
    return F.greatest(F.lit(1).cast("bigint"), half_even(value / base * 100, 0).cast("bigint"))


def domain_bars(requests: DataFrame, bars: int = DOMAIN_BARS) -> DataFrame:
    """The first domains of each session by bytes with their bar width in percent of the largest."""
    shown = top_per_group(domain_rollup(requests), ["session_id"], domain_order(), bars)
    peak = F.max("bytes").over(Window.partitionBy("session_id"))
    return shown.withColumn("_peak", peak).withColumn("width_percent", _bar(F.col("bytes"), F.col("_peak"))).drop("_peak")


def aggregate_bars(counts: DataFrame, bars: int = AGGREGATE_BARS) -> DataFrame:
    """The first values of each frequency table with their bar width in percent of the most frequent."""
    key = ["session_id", "dimension"]
    shown = top_per_group(counts, key, [F.desc("count"), F.asc("first_seq")], bars)
    peak = F.max("count").over(Window.partitionBy(*key))
    return shown.withColumn("_peak", peak).withColumn("width_percent", _bar(F.col("count"), F.col("_peak"))).drop("_peak")


def score_classes(scores: DataFrame) -> DataFrame:
    """One row per session and score with its class."""
    names = ("overall", "performance", "reliability", "privacy", "security")
    long = scores.unpivot(["session_id"], list(names), "score_name", "score")
    return long.withColumn("score_class", L.score_class(F.col("score")))
