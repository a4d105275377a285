"""Session scores and network quality score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlens.functions.numbers import clamp, half_even

SCORE_NAMES = ("overall", "performance", "reliability", "privacy", "security")


def _rounded(value: Column) -> Column:
    return half_even(value, 0).cast("bigint")


def session_scores(profile: DataFrame) -> DataFrame:
    """Five scores per session, floored at 0; the overall one averages the unfloored four.

    Fixed values: the weights and caps below.
    """
    count = F.greatest(F.lit(1), F.col("requests"))
    slow = F.least(F.lit(35), _rounded(F.col("slow_requests") / count * 80))
    large = F.least(F.lit(25), F.col("large_requests") * 5)
    repeated = F.least(F.lit(15), _rounded(F.col("duplicate_requests") / count * 40))
    span = F.when(F.col("page_span_ms") > 10_000, 20).when(F.col("page_span_ms") > 5_000, 10).otherwise(0)
    raw = profile.withColumns(
        {
            "_performance": F.lit(100) - slow - large - repeated - span,
            "_reliability": F.lit(100) - F.least(F.lit(70), (F.col("failed") + F.col("http_errors")) * 8),
            "_privacy": F.lit(100)
            - F.least(F.lit(55), F.col("trackers") * 7)
            - F.least(F.lit(25), _rounded(F.col("third_party_percent") / 4)),
            "_security": F.lit(100)
            - F.least(F.lit(60), F.col("insecure") * 15)
            - F.least(F.lit(30), F.col("old_tls") * 10),
        }
    )
    parts = [F.col("_" + name) for name in SCORE_NAMES[1:]]
    floor = F.lit(0).cast("bigint")
    return raw.select(
        "session_id",
        F.greatest(floor, _rounded((parts[0] + parts[1] + parts[2] + parts[3]) / 4)).alias("overall"),
        *[F.greatest(floor, part.cast("bigint")).alias(name) for part, name in zip(parts, SCORE_NAMES[1:])],
    )


def quality_scores(probes: DataFrame) -> DataFrame:
    """Network quality of each run from its ping, DNS, TLS and HTTP probes.

    ``probes`` has (run_id, kind, ok, duration_ms, packet_loss_percent, avg_ms, jitter_ms); a probe
    that is missing counts as failed. Fixed values: the weights and caps below.
    """

    def of(kind: str, name: str) -> Column:
        return F.max(F.when(F.col("kind") == kind, F.col(name)))

    zero = F.lit(0.0)
    wide = probes.groupBy("run_id").agg(
        *[F.coalesce(F.bool_or(F.when(F.col("kind") == kind, F.col("ok"))), F.lit(False)).alias(kind + "_ok")
          for kind in ("ping", "dns", "tls", "http")],
        F.coalesce(of("ping", "packet_loss_percent"), zero).alias("loss"),
        F.coalesce(of("ping", "avg_ms"), zero).alias("latency"),
        F.coalesce(of("ping", "jitter_ms"), zero).alias("jitter"),
        F.coalesce(of("dns", "duration_ms"), zero).alias("dns_ms"),
    )
    ping = F.when(~F.col("ping_ok"), 45.0).otherwise(
        F.least(F.lit(35.0), F.col("loss") * 2.5)
        + clamp((F.col("latency") - 30) / 10, 0.0, 20.0)
        + clamp((F.col("jitter") - 5) / 4, 0.0, 10.0)
    )
    dns = (
        F.when(~F.col("dns_ok"), 20.0).when(F.col("dns_ms") > 150, 10.0).when(F.col("dns_ms") > 60, 4.0).otherwise(0.0)
    )
    tls = F.when(F.col("tls_ok"), 0.0).otherwise(15.0)
    http = F.when(F.col("http_ok"), 0.0).otherwise(15.0)
    total = F.lit(100.0) - ping - dns - tls - http
    return wide.select("run_id", _rounded(clamp(half_even(total, 0), 0.0, 100.0)).alias("score"))
