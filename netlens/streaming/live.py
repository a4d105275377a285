"""Live counters, quiet gaps and append-only sinks with built-in streaming operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from netlens.functions.numbers import whole
from netlens.operators import recorder
from netlens.sinks.documents import event_lines, spool_batch

WATERMARK = "10 minutes"


def live_counters(events: DataFrame) -> DataFrame:
    """Domains, resource types, methods and statuses so far (update mode)."""
    return recorder.recorder_counters(events)


def live_totals(events: DataFrame) -> DataFrame:
    """Failures, HTTP errors and encoded bytes so far per session (update mode)."""
    method = F.col("method")
    get = lambda path: whole(F.try_variant_get("body", "$.params." + path, "string"))
    return events.where(F.col("type") == "cdp_event").groupBy("session_id").agg(
        F.count_if(method == recorder.FAILED).alias("network_failures"),
        F.count_if((method == recorder.RESPONSE) & (get("response.status") >= 400)).alias("http_errors"),
        F.sum(F.when(method == recorder.FINISHED, get("encodedDataLength")).otherwise(0)).alias("encoded_bytes"),
    )


def quiet_gaps(events: DataFrame, idle: str = "3 seconds", watermark: str = WATERMARK) -> DataFrame:
    """Stretches of network activity, each ended by ``idle`` without any (append mode).

    The end of a stretch is the moment at which the network had been quiet for that long.
    """
    stamped = events.where((F.col("type") == "cdp_event") & F.col("method").isin(*recorder.ACTIVITY)).select(
        "session_id", F.col("timestamp").try_cast("timestamp").alias("ts")
    )
    return (
        stamped.where(F.col("ts").isNotNull())
        .withWatermark("ts", watermark)
        .groupBy("session_id", F.session_window("ts", idle).alias("stretch"))
        .agg(F.count("*").alias("events"))
        .select("session_id", F.col("stretch.start").alias("active_from"), F.col("stretch.end").alias("idle_at"), "events")
    )


def dns_watch(packets: DataFrame, width: str | None = None, watermark: str = WATERMARK) -> DataFrame:
    """Questions per domain and server, in total or per time window of ``ts``."""
    asked = packets.where(F.col("direction") == "query").withColumns(
        {"domain": F.coalesce("domain", F.lit("unknown")), "server": F.col("destination.host")}
    )
    if width is None:
        return asked.groupBy("capture_id", "domain", "server").agg(F.count("*").alias("queries"))
    windowed = asked.withWatermark("ts", watermark).groupBy("capture_id", F.window("ts", width).alias("_w"), "domain", "server")
    return windowed.agg(F.count("*").alias("queries")).select(
        "capture_id", F.col("_w.start").alias("from"), F.col("_w.end").alias("to"), "domain", "server", "queries"
    )


def append_events(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append events as JSON lines; each event is written exactly once."""
    return (
        event_lines(events)
        .writeStream.format("text")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def append_proxy_events(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append only the proxy requests of a stream."""
    return append_events(events.where(F.col("type") == "proxy_request"), path, checkpoint)


def bundle_batches(requests: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Spool each micro-batch of finished requests below ``path``; ``finish_bundle`` makes the bundle of all of them.

    A session may be cut over any number of batches: its page, first start and size are merged over their partial facts.
    A repeated batch overwrites what it has written, so every request counts once.
    """

    def write(batch: DataFrame, number: int) -> None:
        spool_batch(batch, path, number)

    return (
        requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
