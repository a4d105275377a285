"""Registered queries that run as file streams over the given tables until all input is read.

State, progress and result live in a fresh folder below the shared folder the cluster names in
``spark.checkpoint.dir``; the result is read back from there.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netlens.operators import connections
from netlens.plans import derive, host_sql, reference_sql
from netlens.session import ROCKSDB_PROVIDER, checkpoint_root
from netlens.sources import jsonl
from netlens.streaming import live, stateful

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Shuffle files go when the job that made them ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: All lines are one micro-batch here, so the buckets of request ids grow with them.
REQUESTS_A_BUCKET = 256


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream."""
    schema = derive.table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet").withColumn(
        "k", F.get_json_object("props", "$.k").cast("int")
    )


def _folder(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark, tempfile.gettempdir())}/netlens-stream-{uuid.uuid4().hex}"


@contextmanager
def _settings(spark: SparkSession, **settings: str) -> Iterator[None]:
    """Settings of the session for the jobs within it."""
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value else spark.conf.unset(name)


def _drained(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """What a stream with keyed state appends until all input is read."""
    folder = _folder(spark)
    with _settings(spark, **{PROVIDER: ROCKSDB_PROVIDER, CLEANUP: "true"}):
        query = (
            rows.writeStream.format("parquet").outputMode("append").option("path", folder + "/result")
            .option("checkpointLocation", folder + "/state").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    return spark.read.parquet(folder + "/result")


def _spooled(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Rows written to the shared folder and read as a file stream."""
    folder = _folder(spark)
    with _settings(spark, **{CLEANUP: "true"}):
        rows.write.parquet(folder, compression="zstd")
    return spark.readStream.schema(rows.schema).parquet(folder)


def stream_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests correlated by a stream of the event lines: the last version of each."""
    lines = _spooled(spark, derive.cdp_lines(spark, sf_dir))
    requests = derive.table(spark, sf_dir, "events").count()  # answered from the file footers
    buckets = max(stateful.ID_BUCKETS, requests // REQUESTS_A_BUCKET)
    versions = _drained(spark, stateful.correlation_stream(jsonl.events_of(jsonl.parse_event_lines(lines)), buckets=buckets))
    kept = (
        "seq", "url", "method", "resource_type", "status", "protocol", "duration_ms", "transfer_bytes", "body_bytes", "failed", "from_cache", "redirect",
    )
    latest = versions.groupBy("session_id", "id", "redirect_index").agg(F.max_by(F.struct(*kept), "version").alias("r"))
    return latest.select("session_id", "r.seq", "id", "redirect_index", *[f"r.{name}" for name in kept[1:]])


def stream_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sockets opened and closed, by a stream of whole snapshots."""
    keyed, taken = connections.with_key(derive.connections(spark, sf_dir)), derive.snapshots(spark, sf_dir)
    held = keyed.groupBy("host", "snapshot_no").agg(F.collect_set("conn_key").alias("keys"))  # a snapshot is one record of its host
    packed = taken.join(held, ["host", "snapshot_no"], "left").withColumn("keys", F.coalesce("keys", F.array().cast("array<string>")))
    return _drained(spark, stateful.lifecycle_stream(_spooled(spark, packed)))


def stream_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live counters of start and response lines built from the event stream."""
    k = F.col("k")
    start = F.struct(
        F.struct(F.concat(F.lit("https://h"), k % 5, F.lit(".example/")).alias("url"), F.lit("GET").alias("method")).alias("request"),
        F.col("event_type").alias("type"),
    )
    reply = F.struct(F.struct((F.lit(200) + k % 3 * 100).alias("status")).alias("response"))

    def line(method: str, params: Column) -> Column:
        return F.to_json(F.struct(F.lit("cdp_event").alias("type"), F.lit(method).alias("method"), params.alias("params")))

    value = F.when(k % 2 == 0, line("Network.requestWillBeSent", start)).otherwise(line("Network.responseReceived", reply))
    lines = _event_stream(spark, sf_dir).select(
        F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("seq"), value.alias("value")
    )
    counted = live.live_counters(jsonl.events_of(jsonl.parse_event_lines(lines)))
    folder = _folder(spark)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(folder + "/result")

    query = (
        counted.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", folder + "/state")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.parquet(folder + "/result").select("session_id", "dimension", "value", "count")


def stream_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interface rates with keyed state; every event is a counter sample of its user's interface."""
    event = F.col("event_id")
    samples = _event_stream(spark, sf_dir).select(
        F.concat(F.lit("host-"), F.col("user_id") % 10).alias("host"), F.concat(F.lit("en"), F.col("user_id") % 4).alias("name"),
        (event * 1000).alias("ts_ms"), (event * 37 % 100000).alias("rx_bytes"), (event * 5).alias("tx_bytes"),
    )
    rates = _drained(spark, stateful.rate_stream(samples))
    return rates.select("host", "name", "ts_ms", *[F.round(name, 6).alias(name) for name in ("rx_rate", "tx_rate")])


QUERIES = {f.__name__: f for f in (stream_counters, stream_rates, stream_requests, stream_lifecycle)}

STATEMENTS = {
    "stream_requests": reference_sql._with(
        reference_sql.HOPS,
        """SELECT session_id, seq, id, redirect_index, url, method, resource_type, status, protocol, duration_ms, transfer_bytes, body_bytes, failed,
                  from_cache, redirect FROM correlated""",
    ),
    "stream_lifecycle": host_sql.host_statements()["lifecycle_changes"],
    "stream_counters": """
        WITH e AS (SELECT CAST(user_id AS VARCHAR) AS session_id, event_type,
                          CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k FROM events)
        SELECT session_id, dimension, value, count(*) AS count FROM (
          SELECT session_id, 'domains' AS dimension, 'h' || k % 5 || '.example' AS value FROM e WHERE k % 2 = 0
          UNION ALL SELECT session_id, 'resource_types', event_type FROM e WHERE k % 2 = 0
          UNION ALL SELECT session_id, 'methods', 'GET' FROM e WHERE k % 2 = 0
          UNION ALL SELECT session_id, 'statuses', CAST(200 + k % 3 * 100 AS VARCHAR) FROM e WHERE k % 2 = 1) GROUP BY ALL""",
    "stream_rates": """
        WITH s AS (SELECT 'host-' || user_id % 10 AS host, 'en' || user_id % 4 AS name, event_id * 1000 AS ts_ms,
                          event_id * 37 % 100000 AS rx, event_id * 5 AS tx FROM events)
        SELECT host, name, ts_ms,
               round(coalesce(greatest(0.0, (rx - lag(rx) OVER w) / ((ts_ms - lag(ts_ms) OVER w) / 1000.0)), 0.0), 6) AS rx_rate,
               round(coalesce(greatest(0.0, (tx - lag(tx) OVER w) / ((ts_ms - lag(ts_ms) OVER w) / 1000.0)), 0.0), 6) AS tx_rate
        FROM s WINDOW w AS (PARTITION BY host, name ORDER BY ts_ms)""",
}
