"""Event recordings: one JSON object per line, one file per session.

``read_recordings`` gives the events and the quarantined lines of a folder; ``stream_recordings``
gives the same events as a file stream. The text is parsed once into VARIANT, so unknown fields
survive and wrongly typed fields read as NULL instead of failing the job.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

POSITION_BITS = 33
#: Without this, a string over 20 million characters makes its whole document unreadable.
LONG_STRINGS = {"maxStringLen": str((1 << 31) - 1)}
#: Largest VARIANT. What is longer is not called malformed.
VARIANT_BYTES = 128 << 20


@dataclass(frozen=True)
class Recording:
    """Accepted events and quarantined lines of one scan."""

    events: DataFrame
    rejects: DataFrame


def _bytes(text: str) -> int:
    units = {"k": 10, "m": 20, "g": 30, "t": 40, "p": 50}
    text = text.strip().lower().rstrip("b")
    return int(text[:-1]) << units[text[-1]] if text and text[-1] in units else int(text)


def _split_unit(spark: SparkSession) -> int:
    """File splits never start closer together than this, so start/unit tells them apart."""
    limits = (
        spark.conf.get("spark.sql.files.maxPartitionBytes", "128MB"),
        spark.conf.get("spark.sql.files.openCostInBytes", "4MB"),
    )
    return max(1, min(_bytes(item) for item in limits))


def _split_number(spark: SparkSession) -> Column:
    return F.expr(f"CAST(_metadata.file_block_start AS BIGINT) DIV {_split_unit(spark)}")


def file_position(spark: SparkSession) -> Column:
    """Order of a line within its file: split number in the high bits, row in the scan task below."""
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << POSITION_BITS) - 1))
    return F.shiftleft(_split_number(spark), POSITION_BITS).bitwiseOR(row)


def session_of(spark: SparkSession, path: str) -> Column:
    """Identity of a recording: its path below the folder ``path``, without the last extension, escapes undone.

    Files of one name in different folders stay apart; below a glob, the folder is what stands before its first pattern.
    A single file gives the bare file name.
    """
    plain = re.split(r"/[^/]*[*?\[{]", path)[0]
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(plain or "/")
    system = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    root = re.sub("^([a-z]+):/+", r"\1:/", system.makeQualified(hadoop).toUri().toString()).rstrip("/") + "/"
    file = F.regexp_replace(F.col("_metadata.file_path"), "^([a-z]+):/+", "$1:/")
    below = F.when(file.startswith(root), F.substring(file, len(root) + 1, 1 << 20)).otherwise(F.element_at(F.split(file, "/"), -1))
    return F.try_url_decode(F.replace(F.regexp_replace(below, r"\.[^./]*$", ""), F.lit("+"), F.lit("%2B")))


def text_lines(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(session_id, seq, value) of every line; ``pattern`` (a glob) picks files by name."""
    return spark.read.text(path, recursiveFileLookup=True, pathGlobFilter=pattern).select(
        session_of(spark, path).alias("session_id"),
        file_position(spark).alias("seq"),
        F.make_valid_utf8(F.col("value")).alias("value"),
    )


def text_of(body: Column, path: str) -> Column:
    return F.try_variant_get(body, path, "string")


def read_json(value: Column) -> Column:
    """VARIANT of a text, or NULL; strings of any length and NaN are read, if the whole stays within VARIANT_BYTES."""
    # The second reading is only for the few texts that the first one leaves.
    return F.coalesce(F.try_parse_json(value), F.from_json(value, "variant", LONG_STRINGS))


@contextmanager
def repeated_keys(spark: SparkSession) -> Iterator[None]:
    """Within it, plans are made whose ``try_parse_json`` takes the last of repeated keys; the setting is bound with the plan, no job runs."""
    name = "spark.sql.variant.allowDuplicateKeys"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def parse_event_lines(lines: DataFrame) -> DataFrame:
    """Add ``parsed`` (VARIANT or NULL) and ``reason`` (NULL for an event) to non-blank lines. Of repeated keys the last counts."""
    # explode() pins the parse: a plain column would be copied into every filter pushed below it.
    with repeated_keys(lines.sparkSession):
        parsed = lines.where(F.col("value").rlike(r"\S")).select(
            *lines.columns, F.explode(F.array(read_json(F.col("value")))).alias("parsed")
        )
    return parsed.withColumn(
        "reason",
        F.when(F.col("parsed").isNull() & (F.octet_length("value") > VARIANT_BYTES), "larger than 128 MiB")
        .when(F.col("parsed").isNull(), "malformed JSON").when(
            ~F.ltrim("value", F.lit(" \t\r\n")).startswith("{"), "expected an object"
        ),
    )


def events_of(parsed: DataFrame) -> DataFrame:
    """EVENT rows of the accepted lines."""
    body = F.col("parsed")
    return parsed.where(F.col("reason").isNull()).select(
        "session_id",
        "seq",
        text_of(body, "$.type").alias("type"),
        text_of(body, "$.timestamp").alias("timestamp"),
        F.coalesce(text_of(body, "$.method"), F.lit("")).alias("method"),
        F.coalesce(text_of(body, "$.params.requestId"), F.lit("")).alias("request_id"),
        body.alias("body"),
    )


def _line_numbers(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """Line numbers of a few lines: rows before their split plus their row within it.

    One row per file split is windowed; the lines themselves are only counted.
    """
    split = F.shiftright("seq", POSITION_BITS)
    earlier = Window.partitionBy("session_id").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    splits = (
        lines.groupBy("session_id", split.alias("_split"))
        .agg(F.min("seq").alias("_first"), F.count("*").alias("_rows"))
        .withColumn("_skipped", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    )
    return (
        wanted.withColumn("_split", split)
        .join(splits, ["session_id", "_split"])
        .withColumn("line", F.col("_skipped") + F.col("seq") - F.col("_first") + 1)
        .drop("_split", "_first", "_rows", "_skipped")
    )


def split_lines(lines: DataFrame) -> Recording:
    """Events and rejects of (session_id, seq, value) lines."""
    parsed = parse_event_lines(lines)
    bad = parsed.where(F.col("reason").isNotNull()).select("session_id", "seq", "reason", "value")
    numbered = _line_numbers(lines, bad)
    message = F.concat(F.lit("line "), F.col("line"), F.lit(": "), F.col("reason"))
    return Recording(
        events_of(parsed),
        numbered.select("session_id", "seq", "line", "reason", message.alias("message"), "value"),
    )


def read_recordings(spark: SparkSession, path: str, pattern: str | None = None) -> Recording:
    return split_lines(text_lines(spark, path, pattern))


def _numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Line positions of one scan task, whose batches arrive in file order."""
    count = 0
    for batch in batches:
        rows = np.arange(count, count + len(batch), dtype="int64")
        count += len(batch)
        yield batch.assign(seq=batch["split"].to_numpy("int64") << POSITION_BITS | rows)[["session_id", "seq", "value"]]


def stream_recordings(spark: SparkSession, path: str, files_per_trigger: int | None = 64) -> DataFrame:
    """EVENT rows as a file stream, at most so many files in a micro-batch (None: all that are there).

    Streams have no ``monotonically_increasing_id``, so lines are numbered in Arrow batches.
    """
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    lines = reader.load(path).select(
        session_of(spark, path).alias("session_id"),
        _split_number(spark).alias("split"),
        F.make_valid_utf8(F.col("value")).alias("value"),
    )
    numbered = lines.mapInPandas(_numbered, "session_id string, seq bigint, value string")
    return events_of(parse_event_lines(numbered))


# --- typed views -------------------------------------------------------------------------------


def cdp_events(events: DataFrame) -> DataFrame:
    """Browser events: method, request id, and params (an empty object where it is none)."""
    params = F.try_variant_get("body", "$.params", "variant")
    is_object = F.try_variant_get("body", "$.params", "map<string,variant>").isNotNull()
    return events.where(F.col("type") == "cdp_event").select(
        "session_id", "seq", "timestamp", "method", "request_id",
        F.when(is_object, params).otherwise(F.parse_json(F.lit("{}"))).alias("params"),
    )


def proxy_events(events: DataFrame) -> DataFrame:
    """Proxy requests as typed columns."""
    body = F.col("body")

    def get(path: str, kind: str = "string") -> Column:
        return F.try_variant_get(body, path, kind)

    return events.where(F.col("type") == "proxy_request").select(
        "session_id", "seq", "timestamp",
        get("$.client").alias("client"),
        get("$.method").alias("method"),
        get("$.target").alias("target"),
        get("$.http_version").alias("http_version"),
        get("$.headers", "map<string,string>").alias("headers"),
        get("$.mode").alias("mode"),
        get("$.host").alias("host"),
        get("$.port").alias("port"),
        get("$.response.http_version").alias("response_http_version"),
        get("$.response.status", "int").alias("status"),
        get("$.response.reason").alias("reason"),
        get("$.response.headers", "map<string,string>").alias("response_headers"),
        get("$.ttfb_ms", "double").alias("ttfb_ms"),
        get("$.ok", "boolean").alias("ok"),
        get("$.upload_bytes", "bigint").alias("upload_bytes"),
        get("$.download_bytes", "bigint").alias("download_bytes"),
        get("$.error").alias("error"),
        get("$.duration_ms", "double").alias("duration_ms"),
    )


def connection_events(events: DataFrame) -> DataFrame:
    """Socket lifecycle events with the connection as typed columns."""
    from netlens.schemas import CONNECTION_FIELDS

    connection = F.try_variant_get("body", "$.connection", f"struct<{_colon(CONNECTION_FIELDS)}>")
    return (
        events.where(F.col("type").isin("connection_open", "connection_close"))
        .withColumn("_c", connection)
        .select("session_id", "seq", "timestamp", "type", "_c.*")
    )


def _colon(fields: str) -> str:
    """``name type, ...`` as the fields of a struct type."""
    parts = []
    depth = 0
    current = ""
    for char in fields + ",":
        depth += (char == "<") - (char == ">")
        if char == "," and depth == 0:
            name, kind = current.strip().split(" ", 1)
            parts.append(f"{name}:{kind}")
            current = ""
        else:
            current += char
    return ",".join(parts)


def dns_events(events: DataFrame) -> DataFrame:
    """DNS packets written by the watcher."""

    def get(path: str, kind: str = "string") -> Column:
        return F.try_variant_get("body", path, kind)

    return events.where(F.col("type") == "dns_packet").select(
        "session_id", "seq", "timestamp",
        get("$.source.host").alias("src_host"), get("$.source.port", "int").alias("src_port"),
        get("$.destination.host").alias("dst_host"), get("$.destination.port", "int").alias("dst_port"),
        get("$.direction").alias("direction"), get("$.transaction_id", "bigint").alias("transaction_id"),
        get("$.query_type").alias("query_type"), get("$.domain").alias("domain"), get("$.raw").alias("raw"),
    )


def session_types(events: DataFrame) -> DataFrame:
    """What each session is: browser over proxy over connection over DNS events, else unsupported."""
    has = {
        name: F.bool_or(F.col("type").isin(*kinds))
        for name, kinds in {
            "cdp": ("cdp_event",), "proxy": ("proxy_request",), "conn": ("connection_open", "connection_close"),
            "dns": ("dns_packet",),
        }.items()
    }
    return (
        events.groupBy("session_id")
        .agg(*[value.alias(name) for name, value in has.items()], F.count("*").alias("events"))
        .select(
            "session_id",
            F.when(F.col("cdp"), "chrome-cdp").when(F.col("proxy"), "proxy-jsonl")
            .when(F.col("conn"), "connection-jsonl").when(F.col("dns"), "dns-jsonl")
            .otherwise("unsupported").alias("source_type"),
            "events",
        )
    )
