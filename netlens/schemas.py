"""Column sets shared by sources, operators and sinks.

``seq`` is one BIGINT that orders the records of a session as they stand in the file. JSON detail
that is only passed through (initiator, cookies, certificate details) stays JSON text, because
VARIANT cannot be compared or grouped.
"""

from __future__ import annotations

TIMING_FIELDS = ("queueing_ms", "dns_ms", "connect_ms", "ssl_ms", "worker_ms", "send_ms", "ttfb_ms", "receive_ms")

TIMING = "struct<" + ",".join(f"{name}:double" for name in TIMING_FIELDS) + ">"

EVENT = {
    "session_id": "string",
    "seq": "bigint",
    "type": "string",
    "timestamp": "string",
    "method": "string",
    "request_id": "string",
    "body": "variant",
}

REQUEST = {
    "session_id": "string",
    "seq": "bigint",
    "id": "string",
    "redirect_index": "int",
    "url": "string",
    "scheme": "string",
    "domain": "string",
    "path": "string",
    "query_keys": "array<string>",
    "method": "string",
    "resource_type": "string",
    "document_url": "string",
    "started_monotonic": "double",
    "started_wall_time": "double",
    "started_at": "string",
    "duration_ms": "double",
    "status": "int",
    "status_text": "string",
    "protocol": "string",
    "mime_type": "string",
    "remote_ip": "string",
    "remote_port": "string",
    "connection_id": "string",
    "connection_reused": "boolean",
    "transfer_bytes": "bigint",
    "body_bytes": "bigint",
    "request_headers": "map<string,string>",
    "response_headers": "map<string,string>",
    "has_post_data": "boolean",
    "post_data": "string",
    "associated_cookies": "string",
    "initial_priority": "string",
    "referrer_policy": "string",
    "initiator_type": "string",
    "initiator": "string",
    "from_cache": "boolean",
    "from_service_worker": "boolean",
    "from_prefetch_cache": "boolean",
    "failed": "boolean",
    "failure": "string",
    "canceled": "boolean",
    "blocked_reason": "string",
    "security_state": "string",
    "tls_protocol": "string",
    "security_details": "string",
    "timing": TIMING,
    "redirect": "boolean",
}

# Columns that the session pass adds to REQUEST.
NORMALIZED = ("offset_ms", "third_party", "tracker", "compression_ratio")

CONNECTION_FIELDS = (
    "process string, pid int, user string, fd string, family string, protocol string, "
    "local struct<host:string,port:string>, remote struct<host:string,port:string>, state string, path string"
)

FINDING_FIELDS = "severity string, category string, code string, title string, recommendation string, evidence array<string>"

# Report order of the request table in CSV files.
CSV_COLUMNS = (
    "started_at", "offset_ms", "method", "status", "protocol", "resource_type", "mime_type", "duration_ms",
    "transfer_bytes", "body_bytes", "domain", "remote_ip", "from_cache", "third_party", "tracker", "failed", "url",
)


def conform(frame, schema=REQUEST, extra=()):
    """Select the schema's columns with their types; columns the producer lacks become NULL."""
    from pyspark.sql import functions as F

    present = set(frame.columns)
    return frame.select(
        *[
            (F.col(name).cast(kind) if name in present else F.lit(None).cast(kind)).alias(name)
            for name, kind in schema.items()
        ],
        *[name for name in extra if name in present],
    )
