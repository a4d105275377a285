"""Browser events into requests.

Order is meaning: a repeated ``requestWillBeSent`` of the same id opens the next hop, later events
belong to the latest hop, and a response replaces what came before it. The state a sequential
reader would carry is two running counts (starts, responses) and two pending header maps. They are
carried block by block (see ``skew``), so an id with any number of events is spread over tasks;
everything else is a grouped aggregation per hop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netlens.functions import url as U
from netlens.functions.numbers import elapsed_ms, half_even, text_or, truthy, whole
from netlens.operators.skew import BLOCK_BITS, block_totals, by_block
from netlens.schemas import conform
from netlens.sources.jsonl import repeated_keys

# Event names.
START = "Network.requestWillBeSent"
START_EXTRA = "Network.requestWillBeSentExtraInfo"
RESPONSE = "Network.responseReceived"
RESPONSE_EXTRA = "Network.responseReceivedExtraInfo"
SERVED_FROM_CACHE = "Network.requestServedFromCache"
DATA = "Network.dataReceived"
FINISHED = "Network.loadingFinished"
FAILED = "Network.loadingFailed"
REQUEST_EVENTS = (START, START_EXTRA, RESPONSE, RESPONSE_EXTRA, SERVED_FROM_CACHE, DATA, FINISHED, FAILED)

# Response timing marks, (field, start mark, end mark).
TIMING_MARKS = (
    ("queueing_ms", "proxyStart", "proxyEnd"),
    ("dns_ms", "dnsStart", "dnsEnd"),
    ("connect_ms", "connectStart", "connectEnd"),
    ("ssl_ms", "sslStart", "sslEnd"),
    ("worker_ms", "workerStart", "workerReady"),
    ("send_ms", "sendStart", "sendEnd"),
)

HEADERS = "map<string,string>"
KEY = ["session_id", "request_id"]

MARKS = ",".join(f"{mark}:double" for _, start, end in TIMING_MARKS for mark in (start, end))
REPLY = (
    "struct<status:string,statusText:string,protocol:string,mimeType:string,remoteIPAddress:string,remotePort:string,"
    f"connectionId:string,connectionReused:boolean,headers:{HEADERS},fromDiskCache:boolean,fromPrefetchCache:boolean,"
    "fromServiceWorker:boolean,securityState:string,securityDetails:string,"
    f"timing:struct<{MARKS},receiveHeadersEnd:double>>"
)
PARAMS = (
    "struct<timestamp:double,wallTime:double,type:string,documentURL:string,"
    f"request:struct<url:string,method:string,headers:{HEADERS},hasPostData:boolean,postData:string,"
    "initialPriority:string,referrerPolicy:string>,initiator:string,"
    f"response:{REPLY},redirectResponse:{REPLY},headers:{HEADERS},associatedCookies:string,"
    "dataLength:string,encodedDataLength:string,errorText:string,canceled:boolean,blockedReason:string>"
)


def timing_delta(start: Column, end: Column) -> Column:
    """End minus start, two decimals; NULL unless both marks are known and not negative."""
    return F.when((start >= 0) & (end >= 0), half_even(F.greatest(F.lit(0.0), end - start), 2))


def timing_struct(marks: Column) -> Column:
    """Phase durations from the marks of a response."""
    first_byte = marks["receiveHeadersEnd"]
    return F.struct(
        *[timing_delta(marks[start], marks[end]).alias(name) for name, start, end in TIMING_MARKS],
        F.when(first_byte >= 0, half_even(first_byte, 2)).alias("ttfb_ms"),
        F.lit(None).cast("double").alias("receive_ms"),
    )


def no_headers() -> Column:
    return F.create_map().cast(HEADERS)


def request_events(events: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The eight request events with their parameters read once into typed columns, and the columns to ``keep`` as they are."""
    typed = F.explode(F.array(F.try_variant_get("body", "$.params", PARAMS))).alias("p")
    kind, p = F.col("method"), F.col("p")
    wanted = events.where((F.col("type") == "cdp_event") & kind.isin(*REQUEST_EVENTS))
    start = F.struct(
        p["request"].alias("request"), *[p[name].alias(name) for name in ("type", "documentURL", "timestamp", "wallTime", "initiator")]
    )
    reply = F.when(kind == RESPONSE, F.coalesce(p["response"], F.from_json(F.lit("{}"), REPLY))).when(
        kind == START, p["redirectResponse"]
    )
    fault = F.struct(
        p["errorText"].alias("failure"), truthy(p["canceled"]).alias("canceled"), p["blockedReason"].alias("blocked_reason")
    )
    return wanted.select(*KEY, "seq", "method", *keep, typed).select(
        *KEY,
        "seq",
        *keep,
        kind.alias("kind"),
        p["timestamp"].alias("ts"),
        F.when(kind == START, start).alias("start"),
        reply.alias("reply"),
        F.when(kind.isin(START_EXTRA, RESPONSE_EXTRA), F.coalesce(p["headers"], no_headers())).alias("extra_headers"),
        F.when(kind == START_EXTRA, p["associatedCookies"]).alias("cookies"),
        F.when(kind == DATA, whole(p["dataLength"])).alias("data_length"),
        F.when(kind == FINISHED, whole(p["encodedDataLength"])).alias("encoded_length"),
        F.when(kind == FAILED, fault).alias("fault"),
    )


def with_hops(rows: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """Add ``hop`` (-1 before the first start), ``reply_no`` and the pending header maps.

    Within a block the counts are windows; the counts before a block come from one row per earlier
    block of the same id. A header map is pending only while no start has been seen.
    """
    cut = KEY + ["_block"]
    inside = Window.partitionBy(*cut).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*KEY).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    kind = F.col("kind")

    early = {"_ask": START_EXTRA, "_answer": RESPONSE_EXTRA}
    replied = kind == RESPONSE
    local = (
        by_block(rows, KEY, "seq", bits)
        .withColumn("_starts", F.sum(F.when(kind == START, 1).otherwise(0)).over(inside))
        .withColumns(
            {
                "_replies": F.sum(F.when(replied, 1).otherwise(0)).over(inside),
                "_replies_after": F.sum(F.when(replied & (F.col("_starts") > 0), 1).otherwise(0)).over(inside),
                **{
                    name: F.last(
                        F.when((kind == mark) & (F.col("_starts") == 0), F.col("extra_headers")), ignorenulls=True
                    ).over(inside)
                    for name, mark in early.items()
                },
            }
        )
    )
    totals = (
        F.max("_starts").alias("starts"),
        F.max("_replies").alias("replies"),
        F.max("_replies_after").alias("replies_after"),
        F.max_by("_ask", "seq").alias("ask"),
        F.max_by("_answer", "seq").alias("answer"),
    )
    blocks = (
        block_totals(local, cut, *totals)
        .withColumn("starts_before", F.coalesce(F.sum("starts").over(earlier), F.lit(0)))
        .withColumn("counted", F.when(F.col("starts_before") > 0, F.col("replies")).otherwise(F.col("replies_after")))
        .withColumns(
            {
                name: F.when(F.col("starts_before") == 0, F.col(name)) for name in ("ask", "answer")
            }
        )
        .select(
            *cut,
            "starts_before",
            F.coalesce(F.sum("counted").over(earlier), F.lit(0)).alias("replies_before"),
            F.last("ask", ignorenulls=True).over(earlier).alias("ask_before"),
            F.last("answer", ignorenulls=True).over(earlier).alias("answer_before"),
        )
    )
    fresh = F.col("starts_before") == 0
    return local.join(blocks, cut).select(
        *rows.columns,
        (F.col("starts_before") + F.col("_starts") - 1).alias("hop"),
        (
            F.col("replies_before") + F.when(fresh, F.col("_replies_after")).otherwise(F.col("_replies"))
        ).alias("reply_no"),
        F.coalesce(F.when(fresh, F.col("_ask")), F.col("ask_before")).alias("pending_request_headers"),
        F.coalesce(F.when(fresh, F.col("_answer")), F.col("answer_before")).alias("pending_response_headers"),
    )


def _merge(base: Column, late: Column) -> Column:
    """``base`` with the entries of ``late`` written over it."""
    return F.map_concat(F.map_filter(base, lambda key, value: ~F.map_contains_key(late, key)), late)


def _entries(late: Column, kind: str, after: Column) -> Column:
    picked = F.filter(late, lambda item: (item["kind"] == kind) & (item["seq"] > after))
    return F.map_from_entries(F.transform(picked, lambda item: F.struct(item["name"], item["value"])))


def _roles(rows: DataFrame) -> DataFrame:
    """One row per effect of an event: on its own hop, on the hop it closes, on each extra header.

    A start also closes the hop before it, if it carries that hop's redirect response.
    """
    kind, hop = F.col("kind"), F.col("hop")
    nothing = F.lit(None).cast("string")

    def effect(role: Column, target: Column, name: Column = nothing, value: Column = nothing) -> Column:
        return F.struct(role.alias("role"), target.alias("target"), name.alias("name"), value.alias("value"))

    own = F.array(effect(kind, hop))
    closes = (kind == START) & (hop > 0) & F.col("reply").isNotNull()
    headers = F.transform(
        F.map_entries("extra_headers"), lambda item: effect(kind, hop, item["key"], item["value"])
    )
    effects = (
        F.when(closes, F.concat(own, F.array(effect(F.lit("close"), hop - 1))))
        .when(F.col("extra_headers").isNotNull(), F.concat(own, headers))
        .otherwise(own)
    )
    return (
        rows.where(hop >= 0)
        .select("*", F.inline(effects))
        .withColumns(
            {
                "hop": F.col("target"),
                "start": F.when(F.col("role") == START, F.col("start")),
                "reply": F.when(F.col("role") != START, F.col("reply")),
            }
        )
    )


def hop_state(rows: DataFrame) -> DataFrame:
    """The last word of every kind of event per hop.

    Extra headers are combined per header name first, so what is listed per hop is bounded by the
    number of distinct names, however many events a hop has.
    """
    key = KEY + ["hop"]
    role, seq, main = F.col("role"), F.col("seq"), F.col("name").isNull()

    def at(*names: str) -> Column:
        return F.when(main & role.isin(*names), seq)

    header_kind = F.when(F.col("name").isNotNull(), role).alias("header_kind")
    parts = _roles(rows).groupBy(*key, "name", header_kind).agg(
        F.max_by("value", "seq").alias("value"),
        F.max("seq").alias("value_seq"),
        F.max(at(START)).alias("start_seq"),
        F.max_by("start", at(START)).alias("start"),
        F.max_by("pending_request_headers", at(START)).alias("pending_request"),
        F.max_by(F.struct("reply", "reply_no", "pending_response_headers", "seq"), at(RESPONSE)).alias("answer"),
        F.max_by(F.struct("reply", "ts"), at("close")).alias("close"),
        F.max(at(SERVED_FROM_CACHE)).alias("cache_seq"),
        F.sum(F.coalesce("data_length", F.lit(0))).alias("body_bytes"),
        F.max_by("encoded_length", at(FINISHED)).alias("transfer_bytes"),
        F.max_by("fault", at(FAILED)).alias("fault"),
        F.max_by("ts", F.when(F.col("ts").isNotNull(), at(FINISHED, FAILED))).alias("end_ts"),
        F.max_by("cookies", at(START_EXTRA)).alias("associated_cookies"),
    )
    main_columns = [name for name in parts.columns if name not in key + ["name", "header_kind", "value", "value_seq"]]
    header = F.struct(
        F.col("header_kind").alias("kind"), "name", "value", F.col("value_seq").alias("seq")
    )
    return (
        parts.groupBy(*key)
        .agg(
            F.first(F.when(main, F.struct(*main_columns)), ignorenulls=True).alias("m"),
            F.collect_list(F.when(~main, header)).alias("late"),
        )
        .select(*key, "m.*", "late")
    )


def correlate(events: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """REQUEST rows of browser sessions, one per hop, ordered by ``seq`` of the start event."""
    # The rows are joined to totals of themselves, for which Spark makes their expressions anew: both must read lines alike.
    with repeated_keys(events.sparkSession):
        hops = hop_state(with_hops(request_events(events), bits))
    hop, start, close = F.col("hop"), F.col("start"), F.col("close")
    closed = close.isNotNull()
    chosen = hops.withColumns(
        {
            "closed": closed,
            "reply": F.when(closed, close["reply"]).otherwise(F.col("answer.reply")),
            "reply_seq": F.coalesce(F.col("answer.seq"), F.lit(-1)),
        }
    )
    closed, reply, reply_seq = F.col("closed"), F.col("reply"), F.col("reply_seq")
    begun, asked = start["timestamp"], start["request"]
    response_base = F.coalesce(reply["headers"], no_headers())
    first_reply = ~closed & (F.col("answer.reply_no") == 1)
    with_pending = F.when(
        first_reply, _merge(response_base, F.coalesce(F.col("answer.pending_response_headers"), no_headers()))
    ).otherwise(response_base)
    pending_request = F.when(hop == 0, F.coalesce("pending_request", no_headers())).otherwise(no_headers())
    request = chosen.select(
        "session_id",
        F.col("start_seq").alias("seq"),
        F.col("request_id").alias("id"),
        hop.cast("int").alias("redirect_index"),
        F.coalesce(asked["url"], F.lit("")).alias("url"),
        F.coalesce(asked["method"], F.lit("?")).alias("method"),
        F.coalesce(start["type"], F.lit("Other")).alias("resource_type"),
        F.coalesce(start["documentURL"], F.lit("")).alias("document_url"),
        begun.alias("started_monotonic"),
        start["wallTime"].alias("started_wall_time"),
        (truthy(asked["hasPostData"]) | (F.coalesce(asked["postData"], F.lit("")) != "")).alias("has_post_data"),
        asked["postData"].alias("post_data"),
        asked["initialPriority"].alias("initial_priority"),
        asked["referrerPolicy"].alias("referrer_policy"),
        F.get_json_object(start["initiator"], "$.type").alias("initiator_type"),
        F.coalesce(start["initiator"], F.lit("{}")).alias("initiator"),
        F.coalesce(F.when(closed, elapsed_ms(begun, close["ts"])), elapsed_ms(begun, F.col("end_ts"))).alias("duration_ms"),
        whole(reply["status"]).cast("int").alias("status"),
        F.coalesce(reply["statusText"], F.lit("")).alias("status_text"),
        text_or(reply["protocol"], "unknown").alias("protocol"),
        U.mime_essence(text_or(reply["mimeType"], "unknown")).alias("mime_type"),
        reply["remoteIPAddress"].alias("remote_ip"),
        reply["remotePort"].alias("remote_port"),
        reply["connectionId"].alias("connection_id"),
        reply["securityState"].alias("security_state"),
        F.get_json_object(reply["securityDetails"], "$.protocol").alias("tls_protocol"),
        reply["securityDetails"].alias("security_details"),
        timing_struct(reply["timing"]).alias("timing"),
        truthy(reply["connectionReused"]).alias("connection_reused"),
        truthy(reply["fromServiceWorker"]).alias("from_service_worker"),
        truthy(reply["fromPrefetchCache"]).alias("from_prefetch_cache"),
        (
            truthy(reply["fromDiskCache"], reply["fromPrefetchCache"])
            | (~closed & F.coalesce(F.col("cache_seq") > reply_seq, F.lit(False)))
        ).alias("from_cache"),
        F.coalesce("transfer_bytes", F.lit(0)).alias("transfer_bytes"),
        "body_bytes",
        _merge(
            _merge(F.coalesce(asked["headers"], no_headers()), pending_request),
            _entries(F.col("late"), START_EXTRA, F.lit(-1)),
        ).alias("request_headers"),
        F.when(closed, response_base)
        .otherwise(_merge(with_pending, _entries(F.col("late"), RESPONSE_EXTRA, reply_seq)))
        .alias("response_headers"),
        "associated_cookies",
        F.col("fault").isNotNull().alias("failed"),
        F.col("fault.failure").alias("failure"),
        truthy(F.col("fault.canceled")).alias("canceled"),
        F.col("fault.blocked_reason").alias("blocked_reason"),
        closed.alias("redirect"),
    )
    url = F.col("url")
    return conform(
        request.withColumns(
            {
                "scheme": U.url_scheme(url),
                "domain": F.coalesce(U.url_host(url), F.lit("unknown")),
                "path": text_or(U.url_path(url), "/"),
                "query_keys": U.query_keys(url),
            }
        )
    )
