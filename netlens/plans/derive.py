"""Recordings derived from the given tables, row for row and with whole-number arithmetic.

The tables hold no recordings. Each function below turns whole tables into one of the inputs the
engine reads (requests, browser event lines, proxy lines, HAR documents, socket snapshots, packet
lines and so on), so that every query grows with the tables. ``reference_sql`` states the same
relations for the SQL check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netlens.functions import url as U
from netlens.operators.skew import running_sum
from netlens.schemas import conform

# Substrings that mark tracking in the derived pages.
PATTERNS = ("utm_source=", "free-bets")

# Consecutive events of a user within this many event ids share one request id.
ID_SPAN = 400

# Rows of a table that one task turns into documents or lines.
SPREAD = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(spark: SparkSession, sf_dir: str, name: str, size: int = SPREAD) -> DataFrame:
    """A table dealt over tasks of about ``size`` rows.

    A row here becomes a document or some lines, many times its size in the file. A scan is cut by bytes and by row
    groups, so that a table of a few megabytes would be one task whatever is made of it.
    """
    rows = table(spark, sf_dir, name)
    tasks = -(-rows.count() // size)  # answered from the file footers
    return rows.repartition(tasks) if tasks > 1 else rows


def _case(value: Column, mapping: dict, default: object) -> Column:
    result = None
    for key, item in mapping.items():
        result = F.when(value == key, item) if result is None else result.when(value == key, item)
    return result.otherwise(default)


def base_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with ``k`` (0..99), ``v`` (value in hundredths) and the page they touch."""
    pages = table(spark, sf_dir, "pages")
    count = pages.count()  # answered from the file footers
    events = table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", "event_type",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.round(F.col("value") * 100).cast("bigint").alias("v"),
        (F.col("event_id") % count).alias("page_id"),
    )
    return events.join(pages.select("page_id", "url"), "page_id")


def millis(name: str) -> Column:
    """Whole milliseconds since the epoch of a zone-free timestamp column read as UTC."""
    return F.expr(f"timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', {name})")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REQUEST rows: one per event; the user is the session."""
    e = base_events(spark, sf_dir)
    kind, k, v, url = F.col("event_type"), F.col("k"), F.col("v"), F.col("url")
    status = (
        F.when(kind == "error", 500).when(k % 7 == 0, 404).when(kind == "signup", 302).otherwise(200)
    )
    return conform(
        e.select(
            F.col("user_id").cast("string").alias("session_id"),
            F.col("event_id").alias("seq"),
            F.col("event_id").cast("string").alias("id"),
            F.lit(0).alias("redirect_index"),
            url,
            U.url_scheme(url).alias("scheme"),
            F.coalesce(U.url_host(url), F.lit("unknown")).alias("domain"),
            F.coalesce(F.nullif(U.url_path(url), F.lit("")), F.lit("/")).alias("path"),
            U.query_keys(url).alias("query_keys"),
            F.when(kind.isin("signup", "purchase"), "POST").otherwise("GET").alias("method"),
            kind.alias("resource_type"),
            F.when(kind == "view", url).otherwise("").alias("document_url"),
            (millis("ts") / 1000.0).alias("started_monotonic"),
            (millis("ts") / 1000.0).alias("started_wall_time"),
            (v / 10.0).alias("duration_ms"),
            status.alias("status"),
            F.lit("").alias("status_text"),
            _case(k % 3, {0: "http/1.1", 1: "h2"}, "h3").alias("protocol"),
            _case(kind, {"view": "text/html", "click": "application/json", "purchase": "text/css"}, "text/plain").alias(
                "mime_type"
            ),
            F.concat(F.lit("203.0.113."), k).alias("remote_ip"),
            F.lit("443").alias("remote_port"),
            F.expr("v * v div 1000").alias("transfer_bytes"),
            F.expr("v * v div 500").alias("body_bytes"),
            (k % 10 == 0).alias("from_cache"),
            ((kind == "error") & (k < 20)).alias("failed"),
            F.when((kind == "error") & (k < 20), "net::ERR_FAILED").alias("failure"),
            F.when(k % 50 == 0, "TLS 1.0").otherwise("TLS 1.3").alias("tls_protocol"),
            (status == 302).alias("redirect"),
            F.struct(
                F.lit(None).cast("double").alias("queueing_ms"),
                (k / 10.0).alias("dns_ms"), (k / 5.0).alias("connect_ms"), F.lit(None).cast("double").alias("ssl_ms"),
                F.lit(None).cast("double").alias("worker_ms"), F.lit(1.0).alias("send_ms"), (k / 4.0).alias("ttfb_ms"),
                F.lit(None).cast("double").alias("receive_ms"),
            ).alias("timing"),
        )
    )


def cdp_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Browser event lines: start, response, data and end of every request, as JSON text.

    Requests of a user that fall into the same span of event ids share a request id, so they become
    hops; a hop after a 302 carries the redirect response.
    """
    r = requests(spark, sf_dir)
    span = F.expr(f"seq div {ID_SPAN}")
    last_status = F.lag("status").over(Window.partitionBy("session_id", "_span").orderBy("seq"))
    rows = r.withColumn("_span", span).withColumn("_last", last_status)
    rid = F.concat_ws("-", "session_id", F.col("_span").cast("string")).alias("requestId")
    start = F.col("started_monotonic")
    end = (start + F.col("duration_ms") / 1000.0).alias("timestamp")
    stamp = F.date_format(F.timestamp_millis(F.round(start * 1000).cast("bigint")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")

    def line(method: Column, *params: Column) -> Column:
        return F.to_json(
            F.struct(
                F.lit("cdp_event").alias("type"), stamp.alias("timestamp"), method.alias("method"),
                F.struct(rid, *params).alias("params"),
            )
        )

    reply = F.struct(
        "status", "protocol", F.col("mime_type").alias("mimeType"), F.col("remote_ip").alias("remoteIPAddress"),
        F.col("from_cache").alias("fromDiskCache"),
        F.create_map(F.lit("server"), F.col("protocol")).alias("headers"),
        F.struct(F.lit(0).alias("dnsStart"), ((F.round(F.col("timing.dns_ms") * 10).cast("int") * 2 + 1) * 5 / 1000.0).alias("dnsEnd")).alias("timing"),
        F.struct(F.col("tls_protocol").alias("protocol")).alias("securityDetails"),
    ).alias("response")
    redirect = F.when(
        F.col("_last") == 302, F.struct(F.lit(302).alias("status"), F.lit("http/1.1").alias("protocol"))
    ).alias("redirectResponse")
    lines = F.array(
        line(
            F.lit("Network.requestWillBeSent"), start.alias("timestamp"), F.col("started_wall_time").alias("wallTime"),
            F.col("document_url").alias("documentURL"), F.col("resource_type").alias("type"),
            F.struct("url", "method").alias("request"), redirect,
        ),
        line(F.lit("Network.responseReceived"), reply),
        line(F.lit("Network.dataReceived"), F.col("body_bytes").alias("dataLength")),
        line(
            F.when(F.col("failed"), "Network.loadingFailed").otherwise("Network.loadingFinished"), end,
            F.when(~F.col("failed"), F.col("transfer_bytes")).alias("encodedDataLength"),
            F.when(F.col("failed"), F.col("failure")).alias("errorText"),
        ),
    )
    return rows.select("session_id", F.col("seq").alias("_seq"), F.posexplode(lines).alias("_pos", "value")).select(
        "session_id", (F.col("_seq") * 4 + F.col("_pos")).alias("seq"), "value"
    )


def header_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event lines above with the browser's extra events between them: headers before and after a start, headers
    after a response, and cache notes before and after it. Line n of them has place 2 n here; extras stand at odd places."""
    rid = F.concat_ws("-", "session_id", F.expr(f"CAST(seq div {ID_SPAN} AS STRING)"))
    k, seq = F.col("k"), F.col("seq")

    def extra(place: Column, fires: Column, method: str, **headers: Column) -> Column:
        kept = [F.create_map(*[x for name, value in headers.items() for x in (F.lit("x-" + name), value)]).alias("headers")] if headers else []
        params = F.struct(rid.alias("requestId"), *kept)
        text = F.to_json(F.struct(F.lit("cdp_event").alias("type"), F.lit(method).alias("method"), params.alias("params")))
        return F.when(fires, F.struct(place.alias("seq"), text.alias("value")))

    mark = lambda letter: F.concat(F.lit(letter), seq.cast("string"))
    extras = F.array_compact(F.array(
        extra(seq * 8 - 1, k % 5 == 0, "Network.requestWillBeSentExtraInfo", early=mark("e")),
        extra(seq * 8 + 1, k % 6 != 1, "Network.requestWillBeSentExtraInfo", ask=mark("a")),
        extra(seq * 8 + 1, k % 6 == 1, "Network.requestServedFromCache"),
        extra(seq * 8 + 3, k % 4 != 0, "Network.responseReceivedExtraInfo", answer=mark("r")),
        extra(seq * 8 + 5, k % 6 == 2, "Network.requestServedFromCache"),
    ))
    rows = _events(spark, sf_dir).select(F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("seq"), "k")
    added = rows.select("session_id", F.inline(extras))
    return cdp_lines(spark, sf_dir).withColumn("seq", F.col("seq") * 2).unionByName(added)


def proxy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proxy request lines: one per request; POSTs are TLS tunnels."""
    r = requests(spark, sf_dir)
    tunnel = F.col("method") == "POST"
    event = F.struct(
        F.lit("proxy_request").alias("type"), F.lit("2024-01-01T00:00:00.000+00:00").alias("timestamp"),
        F.when(tunnel, "CONNECT").otherwise("GET").alias("method"),
        F.when(tunnel, F.concat("domain", F.lit(":443"))).otherwise(F.col("url")).alias("target"),
        F.lit("HTTP/1.1").alias("http_version"), F.when(tunnel, "tls_tunnel").otherwise("http").alias("mode"),
        F.col("domain").alias("host"), F.when(tunnel, 443).otherwise(80).alias("port"),
        F.when(
            ~tunnel,
            F.struct(
                F.col("protocol").alias("http_version"), "status",
                F.create_map(F.lit("content-type"), F.concat("mime_type", F.lit("; charset=utf-8"))).alias("headers"),
            ),
        ).alias("response"),
        (~F.col("failed")).alias("ok"), F.col("transfer_bytes").alias("upload_bytes"),
        F.col("body_bytes").alias("download_bytes"), "duration_ms",
    )
    return r.select("session_id", "seq", F.to_json(event).alias("value"))


def har_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HAR archives: the requests of a user within one span of event ids, so an archive stays small."""
    r = requests(spark, sf_dir).withColumn("_span", F.expr(f"seq div {ID_SPAN}"))
    entry = F.struct(
        "seq",
        F.struct(
            F.col("duration_ms").alias("time"), F.struct("method", "url").alias("request"),
            F.struct(
                F.when(F.col("failed"), 0).otherwise(F.col("status")).alias("status"),
                F.col("protocol").alias("httpVersion"), F.col("body_bytes").alias("bodySize"),
                F.when(F.col("from_cache"), -1).otherwise(100).alias("headersSize"),
                F.struct(F.concat("mime_type", F.lit("; charset=utf-8")).alias("mimeType")).alias("content"),
            ).alias("response"),
            F.struct(F.lit(-1).alias("blocked"), F.col("timing.dns_ms").alias("dns"), F.col("timing.ttfb_ms").alias("wait")).alias("timings"),
            F.when(F.col("from_cache"), F.struct(F.lit("hit").alias("comment"))).alias("cache"),
        ).alias("entry"),
    )
    docs = r.groupBy("session_id", "_span").agg(F.array_sort(F.collect_list(entry)).alias("_e"))
    log = F.struct(F.struct(F.transform("_e", lambda item: item["entry"]).alias("entries")).alias("log"))
    name = F.concat_ws("-", "session_id", F.col("_span").cast("string"))
    return docs.select(name.alias("session_id"), F.to_json(log).alias("value"))


def mixed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a mixed folder: browser recordings (some with proxy lines in them), proxy logs (some with socket lines in
    them), socket recordings and recordings of nothing that is known. Archives are in ``mixed_archives``."""
    user = F.col("session_id").cast("bigint")
    proxied = proxy_lines(spark, sf_dir)
    web = cdp_lines(spark, sf_dir).where(user % 4 == 0).withColumn("seq", F.col("seq") * 2)
    inner = proxied.where(user % 8 == 0).withColumn("seq", F.col("seq") * 8 + 1)
    proxy = proxied.where(user % 4 == 1).withColumn("seq", F.col("seq") * 8)
    sockets = connection_lines(spark, sf_dir)
    within = _events(spark, sf_dir).where("user_id % 8 = 1").select(
        F.col("user_id").cast("string").alias("session_id"), (F.col("event_id") * 8 + 1).alias("seq"),
        F.lit('{"type":"connection_open","connection":{"process":"p"}}').alias("value"),
    )
    notes = proxied.where(user % 4 == 3).withColumn("value", F.lit('{"type":"note"}'))
    return web.unionByName(inner).unionByName(proxy).unionByName(sockets).unionByName(within).unionByName(notes)


def mixed_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archives of the mixed folder."""
    return har_documents(spark, sf_dir).where("CAST(split(session_id, '-')[0] AS BIGINT) % 4 = 2")


# --- sockets and interfaces ---------------------------------------------------------------------


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", millis("ts").alias("ms"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.round(F.col("value") * 100).cast("bigint").alias("v"),
    )


def _connection(user: Column, kind: Column) -> dict[str, Column]:
    """Connection columns of a user and event type."""

    def text(*parts: object) -> Column:
        return F.concat(*[F.lit(part) if isinstance(part, str) else part.cast("string") for part in parts])

    remote = (
        F.when(user % 4 == 0, text("192.168.1.", user % 200))
        .when(user % 4 == 1, text("8.8.", user % 200, ".8"))
        .when(user % 4 == 2, text("2606:4700::", user % 10))
        .otherwise(F.when(user % 8 == 3, F.lit("127.0.0.1")).otherwise(text("52.1.2.", user % 200)))
    )
    listening = kind == "signup"
    return {
        "process": text("App", user % 7),
        "pid": user.cast("int"),
        "user": text("u", user % 3),
        "fd": text(user % 9, "u"),
        "family": F.lit("IPv4"),
        "protocol": F.when(kind == "error", "UDP").otherwise("TCP"),
        "local": F.struct(
            F.when(listening & (user % 2 == 0), F.lit("*")).otherwise(text("10.0.0.", user % 250)).alias("host"),
            text(F.lit(1000) + user % 500).alias("port"),
        ),
        "remote": F.when(~listening, F.struct(remote.alias("host"), F.lit("443").alias("port"))),
        "state": _case(kind, {"signup": "LISTEN", "purchase": "CLOSED", "error": ""}, "ESTABLISHED"),
        "path": F.lit("direct"),
    }


def connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Socket snapshots: ten hosts, one snapshot per hour, a socket per user and event type seen in it."""
    seen = _events(spark, sf_dir).groupBy(
        F.concat(F.lit("host-"), F.col("user_id") % 10).alias("host"),
        F.expr("ms div 3600000").alias("snapshot_no"), "user_id", "event_type",
    ).agg(F.min("event_id").alias("seq"))
    columns = _connection(F.col("user_id"), F.col("event_type"))
    return seen.select("host", "snapshot_no", "seq", *[value.alias(name) for name, value in columns.items()])


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hour in which anything happened is a snapshot of every host, so some are empty."""
    hours = _events(spark, sf_dir).select(F.expr("ms div 3600000").alias("snapshot_no")).distinct()
    hosts = F.explode(F.array(*[F.lit(f"host-{number}") for number in range(10)]))
    return hours.select(hosts.alias("host"), "snapshot_no")


def connection_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connection open and close lines, one per event."""
    columns = _connection(F.col("user_id"), F.col("event_type"))
    line = F.to_json(
        F.struct(
            F.when(F.col("k") % 3 == 0, "connection_close").otherwise("connection_open").alias("type"),
            F.struct(*[value.alias(name) for name, value in columns.items()]).alias("connection"),
        )
    )
    return _events(spark, sf_dir).select(
        F.concat(F.lit("rec-"), F.col("user_id") % 10).alias("session_id"), F.col("event_id").alias("seq"), line.alias("value")
    )


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes of the hosts above, one per supplier."""
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("host-"), key % 10).alias("host"),
        F.when(key % 3 == 0, "default").otherwise("10.0.0.0/8").alias("destination"),
        F.lit("10.0.0.1").alias("gateway"), F.lit("UGS").alias("flags"),
        F.when(key % 20 == 6, "utun3").otherwise("en0").alias("interface"),
    )


def counter_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interface counters that grow with every event of their users and wrap around at 100,000."""
    e = _events(spark, sf_dir).select(
        F.concat(F.lit("host-"), F.col("user_id") % 10).alias("host"),
        F.concat(F.lit("en"), F.expr("user_id div 10 % 4")).alias("name"), "event_id", "ms", "v", "k",
    )
    summed = running_sum(e, ["host", "name"], "event_id", {"_rx": F.col("v"), "_tx": F.col("k").cast("bigint")})
    return summed.groupBy("host", "name", F.col("ms").alias("ts_ms")).agg(
        F.max_by(F.col("_rx") % 100000, "event_id").alias("rx_bytes"), F.max_by("_tx", "event_id").alias("tx_bytes")
    )


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start, end and load marks per user, with five request ids that are opened and closed at random."""
    k = F.col("k")
    kind = (
        F.when((F.col("event_type") == "view") & (k % 25 == 0), "Page.loadEventFired")
        .when(k % 4 < 2, "Network.requestWillBeSent")
        .when(k % 4 == 2, "Network.loadingFinished")
        .otherwise("Network.loadingFailed")
    )
    return _events(spark, sf_dir).select(
        F.col("user_id").cast("string").alias("session_id"), (k % 5).cast("string").alias("request_id"),
        F.col("event_id").alias("seq"), (F.col("ms") / 1000.0).alias("ts"), kind.alias("kind"),
    )


# --- host text logs -----------------------------------------------------------------------------


def _listing(rows: DataFrame, headers: DataFrame) -> DataFrame:
    columns = ["host", "snapshot_no", "pos", "value"]
    return rows.select(*columns).unionByName(headers.select(*columns))


def _headers(spark: SparkSession, sf_dir: str, before: str, header: str) -> DataFrame:
    """Two opening lines for the listing of every nation."""
    opening = F.posexplode(F.array(F.lit(before), F.lit(header)))
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("string").alias("host"), F.lit(0).cast("bigint").alias("snapshot_no"), opening.alias("pos", "value")
    ).withColumn("pos", F.col("pos").cast("bigint"))


def socket_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Socket listings, one line per customer; some without a numeric pid, some without a remote end."""
    key = F.col("c_custkey")
    pid = F.when(key % 13 == 0, "pid?").otherwise(key.cast("string"))
    name = (
        F.when(key % 3 == 0, F.concat(F.lit("*:"), key % 1000 + 1000, F.lit(" (LISTEN)")))
        .when(key % 3 == 1, F.concat(F.lit("10.0.0.2:"), key % 1000 + 1000, F.lit("->1.1.1.1:443 (ESTABLISHED)")))
        .otherwise(F.concat(F.lit("[fe80::1]:"), key % 1000 + 1000, F.lit("->[2606:4700::1]:443")))
    )
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").cast("string").alias("host"), F.lit(0).cast("bigint").alias("snapshot_no"), (key + 2).alias("pos"),
        F.concat_ws("  ", F.lit("Web\\x20App"), pid, F.lit("me"), F.lit("9u"), F.lit("IPv4"), F.lit("0x1"), F.lit("0t0"),
                    F.when(key % 2 == 0, "tcp").otherwise("UDP"), name).alias("value"),
    )
    return _listing(rows, _headers(spark, sf_dir, "", "COMMAND PID USER FD TYPE DEVICE SIZE/OFF NODE NAME"))


def route_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Route tables, one line per customer; some too short."""
    key = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").cast("string").alias("host"), F.lit(0).cast("bigint").alias("snapshot_no"), (key + 2).alias("pos"),
        F.concat_ws("   ", F.when(key % 10 == 0, "default").otherwise(F.concat(F.lit("10.0."), key % 250)), F.lit("link#1"), F.lit("UGSc"),
                    F.when(key % 11 != 0, F.concat(F.lit("en"), key % 3)), F.when((key % 11 != 0) & (key % 2 == 0), "900")).alias("value"),
    )
    return _listing(rows, _headers(spark, sf_dir, "Routing tables and more", "Destination Gateway Flags Netif Expire"))


def counter_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counter listings, one address line per customer; an interface has many."""
    key = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").cast("string").alias("host"), F.lit(0).cast("bigint").alias("snapshot_no"), (key + 2).alias("pos"),
        F.concat_ws(" ", F.concat(F.lit("en"), key % 4), F.lit("1500"), F.lit("net"), F.lit("addr"), (key * 3), key % 5, (key * 1000),
                    (key * 2), F.lit("0"), F.when(key % 17 != 0, key * 500), F.lit("0"),
                    F.when(key % 2 == 0, "-").otherwise((key % 7).cast("string"))).alias("value"),
    )
    header = "Name Mtu Network Address Ipkts Ierrs Ibytes Opkts Oerrs Obytes Coll Drop"
    return _listing(rows, _headers(spark, sf_dir, "en0 1 2 3 4 5 6 7 8 9 10 11", header))


def arp_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").cast("string").alias("host"), F.lit(0).cast("bigint").alias("snapshot_no"), key.alias("pos"),
        F.concat(F.lit("? ("), F.when(key % 9 == 0, "224.0.0.").otherwise("192.168.1."), key % 250, F.lit(") at "),
                 F.when(key % 7 == 0, "(incomplete)").otherwise("aa:bb:cc:dd:ee:ff"), F.lit(" on en0 ifscope [ethernet]")).alias("value"),
    )


def ndp_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").cast("string").alias("host"), F.lit(0).cast("bigint").alias("snapshot_no"), (key + 2).alias("pos"),
        F.concat_ws(" ", F.concat(F.when(key % 9 == 0, "ff02::").otherwise("fe80::"), key % 9 + 1, F.lit("%en0")),
                    F.when(key % 7 == 0, "(incomplete)").otherwise("aa:bb:cc:dd:ee:ff"), F.lit("en0"), F.lit("23h S R")).alias("value"),
    )
    return _listing(rows, _headers(spark, sf_dir, "", "Neighbor Linklayer Address Netif Expire St"))


# --- packets ------------------------------------------------------------------------------------


def packet_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packet lines with a time of day, one per line item: TCP, UDP, ICMP and ARP."""
    source = F.concat(F.lit("10.0.0."), F.col("l_suppkey") % 250)
    target = F.concat(F.lit("10.1.0."), F.col("l_partkey") % 250)
    size = F.col("l_quantity").cast("int")
    flag = F.col("l_returnflag")
    ports = F.concat(F.lit("IP "), source, F.lit("."), F.col("l_linenumber") + 40000, F.lit(" > "), target, F.lit(".443: "))
    body = (
        F.when(flag == "A", F.concat(ports, F.lit("Flags [P.], length "), size))
        .when(flag == "N", F.concat(ports, F.lit("UDP, length "), size))
        .when(F.col("l_linestatus") == "O", F.concat(F.lit("IP "), source, F.lit(" > "), target, F.lit(": ICMP echo request, length "), size))
        .otherwise(F.concat(F.lit("ARP, Request who-has "), target, F.lit(" tell "), source, F.lit(", length "), size))
    )
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("cap-"), F.col("l_orderkey") % 8).alias("capture_id"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
        F.concat(F.lit("2024-01-01 12:00:00.123456 "), body).alias("value"),
    )


def dns_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DNS packet lines, one per order: questions, answers and other traffic."""
    key = F.col("o_orderkey")
    client = F.concat(F.lit("192.168.1."), F.col("o_custkey") % 200, F.lit("."), key % 1000 + 50000)
    server = F.concat(F.lit("1.1.1."), F.col("o_custkey") % 3, F.lit(".53"))
    kind = F.when(key % 5 == 0, "AAAA").otherwise("A")
    name = F.concat(F.lower(F.substring("o_orderpriority", 3, 20)), F.lit("-"), F.col("o_custkey") % 40, F.lit(".example.com."))
    name = F.replace(name, F.lit(" "), F.lit("-"))
    asked = F.concat(F.lit("IP "), client, F.lit(" > "), server, F.lit(": "), key % 65536, F.lit("+ "), kind, F.lit("? "), name, F.lit(" (29)"))
    answered = F.concat(F.lit("IP "), server, F.lit(" > "), client, F.lit(": "), key % 65536, F.lit(" 1/0/0 A 9.9.9.9 (45)"))
    other = F.concat(F.lit("IP "), client, F.lit(" > 9.9.9.9.443: Flags [S], length 0"))
    line = F.when(key % 3 == 0, answered).when(key % 7 == 1, other).otherwise(asked)
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("dns-"), key % 4).alias("capture_id"), key.alias("seq"), F.concat(F.lit("2024-01-01 12:00:00.5 "), line).alias("value")
    )


# --- probe and snapshot documents ---------------------------------------------------------------


def _documents(rows: DataFrame, host: Column, stamp: Column | None = None, **fields: Column) -> DataFrame:
    stamp = F.lit("2024-01-01T00:00:00.000Z") if stamp is None else stamp
    text = F.to_json(F.struct(stamp.alias("timestamp"), *[value.alias(name) for name, value in fields.items()]))
    # explode() pins the text: a filter on it would else make it a second time, in front of the spreading.
    return rows.select(host.cast("string").alias("host"), F.explode(F.array(text)).alias("value"))


def quality_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One quality report per customer."""
    key = F.col("c_custkey")

    def probe(ok: Column, duration: Column, **details: Column) -> Column:
        return F.struct(
            F.lit("t").alias("target"), ok.alias("ok"), duration.alias("duration_ms"),
            F.struct(F.lit(1).alias("_"), *[value.alias(name) for name, value in details.items()]).alias("details"),
        )

    return _documents(
        spread(spark, sf_dir, "customer"), key,
        ping=probe(key % 10 != 0, F.lit(9.0), packet_loss_percent=(key % 6) * 4.0, avg_ms=(key % 300) * 1.0, jitter_ms=(key % 50) * 1.0),
        dns=probe(key % 7 != 0, (key % 200) * 1.0), tls=probe(key % 8 != 0, F.lit(5.0)), http=probe(key % 9 != 0, F.lit(7.0)),
    )


def dns_comparison_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One DNS comparison of four servers per customer."""
    key = F.col("c_custkey")

    def answer(value: object) -> Column:
        return F.struct(F.lit("answer").alias("section"), (F.lit(value) if isinstance(value, str) else value).alias("value"))

    results = F.array(
        *[
            F.struct(
                F.lit(f"1.1.1.{index}").alias("server"), ((key + index) % 4 != 0).alias("ok"),
                ((key * (index + 3)) % 50 * 1.0).alias("duration_ms"),
                F.array(answer("9.9.9.9"), answer(F.concat(F.lit("8.8.8."), F.when(key % 3 == 0, index).otherwise(0)))).alias("records"),
            )
            for index in range(4)
        ]
    )
    return _documents(spread(spark, sf_dir, "customer"), key, domain=F.lit("example.com"), query_type=F.lit("A"), results=results)


def trace_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trace of three hops per part; some hops time out."""
    key = F.col("p_partkey")
    hops = F.array(
        *[
            F.struct(
                F.lit(index).alias("hop"), F.array(F.lit(f"10.0.0.{index}"), F.lit(f"10.0.0.{index}"), F.lit("10.9.9.9")).alias("addresses"),
                F.when((key + index) % 5 == 0, F.array().cast("array<double>"))
                .otherwise(F.array((key % 40) * 1.0, (key % 60) * 1.0)).alias("samples_ms"),
                F.when((key + index) % 5 == 0, "* * *").otherwise("10.0.0.1 1 ms").alias("raw"),
            )
            for index in (1, 2, 3)
        ]
    )
    return _documents(spread(spark, sf_dir, "part"), key, target=F.lit("example.com"), ok=F.lit(True), hops=hops)


def tls_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One TLS report per part; certificates end on a day of June 2024."""
    key = F.col("p_partkey")
    until = F.concat(F.lit("Jun "), key % 28 + 1, F.lit(" 12:00:00 2024 GMT"))
    return _documents(
        spread(spark, sf_dir, "part"), key, domain=F.lit("example.com"), port=F.lit(443), ok=F.lit(True),
        tls_version=F.lit("TLSv1.3"), certificate=F.struct(until.alias("not_after")),
    )


def snapshot_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One host snapshot per customer, built so that every diagnosis rule fires for some host."""
    key = F.col("c_custkey")
    return _documents(spread(spark, sf_dir, "customer"), key, **_snapshot_fields(key))


def fleet_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots of each host in different states, with the routes to servers in the document."""
    state, number = F.col("state"), F.col("number")
    rows = spread(spark, sf_dir, "customer").select("c_custkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("number"))
    rows = rows.withColumn("state", F.col("c_custkey") + 7 * number)
    fields = _snapshot_fields(state)
    nameless = F.array(F.struct(F.lit(1).alias("id"), F.array().cast("array<string>").alias("nameservers")))
    fields["dns"] = F.when((state % 31 == 0) & (state % 23 != 0), nameless).otherwise(fields["dns"])
    through = F.when(state % 5 == 0, "utun3").otherwise("en0")
    reach = lambda server, interface: F.struct(server.alias("server"), interface.alias("interface"))
    fields["dns_routes"] = F.array(reach(F.when(state % 6 == 0, "192.168.1.1").otherwise("9.9.9.9"), through), reach(F.lit("1.1.1.1"), F.lit("unknown")))
    fields["ipv6_routes"] = F.array(F.struct(
        F.when(state % 2 == 0, "default").otherwise("fe80::/64").alias("destination"), F.when(state % 16 == 0, "en0").otherwise("utun3").alias("interface"),
    ))
    return _documents(rows, F.col("c_custkey"), stamp=F.concat(F.lit("2024-01-0"), (number + 1).cast("string"), F.lit("T00:00:00Z")), **fields)


def _snapshot_fields(key: Column) -> dict[str, Column]:
    end = lambda host, port: F.struct(F.lit(host).alias("host"), F.lit(port).alias("port"))

    def socket(process: str, local: Column, remote: Column | None, state: str) -> Column:
        return F.struct(
            F.lit(process).alias("process"), F.lit(1).alias("pid"), F.lit("3u").alias("fd"), F.lit("TCP").alias("protocol"),
            local.alias("local"), (remote if remote is not None else F.lit(None).cast("struct<host:string,port:string>")).alias("remote"),
            F.lit(state).alias("state"),
        )

    listener = socket("httpd", end("*", "8080"), None, "LISTEN")
    closed = F.array_repeat(socket("old", end("10.0.0.2", "1"), end("1.1.1.1", "443"), "CLOSED"), F.when(key % 19 == 0, 51).otherwise(1))
    sockets = F.when(key % 5 == 0, F.concat(F.array(listener, listener), closed)).otherwise(closed)

    def interface(name: str, up: Column, address: Column, status: str) -> Column:
        return F.struct(
            F.lit(name).alias("name"), F.when(up, F.array(F.lit("UP"))).otherwise(F.array().cast("array<string>")).alias("flags"),
            F.when(address, F.array(F.lit("10.0.0.2"))).otherwise(F.array().cast("array<string>")).alias("ipv4"),
            F.lit(status).alias("status"),
        )

    def route(destination: str, through: object) -> Column:
        return F.struct(
            F.lit(destination).alias("destination"), F.lit("10.0.0.1").alias("gateway"), F.lit("UGS").alias("flags"),
            (F.lit(through) if isinstance(through, str) else through).alias("interface"),
        )

    vpn = key % 4 == 0
    second = F.when(vpn, F.array(route("default", F.when(key % 8 == 0, "utun3").otherwise("en1")))).otherwise(F.array(route("10.0.0.0/8", "en0")))
    servers = F.array(F.when(key % 6 == 0, "192.168.1.1").otherwise("9.9.9.9"), F.lit("1.1.1.1"))
    return dict(
        connections=sockets,
        interfaces=F.array(interface("en0", key % 7 != 0, key % 7 != 0, "unknown"), interface("utun3", vpn, key % 3 == 0, "unknown")),
        routes=F.concat(F.array(route("default", "en0")), second),
        dns=F.when(key % 23 == 0, F.array().cast("array<struct<id:int,nameservers:array<string>>>")).otherwise(
            F.array(F.struct(F.lit(1).alias("id"), servers.alias("nameservers")))),
        proxy=F.when(key % 29 == 0, F.create_map(F.lit("HTTPProxy"), F.lit("127.0.0.1"))),
        interface_counters=F.create_map(F.lit("en0"), F.struct((key * 10).alias("rx_bytes"), key.alias("tx_bytes"))),
        quality=F.struct((key % 101).cast("int").alias("score")),
    )


def server_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interface through which each host reaches its servers; unknown for some."""
    key = F.col("c_custkey")
    pairs = F.array(
        F.struct(F.when(key % 6 == 0, "192.168.1.1").otherwise("9.9.9.9").alias("server"), F.when(key % 5 == 0, "utun3").otherwise("en0").alias("interface")),
    )
    return table(spark, sf_dir, "customer").select(key.cast("string").alias("host"), F.inline(pairs))


def ipv6_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.cast("string").alias("host"), F.when(key % 2 == 0, "default").otherwise("fe80::/64").alias("destination"),
        F.when(key % 16 == 0, "en0").otherwise("utun3").alias("interface"),
    )


def secret_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that carry a whole document as a body, a cookie, a token in a URL and a nested password."""
    message = F.struct(
        F.struct(
            F.col("text").alias("postData"), F.struct(F.col("source").alias("Cookie"), F.col("lang").alias("Accept")).alias("headers"),
            F.concat(F.lit("https://u:p@h.example/?token="), "doc_id", F.lit("&q="), "lang").alias("documentURL"),
        ).alias("request"),
        F.array(F.struct(F.col("n_chars").alias("password"), F.col("doc_id").alias("n"))).alias("list"),
        F.concat(F.lit("HTTP/1.1 200 OK\r\nSet-Cookie: "), "source", F.lit("\r\nVia: "), "lang").alias("headersText"),
    )
    return table(spark, sf_dir, "documents").select("doc_id", F.to_json(message).alias("value"))


# --- mixed event lines --------------------------------------------------------------------------


def browser_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page, web-socket, metric and session records of the users, one per event."""
    e = _events(spark, sf_dir)
    kind, k, v = F.col("event_type"), F.col("k"), F.col("v")

    def cdp(method: object, params: Column) -> Column:
        name = F.lit(method) if isinstance(method, str) else method
        return F.to_json(F.struct(F.lit("cdp_event").alias("type"), name.alias("method"), params.alias("params")))

    frame = F.when(k % 2 == 0, "Network.webSocketFrameSent").otherwise("Network.webSocketFrameReceived")
    opening = F.when(k % 2 == 0, "Network.webSocketCreated").otherwise("Network.webSocketClosed")
    payload = F.struct(F.struct(F.repeat(F.lit("é"), k).alias("payloadData")).alias("response"))
    metrics = F.array(
        F.struct(F.concat(F.lit("m"), k % 3).alias("name"), v.cast("string").alias("value")),
        F.struct(F.lit("heap").alias("name"), F.lit(None).cast("string").alias("value")),
    )
    line = (
        F.when(kind == "view", cdp("Page.lifecycleEvent", F.struct(k.alias("name"))))
        .when(kind == "click", F.when(k % 10 == 0, cdp(opening, F.struct(k.alias("n")))).otherwise(cdp(frame, payload)))
        .when(
            kind == "purchase",
            F.regexp_replace(
                F.to_json(
                    F.struct(
                        F.lit("cdp_command_result").alias("type"), F.lit("Performance.getMetrics").alias("command"),
                        F.struct(metrics.alias("metrics")).alias("result"),
                    )
                ),
                '"value":"([0-9]+)"', '"value":$1',
            ),
        )
        .when(kind == "signup", F.to_json(F.struct(F.lit("session_start").alias("type"), F.col("event_id").alias("n"))))
        .otherwise(F.to_json(F.struct(F.lit("session_end").alias("type"), F.struct(v.alias("requests")).alias("summary"))))
    )
    return e.select(F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("seq"), line.alias("value"))


def damaged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of which some are blank, broken or no objects."""
    k = F.col("k")
    line = F.when(k % 17 == 0, "{broken").when(k % 19 == 0, "[1]").when(k % 23 == 0, "  ").otherwise('{"type":"note"}')
    return _events(spark, sf_dir).select(
        F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("seq"), line.alias("value")
    )


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One IPv4 or IPv6 address per customer, spread over all kinds of networks."""
    key = F.col("c_custkey")
    first = F.element_at(F.array(*[F.lit(n) for n in (10, 127, 169, 172, 192, 198, 224, 240, 8, 100)]), (key % 10 + 1).cast("int"))
    four = F.concat_ws(".", first, key % 256, F.expr("c_custkey div 7 % 256"), F.lit("1"))
    six = F.concat(F.element_at(F.array(*[F.lit(t) for t in ("fe80", "fd00", "ff02", "2606")]), (key % 4 + 1).cast("int")), F.lit("::"), key % 10)
    return table(spark, sf_dir, "customer").select("c_custkey", F.when(key % 3 == 0, six).otherwise(four).alias("address"))
