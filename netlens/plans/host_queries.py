"""Registered queries over proxies, archives, sockets, host logs, packets, probes and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netlens.functions import address as A
from netlens.functions import redact as R
from netlens.operators import connections as C
from netlens.operators import diagnosis, normalize, packets, probes, recorder, scores, summary
from netlens.operators.sanitize import sanitize_json
from netlens.operators.skew import top_per_group
from netlens.plans import derive
from netlens.plans.request_queries import written_folder
from netlens.sinks import documents
from netlens.sources import har, hostlogs, jsonl, snapshots
from netlens.sources import packets as packet_source


def _parsed(lines: DataFrame) -> DataFrame:
    return jsonl.events_of(jsonl.parse_event_lines(lines))


# --- proxy and archives -------------------------------------------------------------------------


def proxy_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = jsonl.proxy_events(_parsed(derive.proxy_lines(spark, sf_dir)))
    return normalize.proxy_requests(events).select(
        "session_id", "seq", "id", "url", "scheme", "domain", "path", "method", "resource_type", "status", "protocol", "mime_type",
        "remote_port", "transfer_bytes", "body_bytes", "duration_ms", "failed",
    )


def har_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = har.split_documents(derive.har_documents(spark, sf_dir)).entries
    return normalize.har_requests(entries).select(
        "session_id", "id", "url", "domain", "method", "status", "protocol", "mime_type", "duration_ms", "body_bytes", "transfer_bytes",
        "failed", "from_cache", F.col("timing.dns_ms").alias("dns_ms"), F.col("timing.queueing_ms").alias("queueing_ms"),
    )


def har_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.har_summary(har.split_documents(derive.har_documents(spark, sf_dir)).entries)


def har_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.har_counters(har.split_documents(derive.har_documents(spark, sf_dir)).entries).drop("first_seq")


def session_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Browser sessions, proxy sessions and socket recordings told apart in one mixed folder."""
    mixed = (
        derive.cdp_lines(spark, sf_dir).withColumn("session_id", F.concat(F.lit("web-"), "session_id"))
        .unionByName(derive.proxy_lines(spark, sf_dir).withColumn("session_id", F.concat(F.lit("proxy-"), "session_id")))
        .unionByName(derive.connection_lines(spark, sf_dir))
    )
    return jsonl.session_types(_parsed(mixed))


# --- activity -----------------------------------------------------------------------------------


def inflight_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recorder.in_flight_peak(derive.activity(spark, sf_dir))


def network_idle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recorder.network_idle(derive.activity(spark, sf_dir), 3600.0)


# --- sockets ------------------------------------------------------------------------------------


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.with_key(derive.connections(spark, sf_dir))


def lifecycle_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.connection_changes(_keyed(spark, sf_dir), derive.snapshots(spark, sf_dir))


def live_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = C.connection_changes(_keyed(spark, sf_dir), derive.snapshots(spark, sf_dir), count_initial=False)
    return C.recent_changes(changes)


def lifecycle_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed, taken = _keyed(spark, sf_dir), derive.snapshots(spark, sf_dir)
    return C.record_summary(C.connection_changes(keyed, taken), keyed, taken)


def snapshot_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sockets of the first four hours of a day and of the other hours, compared as two snapshots per host."""
    keyed, early = _keyed(spark, sf_dir), F.col("snapshot_no") % 24 < 4
    before, after = (keyed.where(side).select("host", "conn_key").distinct() for side in (early, ~early))
    return C.two_snapshot_difference(before, after, ["host", "conn_key"])


def process_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.process_rollup(derive.connections(spark, sf_dir))


def socket_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.overview(derive.connections(spark, sf_dir))


def top_processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.top_processes(derive.connections(spark, sf_dir)).drop("first_seq")


def connection_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.connection_summary(derive.connections(spark, sf_dir))


def connection_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = C.filter_connections(
        derive.connections(spark, sf_dir), process="aPP3", remote_only=True, state="established", text="8.8.", show_closed=False
    )
    return kept.select("host", "snapshot_no", "process", "pid", "protocol", "state")


def connection_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First sockets of every host by state, process and pid."""
    rows = derive.connections(spark, sf_dir)
    order = C.connection_order("state") + [F.asc("snapshot_no"), F.asc("seq")]
    return top_per_group(rows, ["host"], order, 20).select("host", "rank", "state", "process", "pid", "snapshot_no")


def connection_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = C.with_paths(derive.connections(spark, sf_dir), derive.routes(spark, sf_dir))
    return placed.groupBy("host", "path").agg(F.count("*").alias("sockets"))


def recording_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.recording_summary(jsonl.connection_events(_parsed(derive.connection_lines(spark, sf_dir))))


def recording_processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.recording_processes(jsonl.connection_events(_parsed(derive.connection_lines(spark, sf_dir)))).drop("dimension")


def interface_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = C.interface_rates(derive.counter_samples(spark, sf_dir))
    return rates.select("host", "name", "ts_ms", *[F.round(name, 6).alias(name) for name in ("rx_rate", "tx_rate")])


def rate_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = C.interface_rates(derive.counter_samples(spark, sf_dir))
    milli = [F.floor(F.col(name) * 1000).cast("bigint").alias(name) for name in ("rx_rate", "tx_rate")]
    return C.rate_history(rates.select("host", "name", "ts_ms", *milli))


# --- host logs ----------------------------------------------------------------------------------


def socket_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hostlogs.parse_sockets(derive.socket_lines(spark, sf_dir))
    return rows.select(
        "host", "pos", "process", "pid", "protocol", A.endpoint_text(F.col("local")).alias("local"),
        A.endpoint_text(F.col("remote")).alias("remote"), "state",
    )


def route_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hostlogs.parse_routes(derive.route_lines(spark, sf_dir)).drop("snapshot_no")


def default_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hostlogs.default_routes(hostlogs.parse_routes(derive.route_lines(spark, sf_dir)))
    return rows.groupBy("host", "interface").agg(F.count("*").alias("routes"))


def counter_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.deduplicate_counters(hostlogs.parse_counters(derive.counter_lines(spark, sf_dir))).drop("snapshot_no")


def neighbour_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hostlogs.neighbours(derive.arp_lines(spark, sf_dir), derive.ndp_lines(spark, sf_dir))
    return rows.select("host", "family", "pos", "address", "mac", "interface", "state")


# --- packets ------------------------------------------------------------------------------------


def _packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packet_source.parse_packets(derive.packet_lines(spark, sf_dir))


def _dns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packet_source.parse_dns_packets(derive.dns_lines(spark, sf_dir))


def _counted(rows: DataFrame) -> DataFrame:
    return rows.drop("first_seq")


#: The packet limit of the two limited queries.
LIMIT = 200
#: Some line items, and so some packets, share their place.
FILE_ORDER = ("seq", "length", "protocol")

PACKET_QUERIES = {
    "packet_totals": lambda spark, sf_dir: packets.packet_totals(_packets(spark, sf_dir)),
    "packet_protocols": lambda spark, sf_dir: _counted(packets.packet_protocols(_packets(spark, sf_dir))),
    "packet_endpoints": lambda spark, sf_dir: _counted(packets.top_endpoints(_packets(spark, sf_dir))),
    "packet_ports": lambda spark, sf_dir: _counted(packets.top_ports(_packets(spark, sf_dir))),
    "packet_conversations": lambda spark, sf_dir: _counted(packets.top_conversations(_packets(spark, sf_dir))),
    "limited_totals": lambda spark, sf_dir: packets.packet_totals(packets.limit_packets(_packets(spark, sf_dir), LIMIT, FILE_ORDER), LIMIT),
    "limited_samples": lambda spark, sf_dir: packets.packet_samples(packets.limit_packets(_packets(spark, sf_dir), LIMIT, FILE_ORDER)).select("capture_id", "seq", "rank"),
    "packet_samples": lambda spark, sf_dir: packets.packet_samples(_dns(spark, sf_dir)).drop("rank"),
    "dns_totals": lambda spark, sf_dir: packets.dns_totals(_dns(spark, sf_dir)),
    "dns_domains": lambda spark, sf_dir: _counted(packets.top_domains(_dns(spark, sf_dir))),
    "dns_servers": lambda spark, sf_dir: _counted(packets.dns_servers(_dns(spark, sf_dir))),
    "dns_query_types": lambda spark, sf_dir: _dns(spark, sf_dir)
    .where(F.col("direction") == "query")
    .groupBy("query_type")
    .agg(F.count("*").alias("queries"), F.countDistinct("domain").alias("domains"), F.max("transaction_id").alias("last_id")),
}


# --- probes and snapshots -----------------------------------------------------------------------


def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = snapshots.parse_documents(derive.quality_documents(spark, sf_dir), snapshots.QUALITY)
    return scores.quality_scores(snapshots.quality_probes(reports)).withColumn("run_id", F.substring_index("run_id", "|", 1))


def probe_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = derive.table(spark, sf_dir, "orders").select(
        "o_orderpriority", F.floor("o_totalprice").cast("bigint").alias("sample_ms"), F.col("o_custkey").alias("address")
    )
    found = probes.sample_stats(samples, ["o_orderpriority"])
    return found.withColumns({name: F.col(name).cast("bigint") for name in ("min_ms", "max_ms")})  # samples are whole numbers here


def fastest_server(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = snapshots.parse_documents(derive.dns_comparison_documents(spark, sf_dir), snapshots.DNS_COMPARISON)
    return probes.dns_comparison(snapshots.dns_results(reports), ["host"])


def trace_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = snapshots.parse_documents(derive.trace_documents(spark, sf_dir), snapshots.TRACE)
    return probes.trace_stats(snapshots.trace_hops(reports)).select(
        F.col("host"), "hop", F.array_join("addresses", ",").alias("addresses"), "average_ms", "timeout"
    )


def certificate_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = snapshots.parse_documents(derive.tls_documents(spark, sf_dir), snapshots.TLS_REPORT)
    return snapshots.certificates(reports).select("host", "days_remaining")


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.parse_documents(derive.snapshot_documents(spark, sf_dir), snapshots.SNAPSHOT)


def snapshot_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every table in the snapshot documents."""
    documents = _snapshots(spark, sf_dir)
    tables = {
        "connections": snapshots.connections(documents), "interfaces": snapshots.interfaces(documents),
        "routes": snapshots.routes(documents), "resolvers": snapshots.resolvers(documents), "counters": snapshots.counters(documents),
    }
    counted = [
        rows.agg(F.count("*").alias("rows"), F.countDistinct("host").alias("hosts")).select(F.lit(name).alias("table_name"), "rows", "hosts")
        for name, rows in tables.items()
    ]
    result = counted[0]
    for other in counted[1:]:
        result = result.unionByName(other)
    return result


def interface_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _snapshots(spark, sf_dir)
    joined = C.interfaces_with_counters(snapshots.interfaces(documents), snapshots.counters(documents))
    return joined.select("host", "name", "is_vpn", "rx_bytes", "tx_bytes", diagnosis.is_active_interface().alias("is_active"))


def nameservers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.nameservers(snapshots.resolvers(_snapshots(spark, sf_dir)))


def vpn_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _snapshots(spark, sf_dir)
    status = diagnosis.vpn_status(snapshots.interfaces(documents), snapshots.routes(documents))
    return status.withColumn("warnings", F.size("warnings"))


def _leaks(spark: SparkSession, sf_dir: str, documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    vpn = diagnosis.vpn_status(snapshots.interfaces(documents), snapshots.routes(documents))
    servers = snapshots.nameservers(snapshots.resolvers(documents))
    dns = diagnosis.dns_routes(servers, derive.server_routes(spark, sf_dir))
    return vpn, servers, diagnosis.leak_findings(vpn, dns, derive.ipv6_routes(spark, sf_dir))


def leak_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir, _snapshots(spark, sf_dir))[2].select("host", "severity", "code", "detail")


def _diagnosis(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    facts = diagnosis.document_facts(_snapshots(spark, sf_dir))
    vpn = facts.select("host", F.col("vpn_active").alias("active"), "full_tunnel_likely")
    servers = facts.select("host", F.explode("servers").alias("server"))
    dns = diagnosis.dns_routes(servers, derive.server_routes(spark, sf_dir))
    leaks = diagnosis.leak_findings(vpn, dns, derive.ipv6_routes(spark, sf_dir))
    return facts.select("host"), diagnosis.diagnosis_findings(facts, leaks)


def host_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The diagnosis row of every host, from its flat tables."""
    documents = _snapshots(spark, sf_dir)
    interfaces, routes = snapshots.interfaces(documents), snapshots.routes(documents)
    return diagnosis.host_facts(
        documents.select("host"), snapshots.connections(documents), interfaces, routes,
        snapshots.nameservers(snapshots.resolvers(documents)), diagnosis.vpn_status(interfaces, routes),
        documents.select("host", F.to_json("proxy").alias("proxy")),
        documents.select("host", F.col("quality.score").alias("quality_score")),
    )


def diagnosis_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diagnosis(spark, sf_dir)[1].select("host", "severity", "code", "title", "detail")


def diagnosis_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnosis.diagnosis_scores(*_diagnosis(spark, sf_dir))


def _diagnoses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnosis.diagnose(snapshots.parse_documents(derive.fleet_documents(spark, sf_dir), snapshots.SNAPSHOT))


def fleet_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and summary of every snapshot of every host."""
    s = F.col("summary")
    return _diagnoses(spark, sf_dir).select(
        "host", "snapshot_no", "score", F.size("findings").alias("findings"), s["connections"].alias("connections"),
        s["remote_connections"].alias("remote_connections"), s["interfaces"].alias("interfaces"),
        F.array_join(s["active_interfaces"], ",").alias("active_interfaces"), F.array_join(s["dns_servers"], ",").alias("dns_servers"),
        s["vpn_active"].alias("vpn_active"), F.array_join(F.transform(s["default_routes"], lambda r: r["interface"]), ",").alias("default_routes"),
    )


def fleet_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings in report order, per snapshot."""
    return diagnosis.listed(_diagnoses(spark, sf_dir))


def fleet_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The route audit in report order, per snapshot."""
    return diagnosis.listed(_diagnoses(spark, sf_dir), "leaks").drop("title", "recommendation")


def _stored(spark: SparkSession, sf_dir: str, part: str, schema: str) -> DataFrame:
    path = written_folder(spark)
    documents.write_diagnoses(_diagnoses(spark, sf_dir), path)
    return snapshots.parse_documents(snapshots.read_reports(spark, f"{path}/{part}"), schema)


def stored_diagnoses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score, summary counts and number of findings of diagnoses written as reports and read back."""
    stored = _stored(spark, sf_dir, "diagnosis", snapshots.DIAGNOSIS)
    numbers = ("connections", "remote_connections", "interfaces", "vpn_active")
    return stored.select("host", "snapshot_no", "score", F.size("findings").alias("findings"), *[F.col("summary." + name).alias(name) for name in numbers])


def stored_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings of stored diagnoses in report order."""
    return snapshots.reported_findings(_stored(spark, sf_dir, "diagnosis", snapshots.DIAGNOSIS))


def stored_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings of stored leak reports in report order."""
    return snapshots.reported_findings(_stored(spark, sf_dir, "leaks", snapshots.LEAK_REPORT)).drop("title", "recommendation")


def rejected_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of which some are cut short: what is read and what is set aside, per reason."""
    documents = derive.fleet_documents(spark, sf_dir)
    cut = F.when(F.col("host").cast("int") % 9 == 0, F.substring("value", 1, 30)).otherwise(F.col("value"))
    damaged = documents.withColumn("value", cut)
    read = snapshots.parse_documents(damaged, snapshots.SNAPSHOT).select("host", F.lit("accepted").alias("outcome"))
    bad = snapshots.rejected_documents(damaged).select("host", F.col("reason").alias("outcome"))
    return read.unionByName(bad).groupBy("host", "outcome").agg(F.count("*").alias("documents"))


def probe_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of a probe with the sorted list of its addresses."""
    samples = derive.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("probe"), F.floor("o_totalprice").cast("double").alias("sample_ms"), F.concat(F.lit("10.0.0."), (F.col("o_orderkey") % 7).cast("string")).alias("address")
    )
    found = probes.sample_stats(samples, ["probe"])
    return found.join(probes.sample_addresses(samples, ["probe"]), "probe").withColumn("listed", F.array_join("listed", ","))


def live_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total rates of a host with the last 60 totals as lists."""
    rates = C.interface_rates(derive.counter_samples(spark, sf_dir))
    milli = [F.floor(F.col(name) * 1000).cast("bigint").alias(name) for name in ("rx_rate", "tx_rate")]
    found = C.live_history(rates.select("host", "name", "ts_ms", *milli))
    return found.withColumns({name: F.array_join(name, ",") for name in ("history_rx", "history_tx")})


def sanitize_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    def got(path: str) -> Column:
        return F.get_json_object("clean", path)

    clean = derive.secret_documents(spark, sf_dir).select("doc_id", sanitize_json(F.col("value")).alias("clean"))
    return clean.select(
        "doc_id", got("$.request.postData").alias("body"), got("$.request.headers.Cookie").alias("cookie"),
        got("$.request.headers.Accept").alias("accept"), got("$.request.documentURL").alias("url"),
        got("$.list[0].password").alias("password"), got("$.list[0].n").alias("n"), got("$.headersText").alias("header_text"),
    )


# --- event views and small functions ------------------------------------------------------------


def websocket_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.websocket_totals(_parsed(derive.browser_lines(spark, sf_dir)))


def performance_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.performance_metrics(_parsed(derive.browser_lines(spark, sf_dir)))


def lifecycle_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.lifecycle_events(_parsed(derive.browser_lines(spark, sf_dir)))


def session_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.session_metadata(_parsed(derive.browser_lines(spark, sf_dir)))


def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted and rejected lines of each session by reason."""
    parsed = jsonl.parse_event_lines(derive.damaged_lines(spark, sf_dir))
    return parsed.groupBy("session_id", F.coalesce("reason", F.lit("accepted")).alias("outcome")).agg(F.count("*").alias("lines"))


def dns_event_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DNS packets written as event lines and read back."""
    packet = F.struct(
        F.lit("dns_packet").alias("type"), "source", "destination", "direction", "transaction_id", "query_type", "domain"
    )
    lines = _dns(spark, sf_dir).select(F.col("capture_id").alias("session_id"), "seq", F.to_json(packet).alias("value"))
    events = jsonl.dns_events(_parsed(lines))
    return events.select("session_id", "seq", "dst_host", "dst_port", "direction", "transaction_id", "query_type", "domain")


def address_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    address = F.col("address")
    return derive.addresses(spark, sf_dir).select(
        "c_custkey", "address", A.is_private(address).alias("private"), A.is_loopback(address).alias("loopback"),
        A.is_link_local(address).alias("link_local"), A.is_multicast(address).alias("multicast"),
    )


def captured_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("Host", "Cookie", "Referer", "X-Debug", "content-type")
    pairs = [part for name in names for part in (F.lit(name), F.col("url"))]
    kept = derive.table(spark, sf_dir, "pages").select("page_id", R.captured_headers(F.create_map(*pairs)).alias("h"))
    return kept.select(
        "page_id", F.array_join(F.array_sort(F.map_keys("h")), ",").alias("names"), F.col("h").getItem("Cookie").alias("cookie"),
        F.col("h").getItem("Host").alias("host"),
    )


QUERIES = {
    **{
        function.__name__: function
        for function in (
            proxy_requests, har_entries, har_summary, har_counters, session_types, inflight_peak, network_idle, lifecycle_changes,
            live_changes, lifecycle_summary, snapshot_difference, process_rollup, socket_overview, top_processes, connection_summary,
            connection_filter, connection_listing, connection_paths, recording_summary, recording_processes, interface_rates,
            rate_history, socket_log, route_log, default_routes, counter_log, neighbour_union, quality_scores, probe_stats,
            fastest_server, trace_stats, certificate_days, snapshot_tables, interface_counters, nameservers, vpn_status, leak_findings,
            host_facts, diagnosis_findings, diagnosis_scores, fleet_diagnosis, fleet_findings, fleet_leaks, stored_diagnoses, stored_findings, stored_leaks, rejected_snapshots, probe_addresses,
            live_history, sanitize_events, websocket_totals,
            performance_metrics, lifecycle_list, session_metadata, quarantine, dns_event_view, address_classes, captured_headers,
        )
    },
    **PACKET_QUERIES,
}
