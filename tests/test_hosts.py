"""Host text logs, packet lines, sockets and snapshots on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from netlens.operators import connections as C
from netlens.operators import diagnosis, normalize, packets, probes, scores
from netlens.sources import hostlogs, jsonl, snapshots
from netlens.sources import packets as packet_source
from tests.sessions import shop_events, lines


def listing(spark, text, host="h"):
    rows = [(host, 0, number, line) for number, line in enumerate(text.splitlines())]
    return spark.createDataFrame(rows, "host string, snapshot_no bigint, pos bigint, value string")


def test_sockets(spark, tmp_path):
    text = (
        "COMMAND PID USER FD TYPE DEVICE SIZE/OFF NODE NAME\n"
        "Mail\\x20Agent 911 ann 23u IPv6 0xab 0t0 TCP [2001:db8::5]:61234->[2a00:1450::99]:993 (CLOSE_WAIT)\n"
        "queued 77 root 8u IPv4 0xac 0t0 udp *:5353\n"
        "web 5120 www 4u IPv4 0xad 0t0 TCP 127.0.0.1:3000 (LISTEN)\n\nbad x me 5u IPv6 0x2 0t0 TCP a\nshort 1 2\n"
    )
    rows = hostlogs.parse_sockets(listing(spark, text))
    mail, queued, web = rows.orderBy("pos").collect()
    assert (mail.process, mail.pid, mail.state, mail.remote.host, mail.remote.port) == ("Mail Agent", 911, "CLOSE_WAIT", "2a00:1450::99", "993")
    assert (queued.protocol, queued.local.host, queued.local.port, queued.remote, queued.state) == ("UDP", "*", "5353", None, "")
    assert (web.remote, web.local.host, web.local.port, web.protocol) == (None, "127.0.0.1", "3000", "TCP")
    routes = spark.createDataFrame([("h", "default", "wg0"), ("h", "default", "en7")], "host string, destination string, interface string")
    placed = {r.process: r.path for r in C.with_paths(rows, routes).collect()}
    assert placed["web"] == "loopback" and placed["Mail Agent"] == "vpn-default"
    (tmp_path / "mac-1.7.txt").write_text(text)
    read = hostlogs.read_listing(spark, str(tmp_path))
    assert {(r.host, r.snapshot_no) for r in read.collect()} == {("mac-1", 7)}
    assert hostlogs.parse_sockets(read).count() == 3
    assert C.process_rollup(rows).where("pid = 911").first().asDict() == dict(
        host="h", process="Mail Agent", pid=911, total=1, remote=1, tcp=1, udp=0, listen=0, targets=1)


def test_routes_counters_neighbours(spark):
    routes = hostlogs.parse_routes(listing(spark, (
        "Routing tables\n\nInternet:\nDestination        Gateway            Flags               Netif Expire\n"
        "default            172.20.10.254      UGSc                  en7\n10.99/16           10.99.0.2          UGSc   utun3  !\n"
        "203.0.113.8        8:0:27:1:2:3       UHLWIir               en7   1187\nx y z\n"
    ))).orderBy("pos").collect()
    assert [(r.destination, r.interface, r.expire) for r in routes] == [("default", "en7", ""), ("10.99/16", "utun3", "!"), ("203.0.113.8", "en7", "1187")]
    counters = C.deduplicate_counters(hostlogs.parse_counters(listing(spark, (
        "en7 1 2 3 4 5 6 7 8 9 10 11\nName Mtu Network Address Ipkts Ierrs Ibytes Opkts Oerrs Obytes Coll Drop\n"
        "utun3 1380 <Link#9> - 7 0 512 9 0 640 0 0\nen7 1500 <Link#6> 08:00:27:aa:00:01 300 2 45000 280 1 39000 0 4\n"
        "en7 1500 172.20.10/28 172.20.10.3 299 2 44990 280 1 39000 - -\nlo0 1 2\n"
    )))).orderBy("name").collect()
    assert [(r.name, r.rx_bytes, r.tx_packets, r.drops) for r in counters] == [("en7", 45000, 280, 4), ("utun3", 512, 9, 0)]
    arp = "gw.test (172.20.10.254) at 8:0:27:1:2:3 on en7 permanent [ethernet]\n? (239.255.255.250) at 1:0 on en7\n? (172.20.10.9) at (incomplete) on en7\n"
    ndp = "2001:db8::7 x en7\nNeighbor Linklayer Address Netif Expire St\n2001:db8::7 08:00:27:0a:0b:0c en7 12m R\nff02::2%en7 a en7\n"
    kept = hostlogs.neighbours(listing(spark, arp), listing(spark, ndp)).collect()
    assert [(r.family, r.address, r.state) for r in sorted(kept, key=lambda r: r.family)] == [
        ("IPv4", "172.20.10.254", "permanent [ethernet]"), ("IPv6", "2001:db8::7", "12m R")]
    assert hostlogs.neighbours(listing(spark, arp), listing(spark, ndp), show_all=True).count() == 5


PACKET_LINES = [
    "2026-01-01 IP 10.0.0.1.50000 > 1.1.1.1.443: Flags [S], length 0",
    "2026-01-01 12:00:00.123456 IP 10.0.0.1.50000 > 1.1.1.1.443: UDP, length 33",
    "12:00:00.1 IP6 fe80::1.5353 > ff02::fb.5353: 0 PTR (QM)? x. (40)",
    "12:00:00.1 IP 10.0.0.1 > 10.0.0.2: ICMP echo request, id 1, length 64",
    "12:00:00.1 ARP, Request who-has 10.0.0.2 tell 10.0.0.1, length 28",
    "   ",
    "garbage",
]


def capture(spark, texts):
    return spark.createDataFrame([("c", n, t) for n, t in enumerate(texts)], "capture_id string, seq bigint, value string")


def test_packet_lines(spark):
    rows = packet_source.parse_packets(capture(spark, PACKET_LINES)).orderBy("seq").collect()
    assert [r.protocol for r in rows] == ["tcp", "udp", "ipv6", "icmp", "arp", "other"]
    assert [r.length for r in rows] == [0, 33, 0, 64, 28, 0]
    assert [(r.source.host, r.source.port, r.destination.host, r.destination.port) for r in rows[:3]] == [
        ("10.0.0.1", "50000", "1.1.1.1", "443")] * 2 + [("fe80::1", "5353", "ff02::fb", "5353")]
    assert all(r.source is None for r in rows[3:])
    plain = packet_source.parse_packets(capture(spark, PACKET_LINES), compat=True).orderBy("seq").collect()
    assert (plain[0].source.host, plain[0].destination.port) == ("10.0.0.1", "443")
    assert plain[1].source.host == "12:00:00"  # the time of day, as the plain pattern reads it


def test_packet_rollups(spark):
    rows = packet_source.parse_packets(capture(spark, PACKET_LINES))
    assert packets.packet_totals(rows).first().asDict() == dict(capture_id="c", packets=6, payload_bytes=125, limited=False)
    assert packets.packet_totals(packets.limit_packets(rows, 2), 2).first().limited
    ends = packets.top_endpoints(rows).orderBy("rank").collect()
    assert [(r.host, r["count"]) for r in ends] == [("10.0.0.1", 2), ("1.1.1.1", 2), ("fe80::1", 1), ("ff02::fb", 1)]
    assert [(r.port, r["count"]) for r in packets.top_ports(rows).orderBy("rank").collect()] == [("50000", 2), ("443", 2), ("5353", 2)]
    assert packets.top_conversations(rows).orderBy("rank").first().conversation == "1.1.1.1:443 ↔ 10.0.0.1:50000"
    assert [r.seq for r in packets.packet_samples(rows, 2).orderBy("rank").collect()] == [0, 1]


def test_dns_lines(spark):
    texts = [
        "2026-01-01 IP 192.168.1.2.50000 > 1.1.1.1.53: 1234+ A? example.com. (29)",
        "12:00:00.5 IP 192.168.1.2.50000 > 1.1.1.1.53: 7+ [1au] AAAA? www.example.com. (40)",
        "12:00:00.5 IP 1.1.1.1.53 > 192.168.1.2.50000: 7 1/0/1 AAAA 2606::1 (60)",
        "12:00:00.5 IP 1.1.1.1.53 > 192.168.1.2.50000: 8 NXDomain 0/1/0 (60)",
        "IP 192.168.1.2.50000 > 1.1.1.1.53: junk", "no arrow .53:", "IP 1.2.3.4.5 > 6.7.8.9.443: Flags [S], length 0",
    ]
    rows = packet_source.parse_dns_packets(capture(spark, texts))
    got = [(r.direction, r.transaction_id, r.query_type, r.domain) for r in rows.orderBy("seq").collect()]
    assert got == [("query", 1234, "A", "example.com"), ("query", 7, "AAAA", "www.example.com"), ("response", 7, None, None),
                   ("response", 8, None, None), ("unknown", None, None, None)]
    assert packets.dns_totals(rows).first().asDict() == dict(capture_id="c", queries=2, responses=2)
    assert [(r.server, r["count"]) for r in packets.dns_servers(rows).collect()] == [("1.1.1.1", 2)]
    plain = packet_source.parse_dns_packets(capture(spark, texts), compat=True)
    assert packets.dns_totals(plain).first().responses == 0


def test_event_views(spark):
    events = jsonl.split_lines(lines(spark, {
        "dns": [{"type": "dns_packet", "source": {"host": "a", "port": 5}, "direction": "query", "transaction_id": 9, "domain": "x"}],
        "conn": [{"type": "connection_open", "connection": {"process": "p", "pid": 1, "local": {"host": "h", "port": "1"}, "remote": None}},
                 {"type": "connection_close", "connection": {"process": "q"}}, {"type": "connection_open"}],
        "web": shop_events(),
        "proxy": [{"type": "proxy_request", "method": "CONNECT", "target": "example.com:443", "mode": "tls_tunnel", "host": "example.com", "port": 443,
                   "ok": True, "upload_bytes": 5, "download_bytes": 7, "duration_ms": 12.5, "ttfb_ms": 3},
                  {"type": "proxy_request", "method": "GET", "target": "http://a.b/c?d", "ok": False, "error": "boom", "headers": {"X": "1"},
                   "response": {"status": 200, "http_version": "HTTP/1.0", "reason": "OK", "headers": {"Content-Type": "text/html; x"}}}],
    })).events
    assert {r.session_id: r.source_type for r in jsonl.session_types(events).collect()} == {
        "dns": "dns-jsonl", "conn": "connection-jsonl", "web": "chrome-cdp", "proxy": "proxy-jsonl"}
    dns = jsonl.dns_events(events).first()
    assert (dns.src_host, dns.src_port, dns.direction, dns.transaction_id, dns.domain) == ("a", 5, "query", 9, "x")
    sockets = jsonl.connection_events(events)
    assert C.recording_summary(sockets).first().asDict() == dict(session_id="conn", events=3, opened=2, closed=1, processes=3)
    assert jsonl.cdp_events(events).where("request_id = 'page'").count() == 6
    tunnel, plain = normalize.normalize(normalize.proxy_requests(jsonl.proxy_events(events))).orderBy("seq").collect()
    assert (tunnel.id, tunnel.scheme, tunnel.path, tunnel.resource_type, tunnel.transfer_bytes, tunnel.body_bytes, tunnel.failed) == (
        "proxy-0", "https", "443", "tunnel", 12, 7, False)
    assert (plain.id, plain.domain, plain.mime_type, plain.protocol, plain.failed, plain.failure, plain.third_party) == (
        "proxy-1", "a.b", "text/html", "HTTP/1.0", True, "boom", True)
    assert tunnel.timing.ttfb_ms == 3.0 and plain.request_headers == {"X": "1"}


def test_lifecycle_brute_force(spark):
    import random

    rng = random.Random(5)
    taken = {host: sorted(rng.sample(range(40), 12)) for host in "ab"}
    held = {(host, no): {f"k{n}" for n in range(6) if rng.random() < 0.5} if no % 5 else set() for host in taken for no in taken[host]}
    snapshots_df = spark.createDataFrame(list(held), "host string, snapshot_no bigint")
    rows = [(host, no, key) for (host, no), keys in held.items() for key in keys]
    sockets = spark.createDataFrame(rows, "host string, snapshot_no bigint, conn_key string")
    for initial in (True, False):
        want = set()
        for host, numbers in taken.items():
            previous = set()
            for place, number in enumerate(numbers):
                now = held[host, number]
                if place or initial:
                    want |= {(host, number, key, "open") for key in now - previous}
                want |= {(host, number, key, "close") for key in previous - now}
                previous = now
        got = C.connection_changes(sockets, snapshots_df, initial)
        assert {tuple(r) for r in got.collect()} == want
    changes = C.connection_changes(sockets, snapshots_df)
    summary = {r.host: r for r in C.record_summary(changes, sockets, snapshots_df).collect()}
    assert summary["a"].snapshots == 12 and summary["a"].active_at_end == len(held["a", taken["a"][-1]])


def test_snapshot_documents(spark, tmp_path):
    document = {
        "timestamp": "2026-01-01T00:00:00.500+00:00", "version": "x",
        "connections": [{"process": "p", "pid": 1, "user": "u", "fd": "3", "family": "IPv4", "protocol": "TCP",
                         "local": {"host": "*", "port": "80"}, "remote": None, "state": "LISTEN", "path": "direct"}],
        "interfaces": [{"name": "en0", "flags": ["UP"], "mtu": 1500, "ipv4": ["10.0.0.1"], "ipv6": [], "status": "unknown"},
                       {"name": "UTUN2", "flags": [], "mtu": None, "ipv4": [], "ipv6": [], "status": "inactive"}],
        "routes": [{"destination": "default", "gateway": "g", "flags": "f", "interface": "en0", "expire": ""}],
        "dns": [{"id": 1, "nameservers": ["1.1.1.1", "8.8.8.8"]}, {"id": 2, "nameservers": ["1.1.1.1"]}],
        "interface_counters": {"en0": {"rx_bytes": 5, "tx_bytes": 6}}, "proxy": {"HTTPEnable": 1},
    }
    (tmp_path / "mac.json").write_text(json.dumps(document))
    parsed = snapshots.parse_documents(snapshots.read_documents(spark, str(tmp_path)), snapshots.SNAPSHOT)
    assert parsed.first().snapshot_no == 1767225600500
    faces = C.interfaces_with_counters(snapshots.interfaces(parsed), snapshots.counters(parsed))
    got = {r.name: (r.is_vpn, r.rx_bytes, r.active) for r in faces.withColumn("active", diagnosis.is_active_interface()).collect()}
    assert got == {"en0": (False, 5, True), "UTUN2": (True, None, False)}
    assert sorted(r.server for r in snapshots.nameservers(snapshots.resolvers(parsed)).collect()) == ["1.1.1.1", "8.8.8.8"]
    assert snapshots.connections(parsed).where(diagnosis.is_public_listener()).count() == 1


@pytest.mark.parametrize("ping,dns,tls,http,score", [
    ((True, 0.0, 20.0, 3.0), (True, 20.0), True, True, 100), ((False, 100.0, None, None), (False, None), False, False, 5),
    ((True, 4.0, 130.0, 25.0), (True, 61.0), True, True, 71), ((True, 90.0, 900.0, 99.0), (True, 151.0), False, True, 10),
])
def test_quality_score(spark, ping, dns, tls, http, score):
    rows = [("r", "ping", ping[0], None, *ping[1:]), ("r", "dns", *dns, None, None, None), ("r", "tls", tls, None, None, None, None),
            ("r", "http", http, None, None, None, None)]
    frame = spark.createDataFrame(rows, "run_id string, kind string, ok boolean, duration_ms double, packet_loss_percent double, avg_ms double, jitter_ms double")
    assert scores.quality_scores(frame).first().score == score


def test_probe_statistics(spark):
    samples = spark.createDataFrame([("a", 1.0, "x"), ("a", 2.005, "y"), ("a", 4.0, "x")], "k string, sample_ms double, address string")
    assert probes.sample_stats(samples, ["k"]).first()[1:] == (3, 1.0, round((1.0 + 2.005 + 4.0) / 3, 2), 4.0, 2)
    hops = spark.createDataFrame([(1, ["a", "b", "a"], [1.0, 2.0], "x"), (2, [], [], "* * *")],
                                 "hop int, addresses array<string>, samples_ms array<double>, raw string")
    first, second = probes.trace_stats(hops).orderBy("hop").collect()
    assert (first.addresses, first.average_ms, first.timeout) == (["a", "b"], 1.5, False)
    assert (second.average_ms, second.timeout) == (None, True)
    results = spark.createDataFrame(
        [("d", 0, "s0", True, 5.0, ["a"]), ("d", 1, "s1", True, 5.0, ["b"]), ("d", 2, "s2", False, 1.0, ["c"]), ("e", 0, "s0", False, 1.0, [])],
        "k string, pos int, server string, ok boolean, duration_ms double, answers array<string>")
    got = {r.k: (r.fastest, r.answers_differ) for r in probes.dns_comparison(results, ["k"]).collect()}
    assert got == {"d": ("s0", True), "e": (None, False)}


def test_every_snapshot_has_its_own_diagnosis(spark):
    """Two snapshots of a host, empty documents and null tables; order, score and summary of each."""
    up = {"name": "en0", "flags": ["UP"], "ipv4": ["10.1.1.1"], "status": "unknown"}
    tunnel = {"name": "utun4", "flags": ["UP"], "ipv4": ["10.9.0.2"], "status": "active"}
    default = lambda interface: {"destination": "default", "gateway": "10.1.1.254", "interface": interface}
    well = {"timestamp": "2025-06-03T08:00:00Z", "interfaces": [up], "routes": [default("en0")], "dns": [{"id": 1, "nameservers": ["9.9.9.9", "1.1.1.1", "9.9.9.9"]}]}
    leaky = {
        "timestamp": "2025-06-03T09:00:00Z", "interfaces": [up, tunnel], "routes": [default("utun4"), default("en0")],
        "dns": [{"id": 1, "nameservers": ["9.9.9.9", "192.168.4.1"]}, {"id": 2, "nameservers": None}],
        "dns_routes": [{"server": "192.168.4.1", "interface": "en0"}, {"server": "9.9.9.9", "interface": "en0"}, {"server": "8.8.8.8", "interface": "en0"}, {"server": "9.9.9.9", "interface": None}],
        "ipv6_routes": [{"destination": "::/0", "interface": "en0"}, {"destination": "fe80::/64", "interface": "en0"}, {"destination": "default", "interface": ""}],
        "connections": [{"process": "srv", "state": "LISTEN", "local": {"host": "::", "port": "22"}}], "proxy": {"HTTPEnable": "1"}, "quality": {"score": 60},
    }
    nameless = {"timestamp": "2025-06-03T08:00:00Z", "interfaces": [up], "dns": [{"id": 1, "nameservers": []}], "quality": {"score": 10}}
    rows = [("h", json.dumps(well)), ("h", json.dumps(leaky)), ("bare", "{}"), ("named", json.dumps(nameless)), ("broken", "{")]
    documents = snapshots.parse_documents(spark.createDataFrame(rows, "host string, value string"), snapshots.SNAPSHOT)
    found = {(r.host, r.snapshot_no): r for r in diagnosis.diagnose(documents).collect()}
    codes = {key: [f.code for f in r.findings] for key, r in found.items()}
    nine = 1748941200000
    assert codes[("h", nine - 3_600_000)] == ["baseline-clean"] and found[("h", nine - 3_600_000)].score == 100
    assert codes[("h", nine)] == [
        "multiple-default-routes", "public-listeners", "dns-outside-vpn", "dns-outside-vpn", "ipv6-outside-vpn", "system-proxy", "quality-degraded"]
    assert [f.severity for f in found[("h", nine)].findings][2:5] == ["warning", "critical", "warning"]
    assert found[("h", nine)].score == 100 - 12 - 12 - 30 - 12 - 12
    assert codes[("bare", 0)] == ["no-active-interface", "no-dns"] and codes[("named", nine - 3_600_000)] == ["baseline-clean", "quality-poor"]
    summary = found[("h", nine)].summary
    assert (summary.active_interfaces, summary.dns_servers, summary.vpn_active) == (["en0", "utun4"], ["192.168.4.1", "9.9.9.9"], True)
    assert [r.interface for r in summary.default_routes] == ["utun4", "en0"]
    leaks = {(r.host, r.position, r.code) for r in diagnosis.listed(diagnosis.diagnose(documents), "leaks").collect() if r.host in ("bare", "h")}
    assert ("bare", 1, "vpn-not-active") in leaks and ("h", 3, "ipv6-outside-vpn") in leaks
    scores_ = diagnosis.diagnose(documents)
    assert "Exchange" not in scores_._jdf.queryExecution().executedPlan().toString()


def test_live_history_lists(spark):
    """Lists of at most three totals, over a block border, without a host's first sample."""
    rates = spark.createDataFrame([("h", name, 1000 * n, float(n), 1.0) for n in range(8) for name in ("a", "b")] + [("one", "a", 5, 1.0, 1.0)],
                                  "host string, name string, ts_ms bigint, rx_rate double, tx_rate double")
    found = C.live_history(rates, 3).orderBy("ts_ms").collect()
    assert [(r.ts_ms, r.history_rx) for r in found] == [(1000 * n, [2.0 * m for m in range(max(1, n - 2), n + 1)]) for n in range(1, 8)]


def test_limited_capture(spark):
    rows = packet_source.parse_packets(capture(spark, PACKET_LINES))
    kept = packets.limit_packets(rows, 3)
    assert [r.seq for r in kept.orderBy("seq").collect()] == [0, 1, 2]
    assert packets.packet_totals(kept, 3).first().asDict() == dict(capture_id="c", packets=3, payload_bytes=33, limited=True)
    assert not packets.packet_totals(packets.limit_packets(rows, 50), 50).first().limited
    assert probes.sample_addresses(spark.createDataFrame([("p", "b"), ("p", "a"), ("p", "b"), ("p", None)], "probe string, address string"), ["probe"]).first().listed == ["a", "b"]
