import pytest
from pyspark.sql import functions as F

from netlens.operators import findings, normalize, scores, summary
from netlens.operators.correlate import correlate
from netlens.sources import jsonl
from tests.sessions import expected_requests, shop_events, lines, random_events, write_jsonl


@pytest.fixture(scope="module")
def shop(spark):
    events = jsonl.split_lines(lines(spark, {"s": shop_events()})).events.cache()
    return events, normalize.normalize(correlate(events)).cache()


def test_shop_requests(shop):
    hop, page, style, hero, beacon = shop[1].orderBy("seq").collect()
    assert (hop.url, hop.status, hop.redirect, hop.duration_ms, hop.protocol, hop.redirect_index) == ("http://shop.test/", 301, True, 40.0, "http/1.1", 0)
    assert (page.duration_ms, page.redirect_index, page.compression_ratio, page.mime_type) == (300.0, 1, 2.5, "text/html")
    timing = page.timing
    assert (timing.dns_ms, timing.connect_ms, timing.ssl_ms, timing.send_ms, timing.ttfb_ms) == (12.5, 25.5, 19.0, 0.5, 90.0)
    assert (page.remote_ip, page.remote_port, page.tls_protocol, page.initiator_type) == ("198.51.100.7", "8443", "TLS 1.2", "parser")
    assert page.started_at == "2025-06-03T08:15:00.040+00:00" and page.offset_ms == 40.0
    assert (style.from_cache, style.third_party, style.tracker, style.query_keys, style.duration_ms) == (True, True, False, ["v"], 10.0)
    assert (hero.offset_ms, hero.duration_ms, hero.transfer_bytes, hero.third_party) == (320.0, 2000.0, 2_400_000, False)
    assert (beacon.failed, beacon.failure, beacon.status, beacon.method, beacon.tracker) == (True, "net::ERR_BLOCKED_BY_CLIENT", 0, "POST", True)


def test_shop_summary_scores_findings(shop):
    _, requests = shop
    profile = summary.session_profile(requests).cache()
    row = profile.first().asDict()
    expected = dict(
        requests=5, domains=3, transfer_bytes=2_401_600, body_bytes=4000, page_span_ms=2320.0, failed=1, http_errors=0, cached=1,
        cache_percent=20.0, third_party=2, third_party_percent=40.0, trackers=1, duplicate_requests=0, redirects=1, slow_requests=1,
        large_requests=1,
    )
    assert {name: row[name] for name in expected} == expected
    score = scores.session_scores(profile).first()  # lost: 16 + 5 for one slow and large of five, 8 failed, 7 + 10 tracked and foreign, 15 plain
    assert score.asDict() == dict(session_id="s", overall=85, performance=79, reliability=92, privacy=83, security=85)
    found = findings.session_findings(requests, profile).orderBy(*findings.finding_order()).collect()
    assert [(f.severity, f.code, f.evidence) for f in found] == [
        ("critical", "unencrypted-http", []), ("warning", "large-resources", ["2400000 bytes https://shop.test/hero.png"]),
        ("warning", "slow-requests", ["2000.0ms https://shop.test/hero.png"]),
        ("warning", "request-errors", ["https://stats.doubleclick.net/beacon"]), ("info", "tracking-requests", ["stats.doubleclick.net"]),
    ]
    assert found[0].title == "1 unencrypted HTTP requests"


def test_shop_browser_facts(shop):
    events, _ = shop
    ws = summary.websocket_totals(events).first()
    assert (ws.opened, ws.closed, ws.sent_frames, ws.sent_bytes, ws.received_frames) == (1, 1, 2, 11, 1)
    metrics = summary.performance_metrics(events).collect()
    assert [(m.name, m.value) for m in metrics] == [("LayoutCount", 7.0)]
    assert [r.method for r in summary.lifecycle_events(events).collect()] == ["Page.lifecycleEvent"]
    meta = summary.session_metadata(events).first()
    assert meta.recorder_summary == '{"note":"done","requests":5}' and "test_browser" in meta.source_metadata
    assert jsonl.session_types(events).first().source_type == "chrome-cdp"


@pytest.mark.parametrize("bits", [20, 3])
def test_random_sequences_match_sequential_model(spark, bits):
    sessions = {f"s{seed}": random_events(seed) for seed in range(6)}
    events = jsonl.split_lines(lines(spark, sessions)).events
    got = correlate(events, bits=bits).orderBy("session_id", "seq").collect()
    want = [dict(row, session=name) for name in sorted(sessions) for row in expected_requests(sessions[name])]
    assert len(got) == len(want)
    for row, hop in zip(got, want):
        actual = dict(
            session=row.session_id, seq=row.seq, id=row.id, index=row.redirect_index, url=row.url,
            start=row.started_monotonic, ask=row.request_headers, answer=row.response_headers, status=row.status,
            ms=row.duration_ms, body=row.body_bytes, sent=row.transfer_bytes, cache=row.from_cache, failed=row.failed,
            failure=row.failure, canceled=row.canceled, redirect=row.redirect, cookies=row.associated_cookies,
        )
        assert abs((actual.pop("ms") or 0) - (hop["ms"] or 0)) <= 0.01
        assert actual == {name: value for name, value in hop.items() if name != "ms"}


def test_recording_files(spark, tmp_path):
    write_jsonl(tmp_path, {"one": shop_events()[:3] + ["", "{broken", "[1]", "  "] + shop_events()[3:] + ["7"],
                           "two two": [{"type": "proxy_request"}], "three": [{"type": "note"}]})
    recording = jsonl.read_recordings(spark, str(tmp_path))
    rejects = recording.rejects.orderBy("line").collect()
    assert [(r.session_id, r.line, r.reason) for r in rejects] == [
        ("one", 5, "malformed JSON"), ("one", 6, "expected an object"), ("one", 29, "expected an object"),
    ]
    types = {r.session_id: r.source_type for r in jsonl.session_types(recording.events).collect()}
    assert types == {"one": "chrome-cdp", "two two": "proxy-jsonl", "three": "unsupported"}
    assert correlate(recording.events).count() == 5


def test_line_numbers_over_several_splits(spark, tmp_path):
    rows = ["{bad" if n % 997 == 0 else '{"type":"note","n":%d}' % n for n in range(1, 5001)]
    write_jsonl(tmp_path, {"big": rows})
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        recording = jsonl.read_recordings(spark, str(tmp_path))
        assert recording.events.rdd.getNumPartitions() > 3
        assert sorted(r.line for r in recording.rejects.collect()) == [997, 1994, 2991, 3988, 4985]
        ordered = recording.events.orderBy("seq").select(F.try_variant_get("body", "$.n", "int").alias("n"))
        assert [r.n for r in ordered.collect()] == [n for n in range(1, 5001) if n % 997]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
