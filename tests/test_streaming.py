"""Streams give what the batch operators give."""

import json
import os
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from netlens.operators import connections as C
from netlens.operators import recorder
from netlens.operators.correlate import correlate
from netlens.plans import derive
from netlens.sources import jsonl
from netlens.sources.packets import parse_dns_packets
from netlens.streaming import live, stateful
from tests.sessions import cdp, shop_events, random_events, write_jsonl


def drain(query_frame, name, mode="append"):
    query = query_frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert query.exception() is None
    return query_frame.sparkSession.table(name)


def test_lifecycle_stream_equals_batch(spark, sf_dir, tmp_path):
    keyed = C.with_key(derive.connections(spark, sf_dir))
    taken = derive.snapshots(spark, sf_dir)
    packed = (
        taken.where("host IN ('host-1', 'host-2')")
        .join(keyed.groupBy("host", "snapshot_no").agg(F.collect_set("conn_key").alias("keys")), ["host", "snapshot_no"], "left")
        .withColumn("keys", F.coalesce("keys", F.array().cast("array<string>")))
    )
    ordered = packed.orderBy("snapshot_no").collect()
    third = len(ordered) // 3
    for number, chunk in enumerate((ordered[:third], ordered[third: 2 * third], ordered[2 * third:])):
        (tmp_path / f"{number}.json").write_text("\n".join(json.dumps(row.asDict()) for row in chunk))
    stream = (
        spark.readStream.schema("host string, snapshot_no bigint, keys array<string>").option("maxFilesPerTrigger", 1).json(str(tmp_path))
    )
    got = drain(stateful.lifecycle_stream(stream, buckets=3), "lifecycle").collect()
    want = C.connection_changes(keyed, taken).where("host IN ('host-1', 'host-2')").collect()
    key = lambda row: (row.host, row.snapshot_no, row.conn_key, row.change)
    assert sorted(map(key, got)) == sorted(map(key, want)) and got


def test_lifecycle_stream_with_late_missing_repeated_and_empty_snapshots(spark, tmp_path):
    """Late and repeated snapshots are left out; a missing one widens the comparison; an empty one closes all."""
    batches = [
        [("h", 1, ["a", "b"]), ("h", 4, ["b", "c", None]), ("g", 1, [])],
        [("h", 3, ["z"]), ("h", 4, ["q"]), ("h", 6, []), ("g", 2, None)],
        [("h", 7, ["a", "a"]), ("g", 5, ["x"]), ("h", 9, ["a", "d"])],
    ]
    for number, chunk in enumerate(batches):
        lines = [json.dumps(dict(zip(("host", "snapshot_no", "keys"), row))) for row in chunk]
        (tmp_path / f"{number}.json").write_text("\n".join(lines))
        os.utime(tmp_path / f"{number}.json", (1_000_000 + number, 1_000_000 + number))
    stream = (
        spark.readStream.schema("host string, snapshot_no bigint, keys array<string>").option("maxFilesPerTrigger", 1).json(str(tmp_path))
    )
    got = {tuple(row) for row in drain(stateful.lifecycle_stream(stream, buckets=5), "odd_lifecycle").collect()}
    changes = {
        1: {"open": "ab"}, 4: {"open": "c", "close": "a"}, 6: {"close": "bc"}, 7: {"open": "a"}, 9: {"open": "d"},
    }
    want = {("h", number, name, change) for number, found in changes.items() for change, names in found.items() for name in names}
    assert got == want | {("g", 5, "x", "open")}


def test_rate_stream_equals_batch(spark, sf_dir, tmp_path):
    samples = derive.counter_samples(spark, sf_dir).orderBy("ts_ms").collect()
    half = len(samples) // 2
    for number, chunk in enumerate((samples[:half], samples[half:])):
        (tmp_path / f"{number}.json").write_text("\n".join(json.dumps(row.asDict()) for row in chunk))
    stream = (
        spark.readStream.schema("host string, name string, ts_ms bigint, rx_bytes bigint, tx_bytes bigint")
        .option("maxFilesPerTrigger", 1).json(str(tmp_path))
    )
    got = {(r.host, r.name, r.ts_ms): (r.rx_rate, r.tx_rate) for r in drain(stateful.rate_stream(stream), "rates").collect()}
    batch = C.interface_rates(derive.counter_samples(spark, sf_dir)).collect()
    assert got == {(r.host, r.name, r.ts_ms): (r.rx_rate, r.tx_rate) for r in batch}


def test_correlation_stream_equals_batch(spark, tmp_path):
    write_jsonl(tmp_path, {f"s{seed}": random_events(seed, 80) for seed in range(4)})
    events = jsonl.stream_recordings(spark, str(tmp_path), 2)
    versions = drain(stateful.correlation_stream(events), "requests")
    latest = versions.groupBy("session_id", "id", "redirect_index").agg(F.max_by(F.struct("*"), "version").alias("r")).select("r.*")
    batch = {(r.session_id, r.id, r.redirect_index): r for r in correlate(jsonl.read_recordings(spark, str(tmp_path)).events).collect()}
    rows = latest.collect()
    assert rows
    for row in rows:
        want = batch[(row.session_id, row.id, row.redirect_index)]
        names = ("url", "status", "transfer_bytes", "body_bytes", "from_cache", "failed", "failure", "redirect", "duration_ms")
        assert {n: row[n] for n in names} == {n: want[n] for n in names}
        assert json.loads(row.request_headers) == want.request_headers
        assert json.loads(row.response_headers) == want.response_headers
    ended = {key for key, r in batch.items() if r.redirect or r.failed or r.transfer_bytes}
    assert ended <= {(r.session_id, r.id, r.redirect_index) for r in rows}


def cut_stream(spark, folder, sessions, pieces):
    """Sessions whose lines arrive in ``pieces`` files, one file a micro-batch: every session is cut over all of them."""
    folder.mkdir()
    for number in range(pieces):
        rows = []
        for name, events in sessions.items():
            size = -(-len(events) // pieces)
            rows += [json.dumps({"session_id": name, "seq": i, "value": json.dumps(events[i])}) for i in range(number * size, min(len(events), (number + 1) * size))]
        (folder / f"{number}.json").write_text("\n".join(reversed(rows)))
        os.utime(folder / f"{number}.json", (1_700_000_000 + number, 1_700_000_000 + number))  # files are taken in this order
    lines = spark.readStream.schema("session_id string, seq bigint, value string").option("maxFilesPerTrigger", 1).json(str(folder))
    return jsonl.events_of(jsonl.parse_event_lines(lines))


def stamped(events, step=1):
    """The events with times that move on by ``step`` seconds."""
    start = datetime(2025, 6, 3, 8, 0, tzinfo=timezone.utc)
    return [dict(event, timestamp=(start + timedelta(seconds=step * i)).isoformat()) for i, event in enumerate(events)]


@pytest.mark.parametrize("pieces", [1, 3, 7])
def test_correlation_over_micro_batches(spark, tmp_path, pieces):
    """However the events of a request are cut over micro-batches, its last version is what the batch gives."""
    sessions = {f"s{seed}": stamped(random_events(seed, 90)) for seed in range(3)}
    versions = drain(stateful.correlation_stream(cut_stream(spark, tmp_path / "in", sessions, pieces)), f"cut{pieces}")
    latest = versions.groupBy("session_id", "id", "redirect_index").agg(F.max_by(F.struct("*"), "version").alias("r")).select("r.*").collect()
    rows = [(name, i, json.dumps(event)) for name, events in sessions.items() for i, event in enumerate(events)]
    events = jsonl.split_lines(spark.createDataFrame(rows, "session_id string, seq bigint, value string")).events
    batch = {(r.session_id, r.id, r.redirect_index): r for r in correlate(events).collect()}
    names = ("seq", "url", "status", "transfer_bytes", "body_bytes", "from_cache", "failed", "failure", "redirect", "duration_ms")
    for row in latest:
        want = batch[(row.session_id, row.id, row.redirect_index)]
        assert {n: row[n] for n in names} == {n: want[n] for n in names}
        assert (json.loads(row.request_headers), json.loads(row.response_headers)) == (want.request_headers, want.response_headers)
    assert {key for key, r in batch.items() if r.redirect or r.failed or r.transfer_bytes} <= {(r.session_id, r.id, r.redirect_index) for r in latest}


def test_unfinished_requests_leave_with_the_watermark(spark, tmp_path):
    """A request without an end is emitted once, when event time has moved on; its state goes."""
    ask = lambda rid, url: cdp("Network.requestWillBeSent", requestId=rid, timestamp=1.0, request={"url": url, "method": "GET"})
    at = lambda event, minute: dict(event, timestamp=f"2025-06-03T{8 + minute // 60:02d}:{minute % 60:02d}:00Z")
    events = [at(ask("1", "http://open.test/"), 0), at(ask("2", "http://x.test/"), 1), at(ask("3", "http://y.test/"), 40), at(ask("4", "http://z.test/"), 41)]
    found = drain(stateful.correlation_stream(cut_stream(spark, tmp_path / "in", {"s": events}, 4), "5 minutes", "1 minute"), "idle").collect()
    assert sorted((r.url, r.version, r.ended) for r in found) == [("http://open.test/", 2, False), ("http://x.test/", 2, False)]


def latest_and_batch(spark, versions, sessions):
    """The last versions of a stream and what the batch gives for the same sessions, by request."""
    latest = versions.groupBy("session_id", "id", "redirect_index").agg(F.max_by(F.struct("*"), "version").alias("r")).select("r.*").collect()
    rows = [(name, i, json.dumps(event)) for name, events in sessions.items() for i, event in enumerate(events)]
    events = jsonl.split_lines(spark.createDataFrame(rows, "session_id string, seq bigint, value string")).events
    key = lambda r: (r.session_id, r.id, r.redirect_index)
    return {key(r): r for r in latest}, {key(r): r for r in correlate(events).collect()}


def test_ids_of_a_bucket_share_one_state(spark, tmp_path):
    """However many ids a stream has, a micro-batch reads and writes a state and a timer per bucket, not per id."""
    one = lambda rid, url: [
        cdp("Network.requestWillBeSent", requestId=rid, timestamp=1.0, type="Document", request={"url": url, "method": "GET", "headers": {"b": "2", "a": None}}),
        cdp("Network.responseReceived", requestId=rid, response={"status": 200, "protocol": "h2", "headers": {"x": "tab\tline\nü"}}),
        cdp("Network.dataReceived", requestId=rid, dataLength=9_007_199_254_740_993),
        cdp("Network.loadingFinished", requestId=rid, timestamp=1.5, encodedDataLength=7),
    ]
    whole = [one(f"{n}\t\n{n}", f"http://{n}.test/") for n in range(200)]
    # The starts of all requests come first, so every one of them is open between two micro-batches.
    sessions = {f"s{s}": stamped([request[step] for step in range(4) for request in whole], 0.01) for s in range(2)}
    stream = stateful.correlation_stream(cut_stream(spark, tmp_path / "in", sessions, 4), buckets=5)
    query = stream.writeStream.format("memory").queryName("shared").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert query.exception() is None
    assert max(p.stateOperators[0].numRowsTotal for p in query.recentProgress) <= 20
    got, batch = latest_and_batch(spark, spark.table("shared"), sessions)
    assert len(got) == 400 and got.keys() == batch.keys()
    names = ("seq", "url", "method", "resource_type", "status", "protocol", "transfer_bytes", "body_bytes", "from_cache", "failed", "redirect", "duration_ms")
    for key, row in got.items():
        assert {n: row[n] for n in names} == {n: batch[key][n] for n in names}
        assert (json.loads(row.request_headers), json.loads(row.response_headers)) == (batch[key].request_headers, batch[key].response_headers)


@pytest.mark.parametrize("buckets", [1, 3])
def test_ids_of_a_bucket_end_each_at_its_time(spark, tmp_path, buckets):
    """Of the ids of one bucket, only those leave that the watermark has passed; one with a later event stays."""
    ask = lambda rid: cdp("Network.requestWillBeSent", requestId=rid, timestamp=1.0, request={"url": f"http://{rid}.test/", "method": "GET"})
    done = lambda rid: cdp("Network.loadingFinished", requestId=rid, timestamp=2.0, encodedDataLength=3)
    at = lambda event, minute: dict(event, timestamp=f"2025-06-03T{8 + minute // 60:02d}:{minute % 60:02d}:00Z")
    batches = [
        [at(ask("a"), 0), at(ask("b"), 1), at(ask("c"), 2)],
        [at(ask("d"), 6), at(cdp("Network.dataReceived", requestId="b", dataLength=4), 6), at(done("c"), 6)],
        [at(ask("e"), 9), at(ask("f"), 12), at(cdp("Network.dataReceived", requestId="f", dataLength=1), 12)],
        [at(done("e"), 13), at(ask("g"), 13), at(ask("h"), 13)],
    ]
    stream = stateful.correlation_stream(cut_stream(spark, tmp_path / "in", {"s": sum(batches, [])}, 4), "5 minutes", "1 minute", buckets)
    found = drain(stream, f"leave{buckets}").collect()
    shown = sorted((r.id, r.version, r.ended, r.body_bytes) for r in found)
    # At the end the watermark stands at 12 minutes: a, b and d (last seen at 0, 6 and 6) are past it by 5 minutes, c and e had ended.
    assert shown == [("a", 2, False, 0), ("b", 3, False, 4), ("c", 2, True, 0), ("d", 2, False, 0), ("e", 2, True, 0)]


def test_live_counters_and_append(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    write_jsonl(source, {"a": shop_events(), "p": [{"type": "proxy_request", "target": "http://x/"}]})
    events = jsonl.stream_recordings(spark, str(source))
    counted = drain(live.live_counters(events), "counters", "complete").collect()
    batch = recorder.recorder_counters(jsonl.read_recordings(spark, str(source)).events).collect()
    key = lambda r: (r.session_id, r.dimension, r.value, r["count"])
    assert sorted(map(key, counted)) == sorted(map(key, batch))
    totals = drain(live.live_totals(events), "totals", "complete").collect()
    assert [(r.network_failures, r.http_errors, r.encoded_bytes) for r in totals] == [(1, 0, 2_401_600)]
    for target, start in (("all", live.append_events), ("proxy", live.append_proxy_events)):
        start(events, str(out / target), str(tmp_path / ("cp" + target))).awaitTermination(120)
    assert spark.read.text(str(out / "all")).count() == 25
    assert json.loads(spark.read.text(str(out / "proxy")).first().value)["target"] == "http://x/"


def test_quiet_gaps_and_dns_watch(spark, tmp_path):
    def at(second):
        event = cdp("Network.requestWillBeSent", requestId="1", request={"url": "http://x/"})
        return dict(event, timestamp=f"2026-01-01T00:{second // 60:02d}:{second % 60:02d}Z")

    write_jsonl(tmp_path, {"s": [at(0), at(2), at(4), at(20), at(3000)]})
    gaps = drain(live.quiet_gaps(jsonl.stream_recordings(spark, str(tmp_path)), "3 seconds", "1 minute"), "gaps").collect()
    assert [(r.events, r.idle_at.second) for r in sorted(gaps, key=lambda r: r.active_from)][:2] == [(3, 7), (1, 23)]
    logs = tmp_path / "dns"
    logs.mkdir()
    (logs / "c.txt").write_text("x IP 10.0.0.1.5 > 1.1.1.1.53: 12+ A? a.com. (9)\nx IP 10.0.0.1.5 > 1.1.1.1.53: 13+ AAAA? a.com. (9)\n")
    lines = spark.readStream.text(str(logs)).select(F.lit("c").alias("capture_id"), F.lit(0).alias("seq"), "value")
    watched = drain(live.dns_watch(parse_dns_packets(lines)), "dns", "complete").collect()
    assert [(r.domain, r.server, r.queries) for r in watched] == [("a.com", "1.1.1.1", 2)]
