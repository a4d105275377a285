"""Recordings of one file name in different folders, fractional counts, unreadable snapshots, report order."""

import json

from pyspark.sql import functions as F

from netlens.functions.numbers import whole
from netlens.operators import correlate, diagnosis
from netlens.sources import har, jsonl, snapshots


def _line(method, **params):
    return json.dumps({"type": "cdp_event", "method": method, "params": {"requestId": "7", **params}}) + "\n"


def test_same_name_in_two_folders(spark, tmp_path):
    for host in ("a", "b c"):
        (tmp_path / host).mkdir()
        start = _line("Network.requestWillBeSent", timestamp=1.0, request={"url": f"https://{host[0]}.example/", "method": "GET"})
        (tmp_path / host / "rec.jsonl").write_text(start + _line("Network.loadingFinished", timestamp=2.0, encodedDataLength=1234.7))
    (tmp_path / "a" / "rec.har").write_text(json.dumps({"log": {"entries": []}}))
    for path in (str(tmp_path), f"{tmp_path}/*/rec.jsonl"):
        events = jsonl.read_recordings(spark, path).events.where(F.col("method") != "")
        assert {r.session_id for r in events.select("session_id").distinct().collect()} == {"a/rec", "b c/rec"}
    assert events.select("session_id", "seq").distinct().count() == events.count() == 4
    requests = correlate.correlate(events)
    assert requests.groupBy("session_id").count().where("count <> 1").count() == 0
    assert [r.reason for r in har.read_har(spark, f"{tmp_path}/a/rec.har").rejects.collect()] == []


def test_whole_part_of_numbers(spark):
    frame = spark.createDataFrame([("1234.7",), ("-2.9",), ("1e3",), ("12",), ("x",), (None,)], "v string")
    assert [r.n for r in frame.select(whole(F.col("v")).alias("n")).collect()] == [1234, -2, 1000, 12, 0, 0]


def test_unreadable_snapshots_are_kept_apart(spark):
    documents = spark.createDataFrame([("h", "{broken"), ("i", '{"timestamp": "2026-01-01T00:00:00Z"}')], "host string, value string")
    assert [(r.host, r.value) for r in snapshots.rejected_documents(documents).collect()] == [("h", "{broken")]
    assert [r.host for r in snapshots.parse_documents(documents, "timestamp string").collect()] == ["i"]


def test_large_and_odd_input_is_read(spark, tmp_path):
    text = "x" * 21_000_000
    lines = [_line("Network.a", body=text), _line("Network.b", size=float("nan")), "{broken\n"]
    (tmp_path / "rec.jsonl").write_text("".join(lines))
    found = jsonl.read_recordings(spark, str(tmp_path / "rec.jsonl"))
    assert {r.method for r in found.events.select("method").collect()} == {"Network.a", "Network.b"}
    assert [(r.line, r.reason) for r in found.rejects.select("line", "reason").collect()] == [(3, "malformed JSON")]
    entries = [{"time": i, "request": {"url": f"https://e{i}.example/", "method": "GET"}, "response": {"content": {"text": text}}} for i in range(7)]
    (tmp_path / "har").mkdir()
    whole = json.dumps({"log": {"entries": entries}})
    (tmp_path / "har" / "large.har").write_text(whole)
    (tmp_path / "har" / "cut.har").write_text(whole[:-3])
    archive = har.read_har(spark, str(tmp_path / "har"))
    got = archive.entries.select("session_id", "seq", "domain", "duration_ms").orderBy("seq").collect()
    assert [tuple(r) for r in got] == [("large", i, f"e{6 - i}.example", 6.0 - i) for i in range(7)]
    assert [tuple(r) for r in archive.rejects.collect()] == [("cut", "malformed JSON")]


def test_rule_blocks_have_their_own_ranks():
    ranks = (diagnosis.LOCAL_RANK, diagnosis.LEAK_RANK, diagnosis.PROXY_RANK, diagnosis.CLEAN_RANK, diagnosis.QUALITY_RANK)
    assert list(ranks) == sorted(set(ranks))
