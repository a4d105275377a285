import csv
import json

import pytest
from pyspark.sql import functions as F

from netlens.operators import normalize, recorder, scores, summary
from netlens.operators.correlate import correlate
from netlens.operators import compare, diagnosis, views
from netlens.sinks import documents as D
from netlens.sources import har, jsonl, snapshots
from netlens.operators.sanitize import sanitize_events, sanitized
from tests.sessions import cdp, shop_events, lines


@pytest.fixture(scope="module")
def requests(spark):
    events = jsonl.split_lines(lines(spark, {"s": shop_events()})).events
    return normalize.normalize(correlate(events)).cache()


def read_text(path):
    return "".join(p.read_text(encoding="utf-8") for p in sorted(path.glob("*.txt")))


def test_csv(spark, requests, tmp_path):
    D.write_csv(requests, str(tmp_path / "csv"))
    rows = [row for path in (tmp_path / "csv").glob("*.csv") for row in csv.DictReader(path.open(encoding="utf-8"))]
    assert list(rows[0]) == ["session_id", "seq", *D.CSV_COLUMNS] and len(rows) == 5
    beacon = next(row for row in rows if "doubleclick" in row["url"])
    assert (beacon["third_party"], beacon["failed"], beacon["duration_ms"], beacon["status"]) == ("True", "True", "400.0", "0")
    one = D.session_csv(spark, str(tmp_path / "csv"), "s")
    assert one.columns == list(D.CSV_COLUMNS) and [r.status for r in one.collect()] == ["301", "200", "200", "200", "0"]
    assert D.session_csv(spark, str(tmp_path / "csv"), "nobody").count() == 0


@pytest.fixture(scope="module")
def many(spark, requests):
    """Four more sessions: copies of the shop session, one of them long."""
    from pyspark.sql import functions as F

    copies = requests.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(400))))
    long_ = copies.withColumns({"session_id": F.lit("long"), "seq": F.col("seq") + F.col("copy") * (1 << 16)})
    small = copies.where("copy < 3").withColumn("session_id", F.concat(F.lit("s/ü "), "copy"))
    return requests.unionByName(long_.drop("copy")).unionByName(small.drop("copy")).cache()


def test_clusters_and_manifest(spark, many, tmp_path):
    """A long session lies in several files, small ones share theirs; the manifest finds every row."""
    path = str(tmp_path / "lines")
    D.write_lines(many.select("session_id", "seq", "url"), path, max_rows_per_file=300)
    manifest = D.read_manifest(spark, path)
    totals = {r.session_id: r.n for r in manifest.groupBy("session_id").agg({"rows": "sum"}).withColumnRenamed("sum(rows)", "n").collect()}
    assert totals == {r.session_id: r["count"] for r in many.groupBy("session_id").count().collect()}
    assert len(D.session_files(spark, path, "long")) > 3 and len(D.session_files(spark, path, "s/ü 1")) == 1
    for file in (tmp_path / "lines").glob("*.json"):
        keys = [(row["session_id"], row["seq"]) for row in map(json.loads, file.read_text(encoding="utf-8").splitlines())]
        assert keys == sorted(keys) and len(keys) <= 300


@pytest.mark.parametrize("session", ["s", "long", "s/ü 2"])
def test_report_documents(spark, many, tmp_path, session):
    D.write_report(many, str(tmp_path / "report"))
    D.write_document(D.report_lines(spark, str(tmp_path / "report"), session), str(tmp_path / "one"))
    head = json.loads(read_text(tmp_path / "one"))
    times = 401 if session == "long" else 1
    assert head["schema_version"] == 2 and head["session_id"] == session and head["summary"]["requests"] == 5 * times
    if times == 1:
        assert head["scores"]["overall"] == 85
        assert [item["code"] for item in head["findings"]][:2] == ["unencrypted-http", "large-resources"]
    assert [item["id"] for item in head["requests"]] == ["page", "page", "style", "hero", "beacon"] * times
    assert head["requests"][0]["initiator"] == {"type": "parser"}
    assert list(head["aggregates"]["domains"]) == ["shop.test", "stats.doubleclick.net", "cdn.other.test"][:1] + sorted(["stats.doubleclick.net", "cdn.other.test"])
    assert head["aggregates"]["domains"]["shop.test"]["requests"] == 3 * times and head["aggregates"]["statuses"] == {"200": 3 * times, "301": times, "0": times}
    assert set(head["aggregates"]) == set(D.DIMENSIONS)


def test_report_computes_its_requests_once(spark, many, tmp_path):
    computed = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(url):
        computed.add(1)
        return url

    rows = many.withColumn("url", seen("url"))
    D.write_report(rows, str(tmp_path / "report"))
    assert computed.value == many.count()


def test_unknown_session(spark, many, tmp_path):
    D.write_report(many, str(tmp_path / "report"))
    assert D.report_lines(spark, str(tmp_path / "report"), "nobody").count() == 0


def test_har_round_trip(spark, many, tmp_path):
    D.write_har(many, str(tmp_path / "har"))
    (tmp_path / "archives").mkdir()
    for session in ("s", "long"):
        D.write_document(D.archive_lines(spark, str(tmp_path / "har"), session), str(tmp_path / session))
        (tmp_path / "archives" / f"{session}.har").write_text(read_text(tmp_path / session), encoding="utf-8")
    log = json.loads((tmp_path / "archives" / "s.har").read_text(encoding="utf-8"))["log"]
    assert log["version"] == "1.2" and len(log["entries"]) == 5
    page = log["entries"][1]
    assert page["timings"] == {"blocked": -1.0, "dns": 12.5, "connect": 25.5, "ssl": 19.0, "send": 0.5, "wait": 90.0, "receive": 152.5}
    assert page["response"]["bodySize"] == 1600 and page["response"]["content"]["size"] == 4000 and page["cache"] == {}
    assert log["entries"][2]["request"]["queryString"] == [{"name": "v", "value": "[not retained]"}]
    archive = har.read_har(spark, str(tmp_path / "archives"))
    assert archive.rejects.count() == 0 and archive.entries.groupBy("session_id").count().collect().__len__() == 2
    rows = normalize.normalize(normalize.har_requests(archive.entries.where("session_id = 's'"))).orderBy("seq").collect()
    assert [(r.id, r.duration_ms, r.body_bytes) for r in rows][:3] == [("har-0", 2000.0, 2_400_000), ("har-1", 400.0, 0), ("har-2", 300.0, 1600)]
    assert [r.third_party for r in rows][:2] == [False, True]  # the slowest request's domain stands for the page


def test_batches_make_one_bundle(spark, many, tmp_path):
    """A session cut over three batches, one of them written twice, gives what the whole gives."""
    from pyspark.sql import functions as F

    raw = many.drop("offset_ms", "third_party", "tracker", "compression_ratio")
    third = F.pmod(F.xxhash64("session_id", "seq"), F.lit(3))
    for number in (0, 1, 1, 2):
        D.spool_batch(raw.where(third == number), str(tmp_path / "out"), number)
    D.finish_bundle(spark, str(tmp_path / "out"))
    D.write_bundle(normalize.normalize(raw), str(tmp_path / "whole"))
    for name in ("report/heads", "report/tables", "report/requests", "har", "csv"):
        got, want = (sorted(r.value for r in spark.read.text(f"{tmp_path}/{side}/{name}").collect()) for side in ("out", "whole"))
        assert got == want and got, name


def test_har_cases(spark):
    good = {"log": {"pages": [{"id": "p"}], "entries": [
        {"startedDateTime": "2025-06-03T08:15:00.5Z", "time": 61.257, "request": {"method": "PUT", "url": "https://api.test/v2/cart?session_token=abc&n=2", "httpVersion": "h3"},
         "response": {"status": 204, "bodySize": 31, "headersSize": 9, "content": {"mimeType": "application/json;charset=x"}},
         "timings": {"dns": -1, "ssl": 2.5, "wait": 40, "comment": "x"}, "cache": {"afterRequest": None}},
        {"time": 700, "request": {"url": "http://b/"}, "response": {"status": 0, "bodySize": -1}},
    ]}}
    frame = spark.createDataFrame(
        [("a", json.dumps(good)), ("b", json.dumps({"log": {"entries": {}}})), ("c", "{nope"), ("d", "{}")], "session_id string, value string"
    )
    archive = har.split_documents(frame)
    assert {(r.session_id, r.reason) for r in archive.rejects.collect()} == {("b", "log.entries must be an array"), ("c", "malformed JSON")}
    slow, fast = archive.entries.orderBy("seq").collect()
    assert (slow.duration_ms, slow.status, slow.transfer_bytes, slow.protocol) == (700.0, 0, 0, "unknown")
    assert (fast.transfer_bytes, fast.mime_type, fast.timings, fast.cached) == (40, "application/json", {"ssl": 2.5, "wait": 40.0}, True)
    assert (fast.duration_ms, fast.method, fast.protocol, fast.status) == (61.26, "PUT", "h3", 204) and "abc" not in fast.url
    total = summary.har_summary(archive.entries).first()
    assert (total.requests, total.failed, total.longest_request_ms) == (2, 1, 700.0)


def test_bundle_and_comparison(spark, requests, tmp_path):
    D.write_bundle(requests, str(tmp_path))
    assert spark.read.text(str(tmp_path / "report" / "heads")).count() == 1
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 5
    assert spark.read.text(str(tmp_path / "har")).count() == 5
    profile = summary.session_profile(requests)
    halves = profile.withColumn("requests", profile.requests * 2)
    metrics = compare.compare_summaries(profile, halves, ["session_id"])
    marks = compare.compare_scores(scores.session_scores(profile), scores.session_scores(profile), ["session_id"])
    D.write_comparison(metrics, marks, str(tmp_path / "cmp"))
    row = metrics.where("metric = 'requests'").first()
    assert (row.before, row.after, row.delta, row.percent, row.worse) == (5.0, 10.0, 5.0, 100.0, True)
    assert metrics.where("metric = 'http_errors'").first().percent is None
    assert spark.read.json(str(tmp_path / "cmp" / "scores")).count() == 5


def test_views(requests):
    assert [r.id for r in views.top_requests(requests, "slowest", 1).collect()] == ["hero"]
    assert [r.id for r in views.top_requests(requests, "start", 1).collect()] == ["page"]
    assert views.filter_requests(requests, "DOUBLECLICK", "error").count() == 1
    assert views.filter_requests(requests, status="success", resource_type="Document").count() == 2
    bars = views.waterfall(requests).orderBy("rank").collect()
    assert (bars[0].left_percent, round(bars[0].width_percent, 3), round(bars[3].left_percent, 3)) == (0.0, 1.724, 13.793)
    detail = views.request_details(requests).orderBy("seq").collect()
    assert detail[1].remote == "198.51.100.7:8443" and detail[4].remote == "—:—" and detail[4].flags == ["3rd", "tracker", "failed"]


def test_sanitize(spark):
    clean = sanitized({
        "documentURL": "https://example.com/?token=secret", "request": {"headers": {"Cookie": "secret"}, "postData": "password=bad"},
        "headersText": "HTTP/1.1 200 OK\r\nSet-Cookie: secret\r\nContent-Type: text/plain", "data": {"x": 1}, "items": [{"url": "http://u:p@h/"}],
    })
    assert clean["request"] == {"headers": {"Cookie": "[REDACTED]"}, "postData": "[REDACTED 12 bytes]"}
    assert clean["documentURL"] == "https://example.com/?token=%5BREDACTED%5D" and clean["data"] == "[REDACTED]"
    assert clean["headersText"] == "HTTP/1.1 200 OK\nSet-Cookie: [REDACTED]\nContent-Type: text/plain"
    assert clean["items"] == [{"url": "http://[REDACTED]@h/"}]
    events = jsonl.split_lines(lines(spark, {"s": [cdp("Network.x", response={"payloadData": "secret"}), {"type": "session_end", "body": 1}]})).events
    rows = [json.loads(r.value) for r in sanitize_events(events).orderBy("seq").collect()]
    assert rows[0]["params"] == {"response": {"payloadData": "[REDACTED 6 bytes]"}} and rows[0]["method"] == "Network.x"
    assert rows[1] == {"type": "session_end", "body": 1}


def test_recorder_flight_and_idle(spark):
    plan = [(0, "a", "s"), (1, "b", "s"), (2, "a", "s"), (3, "a", "e"), (4, "b", "e"), (4.5, "", "l"), (20, "c", "s"), (21, "c", "e")]
    kinds = {"s": "Network.requestWillBeSent", "e": "Network.loadingFinished", "l": recorder.PAGE_LOADED}
    rows = spark.createDataFrame([("x", rid, n, float(ts), kinds[k]) for n, (ts, rid, k) in enumerate(plan)],
                                 "session_id string, request_id string, seq bigint, ts double, kind string")
    assert [r.in_flight for r in recorder.in_flight(rows).orderBy("seq").collect()] == [1, 2, 2, 1, 0, 0, 1, 0]
    assert recorder.network_idle(rows, 3.0).first().idle_at == 7.0
    assert recorder.network_idle(rows, 100.0).first().idle_at == 121.0
    events = jsonl.split_lines(lines(spark, {"s": shop_events()})).events
    assert recorder.in_flight_peak(recorder.activity(events)).first().asDict() == {"session_id": "s", "peak": 2, "open_at_end": 0}
    assert recorder.recorder_summary(events).first().requests == 4


def test_diagnosis_documents(spark):
    hosts = spark.createDataFrame([("h",), ("i",)], "host string")
    found = spark.createDataFrame(
        [("h", 0, "", "critical", "no-dns", "t", "d", ""), ("h", 1, "", "warning", "w", "t", "d", "")],
        "host string, position int, subject string, severity string, code string, title string, detail string, recommendation string",
    )
    score = diagnosis.diagnosis_scores(hosts, found)
    assert {(r.host, r.score) for r in score.collect()} == {("h", 58), ("i", 100)}
    texts = {r.host: json.loads(r.value) for r in D.diagnosis_documents(score, found).collect()}
    assert [f["code"] for f in texts["h"]["findings"]] == ["no-dns", "w"] and texts["i"]["score"] == 100


def test_comparison_of_sessions_that_one_side_lacks(spark):
    names = "session_id string, requests bigint, failed bigint"
    before = spark.createDataFrame([("a", 4, None), ("b", 0, 1)], names)
    after = spark.createDataFrame([("a", 5, 2), ("c", 3, 0)], names)
    got = {(r.session_id, r.metric): (r.before, r.after, r.delta, r.percent, r.worse) for r in compare.compare_summaries(before, after, ["session_id"]).collect()}
    assert got == {
        ("a", "requests"): (4.0, 5.0, 1.0, 25.0, True), ("a", "failed"): (0.0, 2.0, 2.0, None, True),
        ("b", "requests"): (0.0, 0.0, 0.0, None, False), ("b", "failed"): (1.0, 0.0, -1.0, -100.0, False),
        ("c", "requests"): (0.0, 3.0, 3.0, None, True), ("c", "failed"): (0.0, 0.0, 0.0, None, False),
    }
    marks = compare.compare_scores(before.select("session_id", F.col("requests").alias("overall")), after.select("session_id", F.col("failed").alias("privacy")), ["session_id"])
    assert {(r.session_id, r.metric, r.before, r.after) for r in marks.collect()} >= {("a", "overall", 4.0, 0.0), ("c", "privacy", 0.0, 0.0)}
    assert compare.compare_summaries(before.limit(0), after.limit(0), ["session_id"]).collect() == []


def test_periods_in_one_pass_equal_two_profiles(spark, requests):
    later = F.col("seq") % 2 == 0
    unknown = F.when(F.col("seq") > requests.selectExpr("min(seq)").first()[0], later)  # the first request is of no period
    both = compare.split_periods(summary.session_profile(compare.in_periods(requests, unknown)))
    sides = [summary.session_profile(requests.where(unknown == side)) for side in (False, True)]
    one = compare.summary_differences(both, ["session_id"]).collect()
    two = compare.compare_summaries(*sides, ["session_id"]).collect()
    assert sorted(map(str, one)) == sorted(map(str, two)) and one


def test_stored_reports_come_back(spark, tmp_path):
    text = {"timestamp": "2024-01-01T00:00:00Z", "interfaces": [{"name": "en0", "flags": ["UP"], "ipv4": ["10.0.0.2"], "status": "active"}],
            "routes": [{"destination": "default", "gateway": "10.0.0.1", "interface": "en0"}], "ipv6_routes": [{"destination": "::/0", "interface": "en0"}, {"destination": "fe80::/64"}]}
    texts = [("h \u00e9", json.dumps(text)), ("empty", "{}"), ("broken", "{"), ("h \u00e9", json.dumps(dict(text, timestamp="2024-01-02T00:00:00Z", interfaces=None)))]
    found = diagnosis.diagnose(snapshots.parse_documents(spark.createDataFrame(texts, "host string, value string"), snapshots.SNAPSHOT))
    D.write_diagnoses(found, str(tmp_path / "out"))
    (tmp_path / "out" / "diagnosis" / "deep").mkdir()
    (tmp_path / "out" / "diagnosis" / "deep" / "more.txt").write_text("{cut short\n")
    lines = snapshots.read_reports(spark, str(tmp_path / "out" / "diagnosis"))
    back = snapshots.parse_documents(lines, snapshots.DIAGNOSIS)
    want = {(r.host, r.snapshot_no): (r.score, r.summary, r.findings) for r in found.collect()}
    assert {(r.host, r.snapshot_no): (r.score, r.summary, r.findings) for r in back.collect()} == want and len(want) == 3
    assert [(r.host, r.value) for r in snapshots.rejected_documents(lines).collect()] == [(None, "{cut short")]
    assert sorted(map(str, snapshots.reported_findings(back).collect())) == sorted(map(str, diagnosis.listed(found).collect()))
    leaks = snapshots.parse_documents(snapshots.read_reports(spark, str(tmp_path / "out" / "leaks")), snapshots.LEAK_REPORT)
    assert sorted(map(str, snapshots.reported_findings(leaks).collect())) == sorted(map(str, diagnosis.listed(found, "leaks").collect()))
    assert {len(r.ipv6_default_routes) for r in leaks.where("snapshot_no > 0").collect()} == {1}
