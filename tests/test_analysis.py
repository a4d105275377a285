"""A folder with recordings of every kind, analysed end to end."""

import json

from netlens.operators import analysis
from tests.sessions import shop_events, write_jsonl

ARCHIVE = {"log": {"entries": [
    {"time": 12, "request": {"method": "GET", "url": "https://fast.test/a"}, "response": {"status": 500, "bodySize": 10, "headersSize": 5}},
    {"time": 1500, "request": {"method": "GET", "url": "https://slow.test/b"}, "response": {"status": 200, "bodySize": 2_000_000, "headersSize": 0}},
]}}


def folder(path):
    proxy = {"type": "proxy_request", "method": "GET", "target": "http://plain.test/", "ok": True, "response": {"status": 200}, "download_bytes": 9}
    socket = {"type": "connection_open", "connection": {"process": "p"}}
    write_jsonl(path, {
        "web": shop_events() + [proxy, socket], "proxy": [socket, proxy, proxy], "socket": [socket, {"type": "connection_close", "connection": {"process": "q"}}],
        "notes": [{"type": "note"}],
    })
    (path / "deep").mkdir()
    (path / "deep" / "page.HAR").write_text(json.dumps(ARCHIVE))
    (path / "bad.har").write_text('{"log": {"entries": 7}}')
    (path / "other.txt").write_text("{")


def test_folder_end_to_end(spark, tmp_path):
    folder(tmp_path)
    found = analysis.analyze_folder(spark, str(tmp_path))
    kinds = {r.session_id: (r.source_type, r.events) for r in found.sources.collect()}
    assert kinds == {
        "web": ("chrome-cdp", 26), "proxy": ("proxy-jsonl", 3), "socket": ("connection-jsonl", 2), "notes": ("unsupported", 1), "deep/page": ("har", 2),
    }
    summary = {r.session_id: r for r in found.summary().collect()}
    assert {name: r.requests for name, r in summary.items()} == {"web": 5, "proxy": 2, "deep/page": 2}
    assert (summary["web"].transfer_bytes, summary["web"].page_span_ms, summary["web"].source_type) == (2_401_600, 2320.0, "chrome-cdp")
    assert (summary["deep/page"].third_party, summary["deep/page"].large_requests) == (1, 1)  # the slowest request's domain stands for the page
    assert {r.session_id: r.overall for r in found.scores().collect()}["web"] == 85
    rows = sorted((r.session_id, r.position, r.code, r.recommendation != "") for r in found.findings().collect())
    assert [r[:3] for r in rows if r[0] == "web"] == [
        ("web", n + 1, code) for n, code in enumerate(["unencrypted-http", "large-resources", "slow-requests", "request-errors", "tracking-requests"])
    ]
    assert [r[2] for r in rows if r[0] == "proxy"] == ["unencrypted-http", "duplicate-requests"] and all(r[3] for r in rows)
    assert [(r.session_id, r.opened, r.closed, r.processes) for r in found.sockets.collect()] == [("socket", 1, 1, 2)]
    assert {(r.session_id, r.reason) for r in found.rejects.collect()} == {("notes", analysis.UNSUPPORTED), ("bad", "log.entries must be an array")}
