"""The pull parser of archives against a whole-document parse; large archives in bounded memory."""

import gzip
import json
import random
import tracemalloc

import pytest
from pyspark.sql import functions as F

from netlens.sources import har, jsonl


def read(text, cuts):
    """Outcome and kept entries of a document fed in pieces."""
    reader, found, at = har.ArchiveReader(), [], 0
    for cut in [*sorted(cuts), len(text)]:
        # Pieces end behind a brace, as Spark cuts them, so that no escape is cut in two.
        cut = text.find("}", max(cut, at)) + 1 or len(text)
        found += reader.feed(text[at:cut])
        at = cut
    reason, array = reader.finish()
    return reason, [entry for number, _, entry in found if number == array] if reason is None else []


def plain(text):
    """The same by one parse of the whole text."""
    try:
        document = json.loads(text)
    except ValueError:
        return har.MALFORMED, []
    log = document.get("log") if isinstance(document, dict) else None
    if not isinstance(log, dict) or "entries" not in log:
        return None, []
    if not isinstance(log["entries"], list):
        return har.NO_ARRAY, []
    if not all(isinstance(entry, dict) for entry in log["entries"]):
        return har.NO_OBJECTS, []
    return None, log["entries"]


def value(rng, depth=0):
    kinds = [lambda: rng.choice(['"}', "a\\b", 'q"{[', "é ", "", "\\", 'x\\"}'])] * 2 + [lambda: rng.choice([0, -1.5, 1e9, True, None])]
    if depth < 4:
        kinds += [lambda: [value(rng, depth + 1) for _ in range(rng.randint(0, 3))], lambda: {rng.choice("abc}"): value(rng, depth + 1) for _ in range(rng.randint(0, 3))}]
    return rng.choice(kinds)()


def document(rng):
    entries = [{"time": i, "request": value(rng), "x": value(rng)} for i in range(rng.randint(0, 5))]
    log = {"pages": [{"id": value(rng)} for _ in range(rng.randint(0, 2))], "entries": entries, "creator": value(rng), "other": [[{"a": 1}]]}
    keys = list(log)
    rng.shuffle(keys)
    shapes = [{"log": {k: log[k] for k in keys}}] * 6 + [{"log": {"entries": value(rng)}}, {"log": value(rng)}, value(rng), {"pre": {"list": [{"z": 1}]}, "log": log}]
    return json.dumps(rng.choice(shapes), indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5)


def test_pieces_give_what_a_whole_parse_gives():
    rng = random.Random(8)
    for _ in range(1500):
        text = document(rng)
        damage = rng.random()
        if damage < 0.3 and len(text) > 3:  # drop, double or swap a character
            i = rng.randrange(len(text))
            text = text[:i] + rng.choice(["", text[i] * 2, ",", "}", "]", '"', " "]) + text[i + 1 :]
        elif damage < 0.35:
            text = text[: rng.randrange(len(text) + 1)]
        cuts = [rng.randrange(len(text) + 1) for _ in range(rng.randint(0, 12))]
        assert read(text, cuts) == plain(text), text


@pytest.mark.parametrize(
    "text,outcome",
    [
        ('{"log":{"entries":[{"a":1}],"entries":[{"a":2},{"a":3}]}}', (None, [{"a": 2}, {"a": 3}])),
        ('{"log":{"entries":[{"a":1}]},"log":{"entries":[]}}', (None, [])),
        ('{"log":{"entries":[{"a":1,"a":5}]}}', (None, [{"a": 5}])),
        ('{"log":{"entries":[{"a":1} {"a":2}]}}', (har.MALFORMED, [])),
        ('{"log":{"entries":[{"a":1},]}}', (har.MALFORMED, [])),
        ('{"log":{"entries":[,{"a":1}]}}', (har.MALFORMED, [])),
        ('{"log":{"entries":[{"a":1},7]}}', (har.NO_OBJECTS, [])),
        ('{"log":{"entries":[{"a":NaN}]}} ', (None, [pytest.approx({"a": float("nan")}, nan_ok=True)])),
        ('{"log":{"entries":{"a":[{"b":1}]}}}', (har.NO_ARRAY, [])),
        ('{"log":{"entries":[]}}}', (har.MALFORMED, [])),
        ("", (har.MALFORMED, [])),
    ],
)
def test_odd_documents(text, outcome):
    assert read(text, [5, 15, 25]) == outcome
    if outcome[0] != har.NO_OBJECTS:
        assert plain(text)[0] == outcome[0]


def test_files_of_every_ending(spark, tmp_path):
    """A file's last brace, a line end behind it, a missing brace, blanks only, and a compressed file."""
    good = json.dumps({"log": {"entries": [{"time": 2, "request": {"url": "https://a.example/"}}, {"time": 7.5}]}}, indent=1)
    for name, text in {"brace": good, "line": good + "\n", "spaces": good + " \n\n", "cut": good[:-1], "cutline": good[:-1] + "\n", "blank": "\n", "more": good + "}"}.items():
        (tmp_path / f"{name}.har").write_text(text)
    for name, text in {"packed": good, "packedline": good + "\n"}.items():
        (tmp_path / f"{name}.har.gz").write_bytes(gzip.compress(text.encode()))
    (tmp_path / "skipped.txt").write_text(good)
    archive = har.read_har(spark, str(tmp_path), pattern="*.har*")
    entries = {(r.session_id, r.seq, r.position, r.duration_ms) for r in archive.entries.collect()}
    whole = ("brace", "line", "spaces", "packed.har", "packedline.har")
    assert entries == {(name, seq, 1 - seq, duration) for name in whole for seq, duration in ((0, 7.5), (1, 2.0))}
    rejects = sorted((r.session_id, r.reason) for r in archive.rejects.collect())
    assert rejects == [(name, har.MALFORMED) for name in ("blank", "cut", "cutline", "more")]


def test_rank_over_blocks_of_duration(spark):
    rng = random.Random(3)
    times = [rng.choice([0, 0.004, 1.28, 1.29, -1, 5, 5, 1e9, 2e9, 70.5]) for _ in range(300)]
    text = json.dumps({"log": {"entries": [{"time": t} for t in times]}})
    frame = spark.createDataFrame([("s", text)], "session_id string, value string")
    found = har.split_documents(frame).entries.select("seq", "position").orderBy("seq").collect()
    clipped = [max(-85_899_345.91, min(85_899_345.91, round(t, 2))) for t in times]
    order = sorted(range(len(times)), key=lambda i: (-clipped[i], i))
    assert [(r.seq, r.position) for r in found] == list(enumerate(order))


def test_300_mb_in_bounded_memory():
    """The reader keeps one entry at a time, so 300 MB take no more memory than their largest entry needs."""
    body = "x" * 1_000_000
    piece = json.dumps({"time": 1, "request": {"url": "https://a.example/"}, "response": {"content": {"text": body}}})
    reader, count = har.ArchiveReader(), 0
    tracemalloc.start()
    for number in range(301):
        text = ('{"log":{"entries":[' if number == 0 else ",") + piece
        for part in text.split("}")[:-1]:
            count += len(list(reader.feed(part + "}")))
    reader.feed("]}"), list(reader.feed("]}")), list(reader.feed("}"))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert reader.finish() == (None, 0) and count == 301
    assert peak < 20_000_000 and sum(map(len, reader.frame)) < 200


def test_no_row_holds_an_archive(spark, tmp_path):
    entries = [{"time": i, "response": {"content": {"text": "y" * 20_000}}} for i in range(400)]
    (tmp_path / "large.har").write_text(json.dumps({"log": {"entries": entries}}))
    pieces = spark.read.option("lineSep", har.CUT).text(str(tmp_path))
    assert pieces.agg(F.max(F.length("value"))).first()[0] < 21_000
    assert har.read_har(spark, str(tmp_path)).entries.count() == 400


def test_repeated_keys_of_a_line(spark):
    """The last one counts, as everywhere in JSON readers, and the session's setting is as it was."""
    name = "spark.sql.variant.allowDuplicateKeys"
    before = spark.conf.get(name)
    lines = [("s", 0, '{"type":"a","type":"cdp_event","method":"M","params":{"requestId":"1","requestId":"2"}}'), ("s", 1, '{"type":"x"')]
    found = jsonl.split_lines(spark.createDataFrame(lines, "session_id string, seq bigint, value string"))
    assert [(r.type, r.method, r.request_id) for r in found.events.select("type", "method", "request_id").collect()] == [("cdp_event", "M", "2")]
    assert found.rejects.count() == 1 and spark.conf.get(name) == before


def test_self_join_reads_lines_alike(spark):
    """Spark makes a parse anew for a self-join; the copy must also take the last of repeated keys, and so be the same exchange."""
    from netlens.operators.correlate import correlate

    lines = [("s", 0, '{"type":"cdp_event","type":"cdp_event","method":"Network.requestWillBeSent","params":{"requestId":"1","timestamp":1.0}}')]
    events = jsonl.events_of(jsonl.parse_event_lines(spark.createDataFrame(lines, "session_id string, seq bigint, value string")))
    plan = correlate(events)._jdf.queryExecution().optimizedPlan().toString()
    assert "parseJson(value#" in plan and ", true, false" in plan and ", false, false" not in plan


def test_entries_in_one_piece_and_cut_behind_braces():
    """Whole objects are decoded at once; cut behind any brace they give the same entries and outcome."""
    good = '{"log":{"x":[{"a":1}],"entries":[{"a":"}{\\"","b":{"c":[1,{}]}} , {"a":NaN},{"a":1,"a":2}]}}'
    for text in (good, good.replace("NaN", "x"), good[:-1], good + "]", good.replace(" , ", " ")):
        want = None
        pieces = text.replace(har.CUT, har.CUT + "\0").split("\0")
        for size in (len(pieces), 1, 2, 3):
            reader = har.ArchiveReader()
            found = [repr(entry) for at in range(0, len(pieces), size) for entry in reader.feed("".join(pieces[at : at + size]))]
            got = (reader.finish(), found)
            want = want or got
            assert got[0] == want[0] and (want[0][0] is not None or got == want)
