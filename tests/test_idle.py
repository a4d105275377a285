"""The network-idle scan against a plain reading of the event order."""

import random
import re

import pytest
from pyspark.sql import functions as F

from netlens.operators import recorder
from netlens.operators.correlate import FAILED, FINISHED, RESPONSE, START

KINDS = (START, START, RESPONSE, FINISHED, FAILED, recorder.PAGE_LOADED)
SCHEMA = "session_id string, request_id string, seq bigint, ts double, kind string"


def made_up(seed, sessions=4, size=70):
    """Rows with repeated starts, ends without a start, missing ids, ids that live over many blocks and a one-row session."""
    luck, rows = random.Random(seed), [("single", "a", 3, 1.0, START)]
    for session in range(sessions):
        clock = 0.0
        for seq in range(size):
            clock += luck.choice((0.0, 0.25, 1.0, 4.0))
            kind = luck.choice(KINDS)
            name = None if kind == recorder.PAGE_LOADED or luck.random() < 0.05 else f"r{luck.randrange(6)}"
            rows.append((f"s{session}", name, seq * 3, None if luck.random() < 0.03 and kind != recorder.PAGE_LOADED else clock, kind))
    return rows


def plainly(rows, idle):
    counts, ready = {}, {}
    for session in {row[0] for row in rows}:
        own, held = sorted((row for row in rows if row[0] == session), key=lambda row: row[2]), set()
        for _, name, seq, _, kind in own:
            if name is not None and kind == START:
                held.add(name)
            elif name is not None and kind in (FINISHED, FAILED):
                held.discard(name)
            counts[session, seq] = len(held)
        loaded = [ts for *_, ts, kind in own if kind == recorder.PAGE_LOADED and ts is not None]
        moves = [(seq, ts) for _, _, seq, ts, kind in own if kind != recorder.PAGE_LOADED]
        for (seq, ts), (_, later) in zip(moves, [*moves[1:], (None, None)]):
            if counts[session, seq] or not loaded or ts is None and later is not None:
                continue
            moment = min(loaded) if ts is None else max(ts + idle, min(loaded))
            if later is None or later - ts >= idle and moment <= later:
                ready[session] = min(ready.get(session, moment), moment)
    return counts, ready


@pytest.mark.parametrize("seed,bits", [(1, 0), (2, 3), (3, 5), (4, 20)])
def test_scan_equals_plain_reading(spark, seed, bits):
    rows = made_up(seed)
    frame = spark.createDataFrame(random.Random(seed).sample(rows, len(rows)), SCHEMA).repartition(3)
    counts, ready = plainly(rows, 2.0)
    got = recorder.in_flight(frame, bits)
    assert got.columns == [*frame.columns, "in_flight"]
    assert {(r.session_id, r.seq): r.in_flight for r in got.collect()} == counts
    assert {r.session_id: r.idle_at for r in recorder.network_idle(frame, 2.0, bits).collect()} == ready
    peaks = {r.session_id: (r.peak, r.open_at_end) for r in recorder.in_flight_peak(frame, bits).collect()}
    for session in {row[0] for row in rows}:
        own = [counts[key] for key in sorted(counts) if key[0] == session]
        assert peaks[session] == (max(own), own[-1])


def test_scan_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert recorder.network_idle(empty, 1.0).collect() == [] and recorder.in_flight_peak(empty).collect() == []


def test_scan_has_few_exchanges(spark):
    frame = spark.createDataFrame(made_up(1), SCHEMA)
    plan = recorder.network_idle(frame, 2.0)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"(?<!Reused)Exchange (?:hash|range|single)", plan)) <= 10
