"""Keyed state across micro-batches: socket lifecycle, interface rates, request correlation.

Each processor keeps one value per key, a small one but for buckets of request ids, which hold a line per open id.
A hot host is split: its snapshots are cut into buckets of connection keys, and every bucket, also an empty one, hears of
every snapshot. A key's rows of one micro-batch are ordered in memory, so bound a backlog with ``maxFilesPerTrigger``.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from netlens.operators import correlate as C
from netlens.operators.connections import MIN_ELAPSED

BUCKETS = 64
MARKED = "array<struct<bucket: int, conn_key: string>>"

# --- socket lifecycle ---------------------------------------------------------------------------


class LifecycleProcessor(StatefulProcessor):
    """Open and close records of one (host, bucket); snapshots not newer than the last are dropped."""

    def __init__(self, count_initial: bool = True) -> None:
        self.count_initial = count_initial

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "last bigint, keys array<string>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, held = self.seen.get() if self.seen.exists() else (None, [])
        held = set(held)
        arrived: dict[int, set] = {}
        for part in rows:
            part = part if last is None else part[part["snapshot_no"] > last]
            for number, names in part.groupby("snapshot_no")["conn_key"]:
                arrived.setdefault(int(number), set()).update(names.dropna())
        changes = []
        for number in sorted(arrived):
            now = arrived[number]
            if last is not None or self.count_initial:
                changes += [(key[0], number, name, "open") for name in sorted(now - held)]
            changes += [(key[0], number, name, "close") for name in sorted(held - now)]
            last, held = number, now
        if last is not None:
            self.seen.update((last, sorted(held)))
        yield pd.DataFrame(changes, columns=["host", "snapshot_no", "conn_key", "change"])

    def close(self) -> None:
        pass


def lifecycle_stream(snapshots: DataFrame, count_initial: bool = True, buckets: int = BUCKETS) -> DataFrame:
    """Changes of a stream of (host, snapshot_no, keys): one row per snapshot with its connection keys.

    A snapshot is cut once: each key becomes a row of its bucket, and each bucket gets one marker (a row without a key),
    which says that the snapshot was taken even where the bucket has no key left. All rows of a snapshot come from one
    input row, so they arrive in one micro-batch and the snapshot is complete. Snapshots older than the last one
    compared are late and left out; a missing one only widens the comparison; a repeated one changes nothing.
    """
    row = lambda bucket, name: F.struct(bucket.cast("int").alias("bucket"), name.alias("conn_key"))
    held = F.transform("keys", lambda name: row(F.pmod(F.xxhash64(name), F.lit(buckets)), name))
    markers = F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda bucket: row(bucket, F.lit(None).cast("string")))
    cut = snapshots.select("host", "snapshot_no", F.inline(F.concat(markers, F.coalesce(held, F.array().cast(MARKED)))))
    return cut.groupBy("host", "bucket").transformWithStateInPandas(
        statefulProcessor=LifecycleProcessor(count_initial),
        outputStructType="host string, snapshot_no bigint, conn_key string, change string",
        outputMode="Append",
        timeMode="None",
    )


# --- interface rates ----------------------------------------------------------------------------


class RateProcessor(StatefulProcessor):
    """Bytes per second of one (host, interface) since its previous sample."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "ts_ms bigint, rx bigint, tx bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        samples = pd.concat(list(rows)).sort_values("ts_ms")
        old = self.last.get() if self.last.exists() else None
        out = []
        for now in zip(samples["ts_ms"], samples["rx_bytes"], samples["tx_bytes"]):
            if old is not None and now[0] <= old[0]:
                continue
            elapsed = max(MIN_ELAPSED, (now[0] - old[0]) / 1000.0) if old else 1.0
            rates = [max(0.0, (new - before) / elapsed) for new, before in zip(now[1:], old[1:])] if old else [0.0, 0.0]
            out.append((key[0], key[1], int(now[0]), *rates))
            old = tuple(int(value) for value in now)
        if old is not None:
            self.last.update(old)
        yield pd.DataFrame(out, columns=["host", "name", "ts_ms", "rx_rate", "tx_rate"])

    def close(self) -> None:
        pass


def rate_stream(samples: DataFrame) -> DataFrame:
    """Rates of a stream of (host, name, ts_ms, rx_bytes, tx_bytes); late samples are dropped."""
    return samples.groupBy("host", "name").transformWithStateInPandas(
        statefulProcessor=RateProcessor(),
        outputStructType="host string, name string, ts_ms bigint, rx_rate double, tx_rate double",
        outputMode="Append",
        timeMode="None",
    )


# --- request correlation ------------------------------------------------------------------------

CORRELATED = (
    "session_id string, id string, redirect_index int, seq bigint, version int, ended boolean, url string, method string, "
    "resource_type string, status int, protocol string, duration_ms double, transfer_bytes bigint, body_bytes bigint, "
    "from_cache boolean, failed boolean, failure string, redirect boolean, request_headers string, response_headers string"
)
_COLUMNS = [field.split()[0] for field in CORRELATED.split(", ")]
_EXTRAS = {C.START_EXTRA: "ask", C.RESPONSE_EXTRA: "answer"}
#: Kinds of which a hop needs the latest event only, and what is kept of it where the event has it.
_LATEST = {C.START, C.RESPONSE, C.FINISHED, C.FAILED, C.SERVED_FROM_CACHE}
_KEPT = ("start", "reply", "encoded_length", "failure")
_ENDS = {C.FINISHED, C.FAILED}
BEFORE = -1
#: Request ids are dealt over so many buckets; more of them where a micro-batch or the open requests are many.
ID_BUCKETS = 1024
#: Lines of many ids are much alike: this packs them to two thirds of what the state store's own compression does.
PACKED = "zstd"
_sorted = json.JSONEncoder(sort_keys=True).encode


def _missing(value: object) -> bool:
    return value is None or value is pd.NA or value != value


def _number(value: object) -> float | None:
    """A number of an event's text, where NaN and the infinities are words; None for NaN."""
    number = None if value is None else float(value)
    return None if _missing(number) else number


def hop_summaries(events: Iterable[tuple[int, str]], first_hop: int, replies: int) -> tuple[dict[int, dict], list[int], int]:
    """Summaries of the events (seq, text) of one request id by hop (BEFORE: before any start), where its responses stand, and its newest time.

    ``first_hop`` is open, ``replies`` were seen. A summary has the latest event of each kind, the latest end with a time,
    the latest value of each extra header, and the received bytes, so summaries of consecutive stretches of a hop merge by
    taking the later part (``merged``).
    """
    summaries: dict[int, dict] = {}
    hop, number, replied, last = first_hop, replies, [], 0
    for seq, group in groupby(sorted(events, key=itemgetter(0)), key=itemgetter(0)):
        same = [json.loads(text) for _, text in group]
        hop += sum(event["kind"] == C.START for event in same)
        for event in same:
            kind = event["kind"]
            summary = summaries.get(hop)
            if summary is None:
                summary = summaries[hop] = {"latest": {}, "end": None, "ask": {}, "answer": {}, "body": 0}
            if kind == C.RESPONSE:
                replied.append(seq)
                number += hop > BEFORE
            ts = _number(event.get("ts"))
            if kind in _LATEST:
                kept = {name: event[name] for name in _KEPT if name in event}
                summary["latest"][kind] = kept | {"seq": seq, "number": number} | ({} if ts is None else {"ts": ts})
            if kind in _ENDS and ts is not None:
                summary["end"] = ts
            if kind in _EXTRAS:
                side = summary[_EXTRAS[kind]]
                if hop == BEFORE:  # only the last map before the first start counts, as a whole
                    side.clear()
                side.update({name: [seq, value] for name, value in event["extra_headers"].items()})
            summary["body"] += event.get("data_length", 0)
            last = max(last, event["at"])
    return summaries, replied, last


def merged(early: dict, late: dict) -> dict:
    """The summary of two stretches of one hop, the second after the first."""
    return {
        "latest": early["latest"] | late["latest"], "end": early["end"] if late["end"] is None else late["end"],
        "ask": early["ask"] | late["ask"], "answer": early["answer"] | late["answer"], "body": early["body"] + late["body"],
    }


def hop_row(summary: dict, hop: int, follower: dict | None, pending: dict) -> dict:
    """The request that a summary stands for; ``follower`` is the start after it, ``pending`` the headers before any start."""
    begun, answer = summary["latest"][C.START], summary["latest"].get(C.RESPONSE)
    start = begun["start"]
    asked = start.get("request") or {}
    closing = follower if follower and "reply" in follower else None
    source = closing or answer
    reply = source["reply"] if source else {}
    headers = dict(reply.get("headers") or {})
    cached = bool(reply.get("fromDiskCache") or reply.get("fromPrefetchCache"))
    if closing is None:
        after = answer["seq"] if answer else BEFORE
        if answer and answer["number"] == 1:
            headers |= {name: value for name, (_, value) in pending["answer"].items()}
        headers |= {name: value for name, (seq, value) in summary["answer"].items() if seq > after}
        note = summary["latest"].get(C.SERVED_FROM_CACHE)
        cached = cached or bool(note and note["seq"] > after)
    first = {name: value for name, (_, value) in pending["ask"].items()} if hop == 0 else {}
    stop, since = closing["ts"] if closing and "ts" in closing else summary["end"], _number(start.get("timestamp"))
    span = None if stop is None or since is None else round(max(0.0, stop - since) * 1000, 2)
    done, fault = summary["latest"].get(C.FINISHED), summary["latest"].get(C.FAILED)
    return {
        "redirect_index": hop, "seq": begun["seq"], "ended": bool(closing or done or fault), "url": asked.get("url") or "",
        "method": asked.get("method") or "?", "resource_type": start.get("type") or "Other", "status": int(float(reply.get("status") or 0)),
        "protocol": reply.get("protocol") or "unknown", "duration_ms": span, "transfer_bytes": done.get("encoded_length", 0) if done else 0,
        "body_bytes": summary["body"], "from_cache": cached, "failed": fault is not None, "failure": fault and fault.get("failure"),
        "redirect": closing is not None,
        "request_headers": _sorted(dict(asked.get("headers") or {}) | first | {n: v for n, (_, v) in summary["ask"].items()}),
        "response_headers": _sorted(headers),
    }


class CorrelationProcessor(StatefulProcessor):
    """Requests of one bucket of (session, request id), from a summary of the open hop of each.

    After each micro-batch every hop that ended in it, or changed after its end, is emitted with a higher version. Once
    the watermark is ``idle_ms`` past an id's last event, an unfinished request is emitted as it stands and the id forgotten.

    A call, its state and its timer cost Spark and Python some milliseconds whatever they are for, an id only some tens of
    microseconds: so the ids of a bucket share them. The state has a line for each id, when it is forgotten, its name and
    what is known of it, packed together; only the lines of ids with events are read. The one timer is that of the first id to go.
    """

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("open", "size int, lines binary")

    def _held(self) -> dict[str, tuple[int, str]]:
        """When each id of the bucket is forgotten, and what is known of it as text."""
        value = self.state.get()  # each call of the state is a round trip to the JVM
        if value is None:
            return {}
        lines = pa.decompress(bytes(value[1]), value[0], PACKED, asbytes=True).decode().split("\n")
        return {name: (int(due), text) for due, name, text in (line.split("\t", 2) for line in lines)}

    def _keep(self, held: dict[str, tuple[int, str]]) -> int | None:
        """The state from now on; when its first id is forgotten."""
        if held:
            lines = "\n".join([f"{due}\t{name}\t{text}" for name, (due, text) in held.items()]).encode()
            self.state.update((len(lines), pa.compress(lines, PACKED, asbytes=True)))
        else:
            self.state.clear()
        return _first(held)

    def _advance(self, known: dict, events: Iterable[tuple[int, str]]) -> list[dict]:
        """Bring what is known of an id forward by its events; its hops as they now stand."""
        parts, replied, last = hop_summaries(events, known["hop"], known["replies"])
        if known["hop"] == BEFORE and BEFORE in parts:
            known["pending"] = {side: parts[BEFORE][side] or known["pending"][side] for side in ("ask", "answer")}
        if known["summary"] and known["hop"] in parts:
            parts[known["hop"]] = merged(known["summary"], parts[known["hop"]])
        elif known["summary"]:
            parts[known["hop"]] = known["summary"]
        found = []
        hops = sorted(hop for hop in parts if hop > BEFORE)
        for hop in hops:
            follower = parts[hop + 1]["latest"][C.START] if hop + 1 in parts else None
            version = known["version"] + 1 if hop == known["hop"] else 1
            found.append(dict(hop_row(parts[hop], hop, follower, known["pending"]), version=version))
        if hops:
            begun = min(parts[h]["latest"][C.START]["seq"] for h in hops)
            answered = sum(seq > begun for seq in replied)
            known.update(hop=hops[-1], summary=parts[hops[-1]], version=found[-1]["version"], replies=known["replies"] + answered)
        known["last"] = max(last, known["last"])
        return found

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        arrived: dict[tuple, list] = {}
        for part in rows:
            for session, request, seq, text in zip(*[part[name].tolist() for name in ("session_id", "request_id", "seq", "event")]):
                arrived.setdefault((None if _missing(session) else session, None if _missing(request) else request), []).append((seq, text))
        held = self._held()
        before, found = _first(held), []
        for (session, request), events in arrived.items():
            name = json.dumps([session, request])
            known = json.loads(held[name][1]) if name in held else {
                "hop": BEFORE, "summary": None, "version": 0, "replies": 0, "pending": {"ask": {}, "answer": {}}, "last": 0,
            }
            found += [dict(row, session_id=session, id=request) for row in self._advance(known, events) if row["ended"]]
            held[name] = known["last"] + self.idle_ms, json.dumps(known)
        due = self._keep(held)
        if before != due:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(due)
        if found:
            yield pd.DataFrame(found, columns=_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, now, found = self._held(), timerValues.getCurrentWatermarkInMs(), []
        for name in [name for name, (due, _) in held.items() if due <= now]:
            (session, request), known = json.loads(name), json.loads(held.pop(name)[1])
            if known["summary"] and not _ENDS & known["summary"]["latest"].keys():
                row = hop_row(known["summary"], known["hop"], None, known["pending"])
                found.append(dict(row, session_id=session, id=request, version=known["version"] + 1))
        due = self._keep(held)
        if due is not None:  # Spark deletes the timer that called
            self.handle.registerTimer(due)
        if found:
            yield pd.DataFrame(found, columns=_COLUMNS)

    def close(self) -> None:
        pass


def _first(held: dict[str, tuple[int, str]]) -> int | None:
    return min((due for due, _ in held.values()), default=None)


def correlation_stream(events: DataFrame, idle: str = "10 minutes", late: str = "1 hour", buckets: int = ID_BUCKETS) -> DataFrame:
    """Requests of an EVENT stream; the highest ``version`` of a (session, id, hop) is its latest state.

    Time is that of the events. An id without an event for ``idle`` is forgotten once the watermark (``late`` behind the
    newest event) is past it, so the state is bounded whatever the stream is; a replay gives what the live run gave.
    Events without a readable time, and events older than the watermark, are left out.

    Ids are dealt over ``buckets``. The state of a bucket with events is read and written as a whole and its rows of one
    micro-batch are held in memory: take about one bucket for 1,000 events of a micro-batch or 1,000 open ids, whichever is more.
    A checkpoint holds for the number of buckets it was begun with.
    """
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    timed = events.withColumn("wall", F.col("timestamp").try_cast("timestamp")).where(F.col("wall").isNotNull()).withWatermark("wall", late)
    start, asked, reply = F.col("start"), F.col("start.request"), F.col("reply")

    def only(whole: Column, *fields: str) -> Column:
        return F.when(whole.isNotNull(), F.struct(*[whole[name].alias(name) for name in fields]))

    event = F.struct(
        "kind", "ts",
        F.when(start.isNotNull(), F.struct(only(asked, "url", "method", "headers").alias("request"), start["type"].alias("type"), start["timestamp"].alias("timestamp"))).alias("start"),
        only(reply, "status", "protocol", "headers", "fromDiskCache", "fromPrefetchCache").alias("reply"),
        "extra_headers", "data_length", "encoded_length", F.col("fault.failure").alias("failure"), F.unix_millis("wall").alias("at"),
    )
    rows = C.request_events(timed, ("wall",)).select(
        F.pmod(F.xxhash64(*C.KEY), F.lit(buckets)).cast("int").alias("bucket"), *C.KEY, "seq", F.to_json(event).alias("event"), "wall"
    )
    return rows.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=CorrelationProcessor(idle_ms), outputStructType=CORRELATED, outputMode="Append", timeMode="EventTime"
    )
