"""HAR archives: one JSON document per file, or one document per row, read as many small rows.

An archive's text is cut behind every closing brace, so no row holds an archive. The pieces of an archive go to one task
in order, where a pull parser takes them one by one: it hands out each entry as soon as it is complete, reduced to the
fields that are used, and keeps nothing but the current entry and the document's frame. The same holds at every size.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netlens.functions import redact as R
from netlens.functions import url as U
from netlens.functions.numbers import half_even, text_or, whole
from netlens.operators.skew import row_numbers
from netlens.sources.jsonl import LONG_STRINGS, file_position, session_of

#: Where an archive's text is cut.
CUT = "}"
MALFORMED, NO_ARRAY, NO_OBJECTS = "malformed JSON", "log.entries must be an array", "log.entries must hold objects"
#: Characters of entries that a task hands on at once.
OUTPUT = 4 << 20
#: Characters of pieces that are read at once.
INPUT = 1 << 20


@dataclass(frozen=True)
class Archive:
    """Entries and rejected documents of one scan."""

    entries: DataFrame
    rejects: DataFrame


def read_har(spark: SparkSession, path: str, show_sensitive: bool = False, pattern: str | None = None) -> Archive:
    """Entries and rejected documents of a folder of archives; ``pattern`` (a glob) picks files by name.

    Spark does not list files of no bytes, so they are neither accepted nor rejected.
    """
    reader = spark.read.option("lineSep", CUT).option("recursiveFileLookup", True)
    pieces = (reader.option("pathGlobFilter", pattern) if pattern else reader).text(path).select(
        session_of(spark, path).alias("session_id"), file_position(spark).alias("seq"),
        F.octet_length("value").cast("bigint").alias("bytes"), F.col("_metadata.file_size").alias("size"),
        F.make_valid_utf8(F.col("value")).alias("value"),
    )
    return split_pieces(pieces, show_sensitive)


def split_documents(documents: DataFrame, show_sensitive: bool = False) -> Archive:
    """Entries and rejects of (session_id, value) documents."""
    pieces = documents.select(
        "session_id", F.octet_length(F.coalesce("value", F.lit(""))).cast("bigint").alias("size"), F.posexplode(F.split(F.coalesce("value", F.lit("")), CUT)).alias("seq", "value")
    )
    return split_pieces(
        pieces.select("session_id", F.col("seq").cast("bigint").alias("seq"), F.octet_length("value").cast("bigint").alias("bytes"), "size", "value"),
        show_sensitive,
    )


# The parts of an entry that are read; numbers that may be missing or odd are read as text first.
ENTRY = (
    "struct<startedDateTime:string,time:string,request:struct<method:string,url:string,httpVersion:string>,"
    "response:struct<status:string,httpVersion:string,bodySize:string,headersSize:string,content:struct<mimeType:string>>,"
    "timings:map<string,string>,serverIPAddress:string,connection:string,cache:string>"
)
_SHAPE = {
    "startedDateTime": None, "time": None, "request": {"method": None, "url": None, "httpVersion": None},
    "response": {"status": None, "httpVersion": None, "bodySize": None, "headersSize": None, "content": {"mimeType": None}},
    "timings": None, "serverIPAddress": None, "connection": None, "cache": None,
}


def _reduced(value: object, shape: dict | None) -> object:
    """The part of a JSON value that ``shape`` names."""
    if shape is None or not isinstance(value, dict):
        return value
    return {name: _reduced(value[name], inner) for name, inner in shape.items() if name in value}


class ArchiveReader:
    """Pull parser of one document: ``feed`` takes its text in pieces of any size and gives the entries that became complete.

    An object that lies in an array on the third level is cut out, checked and forgotten; the frame around it, with a
    mark for the first object of each array, is checked as a whole by ``finish``.
    """

    _TOKEN = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"|["{}\[\]]', re.DOTALL)
    _CLOSE = re.compile(r'[^"\\]*(?:\\.[^"\\]*)*"', re.DOTALL)
    _DECODER = json.JSONDecoder()

    def __init__(self) -> None:
        self.stack: list[str] = []
        self.frame: list[str] = []
        self.held: list[str] | None = None
        self.text: list[str] = []  # an unfinished string
        self.quoted = self.broken = False
        self.array, self.place, self.arrays = -1, 0, 0

    def feed(self, piece: str) -> Iterator[tuple[int, int, dict]]:
        """(array, position, entry) of every object completed by this piece; arrays are numbered in the order they open."""
        if self.broken:
            return
        at = 0
        if self.quoted:
            found = self._CLOSE.match(piece)
            if not found:
                self.text.append(piece)
                return
            self.text.append(found.group())
            at, self.quoted = found.end(), False
            self._add("".join(self.text))
            self.text = []
        begin = at
        while not self.broken:
            found = self._TOKEN.search(piece, at)
            if not found:
                self._add(piece[begin:])
                return
            token, at = found.group(), found.end()
            if token == '"':  # the string goes on in the next piece
                self._add(piece[begin : found.start()])
                self.quoted, self.text = True, [piece[found.start() :]]
                return
            if token in "{[":
                if token == "{" and self.held is None and len(self.stack) == 3 and self.stack[2] == "[":
                    self._gap(piece[begin : found.start()])
                    self.held, begin = [], found.start()
                    try:  # most objects lie in the piece as a whole
                        entry, at = self._DECODER.raw_decode(piece, begin)
                    except (ValueError, RecursionError):
                        pass
                    else:
                        self.held, self.gap_from, begin = None, len(self.frame), at
                        yield self.array, self.place, entry
                        self.place += 1
                        continue
                self.stack.append(token)
                if token == "[" and len(self.stack) == 3:
                    self._add(piece[begin:at])
                    begin = at
                    self.array, self.place, self.arrays = self.arrays, 0, self.arrays + 1
                    self.gap_from = len(self.frame)
            elif token in "}]":
                if not self.stack or self.stack.pop() != ("{" if token == "}" else "["):
                    self.broken = True
                elif self.held is not None and len(self.stack) == 3:
                    self._add(piece[begin:at])
                    begin = at
                    try:
                        entry = json.loads("".join(self.held))
                    except (ValueError, RecursionError):
                        self.broken = True
                        return
                    self.held, self.gap_from = None, len(self.frame)
                    yield self.array, self.place, entry
                    self.place += 1

    def _add(self, text: str) -> None:
        (self.frame if self.held is None else self.held).append(text)

    def _gap(self, text: str) -> None:
        """Text between two objects of an array: nothing is kept of a plain comma, so the frame stays small."""
        between = "".join(self.frame[self.gap_from :]) + text
        del self.frame[self.gap_from :]
        if not (self.place and between.strip(" \t\r\n") == ","):
            self.frame += [between, '{"":%d}' % self.array]
        self.gap_from = len(self.frame)

    def finish(self) -> tuple[str | None, int]:
        """Why the document is rejected, or None; and which array holds its entries (-1: none does)."""
        try:
            document = None if self.broken or self.stack or self.quoted else json.loads("".join(self.frame))
        except (ValueError, RecursionError):
            document = None
            self.broken = True
        if self.broken or self.stack or self.quoted:
            return MALFORMED, -1
        log = document.get("log") if isinstance(document, dict) else None
        entries = log.get("entries") if isinstance(log, dict) else None
        if entries is None:
            return (NO_ARRAY if isinstance(log, dict) and "entries" in log else None), -1
        if not isinstance(entries, list):
            return NO_ARRAY, -1
        if not all(isinstance(entry, dict) for entry in entries):
            return NO_OBJECTS, -1
        return None, entries[0][""] if entries else -1


def _pull(batches: Iterator[pa.RecordBatch], entries: bool) -> Iterator[pa.RecordBatch]:
    """Entries, or the outcome, of the documents whose pieces arrive in order: a document ends where the next one begins."""
    session, reader, taken, pieces, last, size = None, None, 0, 0, None, None
    rows: list[tuple] = []
    held = 0

    def closing() -> Iterator[tuple[int, int, dict]]:
        # A piece ends with the brace it was cut at, but for the last one, if the file does not end with a brace. Sizes
        # tell; those of a compressed file say nothing, there the open braces do.
        whole_ = taken + pieces
        ended = whole_ == size if size in (whole_, whole_ - 1) else len(reader.stack) == 1
        yield from reader.feed(last + CUT if ended else last)

    def ended() -> Iterator[tuple]:
        for found in closing():
            if entries:
                yield session, *found
        if not entries:
            reason, array = reader.finish()
            yield session, array, 0, reason

    def batch_of(kept: list[tuple]) -> pa.RecordBatch:
        texts = [json.dumps(_reduced(row[3], _SHAPE)) for row in kept] if entries else [row[3] for row in kept]
        return pa.RecordBatch.from_arrays(
            [pa.array([row[0] for row in kept], pa.string()), pa.array([row[1] for row in kept], pa.int32()), pa.array([row[2] for row in kept], pa.int64()), pa.array(texts, pa.string())],
            names=["session_id", "array", "position", "value"],
        )

    for batch in batches:
        columns = [batch.column(batch.schema.names.index(name)).to_pylist() for name in ("session_id", "bytes", "size", "value")]
        names, lengths, totals, values = columns
        at = 0
        while at < len(names):
            if reader is None or names[at] != session:
                if reader is not None:
                    rows += ended()
                session, reader, taken, pieces, last = names[at], ArchiveReader(), 0, 0, None
            to, long = at, 0
            while to < len(names) and names[to] == session and long < INPUT:
                long += len(values[to])
                to += 1
            if last is not None or to - at > 1:  # all but the last piece, which may be the end of its document
                held_back = [] if last is None else [last]
                found = [(session, *entry) for entry in reader.feed(CUT.join([*held_back, *values[at : to - 1], ""]))]
                if entries:
                    rows += found
                    held += len(found) * 512
            taken, pieces, last, size = taken + sum(lengths[at:to]), pieces + to - at, values[to - 1], totals[to - 1]
            at = to
            if len(rows) >= 4096 or held >= OUTPUT:
                yield batch_of(rows)
                rows, held = [], 0
    if reader is not None:
        rows += ended()
    if rows:
        yield batch_of(rows)


def split_pieces(pieces: DataFrame, show_sensitive: bool = False) -> Archive:
    """Entries and rejects of (session_id, seq, bytes, size, value) pieces: ``bytes`` of a piece and ``size`` of its whole document.

    Entries are handed out before the end of their document is known; those of a rejected document, or of an
    ``entries`` that a later one of the same name replaces, fall away in the join with the outcomes.
    """
    ordered = pieces.where(F.col("value").isNotNull()).repartition("session_id").sortWithinPartitions("session_id", "seq")
    schema = "session_id string, array int, position bigint, value string"
    outcomes = ordered.mapInArrow(lambda batches: _pull(batches, False), schema)
    rejects = outcomes.where(F.col("value").isNotNull()).select("session_id", F.col("value").alias("reason"))
    accepted = outcomes.where(F.col("value").isNull() & (F.col("array") >= 0)).select("session_id", "array")
    found = ordered.mapInArrow(lambda batches: _pull(batches, True), schema)
    entries = found.join(accepted, ["session_id", "array"]).select(
        "session_id", "position", F.explode(F.array(F.from_json("value", ENTRY, LONG_STRINGS))).alias("_e")
    )
    return Archive(_entries(entries, show_sensitive), rejects)


# Places of an entry in 28 bits, and hundredths of a millisecond, shifted to be positive, above them.
_PLACE_BITS, _CENTRE = 28, 1 << 33


def _entries(rows: DataFrame, show_sensitive: bool) -> DataFrame:
    """Entries with ``seq``, their rank by falling duration (ties: place in the document), and ``position``, that place.

    The rank is counted in blocks of nearly equal duration, so an archive of any size is spread over tasks. Durations beyond
    23 hours count alike in it.
    """
    hundredths = F.least(F.lit(_CENTRE - 1), F.greatest(F.lit(-_CENTRE + 1), F.round(_duration(F.col("_e")) * 100).cast("bigint")))
    order = F.shiftleft(F.lit(_CENTRE) - hundredths, _PLACE_BITS) + F.col("position")
    rows = row_numbers(rows.withColumn("_order", order), ["session_id"], "_order", "_rank", bits=_PLACE_BITS + 7).select(
        "session_id", (F.col("_rank") - 1).alias("seq"), "position", "_e"
    )
    e = F.col("_e")
    url = F.coalesce(e["request"]["url"], F.lit(""))
    zero = F.lit(0).cast("bigint")
    body = F.greatest(zero, whole(e["response"]["bodySize"]))
    head = F.greatest(zero, whole(e["response"]["headersSize"]))
    timings = F.transform_values(e["timings"], lambda key, value: value.try_cast("double"))
    spoken = F.coalesce(F.nullif(e["response"]["httpVersion"], F.lit("")), e["request"]["httpVersion"])
    return rows.select(
        "session_id",
        "seq",
        "position",
        e["startedDateTime"].alias("started"),
        F.coalesce(e["request"]["method"], F.lit("?")).alias("method"),
        (url if show_sensitive else R.redact_url(url)).alias("url"),
        F.coalesce(U.url_host(url), F.lit("unknown")).alias("domain"),
        whole(e["response"]["status"]).cast("int").alias("status"),
        text_or(spoken, "unknown").alias("protocol"),
        U.mime_essence(text_or(e["response"]["content"]["mimeType"], "unknown")).alias("mime_type"),
        _duration(e).alias("duration_ms"),
        body.alias("body_bytes"),
        (body + head).alias("transfer_bytes"),
        e["serverIPAddress"].alias("server_ip"),
        e["connection"].alias("connection"),
        F.map_filter(timings, lambda key, value: value >= 0).alias("timings"),
        (~F.coalesce(e["cache"], F.lit("")).isin("", "{}")).alias("cached"),
    )


def _duration(entry: Column) -> Column:
    return half_even(F.coalesce(entry["time"].try_cast("double"), F.lit(0.0)), 2)
