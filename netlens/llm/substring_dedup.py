"""Substring dedup by content-defined chunks: a gear rolling hash cuts texts, equal chunks meet by their digests.

The gear hash of the last 16 bytes is looked at after every white space. A cut stands where it is larger than at all
other such places within REACH bytes, so cuts depend on the near text only: an insertion moves no cut beyond its
surroundings, and chunks have REACH bytes or more. Stretches without a place to cut are cut every LONGEST bytes. A chunk
whose digest occurs in a document of smaller doc_id, or earlier in its own, repeats; MIN_WORDS or more words in a row of
repeating chunks are a repeated span.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens.llm import texts
from netlens.llm.common import bounded, free_name, stage

REACH = 16
LONGEST = 512
#: Words in whole repeated chunks that make a span. A repeated passage loses up to a chunk at both of its ends, so this
#: is well below the fifty words of a passage worth removing.
MIN_WORDS = 28
_GEAR = texts.mix(np.arange(1, 257, dtype=np.uint64)).astype(np.uint32)
_FIRST = -(1 << 63)


def _windowed(values: np.ndarray, width: int, join) -> np.ndarray:
    """``join`` over each value and the ``width - 1`` before it (a power of two), by doubling; the array is padded with zeros in front."""
    step = 1
    while step < width:
        values = join(values, np.concatenate([np.zeros(step, values.dtype), values[:-step]]), step)
        step *= 2
    return values


def chunks(block: texts.Block) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per text: where its chunks begin and end (bytes, one more than chunks), their digests, and their words."""
    data, bounds = block.data, block.bounds
    count = len(bounds) - 1
    if not len(data):
        for _ in range(count):
            yield np.zeros(1, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return
    # Zeros between the texts keep them out of each other's windows.
    gap = 2 * REACH
    shift = np.repeat(np.arange(1, count + 1) * gap, np.diff(bounds))
    at = np.arange(len(data)) + shift
    padded = np.zeros(len(data) + (count + 1) * gap, np.uint32)
    padded[at] = _GEAR[data]
    rolled = _windowed(padded, 16, lambda new, old, step: new + (old << np.uint32(step)))
    space = texts.SPACE[data]
    places = np.zeros(len(padded), np.uint32)
    places[at[space]] = rolled[at[space]] | np.uint32(1)
    most = _windowed(places, REACH, lambda new, old, step: np.maximum(new, old))
    ahead = _windowed(places[::-1], REACH, lambda new, old, step: np.maximum(new, old))[::-1]
    peak = np.zeros(len(padded), bool)
    peak[1:-1] = (places[1:-1] > most[:-2]) & (places[1:-1] >= ahead[2:]) & (places[1:-1] > 0)
    cuts = np.flatnonzero(peak[at]) + 1

    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * texts.powers(texts._PRIME, len(data)), out=total[1:])
    inverse = texts.powers(texts._INVERSE, len(data) + 1)
    word_starts, _, _, _ = texts.words(block, fold=False)
    begun = np.zeros(len(data) + 1, np.int64)
    begun[word_starts + 1] = 1
    np.cumsum(begun, out=begun)
    first = np.searchsorted(cuts, bounds[:-1], side="right")
    last = np.searchsorted(cuts, bounds[1:], side="left")
    for i in range(count):
        if bounds[i] == bounds[i + 1]:
            yield np.zeros(1, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
            continue
        edges = np.concatenate([[bounds[i]], cuts[first[i] : last[i]], [bounds[i + 1]]])
        if np.diff(edges).max() > LONGEST:
            edges = _cut_long(edges, data)
        size = np.diff(edges)
        digests = texts.mix((total[edges[1:]] - total[edges[:-1]]) * inverse[edges[:-1]] + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        yield edges - bounds[i], digests, np.diff(begun[edges])


def _cut_long(edges: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Further cuts, LONGEST bytes apart and before whole characters, in chunks longer than that."""
    found = [edges[:1]]
    for a, b in zip(edges[:-1], edges[1:]):
        if b - a > LONGEST:
            inner = np.arange(a + LONGEST, b, LONGEST)
            for _ in range(3):
                inner = np.where((inner < b) & ((data[np.minimum(inner, b - 1)] & 0xC0) == 0x80), inner + 1, inner)
            found.append(inner[inner < b])
        found.append([b])
    return np.concatenate(found)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.xxhash64("doc_id", "text").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def scan_chunks(docs: DataFrame) -> DataFrame:
    """row, doc_id, sizes (bytes), words and digests of all chunks of every text, in one pass."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, counts, digests = [], [], []
            for block in texts.blocks(batch.column(2)):
                for edges, found, words in chunks(block):
                    sizes.append(np.diff(edges).astype(np.int32))
                    counts.append(words.astype(np.int32))
                    digests.append(texts.signed(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32())), pa.array(digests, pa.list_(pa.int64()))],
                names=["row", "doc_id", "sizes", "words", "digests"],
            )

    return _rows(docs).mapInArrow(scan, "row long, doc_id long, sizes array<int>, words array<int>, digests array<long>")


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per repeated span: row (hash of doc_id and text), doc_id, start and end (UTF-8 bytes), n_words, first_doc_id.

    ``first_doc_id`` is the document that keeps the span's first chunk: one of smaller doc_id, or the same one earlier
    on. The first occurrence of every chunk is never part of a span, so no text is lost from the corpus. Rows of equal
    doc_id count as one document and keep what they share; a null doc_id sorts first. Null, empty and blank texts have
    no spans.
    """
    scanned = stage(scan_chunks(docs), "chunks-scan")
    place = F.coalesce("doc_id", F.lit(_FIRST)).alias("place")
    held = scanned.select("row", place, F.explode(F.array_distinct("digests")).alias("digest"))
    # A plain minimum over long keys stays a hash aggregation, combined before the shuffle.
    owners = held.groupBy("digest").agg(F.min("place").alias("owner"), F.max("place").alias("last")).where("owner < last").drop("last")
    later = held.join(owners, "digest").where("place > owner").select("row", "digest", "owner").distinct()
    known = later.groupBy("row").agg(F.collect_list("digest").alias("known"), F.collect_list("owner").alias("owners"))
    merged = scanned.join(known, "row", "left").select("row", "doc_id", "sizes", "words", "digests", "known", "owners")

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {name: [] for name in ("row", "doc_id", "start", "end", "n_words", "first_doc_id")}
            for i in range(batch.num_rows):
                digests = _values(batch, "digests", i, np.int64)
                if not len(digests):
                    continue
                _, first, where = np.unique(digests, return_index=True, return_inverse=True)
                repeats = first[where] < np.arange(len(digests))
                owner = np.full(len(digests), _FIRST)
                own = batch.column(1)[i].as_py()
                owner[repeats] = _FIRST if own is None else own
                known = _values(batch, "known", i, np.int64)
                if len(known):
                    order = np.argsort(known)
                    near = np.minimum(np.searchsorted(known[order], digests), len(known) - 1)
                    hit = known[order][near] == digests
                    owner[hit] = _values(batch, "owners", i, np.int64)[order][near][hit]
                    repeats |= hit
                if not repeats.any():
                    continue
                words = _values(batch, "words", i, np.int32)
                ends = np.cumsum(_values(batch, "sizes", i, np.int32), dtype=np.int64)
                turn = np.flatnonzero(np.diff(np.concatenate([[False], repeats, [False]]).astype(np.int8)))
                for a, b in turn.reshape(-1, 2):
                    count = int(words[a:b].sum())
                    if count >= min_words:
                        out["row"].append(batch.column(0)[i].as_py())
                        out["doc_id"].append(own)
                        out["start"].append(int(ends[a - 1]) if a else 0)
                        out["end"].append(int(ends[b - 1]))
                        out["n_words"].append(count)
                        out["first_doc_id"].append(None if owner[a] == _FIRST else int(owner[a]))
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out.values()], names=list(out))

    return merged.mapInArrow(spans, "row long, doc_id long, start long, end long, n_words long, first_doc_id long")


def _values(batch: pa.RecordBatch, name: str, i: int, kind) -> np.ndarray:
    """One list cell as numpy, without a Python object per element."""
    cell = batch.column(batch.schema.names.index(name))[i]
    return np.zeros(0, kind) if cell.values is None else cell.values.to_numpy(zero_copy_only=False).astype(kind, copy=False)


def drop_repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the repeated spans cut out of the texts; rows and all other columns stay as they are, under any name.

    Null and empty texts stay as they are; rows that repeat both doc_id and text come out equal. An empty table gives none.
    """
    row, listed = free_name(docs, "row"), free_name(docs, "cut_spans")
    cut = repeated_spans(docs, min_words).groupBy(F.col("row").alias(row)).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias(listed))
    joined = docs.withColumn(row, F.xxhash64("doc_id", "text")).join(bounded(stage(cut, "chunks-spans")), row, "left")
    schema = docs.schema

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, spans, found = batch.column(batch.schema.names.index("text")), batch.column(batch.num_columns - 1), []
            for i in range(batch.num_rows):
                value = text[i].as_py()
                if spans[i].as_py():
                    raw, at, kept = value.encode(), 0, []
                    for span in spans[i].as_py():
                        kept.append(raw[at : span["start"]])
                        at = span["end"]
                    value = b"".join([*kept, raw[at:]]).decode()
                found.append(value)
            columns = [pa.array(found, pa.string()) if name == "text" else batch.column(k) for k, name in enumerate(batch.schema.names[: len(schema)])]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], listed).mapInArrow(rewrite, schema)
