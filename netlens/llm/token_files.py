"""Token ids in ORC files: integer run-length encoded stripes with row indexes and Bloom filters on the document ids.

Documents are dealt by ranges of their id, sorted, encoded and written; so files and stripes follow each other in id
order, a reader can take any stripe alone, and both the row index (least and largest id) and the Bloom filter let it
skip stripes and row groups that lack the ids it wants.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netlens.llm import texts
from netlens.llm.common import stage

#: Pieces whose ids a Python worker remembers; beyond that it forgets all and starts again.
REMEMBERED = 600_000
#: Bytes of text that are cut into pieces at once: the more, the fewer times a frequent piece is looked up.
BLOCK = 1 << 21
ORC_OPTIONS = {
    "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": "1000",
    "orc.stripe.size": str(32 << 20), "compression": "zstd",
}
#: Stands between the pieces that are given to the tokenizer as one line; a piece that holds it is given alone.
_BETWEEN = "|"
#: Pieces of a line.
_LINE = 256
_LOADED: dict = {}
_ENCODERS: dict = {}


def tokenizer(path: str):
    """The tokenizer of a file, once per process, without truncation or padding; Spark runs the tasks in parallel."""
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        loaded = Tokenizer.from_file(path)
        loaded.no_truncation()
        loaded.no_padding()
        _LOADED[path] = loaded
    return _LOADED[path]


#: Kinds of bytes: 1 blank, 2 a-z and 0-9, 3 other printable ASCII but the apostrophe, 0 all others.
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = 3
_KIND[[0x20, 0x0A]] = 1
_KIND[[*range(0x30, 0x3A), *range(0x61, 0x7B)]] = 2
_KIND[0x27] = 0


def cut_pieces(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The pieces of all texts of a large string column without nulls, and where each text's pieces begin.

    Pieces end at blanks, line feeds and where an ASCII letter or digit meets an ASCII mark other than an apostrophe (which may begin a token).
    A-Z is lower-cased, but not in texts that may hold a special token: those are matched before case is folded, and such texts are cut at blanks only.
    """
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    letters = texts.LOWER[data]
    kind = _KIND[letters]
    for i in np.flatnonzero(pc.match_substring(column, "<|").to_numpy(zero_copy_only=False)).tolist():
        held = slice(bounds[i], bounds[i + 1])
        letters[held] = data[held]
        kind[held] = kind[held] == 1
    begins = np.ones(len(data), bool)
    begins[1:] = (kind[:-1] == 1) | ((kind[1:] ^ kind[:-1]) == 1) & (np.minimum(kind[1:], kind[:-1]) == 2)
    begins[bounds[:-1][bounds[:-1] < len(data)]] = True
    blank = kind == 1
    begins &= ~blank
    at = np.flatnonzero(begins)
    kept = letters[~blank]
    ends = np.append(at - np.searchsorted(np.flatnonzero(blank), at), len(kept))
    pieces = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(kept)])
    return pieces, np.searchsorted(at, bounds)


class PieceEncoder:
    """Ids of whole texts, put together from the ids of their pieces (``cut_pieces``).

    For tokenizers that fold case, drop white space, never join across it and part ASCII letters and digits from marks: there
    a piece has the same ids in every text, so a task encodes each distinct piece once, whatever its case or the mark
    behind it. New pieces go to the tokenizer by lines, and the token of the mark between them tells their ids apart.
    """

    def __init__(self, path: str):
        self.tokenizer, self.codes = tokenizer(path), {}
        self.between = self.tokenizer.encode(_BETWEEN, add_special_tokens=False).ids
        if len(self.between) != 1:
            raise ValueError(f"the vocabulary must have {_BETWEEN} as one token")
        self.flat, self.begin = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def encode(self, values: pa.Array | list[str]) -> Iterator[np.ndarray]:
        """Ids of every text of some (null: none)."""
        ids, bounds = self.encode_flat(values)
        for first, last in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            yield ids[first:last]

    def encode_flat(self, values: pa.Array | list[str], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: none) one after the other, each closed by ``end_id`` if given, and where each text's begin."""
        column = values.cast(pa.large_string()) if isinstance(values, pa.Array) else pa.array(values, pa.large_string())
        pieces, begin = cut_pieces(column.fill_null(""))
        pieces = pieces.dictionary_encode()
        distinct = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        fresh = [piece for piece in distinct if piece not in self.codes]
        if len(self.codes) + len(fresh) > REMEMBERED:
            fresh = distinct
            self.codes, self.flat, self.begin = {}, np.zeros(0, np.uint32), np.zeros(1, np.int64)
        if fresh:
            self._learn([piece for piece in fresh if _BETWEEN not in piece], _LINE)
            self._learn([piece for piece in fresh if _BETWEEN in piece], 1)
        codes = np.fromiter(map(self.codes.__getitem__, distinct), np.int64, len(distinct))[pieces.indices.to_numpy()]
        sizes = self.begin[codes + 1] - self.begin[codes]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.flat[np.arange(ends[-1]) + np.repeat(self.begin[codes] - ends[:-1], sizes)]
        bounds = ends[begin]
        if end_id is None:
            return ids, bounds
        return np.insert(ids, bounds[1:], np.uint32(end_id)), bounds + np.arange(len(bounds))

    def _learn(self, fresh: list[str], together: int) -> None:
        """Remember the ids of new pieces, given to the tokenizer so many at a time."""
        between = self.between if together > 1 else []
        lines = [f" {_BETWEEN} ".join(fresh[i : i + together]) for i in range(0, len(fresh), together)]
        found = self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)
        if together > 1:
            flat = np.fromiter(chain.from_iterable(chain(e.ids, between) for e in found), np.uint32)
            ends = np.flatnonzero(flat == between[0])
            sizes, flat = np.diff(ends, prepend=-1) - 1, flat[flat != between[0]]
        else:
            sizes, flat = np.array([len(e.ids) for e in found], np.int64), np.fromiter(chain.from_iterable(e.ids for e in found), np.uint32)
        self.codes.update(zip(fresh, range(len(self.codes), len(self.codes) + len(fresh))))
        self.flat = np.concatenate([self.flat, flat])
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(sizes)])


def piece_encoder(path: str) -> PieceEncoder:
    """The encoder of a Python worker: the next task of a reused worker knows its pieces already."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int) -> None:
    """Encode ``docs`` (doc_id, text; null text: empty) and write ORC files of part, place, doc_id and ids.

    ``end_id`` closes every document. ``part`` numbers the files in id order and ``place`` the documents of a file.
    Rows without doc_id come first; rows of equal doc_id follow each other in the order of a hash of their text.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, place = piece_encoder(vocabulary), 0
        for batch in batches:
            column = batch.column(2)
            for block in texts.blocks(column, BLOCK):
                flat, bounds = encoder.encode_flat(column[block.first : block.last], end_id)
                ids, count = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat.view(np.int32))), block.last - block.first
                part, doc_id = (batch.column(i).slice(block.first, count) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([part, pa.array(np.arange(place, place + count)), doc_id, ids], names=["part", "place", "doc_id", "ids"])
                place += count

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    numbered = dealt.select(F.spark_partition_id().alias("part"), "doc_id", "text")
    numbered.mapInArrow(encode, "part int, place long, doc_id long, ids array<int>").write.options(**ORC_OPTIONS).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files as a table; conditions on doc_id reach the stripes' metadata."""
    return spark.read.schema("part int, place long, doc_id long, ids array<int>").orc(path)


def token_digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it in file order), n_tokens, ids_crc32 (of little-endian 32-bit ids)."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(3)
            ids = memoryview(column.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False))
            bounds = column.offsets.to_numpy()
            sums = [zlib.crc32(ids[first:last]) for first, last in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(bounds), pa.int64()), pa.array(sums, pa.int64())], names=["part", "place", "doc_id", "n_tokens", "ids_crc32"])

    # One small row per document, read twice below; the files themselves are read once.
    rows = stage(tokens.select("part", "place", "doc_id", "ids").mapInArrow(digest, "part int, place long, doc_id long, n_tokens long, ids_crc32 long"), "tokens-digests")
    # Running totals inside each file, and over the files' totals: no window over all documents.
    inside = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    totals = totals.select("part", F.coalesce(F.sum("n").over(across), F.lit(0)).alias("offset"))
    placed = rows.withColumn("before", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(totals, "part")
    return placed.select("doc_id", (F.col("offset") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
