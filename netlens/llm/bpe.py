"""BPE encoding with reuse of content-defined chunks, and decoding.

A rolling hash cuts every text into chunks wherever the near text says so, inside words too, so that passages shared by
documents give the same chunks whatever stands before them. A task encodes each distinct chunk once. Only the tokens near
a cut can differ from those of the whole text: around every cut the text is encoded again, from the last place before
the cut at which the tokenizer splits under all circumstances to the first such place after it, and the window grows
until its ends are token boundaries of the chunks on both sides.

Such a place is a blank between two visible characters: byte-level BPE of this kind splits before the blank that starts
a word, and no special token holds a blank. A chunk that is new to the task is itself cut there, and the tokenizer sees
each distinct piece once, many pieces in one call; the byte lengths of the tokens tell their ids apart.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens.llm import texts
from netlens.llm.token_files import tokenizer

#: One byte in so many is a cut, on average.
CHUNK = 2048
#: Bytes of chunks and windows that a task remembers with their ids; beyond that it forgets all and starts again.
REMEMBERED = 12 << 20
#: Pieces of new chunks that a task remembers with their ids, and their bytes; beyond either it starts again.
PIECES, PIECE_BYTES = 120_000, 8 << 20
#: Pieces that go to the tokenizer as one text.
_LINE = 256
_GEAR = texts.mix(np.arange(301, 557, dtype=np.uint64)).astype(np.uint32)
_SEEN = np.zeros(256, bool)
_SEEN[0x21:0x7F] = True


def cut_places(block: texts.Block) -> np.ndarray:
    """Sorted byte positions (ends of chunks inside the block) where the gear hash of the last 16 bytes says so."""
    rolled, step = _GEAR[block.data], 1
    while step < 16:
        rolled = rolled + (np.concatenate([np.zeros(step, np.uint32), rolled[:-step]]) << np.uint32(step))
        step *= 2
    cuts = np.flatnonzero((rolled >> np.uint32(16)) % np.uint32(CHUNK) == 0) + 1
    cuts = cuts[cuts < len(block.data)]
    # Not inside a character, and only where the 16 bytes lie in one text.
    cuts = cuts[(block.data[cuts] & 0xC0) != 0x80]
    owner = np.searchsorted(block.bounds, cuts, side="right") - 1
    return cuts[cuts - block.bounds[owner] >= 16]


def split_places(block: texts.Block) -> np.ndarray:
    """Sorted byte positions of the blanks between two visible characters (ASCII, or of two bytes led by 0xC3)."""
    data = block.data
    if len(data) < 4:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(data[:-1] == 0x20)
    at = at[at >= 2]
    before = _SEEN[data[at - 1]] | (data[at - 2] == 0xC3) & (data[at - 1] >= 0x80)
    after = _SEEN[data[at + 1]] | (data[at + 1] == 0xC3)
    return at[before & after]


class ChunkEncoder:
    """Ids of whole texts by chunks; equal to what the tokenizer gives for each text as a whole."""

    def __init__(self, path: str):
        self.tokenizer, self.known, self.held = tokenizer(path), {}, 0
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        self.size = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, number in described["model"]["vocab"].items():
            self.size[number] = len(token)  # one character per byte
        for added in described["added_tokens"]:
            self.size[added["id"]] = len(added["content"].encode())
        self._forget()

    def _forget(self) -> None:
        """Start anew with the pieces: number of each, all their ids, and where the ids of each begin."""
        self.codes, self.flat, self.begin, self.piece_bytes = {}, np.zeros(0, np.uint32), np.zeros(1, np.int64), 0

    def learn(self, pieces: set[bytes]) -> None:
        fresh = [p for p in pieces if p not in self.known]
        if self.held + sum(map(len, fresh)) > REMEMBERED:
            self.known, self.held, fresh = {}, 0, list(pieces)
        self.held += sum(map(len, fresh))
        self.known.update(zip(fresh, self._by_pieces(fresh)))

    def _by_pieces(self, chunks: list[bytes]) -> list[np.ndarray]:
        """Ids of every chunk, put together from those of its pieces."""
        if not chunks:
            return []
        data, bounds = np.frombuffer(b"".join(chunks), np.uint8), np.concatenate([[0], np.cumsum([len(c) for c in chunks])])
        edges = np.concatenate([bounds, split_places(texts.Block(0, len(chunks), data, bounds))]).astype(np.int64)
        edges.sort()
        edges = edges[np.diff(edges, prepend=-1) > 0]
        column = pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(data)])
        pieces = column.dictionary_encode()
        distinct = pieces.dictionary.to_pylist()
        fresh = [piece for piece in distinct if piece not in self.codes]
        if len(self.codes) + len(fresh) > PIECES or self.piece_bytes + sum(map(len, fresh)) > PIECE_BYTES:
            self._forget()
            fresh = distinct
        joining = [_joins(piece) for piece in fresh]
        self._learn_pieces(list(compress(fresh, joining)), _LINE)
        self._learn_pieces([piece for piece, joins in zip(fresh, joining) if not joins], 1)
        codes = np.fromiter(map(self.codes.__getitem__, distinct), np.int64, len(distinct))[pieces.indices.to_numpy()]
        sizes = self.begin[codes + 1] - self.begin[codes]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.flat[np.arange(ends[-1]) + np.repeat(self.begin[codes] - ends[:-1], sizes)]
        return [part.copy() for part in np.split(ids, ends[np.searchsorted(edges, bounds[1:-1])])]

    def _learn_pieces(self, fresh: list[bytes], together: int) -> None:
        """Remember the ids of new pieces, given to the tokenizer so many at a time."""
        if not fresh:
            return
        lines = [b"".join(fresh[i : i + together]).decode() for i in range(0, len(fresh), together)]
        found = self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)
        flat = np.fromiter(chain.from_iterable(e.ids for e in found), np.uint32)
        sizes = np.array([len(piece) for piece in fresh], np.int64)
        reached, wanted = np.cumsum(self.size[flat]), np.cumsum(sizes)
        at = np.searchsorted(reached, wanted)
        if not np.array_equal(reached[at], wanted):
            raise ValueError("the tokenizer joins text across a blank between visible characters")
        self.codes.update(zip(fresh, range(len(self.codes), len(self.codes) + len(fresh))))
        self.begin = np.concatenate([self.begin, len(self.flat) + at + 1])
        self.flat = np.concatenate([self.flat, flat])
        self.piece_bytes += int(sizes.sum())

    def encode(self, block: texts.Block) -> Iterator[np.ndarray]:
        raw, cuts, splits = block.data.tobytes(), cut_places(block), split_places(block)
        plans = [self._plan(int(a), int(b), cuts, splits) for a, b in zip(block.bounds[:-1], block.bounds[1:])]
        self.learn({raw[a:b] for chunks, windows in plans for a, b in chunks + windows})
        for chunks, windows in plans:
            yield self._join(raw, chunks, windows)

    @staticmethod
    def _plan(first: int, last: int, cuts: np.ndarray, splits: np.ndarray) -> tuple[list, list]:
        """Chunks of one text, and the windows around their joins; windows that meet become one."""
        if first == last:
            return [], []
        mine = cuts[np.searchsorted(cuts, first, side="right") : np.searchsorted(cuts, last, side="left")]
        edges = [first, *mine.tolist(), last]
        places = np.concatenate([[first], splits[np.searchsorted(splits, first, side="right") : np.searchsorted(splits, last, side="left")], [last]])
        windows: list = []
        for left, right in zip(places[np.searchsorted(places, mine, side="right") - 1].tolist(), places[np.searchsorted(places, mine, side="left")].tolist()):
            if left == right:
                continue  # the cut is itself such a place: nothing to repair
            if windows and left <= windows[-1][1]:
                windows[-1] = (windows[-1][0], max(right, windows[-1][1]))
            else:
                windows.append((left, right))
        return list(zip(edges[:-1], edges[1:])), windows

    def _join(self, raw: bytes, chunks: list, windows: list) -> np.ndarray:
        """Chunk tokens outside the windows and the windows' own; a window grows where its end splits a chunk's token."""
        while True:
            parts = [(a, self._window(raw, a, b)) for a, b in windows]
            wider, at = [], 0
            for a, b in chunks:
                kept, start = [], a
                while at < len(windows) and windows[at][0] < b:
                    left, right = windows[at]
                    if left > start:
                        kept.append((start, left))
                    start = max(start, right)
                    if right > b:
                        break
                    at += 1
                if start < b:
                    kept.append((start, b))
                if kept:
                    ids = self.known[raw[a:b]]
                    edges = np.concatenate([[a], a + np.cumsum(self.size[ids])])
                for start, stop in kept:
                    low, high = np.searchsorted(edges, [start, stop])
                    if edges[low] == start and edges[high] == stop:
                        parts.append((start, ids[low:high]))
                    else:
                        wider.append((start, stop))
            if not wider:
                parts.sort(key=lambda part: part[0])
                return np.concatenate([ids for _, ids in parts]) if parts else np.zeros(0, np.uint32)
            windows = _merged(windows + wider)

    def _window(self, raw: bytes, a: int, b: int) -> np.ndarray:
        piece = raw[a:b]
        if piece not in self.known:
            self.known[piece] = np.array(self.tokenizer.encode(piece.decode(), add_special_tokens=False).ids, np.uint32)
            self.held += len(piece)
        return self.known[piece]


def _joins(piece: bytes) -> bool:
    """Whether pieces like this one can follow each other in one text: a blank, then visible from end to end."""
    return len(piece) > 2 and piece[0] == 0x20 and bool(_SEEN[piece[1]] or piece[1] == 0xC3) and bool(_SEEN[piece[-1]] or piece[-2] == 0xC3)


def _merged(windows: list) -> list:
    found: list = []
    for a, b in sorted(windows):
        if found and a <= found[-1][1]:
            found[-1] = (found[-1][0], max(b, found[-1][1]))
        else:
            found.append((a, b))
    return found


class Decoder:
    """Text of a sequence of ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        letters = _letters()
        known = {number: bytes(letters[c] for c in token) for token, number in described["model"]["vocab"].items()}
        known |= {added["id"]: added["content"].encode() for added in described["added_tokens"]}
        self.bytes = np.array([known.get(number) for number in range(max(known) + 1)], object)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(self.bytes[ids].tolist()).decode("utf-8", "replace")


def _letters() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids of every row of ``docs`` (doc_id, text; null text: empty); rows keep their number and repeat as given."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder(vocabulary)
        for batch in batches:
            for block in texts.blocks(batch.column(1)):
                found = list(encoder.encode(block))
                ends = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, len(found)), ids], names=["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(scan, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, vocabulary: str, name: str = "text") -> DataFrame:
    """``tokens`` (doc_id, ids) with the decoded text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode_ids = Decoder(vocabulary).decode
        for batch in batches:
            found = [decode_ids(ids.values.to_numpy(zero_copy_only=False)) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=["doc_id", "ids", name])

    return tokens.select("doc_id", "ids").mapInArrow(scan, f"doc_id long, ids array<int>, {name} string")


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digest_rows(doc_id: pa.Array, ids: pa.Array, decoded: list[str]) -> pa.RecordBatch:
    sums = [hashlib.sha256(each.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False).tobytes()).hexdigest() for each in ids]
    sizes = ids.value_lengths().cast(pa.int64())
    return pa.RecordBatch.from_arrays([doc_id, sizes, pa.array(sums, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of little-endian 32-bit ids), decoded_sha256 of (doc_id, ids, text)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _digest_rows(batch.column(0), batch.column(1), [hashlib.sha256(text.as_buffer()).hexdigest() for text in batch.column(2)])

    return decoded.select("doc_id", "ids", "text").mapInArrow(scan, DIGESTS)


def decoded_digests(tokens: DataFrame, vocabulary: str) -> DataFrame:
    """What ``digests`` gives for the decoded ``tokens`` (doc_id, ids), one text at a time: no decoded text is sent on."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode_ids = Decoder(vocabulary).decode
        for batch in batches:
            found = [hashlib.sha256(decode_ids(ids.values.to_numpy(zero_copy_only=False)).encode()).hexdigest() for ids in batch.column(1)]
            yield _digest_rows(batch.column(0), batch.column(1), found)

    return tokens.select("doc_id", "ids").mapInArrow(scan, DIGESTS)
