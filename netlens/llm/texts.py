"""Whole texts as flat byte arrays: words, hashes and n-grams of many documents at once with numpy.

An Arrow string column holds all its texts in one buffer. The functions here work on such a buffer in blocks of
half a megabyte, so that memory is bounded by the block (or by the longest single text), not by the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 19
_PRIME = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_PRIME, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass
class Block:
    """Rows ``first`` to ``last`` of a batch: their bytes and the position of each text in them."""

    first: int
    last: int
    data: np.ndarray
    bounds: np.ndarray


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a string or large binary column (null: empty) into blocks of whole texts."""
    if not len(column):
        return
    if not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_string())
    column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1)
        last = min(last, len(column))
        yield Block(first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def mix(values: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: every input bit reaches every output bit."""
    turned = values >> np.uint64(30)
    turned ^= values
    turned *= np.uint64(0xBF58476D1CE4E5B9)
    other = turned >> np.uint64(27)
    turned ^= other
    turned *= np.uint64(0x94D049BB133111EB)
    np.right_shift(turned, np.uint64(31), out=other)
    turned ^= other
    return turned


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, count: int) -> np.ndarray:
    """``base`` to the powers 0 to count - 1, modulo 2^64."""
    known = _POWERS.get(base)
    if known is None or len(known) < count:
        known = np.full(max(count, BLOCK_BYTES + 1), base, np.uint64)
        known[0] = 1
        np.multiply.accumulate(known, out=known)
        if count <= 4 * BLOCK_BYTES:
            _POWERS[base] = known
    return known[:count]


def words(block: Block, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the block, split at ASCII white space: starts, ends, 64-bit hashes, and where each text's words begin.

    ``fold`` lower-cases A-Z. Equal words have equal hashes wherever they stand.
    """
    data, bounds = block.data, block.bounds
    inside = ~SPACE[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    cuts = bounds[(bounds > 0) & (bounds < len(data))]
    before[cuts] = False
    after[cuts - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    letters = LOWER[data] if fold else data
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((letters.astype(np.uint64) + np.uint64(1)) * powers(_PRIME, len(data)), out=total[1:])
    hashes = (total[ends] - total[starts]) * powers(_INVERSE, len(data) + 1)[starts]
    hashes = mix(hashes + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return starts, ends, hashes, np.searchsorted(starts, bounds)


_STEPS = [np.uint64(pow(0xA0761D6478BD642F, k + 1, 1 << 64) | 1) for k in range(64)]


def sequence_hash(hashes: np.ndarray) -> np.uint64:
    """One hash for a whole sequence of word hashes, its length included."""
    with np.errstate(over="ignore"):
        turned = hashes * powers(_PRIME, len(hashes))
        return mix(np.array([turned.sum(dtype=np.uint64) + np.uint64(len(hashes)) * _STEPS[63]], np.uint64))[0]


def shingles(block: Block, width: int) -> Iterator[np.ndarray]:
    """Per text, the sorted distinct hashes of its ``width``-word shingles; the whole sequence if it has fewer words."""
    _, _, hashes, at = words(block)
    rolled = np.zeros(0, np.uint64)
    if len(hashes) >= width:
        rolled = sum((hashes[k : len(hashes) - width + 1 + k] * _STEPS[k] for k in range(width)), np.uint64(0))
        rolled = mix(rolled)
    for i in range(len(at) - 1):
        first, last = at[i], at[i + 1]
        if last - first >= width:
            yield np.unique(rolled[first : last - width + 1])
        elif last > first:
            yield np.array([sequence_hash(hashes[first:last])], np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def byte_grams(block: Block, width: int, fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``width`` bytes at each position of the block, and for each text the end of its valid positions."""
    data = (LOWER[block.data] if fold else block.data).astype(np.uint64)
    count = max(0, len(data) - width + 1)
    rolled = np.zeros(count, np.uint64)
    for k in range(width):
        rolled += data[k : k + count] << np.uint64(8 * k) if width <= 8 else data[k : k + count] * _STEPS[k]
    return mix(rolled), np.maximum(block.bounds[:-1], block.bounds[1:] - width + 1)


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)
