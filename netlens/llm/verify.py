"""Exact Jaccard test of candidate pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens.llm.common import BROADCAST_ROWS, bounded, stage

#: Partners of one item that go in one list; an item with more has several lists.
PARTNERS = 4096
SIDES = "a long, b long, key long, payload binary"


def asked_of(pairs: DataFrame, places: DataFrame) -> DataFrame:
    """row, pairs: which pairs (a, b) need an item that ``places`` (key, row) finds in that row.

    One row per row, and more for a row whose item has very many pairs.
    """
    each = pairs.select(F.col("a").alias("key"), "a", "b").union(pairs.select(F.col("b").alias("key"), "a", "b"))
    lists = each.groupBy("key").agg((F.floor(F.count("*") / PARTNERS) + 1).alias("lists"))
    found = each.join(places.join(lists, "key"), "key").groupBy("row", F.pmod(F.xxhash64("a", "b"), F.col("lists")).alias("part"))
    return found.agg(F.collect_list(F.struct("key", "a", "b")).alias("pairs")).drop("part")


def asked_rows(pairs: DataFrame, places: DataFrame, label: str) -> DataFrame:
    """``asked_of`` as a table; broadcast only if the pairs, which its lists hold, are few."""
    asked, most = stage(asked_of(pairs, places), label), 2 * BROADCAST_ROWS
    return bounded(asked) if pairs.limit(most + 1).count() <= most else asked


def sides_for(pairs: pa.Array, payloads: dict[int, bytes]) -> pa.RecordBatch:
    """Rows (a, b, key, payload) of some rows' pairs, for the keys that were found there."""
    struct = pairs.values if isinstance(pairs, pa.ListScalar) else pairs.flatten()
    keys, a, b = (struct.field(name).to_pylist() for name in ("key", "a", "b"))
    kept = [i for i, key in enumerate(keys) if key in payloads]
    return pa.RecordBatch.from_arrays(
        [*[pa.array([x[i] for i in kept], pa.int64()) for x in (a, b, keys)], pa.array([payloads[keys[i]] for i in kept], pa.binary())],
        names=["a", "b", "key", "payload"],
    )


def meet(sides: DataFrame, prepare: Callable[[pa.Array], Iterable], test: Callable[[object, object], bool]) -> DataFrame:
    """The pairs (a, b) whose two prepared payloads pass the test.

    ``sides`` holds a row (a, b, key, payload) for each end of a pair, or several if the data repeats rows. The ends meet
    by one shuffle on the pair, which no single item dominates, and only two payloads are held at a time.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, first, held = None, None, None
        for batch in batches:
            a, b, key, kept = *[batch.column(i).to_numpy() for i in range(3)], []
            for i, value in enumerate(prepare(batch.column(3))):
                if (a[i], b[i]) != before:
                    before, first, held = (a[i], b[i]), key[i], value
                elif held is not None and key[i] != first:
                    if test(held, value):
                        kept.append(i)
                    held = None  # settled: further rows of the pair are repeats
            yield batch.select([0, 1]).take(pa.array(kept, pa.int64()))

    return sides.repartition("a", "b").sortWithinPartitions("a", "b", "key").mapInArrow(scan, "a long, b long")


def jaccard_test(percent: int) -> Callable[[np.ndarray, np.ndarray], bool]:
    """100 * intersection >= percent * union, for sorted distinct arrays; empty sets never link."""

    def test(p: np.ndarray, q: np.ndarray) -> bool:
        least, most = sorted((len(p), len(q)))
        if 100 * least < percent * most:
            return False
        joined = np.concatenate([p, q])
        joined.sort()
        common = int(np.count_nonzero(joined[1:] == joined[:-1]))
        return common > 0 and 100 * common >= percent * (len(joined) - common)

    return test


def parity(found: np.ndarray) -> bytes:
    """Size of the set, and a bitmap of two to four bits per element: whether an odd number of elements fall on each bit."""
    bits = 1 << max(6, (2 * len(found) - 1).bit_length())
    odd = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return len(found).to_bytes(8, "little") + np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def parities(column: pa.Array) -> Iterator[np.ndarray]:
    for payload in column:
        yield np.frombuffer(payload.as_buffer(), np.uint64)


def parity_test(percent: int) -> Callable[[np.ndarray, np.ndarray], bool]:
    """Whether two sets may reach the threshold: each odd bit of the joined bitmaps is an element that one set lacks."""

    def test(p: np.ndarray, q: np.ndarray) -> bool:
        total, (p, q) = int(p[0]) + int(q[0]), sorted((p[1:], q[1:]), key=len)
        while len(q) > len(p):
            q = q[: len(q) // 2] ^ q[len(q) // 2 :]
        apart = int(np.bitwise_count(p ^ q).sum())
        return 100 * (total - apart) >= percent * (total + apart)

    return test
