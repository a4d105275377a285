"""All-with-all comparison of the members of families of sets, without rows of pairs.

A family of any size is dealt over blocks of bounded size; each pair of blocks is a cell, so a member goes to as many
cells as its family has blocks, and no task holds more than two blocks. A cell counts all intersections by matrix
products and returns only how many links each member has there and what hangs together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements and members of one block of a family, on average, and elements that a cell counts at once.
BLOCK_ELEMENTS, BLOCK_MEMBERS, COLUMNS = 1 << 18, 256, 1 << 12
#: Members that small cells of one block gather before they are compared by one call.
GATHERED = 32


def dealt(members: DataFrame) -> DataFrame:
    """``members`` (key, family, size, ...) of families of two or more, with ``blocks`` of the family and the member's ``block``."""
    totals = members.groupBy("family").agg(F.sum("size").alias("total"), F.count("*").alias("count")).where("count > 1")
    blocks = F.greatest(F.floor(F.col("total") / BLOCK_ELEMENTS), F.floor(F.col("count") / BLOCK_MEMBERS)).cast("int") + 1
    placed = members.join(totals.select("family", blocks.alias("blocks")), "family")
    return placed.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))


def _sets(column: pa.Array) -> Iterator[np.ndarray]:
    for payload in column:
        yield np.frombuffer(payload.as_buffer(), np.uint64)


def compared(sets: DataFrame, percent: int, prepare: Callable[[pa.Array], Iterable[np.ndarray]] = _sets) -> DataFrame:
    """(a, b, links, rows) from rows (found: a sorted set as bytes, or what ``prepare`` makes sets of, key, family, held, blocks, block).

    With b null: the links of member a found in a cell, and the rows (``held``) they stand for. Else a and b hang together.
    """
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    cells = sets.select("family", "key", "held", "block", "found", other).select(
        "family", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "key", "held", "block", "found"
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, members = None, {}
        small: list[dict] = []

        def closed() -> Iterator[pa.RecordBatch]:
            if len(members) > 1 and cell[1] == cell[2] and len(members) <= GATHERED:
                small.append(members)
                if sum(map(len, small)) >= GATHERED:
                    yield family_links(small, percent)
                    small.clear()
            elif len(members) > 1:
                yield cell_links(members, cell[1] == cell[2], percent)

        for batch in batches:
            rows = zip(*[batch.column(k).to_pylist() for k in range(6)])
            for (family, i, j, *row), found in zip(rows, prepare(batch.column(6))):
                if (family, i, j) != cell:
                    yield from closed()
                    cell, members = (family, i, j), {}
                if row[0] not in members:  # else a repeated row
                    members[row[0]] = (row[1], row[2], found)
        yield from closed()
        if small:
            yield family_links(small, percent)

    return cells.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "key").mapInArrow(compare, "a long, b long, links long, rows long")


def family_links(cells: list[dict[int, tuple[int, int, np.ndarray]]], percent: int) -> pa.RecordBatch:
    """The links of several whole cells by one call: members of different cells have nothing to do with each other."""
    members = {key: m for cell in cells for key, m in cell.items()}
    return cell_links(members, True, percent, np.repeat(np.arange(len(cells)), [len(cell) for cell in cells]))


def cell_links(members: dict[int, tuple[int, int, np.ndarray]], whole: bool, percent: int, cells: np.ndarray | None = None) -> pa.RecordBatch:
    """Links between the members (key: rows of the class, block, sorted set) of a cell: all of one block (``whole``), or those of different blocks.

    ``cells`` tells members of several cells apart; only those of one cell link.
    """
    keys = np.array(list(members), np.int64)
    weights, blocks = (np.array([m[k] for m in members.values()], np.int64) for k in (0, 1))
    sets = [m[2] for m in members.values()]
    sizes = np.array([len(x) for x in sets], np.float64)
    _, which = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes.astype(int))
    one = np.ones(len(sets), bool) if whole else blocks == blocks[0]
    other = one if whole else ~one
    # Shingles of one member, or of one block if the other is to be compared with it, count for sizes only.
    times = [np.bincount(which[side[owner]], minlength=int(which.max(initial=-1)) + 1) for side in ((one,) if whole else (one, other))]
    met = times[0] > 1 if whole else (times[0] > 0) & (times[1] > 0)
    shared = met[which]
    column = (np.cumsum(met) - 1)[which[shared]]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[shared][order]
    counted = np.zeros((int(one.sum()), int(other.sum())), np.float32)
    for begin in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        cut = slice(*np.searchsorted(column, (begin, begin + COLUMNS)))
        matrix = np.zeros((len(sets), min(COLUMNS, int(column[-1]) + 1 - begin)), np.float32)
        matrix[owner[cut], column[cut] - begin] = 1
        counted += matrix @ matrix.T if whole else matrix[one] @ matrix[other].T
    common = np.zeros((len(sets), len(sets)), np.float64)
    common[np.ix_(one, other)] = counted
    if not whole:
        common[np.ix_(other, one)] = counted.T
    link = (common > 0) & (100 * common >= percent * (sizes[:, None] + sizes[None, :] - common))
    np.fill_diagonal(link, False)
    if cells is not None:
        link &= cells[:, None] == cells[None, :]
    if not whole:
        link &= blocks[:, None] != blocks[None, :]
    label = np.arange(len(sets))
    while True:  # the smallest member that links reach
        least = np.minimum(label, np.where(link, label[None, :], len(sets)).min(axis=1))
        least = least[least]
        if (least == label).all():
            break
        label = least
    linked, moved = link.any(axis=1), label != np.arange(len(sets))
    none = pa.nulls(int(linked.sum()), pa.int64())
    zero = np.zeros(int(moved.sum()), np.int64)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([keys[linked], keys[moved]])), pa.concat_arrays([none, pa.array(keys[label[moved]])]),
            pa.array(np.concatenate([link.sum(axis=1)[linked], zero])), pa.array(np.concatenate([(link @ weights)[linked], zero])),
        ],
        names=["a", "b", "links", "rows"],
    )
