"""Fuzzy line dedup: MinHash over character shingles, banding, exact Jaccard test, union-find over the links.

A line is the set of its distinct GRAM-character shingles (a shorter line is one shingle). Signatures of BANDS x ROWS
minima (fast similarity sketches, see ``minima``) are cut into bands; with 20 x 6 two lines of similarity 0.8 meet in a
band with probability 0.9977, two of 0.5 with 0.27. Lines that hang together by shared buckets form a family: no two
lines of different families share a bucket. Inside a family all lines are compared with each other on their whole sets,
in cells of bounded size, so every link that banding meets is found. Of each component of links the first line of the
corpus stays: the one of smallest doc_id, then row, then line number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens.llm import cells, texts
from netlens.llm.common import bounded, free_name, stage
from netlens.llm.graph import components

#: A power of two.
GRAM = 8
PERCENT = 80
BANDS, ROWS = 20, 6
#: Bucket entries of one part on average, and lines of a batch whose entries are sent at a time.
ENTRIES, SENT = 1 << 18, 1 << 14
#: Bytes of lines that are cut into shingles at a time.
SHINGLED = 1 << 16
#: Rounds that deal the hashes of lines to their minima, lines whose minima are taken at a time, and hashes that are gone over again at a time.
ROUNDS, HELD, SPREAD = 4, 4096, 1 << 18
#: Ids of rows (8 bytes each) that are broadcast to leave out texts without near lines; if there are more, all texts are shuffled.
ASKED_ROWS = 4_000_000
_SEEDS = np.random.default_rng(20).integers(1, 1 << 32, BANDS * ROWS + ROUNDS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def cut_lines(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All lines of a string column (null: no line) in one array, and where each text's lines begin."""
    parts = pc.split_pattern(column.cast(pa.large_string()), "\n")
    counts = pc.fill_null(pc.list_value_length(parts), 0).to_numpy(zero_copy_only=False)
    return parts.flatten(), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def line_keys(lines: pa.Array) -> np.ndarray:
    """A 64-bit key per line; 0 for a blank line, which is never a duplicate."""
    found = []
    for block in texts.blocks(lines, texts.BLOCK_BYTES // 16):
        data, bounds = block.data, block.bounds
        total = np.zeros(len(data) + 1, np.uint64)
        np.multiply(data, texts.powers(texts._PRIME, len(data)), out=total[1:], dtype=np.uint64)
        np.cumsum(total, out=total)
        hashes = (total[bounds[1:]] - total[bounds[:-1]]) * texts.powers(texts._INVERSE, len(data) + 1)[bounds[:-1]]
        hashes = texts.mix(hashes + np.diff(bounds).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        hashes[hashes == 0] = 1
        full = np.flatnonzero(np.diff(bounds))
        blank = np.ones(len(hashes), bool)
        blank[full] = texts.SPACE[data[bounds[full]]]
        if blank[full].any():  # else every line begins with ink
            blank[full] = np.logical_and.reduceat(texts.SPACE[data], bounds[full])
        hashes[blank] = 0
        found.append(hashes)
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def line_shingles(lines: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per block of lines the shingle hashes of all of them and where each line's begin; every line has one at least."""
    for block in texts.blocks(lines, SHINGLED):
        begin, points = block.bounds, block.data
        if len(points) and points.max() > 127:
            points = np.frombuffer(block.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
            begin = begin - np.searchsorted(np.flatnonzero((block.data & 0xC0) == 0x80), begin)
        size, rolled = np.diff(begin), points.astype(np.uint64)
        for width in (1, 2, 4):  # of the halves that make a shingle of twice their width
            joined = rolled[: max(0, len(rolled) - width)] * texts._STEPS[width - 1]
            joined += rolled[width:]
            rolled = joined
        rolled = texts.mix(rolled)
        position, short = np.ones(len(points), bool), np.flatnonzero(size < GRAM)
        for k in range(1, GRAM):
            position[np.maximum(begin[1:] - k, 0)[size > 0]] = False
        counts = np.maximum(1, size - GRAM + 1)
        at = np.concatenate([[0], np.cumsum(counts)])
        if not len(short):
            yield rolled[position[: len(rolled)]], at
            continue
        hashes, long = np.zeros(at[-1], np.uint64), np.ones(at[-1], bool)
        long[at[short]] = False
        hashes[long] = rolled[position[: len(rolled)]]
        for k in range(GRAM - 1):
            reach = short[size[short] > k]
            hashes[at[reach]] += (points[begin[reach] + k].astype(np.uint64) + np.uint64(1)) * texts._STEPS[k]
        hashes[at[short]] = texts.mix(hashes[at[short]] + size[short].astype(np.uint64) * texts._STEPS[63])
        yield hashes, at


def band_keys(lines: pa.Array) -> np.ndarray:
    """One row of BANDS bucket keys per line."""
    return _signatures(lines)


def _signatures(lines: pa.Array) -> np.ndarray:
    """Per line a row of BANDS bucket keys."""
    found = [np.zeros((0, BANDS), np.uint64)]
    for hashes, at in line_shingles(lines):
        for i in range(0, len(at) - 1, HELD):
            cut = at[i : i + HELD + 1]
            least = minima(hashes[cut[0] : cut[-1]], cut - cut[0]).reshape(-1, BANDS, ROWS)
            bands = np.zeros((len(least), BANDS), np.uint64)
            for k in range(ROWS):
                bands += least[:, :, k] * texts._STEPS[k]
            found.append(texts.mix(bands))
    return np.concatenate(found)


def minima(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Per set (its hashes begin at ``at``) a row of BANDS * ROWS minima, each equal in two sets with their similarity as probability.

    Fast similarity sketches (Dahlgaard, Knudsen, Thorup, 2017): a round deals each hash to one minimum, and the first
    round that reaches a minimum settles it. One that no round reaches is taken over all hashes. So every minimum goes
    by one random order of all hashes, and a large set needs few rounds.
    """
    width, sizes, none = BANDS * ROWS, np.diff(at), np.uint32(0xFFFFFFFF)
    found, owner = np.full(len(sizes) * width, none), np.repeat(np.arange(len(sizes)) * width, sizes)
    high, low = (hashes >> np.uint64(32)).astype(np.uint32), hashes.astype(np.uint32)
    first, second = high, low
    for k in range(ROUNDS):
        turned = (first ^ _SEEDS[width + k]) * (second | np.uint32(1)) if k else first
        place = owner + (((turned >> np.uint32(16)) * np.uint32(width)) >> np.uint32(16))
        if k:
            free = np.flatnonzero((found == none)[place])
            np.minimum.at(found, place[free], (second[free] ^ _SEEDS[width + k]) * (first[free] | np.uint32(1)))
        else:
            np.minimum.at(found, place, second)
        open_ = (found.reshape(-1, width) == none).any(axis=1)
        if not open_.any():
            break
        if k + 1 < ROUNDS and 2 * np.count_nonzero(open_) < len(open_):
            kept = np.repeat(open_, sizes) if len(owner) == len(hashes) else open_[owner // width]
            first, second, owner = first[kept], second[kept], owner[kept]
    found = found.reshape(-1, width)
    many = np.count_nonzero(found == none, axis=1) > width // 10
    if many.any():  # short sets mostly: all of their hashes for each minimum
        kept, begin, least = np.repeat(many, sizes), np.cumsum(sizes[many]) - sizes[many], np.empty((width, np.count_nonzero(many)), np.uint32)
        first, second = high[kept], low[kept] | np.uint32(1)
        turned = np.empty_like(first)
        for k, seed in enumerate(_SEEDS[:width]):
            np.multiply(np.bitwise_xor(first, seed, out=turned), second, out=turned)
            np.minimum.reduceat(turned, begin, out=least[k])
        found[many] = np.where(found[many] == none, least.T, found[many])
    rows, columns = np.nonzero((found == none) & ~many[:, None])
    for cut in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(np.cumsum(sizes[rows]) // SPREAD)) + 1):
        row, column, count = rows[cut], columns[cut], sizes[rows[cut]]
        if len(cut):
            begin = np.cumsum(count) - count
            each = np.repeat(at[row] - begin, count) + np.arange(count.sum())
            found[row, column] = np.minimum.reduceat((high[each] ^ np.repeat(_SEEDS[column], count)) * (low[each] | np.uint32(1)), begin)
    return found


def scan_lines(docs: DataFrame) -> DataFrame:
    """row, doc_id, and of its lines keys and sizes (shingles, repeats counted)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, at = cut_lines(batch.column(2))
            at = pa.array(at.astype(np.int32))
            sizes = np.maximum(1, pc.utf8_length(lines).to_numpy(zero_copy_only=False).astype(np.int32) - (GRAM - 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(at, pa.array(texts.signed(line_keys(lines)))), pa.ListArray.from_arrays(at, pa.array(sizes, pa.int32()))],
                names=["row", "doc_id", "keys", "sizes"],
            )

    return _rows(docs).mapInArrow(scan, "row long, doc_id long, keys array<long>, sizes array<int>")


def bucket_links(docs: DataFrame, parts: int) -> DataFrame:
    """Pairs (a, b) of lines that share a bucket, enough to tell what hangs together: each line with its bucket's smallest.

    Buckets are dealt over ``parts`` by their hash. A batch of documents sends each part one row of its buckets and lines,
    so a part, which meets in one task, holds ENTRIES of them on average however many documents there are.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, _ = cut_lines(batch.column(2))
            distinct, first = np.unique(line_keys(lines), return_index=True)
            distinct, first = distinct[distinct != 0], first[distinct != 0]
            for i in range(0, len(first), SENT):
                # The band is part of the bucket's hash.
                bands = _signatures(lines.take(pa.array(first[i : i + SENT])))
                buckets = texts.mix(bands + np.arange(1, BANDS + 1, dtype=np.uint64) * texts._STEPS[ROWS]).reshape(-1)
                keys, part = np.repeat(distinct[i : i + SENT], BANDS), (buckets % np.uint64(parts)).astype(np.int32)
                order = np.argsort(part.astype(np.min_scalar_type(parts)), kind="stable")  # by digits where 16 bits hold a part
                found, begin = np.unique(part[order], return_index=True)
                at = pa.array(np.append(begin, len(order)).astype(np.int32))
                listed = [pa.ListArray.from_arrays(at, pa.array(texts.signed(x[order]))) for x in (buckets, keys)]
                yield pa.RecordBatch.from_arrays([pa.array(found), *listed], names=["part", "buckets", "keys"])

    def link(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        buckets, keys = (np.concatenate([x[k].values.to_numpy() for x in held]) for k in (0, 1))
        order = np.argsort(buckets)
        buckets, keys = buckets[order], keys[order]
        begin = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]]))
        least = np.repeat(np.minimum.reduceat(keys, begin), np.diff(np.append(begin, len(keys))))
        apart = keys != least
        least, keys = least[apart], keys[apart]
        order = np.lexsort((keys, least))
        least, keys = least[order], keys[order]
        once = np.ones(len(keys), bool)
        once[1:] = (least[1:] != least[:-1]) | (keys[1:] != keys[:-1])
        return pa.RecordBatch.from_arrays([pa.array(least[once]), pa.array(keys[once])], names=["a", "b"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for batch in batches:
            for i, number in enumerate(batch.column(0).to_pylist()):
                if number != part:
                    if held:
                        yield link(held)
                    part, held = number, []
                held.append((batch.column(1)[i], batch.column(2)[i]))
        if held:
            yield link(held)

    entries = _rows(docs).mapInArrow(scan, "part int, buckets array<long>, keys array<long>")
    return entries.repartition("part").sortWithinPartitions("part").mapInArrow(meet, "a long, b long").distinct()


def line_links(docs: DataFrame, scanned: DataFrame) -> DataFrame:
    """Edges (a, b) between different lines whose components are those of all links within families."""
    lines = scanned.agg(F.sum(F.array_size("keys"))).first()[0] or 0
    links = bucket_links(docs, lines * BANDS // ENTRIES + 1)
    families = stage(components(links, "lines-families").select(F.col("node").alias("key"), F.col("root").alias("family")), "lines-families")
    each = scanned.select("row", F.explode(F.arrays_zip("keys", "sizes")).alias("e")).select("row", F.col("e.keys").alias("key"), F.col("e.sizes").alias("size"))
    members = each.join(families, "key").groupBy("key", "family").agg(F.min("row").alias("row"), F.max("size").alias("size"))
    placed = cells.dealt(stage(members, "lines-members")).select("row", F.struct("key", "family", "blocks", "block").alias("line"))
    # One list per row of the documents: as long as that document has lines.
    asked = stage(placed.groupBy("row").agg(F.collect_list("line").alias("asked")), "lines-asked")
    rows = _rows(docs)
    if asked.count() <= ASKED_ROWS:  # so that texts without such lines are not shuffled
        rows = rows.join(F.broadcast(asked.select("row")), "row", "left_semi")
    rows = rows.join(asked, "row").select("text", "asked")

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, at = cut_lines(batch.column(0))
            keys = texts.signed(line_keys(lines))
            line, begin = batch.column(1).flatten(), np.concatenate([[0], np.cumsum(batch.column(1).value_lengths().to_numpy())])
            wanted, take = line.field("key").to_numpy(), np.zeros(len(line), np.int64)
            for i in range(batch.num_rows):
                distinct, first = np.unique(keys[at[i] : at[i + 1]], return_index=True)
                take[begin[i] : begin[i + 1]] = at[i] + first[np.searchsorted(distinct, wanted[begin[i] : begin[i + 1]])]
            yield pa.RecordBatch.from_arrays(
                [lines.take(pa.array(take)).cast(pa.string()), line.field("key"), line.field("family"), pa.array(np.ones(len(take), np.int64)), line.field("blocks"), line.field("block")],
                names=["found", "key", "family", "held", "blocks", "block"],
            )

    def sets(column: pa.Array) -> Iterator[np.ndarray]:
        for hashes, begin in line_shingles(column.cast(pa.large_string())):
            for a, b in zip(begin[:-1], begin[1:]):
                found = np.sort(hashes[a:b])
                yield found[np.concatenate([[True], found[1:] != found[:-1]])]

    # Lines go to their cells as text, an eighth of their shingles and less.
    found = cells.compared(rows.mapInArrow(chosen, "found string, key long, family long, held long, blocks int, block int"), PERCENT, sets)
    return stage(found.where("b is not null").select("a", "b"), "lines-links")


def repeated_lines(docs: DataFrame) -> DataFrame:
    """row (hash of doc_id and text), lines: the numbers (from 0) of the lines of that row that repeat an earlier line."""
    scanned = stage(scan_lines(docs), "lines-scan")
    links = line_links(docs, scanned)
    roots = components(links, "lines-components").select(F.col("node").alias("key"), "root")
    held = scanned.select("row", "doc_id", F.posexplode("keys").alias("line", "key")).where("key <> 0")
    place = F.struct("doc_id", "row", "line")
    # Per line first, so that the look-up of its component has one row per line however often the line occurs.
    first = held.groupBy("key").agg(F.min(place).alias("place"), F.count("*").alias("times")).join(roots, "key", "left")
    first = first.withColumn("root", F.coalesce("root", "key"))
    whole = first.groupBy("root").agg(F.min("place").alias("kept"), F.sum("times").alias("times")).where("times > 1")
    repeated = stage(first.join(whole.drop("times"), "root").select("key", "kept"), "lines-repeated")
    gone = held.join(repeated, "key").where(~F.struct("doc_id", "row", "line").eqNullSafe(F.col("kept")))
    return gone.groupBy("row").agg(F.collect_set("line").alias("lines"))


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the text of each row cut down to its lines that repeat no earlier one, and n_removed, n_lines.

    Lines end at LF; blank lines stay. Null texts stay null (no lines), empty ones empty. A row whose lines all go stays
    with an empty text. Rows that repeat both doc_id and text count as one, and come out equal; a null doc_id sorts
    first. Columns of ``docs`` other than doc_id and text pass through, under any name; a column ``n_removed`` or ``n_lines`` of its
    own is kept and not added a second time. An empty table gives none.
    """
    row, lines = free_name(docs, "row"), free_name(docs, "gone_lines")
    gone = stage(repeated_lines(docs), "lines-gone").select(F.col("row").alias(row), F.col("lines").alias(lines))
    named = docs.withColumn(row, F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))).join(bounded(gone), row, "left")
    parts = F.split("text", "\n", -1)
    left = F.filter(parts, lambda line, at: ~F.array_contains(F.col(lines), at))
    cut = F.when(F.col(lines).isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    added = {"n_removed": F.coalesce(F.array_size(F.col(lines)), F.lit(0)), "n_lines": F.coalesce(F.array_size(parts), F.lit(0))}
    return named.select(
        *[cut.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns],
        *[value.cast("long").alias(name) for name, value in added.items() if name not in docs.columns],
    )
