"""Spelling variant grouping: words one edit apart, found through a variable-length gram index.

* Gram dictionary: grams of LEAST code points always count; of the longer ones, up to MOST, the GRAMS most frequent over
  the distinct words belong to the dictionary, so its size is bounded whatever the input is.
* A word is cut into one variable gram per position: the longest dictionary gram that starts there.
* An edit changes few of them. ``decompose`` counts, for every place and kind of edit, the grams that contain the place or
  that could become longer across it, so two words one edit apart share at least (grams - affected) of either word's
  grams, those before the edit at the same distance from the start and those behind it at the same distance from the end.
* List merging: only a word's rarest (affected + 1) grams are looked up, as the shared ones cannot all lie outside them;
  rarity is a property of the gram alone, so that two words agree on which of their shared grams is the rarest;
  for the candidates all grams are then merged against the larger of the two bounds, and the edit distance decides.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlens.llm import texts
from netlens.llm.common import Stage, stage

#: Shortest and longest gram, and entries of the dictionary (some 5 MB at most).
LEAST, MOST, GRAMS = 2, 4, 1 << 16
#: A word counts from so many code points and occurrences on; a form is so many times as frequent as its variant.
LENGTH, TIMES, RATIO = 6, 5, 5
#: One in so many words of a document loses a code point.
EVERY = 199
#: Bytes of text that a task takes at once, or one text if that is longer.
BLOCK = 1 << 19


# ---- words of documents ----------------------------------------------------------------------------------------------


def runs(block: texts.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF: starts, ends (in bytes), and the text of each."""
    data = block.data
    plain = ((data | 0x20) >= 97) & ((data | 0x20) <= 122)
    lead = np.zeros(len(data), bool)
    lead[:-1] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] < 0xC0)
    inside = plain | lead
    inside[1:] |= lead[:-1]
    bounds = block.bounds
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    joined = inner[inside[inner] & inside[inner - 1]]  # a run ends with its text
    before = np.concatenate([[False], inside])
    starts = np.flatnonzero(before[1:] & ~before[:-1])
    after = np.concatenate([inside, [False]])
    ends = np.flatnonzero(after[:-1] & ~after[1:]) + 1
    starts, ends = np.union1d(starts, joined), np.union1d(ends, joined)
    return starts, ends, np.searchsorted(bounds, starts, side="right") - 1


def _shift_tables(lengths: np.ndarray) -> dict[int, np.ndarray]:
    """For each length, the 4 x 256 table that takes a CRC-32 past so many bytes: crc(a + b) = shift(crc(a)) ^ crc(b)."""
    tables, state = {}, np.array([[1 << bit for bit in range(32)]], np.uint64).reshape(32).astype(np.uint32)
    wanted, top = set(lengths.tolist()), int(lengths.max()) if len(lengths) else 0
    for length in range(1, top + 1):
        state = (state >> np.uint32(8)) ^ _CRC_TABLE[state & np.uint32(0xFF)]
        if length in wanted:
            table = np.zeros((4, 256), np.uint32)
            for byte in range(4):
                for bit in range(8):
                    table[byte, (np.arange(256) >> bit) & 1 == 1] ^= state[8 * byte + bit]
            tables[length] = table
    return tables


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


_CRC_TABLE = _crc_table()
_SHIFTS: dict[int, np.ndarray] = {}


def shifted(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 values carried past ``lengths`` bytes."""
    missing = np.setdiff1d(lengths, np.fromiter(_SHIFTS, int, len(_SHIFTS)))
    if len(missing):
        _SHIFTS.update(_shift_tables(missing))
    result = np.empty_like(crc)
    for length in np.unique(lengths):
        at, t = lengths == length, _SHIFTS[int(length)]
        c = crc[at]
        result[at] = t[0][c & 255] ^ t[1][(c >> 8) & 255] ^ t[2][(c >> 16) & 255] ^ t[3][c >> 24]
    return result


def block_words(block: texts.Block, ids: list[int | None]) -> tuple[list[str], list[int]]:
    """The words of a block's texts and their counts, after the deletions; those under LENGTH code points left out."""
    starts, ends, owner = runs(block)
    if not len(starts):
        return [], []
    folded = texts.LOWER[block.data]
    lead = np.concatenate([[0], np.cumsum(folded == 0xC3)])
    size = ends - starts
    points = size - (lead[ends] - lead[starts])
    keep = points >= LENGTH
    starts, ends, owner, size, points = starts[keep], ends[keep], owner[keep], size[keep], points[keep]
    if not len(starts):
        return [], []
    total = np.zeros(len(folded) + 1, np.uint64)
    np.cumsum((folded.astype(np.uint64) + np.uint64(1)) * texts.powers(texts._PRIME, len(folded)), out=total[1:])
    hashes = (total[ends] - total[starts]) * texts.powers(texts._INVERSE, len(folded) + 1)[starts]
    hashes = texts.mix(hashes + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    raw = folded.tobytes()
    names = [raw[starts[i] : ends[i]] for i in first]
    own = np.array([zlib.crc32(name) for name in names], np.uint32)
    # Each distinct word of each text gets its check sum from the sums of its two parts.
    pair, times = np.unique(owner.astype(np.int64) * len(distinct) + which, return_counts=True)
    document, word = pair // len(distinct), pair % len(distinct)
    heads = np.array([zlib.crc32(b"%s:" % (b"" if i is None else str(i).encode())) for i in ids], np.uint32)
    crc = shifted(heads[document], size[first][word]) ^ own[word]
    hit = crc % EVERY == 0
    counts = np.bincount(word[~hit], times[~hit], len(distinct)).astype(np.int64)
    found = [(names[i].decode(), int(counts[i])) for i in np.flatnonzero(counts)]
    for w, c, n in zip(word[hit], crc[hit], times[hit]):
        text = names[w].decode()
        at = int(c) % len(text)
        if len(text) > LENGTH:
            found.append((text[:at] + text[at + 1 :], int(n)))
    return [w for w, _ in found], [n for _, n in found]


def words(docs: DataFrame) -> DataFrame:
    """word, n: the words that count, over the whole texts of ``docs`` (doc_id, text).

    Null and empty texts have none. A null id stands as the empty text in front of the colon. Repeated rows count again.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for block in texts.blocks(batch.column(1), BLOCK):
                found, counts = block_words(block, ids[block.first : block.last])
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(counts, pa.int64())], names=["word", "n"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(scan, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= TIMES)


# ---- the gram index --------------------------------------------------------------------------------------------------


def dictionary(found: DataFrame, size: int = GRAMS) -> list[str]:
    """The ``size`` most frequent grams of more than LEAST and up to MOST code points (ties: shorter, then smaller first).

    A prefix is at least as frequent as the gram and comes before it, so the dictionary holds every longer prefix of its entries.
    """
    starts = F.sequence(F.lit(1), F.length("word") - F.lit(LEAST))
    sizes = F.sequence(F.lit(LEAST + 1), F.lit(MOST))
    places = F.flatten(F.transform(starts, lambda p: F.transform(sizes, lambda k: F.struct(p.alias("p"), k.alias("k")))))
    spots = found.select("word", F.explode(places).alias("s")).where(F.col("s.p") + F.col("s.k") - 1 <= F.length("word"))
    rows = spots.select(F.substring("word", F.col("s.p"), F.col("s.k")).alias("gram"))
    counted = rows.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    return sorted(r["gram"] for r in counted.orderBy(F.desc("n"), F.length("gram"), "gram").limit(size).select("gram").collect())


class Cutter:
    """Variable grams of words, and how many of them one edit can affect."""

    def __init__(self, entries: list[str]):
        self.entries = set(entries)
        self.prefixes = {e[:k] for e in entries for k in range(1, len(e))}

    def decompose(self, word: str) -> tuple[list[str], int]:
        """One gram per position, and the largest number of them that an insertion, deletion or replacement affects."""
        last = len(word) - LEAST
        grams = []
        for p in range(last + 1):
            size = LEAST
            for k in range(min(MOST, len(word) - p), LEAST, -1):
                if word[p : p + k] in self.entries:
                    size = k
                    break
            grams.append(word[p : p + size])
        changed, between = [0] * len(word), [0] * (len(word) + 1)  # by a place that is replaced or deleted, by a gap that is filled
        for p, gram in enumerate(grams):
            end = p + len(gram)
            for i in range(p, len(word)):  # place i: inside the gram, or the text up to it begins a longer entry
                if i < end or word[p:i] in self.prefixes:
                    changed[i] += 1
                elif i - p >= MOST:
                    break
            for i in range(p + 1, len(word) + 1):
                if i < end or word[p:i] in self.prefixes:
                    between[i] += 1
                elif i - p >= MOST:
                    break
        return grams, max(*changed, *between)


def index(found: DataFrame, entries: list[str]) -> DataFrame:
    """word, n, length, grams (by position), affected."""
    shared = found.sparkSession.sparkContext.broadcast(entries)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(shared.value)
        for batch in batches:
            cut = [cutter.decompose(w) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([len(g) + LEAST - 1 for g, _ in cut], pa.int32()), pa.array([g for g, _ in cut], pa.list_(pa.string())), pa.array([a for _, a in cut], pa.int32())],
                names=["word", "n", "length", "grams", "affected"],
            )

    return found.select("word", "n").mapInArrow(scan, "word string, n long, length int, grams array<string>, affected int")


def near_words(indexed: DataFrame) -> DataFrame:
    """a, n_a, b, n_b: every ordered pair of words exactly one edit apart.

    A shared gram has the same place from the start or from the end of both words, so (gram, side, place) is the list's key.
    A gram's weight is the number of words in its longest list, wherever it stands. A word's prefix are its affected + 1 lightest
    positions in the order of (weight, gram), and all others with the gram of the last of them: the first gram in that order that
    two near words share is then in the prefixes of both, at every place they have it.
    """
    spots = indexed.select("word", "n", "length", "affected", F.posexplode("grams").alias("p", "gram"))
    spots = spots.select("word", "n", "length", "affected", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"), "p", "gram").select(
        "word", "n", "length", "affected", "side", "p", "gram", F.when(F.col("side") == 0, F.col("p")).otherwise(F.col("length") - F.col("p")).alias("place")
    )
    lists = spots.groupBy("gram", "side", "place").agg(F.count(F.lit(1)).alias("held"))
    weights = lists.join(lists.groupBy("gram").agg(F.max("held").alias("weight")), "gram")
    weighted = spots.join(weights, ["gram", "side", "place"]).groupBy("word", "n", "length", "affected").agg(
        F.collect_list(F.struct("weight", "gram", "p", "side", "place", "held")).alias("spots")
    )
    # Positions, not spots, are counted: each has a spot of either side.
    positions = F.expr("array_sort(transform(filter(spots, s -> s.side = 0), s -> struct(s.weight AS weight, s.gram AS gram)))")
    kept = weighted.withColumn("last", F.element_at(positions, F.col("affected") + 1))
    chosen = F.filter("spots", lambda s: (F.struct(s["weight"].alias("weight"), s["gram"].alias("gram")) <= F.col("last")) & (s["held"] > 1))
    prefix = stage(
        kept.select("word", "n", "length", F.explode(chosen).alias("s")).select(
            "word", "n", "length", F.col("s.gram").alias("gram"), F.col("s.side").alias("side"), F.col("s.place").alias("place")
        ),
        "spelling-prefixes",
    )
    left = prefix.select("gram", "side", "place", F.col("word").alias("a"), F.col("length").alias("length_a"))
    right = prefix.select("gram", "side", "place", F.col("word").alias("b"), F.col("length").alias("length_b"))
    candidates = left.join(right, ["gram", "side", "place"]).where((F.col("a") < F.col("b")) & (F.abs(F.col("length_a") - F.col("length_b")) <= 1))
    pairs = candidates.select("a", "b").distinct()
    one = indexed.select(F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("grams").alias("grams_a"), F.col("affected").alias("affected_a"))
    two = indexed.select(F.col("word").alias("b"), F.col("n").alias("n_b"), F.col("grams").alias("grams_b"), F.col("affected").alias("affected_b"))
    both = pairs.join(one, "a").join(two, "b")
    bound = F.greatest(F.size("grams_a") - F.col("affected_a"), F.size("grams_b") - F.col("affected_b"))
    near = both.where((_merged("grams_a", "grams_b") >= bound) & (F.levenshtein("a", "b", 1) == 1)).select("a", "n_a", "b", "n_b")
    return near.union(near.select("b", "n_b", "a", "n_a"))


def _merged(a: str, b: str) -> Column:
    """Positions of ``a`` whose gram stands in ``b`` at the same distance from the start or from the end."""
    shift = f"size({b}) - size({a})"
    start = f"(i < size({b}) AND get({b}, i) = get({a}, i))"
    end = f"(i + {shift} >= 0 AND get({b}, i + {shift}) = get({a}, i))"
    return F.expr(f"size(filter(sequence(0, size({a}) - 1), i -> coalesce({start}, false) OR coalesce({end}, false)))")


def group_variants(docs: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n, root for every word of ``docs`` (doc_id, text). Without words, no rows."""
    known = Stage(words(docs), "spelling-words").frame
    indexed = stage(index(known, dictionary(known)), "spelling-index")
    near = near_words(indexed)
    best = near.groupBy(F.col("a").alias("word")).agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("least"), F.col("b").alias("b"))).alias("best")
    )
    joined = known.join(best, "word", "left")
    large = -F.col("best.least") >= RATIO * F.col("n")
    forms = Stage(
        joined.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(large, F.col("best.b")).alias("form"), F.when(large, -F.col("best.least")).alias("form_n")
        ),
        "spelling-forms",
    ).frame
    return forms.join(roots(forms), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def roots(forms: DataFrame) -> DataFrame:
    """word, root for every word with a form: where following forms ends. Each round doubles the steps (pointer jumping).

    A form is RATIO times as frequent as its word, so a path has no circle and at most log n steps.
    """
    now = Stage(forms.where("form is not null").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = now.frame.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = now.frame.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        following = Stage(jumped, "spelling-roots")
        now.drop()
        now = following
        if not now.frame.where("moved").limit(1).count():
            return now.frame.select("word", "root")
        trimmed = Stage(now.frame.select("word", "root"), "spelling-roots")
        now.drop()
        now = trimmed
