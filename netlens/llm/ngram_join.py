"""Jaccard self-join of documents on word n-grams, by adaptive multi-match prefixes.

Every document is the set of its distinct word shingles, in one global order: common shingles last. Two sets with
Jaccard t or more share at least m of the first ``n - ceil(t n) + m`` elements of each, for every m. A document picks
its own m: it lengthens its prefix (and with it the number of shared prefix elements that a partner must have) as long
as that lowers its estimated cost, which is list entries scanned plus candidates left to verify. A pair needs the
smaller of its two m. What is left is verified exactly.

Exact copies (equal shingle sequences) become one class first. Groups of near copies are not expanded into rows of pairs:
classes that often meet the same central class in their prefix lists form a family, and a family's members are compared
with each other, all with all, in cells of bounded size: a cell holds two blocks of sets, counts all intersections by
matrix products and returns only how many links each member has and what hangs together. Pairs of different families
come from the prefix lists and are verified one by one. So every link is found and counted, whichever way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netlens.llm import cells, texts
from netlens.llm.common import Stage, bounded, free_name, stage
from netlens.llm.graph import components
from netlens.llm.verify import SIDES, asked_rows, jaccard_test, meet, parities, parity, parity_test, sides_for

WIDTH = 5
PERCENT = 80
#: Largest number of shared prefix shingles that a document may ask for.
MOST_MATCHES = 16
#: Partners that a shingle of unknown count is expected to have, for the price of a prefix only.
UNKNOWN_PARTNERS = 0.05
#: The most common shingles whose counts are known to all tasks (16 bytes each); all others count as rare. The table
#: only orders shingles and prices prefixes: results do not depend on it.
KNOWN = 1 << 17
#: A shingle is worth counting if this many texts of one batch have it.
NOTED = 4
#: Entries of one prefix list that a task takes; lists of shingles known to be longer are dealt over several.
LIST_SPAN = 20_000


def shingle_facts(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """One pass over whole texts: rows (kind 0) row, doc_id, key, n; and (kind 1) key = a shingle, n = texts having it."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, seen = [], [], []
            for block in texts.blocks(batch.column(2)):
                for found in texts.shingles(block, width):
                    sizes.append(len(found))
                    keys.append(texts.sequence_hash(found) if len(found) else None)
                    seen.append(found)
            keys = pa.array([None if k is None else int(k.view(np.int64)) for k in keys], pa.int64())
            count = pa.array(sizes, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(len(sizes), np.int32)), batch.column(0), batch.column(1), keys, count], names=NAMES
            )
            if seen:
                flat = np.concatenate(seen)
                flat.sort()
                at = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, int)
                times = np.diff(np.append(at, len(flat)))
                common = times >= NOTED
                empty = pa.nulls(int(common.sum()), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ones(len(empty), np.int32)), empty, empty, pa.array(texts.signed(flat[at[common]])),
                     pa.array(times[common].astype(np.int64))], names=NAMES,
                )

    return _rows(docs).mapInArrow(scan, "kind int, row long, doc_id long, key long, n long")


NAMES = ["kind", "row", "doc_id", "key", "n"]


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _common_shingles(facts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The KNOWN most common shingles, sorted by hash, with their counts."""
    top = facts.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(KNOWN).toPandas()
    hashes, counts = top["key"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    order = np.argsort(hashes)
    return hashes[order], counts[order]


def choose_prefix(found: np.ndarray, hashes: np.ndarray, counts: np.ndarray, percent: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Matches asked for, the prefix that belongs to them, and what is known of each element's count."""
    if len(hashes):
        at = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
        known = np.where(hashes[at] == found, counts[at], 0)
    else:
        known = np.zeros(len(found), np.int64)
    order = np.lexsort((found, known))
    found, known = found[order], known[order]
    need = (percent * len(found) + 99) // 100
    least = len(found) - need + 1
    most = min(MOST_MATCHES, need)
    asked = np.arange(1, most + 1)
    partners = np.cumsum(np.maximum(known, UNKNOWN_PARTNERS))[least - 1 : least - 1 + most]
    # List entries to write and scan, and candidates (at most partners / asked) whose bitmaps have to meet.
    cost = least - 1 + asked + partners + partners / asked * (1 + len(found) / 32)
    best = int(np.argmin(cost)) + 1
    return best, found[: least - 1 + best], known[: least - 1 + best]


def prefixes(docs: DataFrame, common: tuple[np.ndarray, np.ndarray], width: int, percent: int) -> DataFrame:
    """key, n, asked, prefix (shingles) and spans (over how many tasks the shingle's list is dealt) of every class."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = shared.value
        for batch in batches:
            rows, done = {"key": [], "n": [], "asked": [], "prefix": [], "spans": []}, set()
            for block in texts.blocks(batch.column(2)):
                for found in texts.shingles(block, width):
                    key = int(texts.sequence_hash(found).view(np.int64)) if len(found) else None
                    if key is None or key in done:
                        continue
                    done.add(key)
                    asked, prefix, known = choose_prefix(found, hashes, counts, percent)
                    for name, value in zip(rows, (key, len(found), asked, texts.signed(prefix), (known // LIST_SPAN + 1).astype(np.int32))):
                        rows[name].append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows["key"], pa.int64()), pa.array(rows["n"], pa.int32()), pa.array(rows["asked"], pa.int32()),
                 pa.array(rows["prefix"], pa.list_(pa.int64())), pa.array(rows["spans"], pa.list_(pa.int32()))],
                names=list(rows),
            )

    found = _rows(docs).mapInArrow(scan, "key long, n int, asked int, prefix array<long>, spans array<int>")
    return found.groupBy("key").agg(*[F.first(c).alias(c) for c in ("n", "asked", "prefix", "spans")])


def _lists(found: DataFrame) -> DataFrame:
    """Entries of the prefix lists with two classes or more, with the list's central class.

    The list of a shingle known to be common is dealt over spans of LIST_SPAN entries, each with a centre of its own.
    """
    entries = found.select("key", "n", "asked", F.explode(F.arrays_zip("prefix", "spans")).alias("e")).select(
        F.col("e.prefix").alias("shingle"), F.pmod(F.col("key"), F.col("e.spans")).cast("int").alias("span"), "key", "n", "asked",
        (F.col("e.spans") > 1).alias("dealt"),
    )
    whole = Window.partitionBy("shingle", "span")
    return entries.withColumn("size", F.count("*").over(whole)).where("size > 1 or dealt")


def _alike(a: str, b: str, percent: int) -> object:
    return (F.col(a) * 100 >= F.col(b) * percent) & (F.col(b) * 100 >= F.col(a) * percent)


def _families(lists: DataFrame, percent: int) -> DataFrame:
    """key, family: classes that hang together by each one's centre, the one with the most list neighbours of those it may link with.

    The centre of a list is its class with the most list neighbours over all its lists: the origin of a group of near
    copies, which its copies resemble more than they resemble each other. A class may link with a centre if they share as
    many prefix shingles as it asks for. Families only decide how pairs are compared, never whether.
    """
    weight = lists.groupBy("key").agg(F.sum("size").alias("weight"))
    rated = lists.join(weight, "key")
    centre = rated.groupBy("shingle", "span").agg(F.max(F.struct("weight", "key", "n")).alias("c"))
    met = rated.join(centre, ["shingle", "span"]).where((F.col("key") != F.col("c.key")) & _alike("n", "c.n", percent))
    times = met.groupBy("key", F.col("c.key").alias("centre"), F.col("c.weight").alias("weight")).agg(
        F.count("*").alias("times"), F.first("asked").alias("asked")
    )
    chosen = times.where("times >= asked").groupBy("key").agg(F.max(F.struct("weight", "centre"))["centre"].alias("centre"))
    found = components(chosen.select(F.col("key").alias("a"), F.col("centre").alias("b")), "join-centres")
    return found.select(F.col("node").alias("key"), F.col("root").alias("family"))


def _cells(docs: DataFrame, families: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """The links inside families, as ``cells.compared`` gives them."""
    members = families.join(classes.select("key", "row", "size", "held"), "key")
    placed = cells.dealt(members).select("row", "key", "family", "held", "blocks", "block")
    rows = _rows(docs).join(placed, "row").select("text", "key", "family", "held", "blocks", "block")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in texts.blocks(batch.column(0)):
                found = [f.tobytes() for f in texts.shingles(block, width)]
                part = batch.slice(block.first, block.last - block.first)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), *part.columns[1:]], names=["found", *part.schema.names[1:]])

    held = rows.mapInArrow(sets, "found binary, key long, family long, held long, blocks int, block int")
    return cells.compared(held, percent)


def _group_pairs(lists: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes of different groups that share as many prefix shingles as the less demanding asks for."""
    placed = lists.select("shingle", "key", "n", "asked").join(groups, "key", "left").withColumn("group", F.coalesce("group", "key"))
    held = placed.groupBy("shingle", "group").agg(F.count("*").alias("held"))
    mixed = held.groupBy("shingle").agg(F.max(F.struct("held", "group")).alias("m"), F.count("*").alias("groups")).where("groups > 1")
    mixed = placed.join(mixed.select("shingle", F.col("m.group").alias("main")), "shingle")
    few = mixed.where("group <> main").select("shingle", *[F.col(c).alias(c + "_a") for c in ("key", "n", "asked", "group")])
    many = mixed.select("shingle", "main", *[F.col(c).alias(c + "_b") for c in ("key", "n", "asked", "group")])
    pairs = few.join(many, "shingle").where(
        "group_a <> group_b and (group_b = main or key_a < key_b)"
    ).where(_alike("n_a", "n_b", percent))
    return _asked_for(pairs)


def _all_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """All pairs of classes that share as many prefix shingles as the less demanding asks for."""
    one, other = (lists.select("shingle", *[F.col(c).alias(c + side) for c in ("key", "n", "asked")]) for side in ("_a", "_b"))
    return _asked_for(one.join(other, "shingle").where("key_a < key_b").where(_alike("n_a", "n_b", percent)))


def _asked_for(pairs: DataFrame) -> DataFrame:
    counted = pairs.groupBy(F.least("key_a", "key_b").alias("a"), F.greatest("key_a", "key_b").alias("b")).agg(
        F.count("*").alias("shared"), F.min(F.least("asked_a", "asked_b")).alias("asked")
    )
    return counted.where("shared >= asked").select("a", "b")


def verified(docs: DataFrame, pairs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that link, by one row of each class, as a table.

    Bitmaps of the sets, a fiftieth of their size, first rule out what cannot link; the whole texts of the rest meet.
    """
    places = classes.select("key", "row")

    def sides(pairs: DataFrame, bitmaps: bool) -> DataFrame:
        asked = asked_rows(pairs, places, "join-asked")
        rows = _rows(docs).join(asked, "row").select("text", "pairs")

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block in texts.blocks(batch.column(0)):
                    for i, found in enumerate(texts.shingles(block, width)):
                        key = int(texts.sequence_hash(found).view(np.int64))
                        payload = parity(found) if bitmaps else block.data[block.bounds[i] : block.bounds[i + 1]].tobytes()
                        yield sides_for(batch.column(1)[block.first + i], {key: payload})

        return rows.mapInArrow(scan, SIDES)

    def sets(column: pa.Array) -> Iterator[np.ndarray]:
        for block in texts.blocks(column.cast(pa.large_binary())):
            yield from texts.shingles(block, width)

    possible = Stage(meet(sides(pairs, True), parities, parity_test(percent)), "join-possible")
    found = stage(meet(sides(possible.frame, False), sets, jaccard_test(percent)), "join-links")
    possible.drop()
    return found


def jaccard_links(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """All links of ``docs``: the pairs (a, b) of different classes (class_key of ``jaccard_components``, a < b), each verified.

    Every row of class a links with every row of class b, and rows of one class link with each other.
    """
    facts = _facts(docs, width)
    lists = _prefix_lists(docs, facts, width, percent)
    pairs = Stage(_all_pairs(lists.frame, percent), "join-all-pairs")
    lists.drop()
    return verified(docs, pairs.frame, _classes(facts), width, percent)


def _facts(docs: DataFrame, width: int) -> DataFrame:
    return stage(shingle_facts(docs, width), "join-facts")


def _classes(facts: DataFrame) -> DataFrame:
    """key, row (one that has it), size (of its set), least (doc_id), held (rows): the distinct sets that are not empty."""
    rows = facts.where("kind = 0 and key is not null")
    return stage(
        rows.groupBy("key").agg(F.min("row").alias("row"), F.first("n").alias("size"), F.min("doc_id").alias("least"), F.count("*").alias("held")), "join-classes"
    )


def _prefix_lists(docs: DataFrame, facts: DataFrame, width: int, percent: int) -> Stage:
    return Stage(_lists(prefixes(docs, _common_shingles(facts), width, percent)), "join-lists")


def _linked(docs: DataFrame, facts: DataFrame, classes: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """key, root of every linked class; and key, links (other classes it links with), rows (in those)."""
    lists = _prefix_lists(docs, facts, width, percent)
    families = stage(_families(lists.frame, percent), "join-families")
    pairs = Stage(_group_pairs(lists.frame, families.select("key", F.col("family").alias("group")), percent), "join-pairs")
    lists.drop()
    inside = stage(_cells(docs, families, classes, width, percent), "join-cells")
    links = verified(docs, pairs.frame, classes, width, percent)
    pairs.drop()
    roots = components(inside.where("b is not null").select("a", "b").union(links), "join-components").select(F.col("node").alias("key"), "root")
    ends = links.select(F.col("a").alias("key"), F.col("b").alias("other")).union(links.select(F.col("b").alias("key"), F.col("a").alias("other")))
    outside = ends.join(classes.select(F.col("key").alias("other"), "held"), "other").select("key", F.lit(1).cast("long").alias("links"), F.col("held").alias("rows"))
    own = inside.where("b is null").select(F.col("a").alias("key"), "links", "rows")
    return roots, own.union(outside).groupBy("key").agg(F.sum("links").alias("links"), F.sum("rows").alias("rows"))


def _placed(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """row, doc_id, n, key (null: no shingles), held, root, links, rows of every row of ``docs``; root is null where nothing links."""
    facts = _facts(docs, width)
    classes = _classes(facts)
    roots, degree = _linked(docs, facts, classes, width, percent)
    # Only linked classes and classes of several rows need a look-up; per class before the join, so copies do not weigh.
    named = classes.select("key", "held").join(roots, "key", "left").join(degree, "key", "left")
    return facts.where("kind = 0").drop("kind").join(named, "key", "left")


def jaccard_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Near-duplicate components of ``docs`` (doc_id, text; other columns are ignored).

    Returns one row per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id that links reach), class_key
    (equal for equal shingle sets), links_found (other classes that its class links with) and row_links (other rows that
    it links with, copies in its own class among them). Words are runs of bytes other than ASCII white space, A-Z folded.
    Null, empty and blank texts have no shingles and stay alone. Repeated rows and repeated doc_ids give a row each; a
    row without doc_id takes part, and its component_id is null if no member has one. Shingles are compared by 64-bit
    hashes.
    """
    placed = stage(_placed(docs, width, percent), "join-placed")
    group = F.coalesce("root", "key")
    # Copies are reduced to their class before the least doc_id of a group is looked for and joined back.
    least = placed.where("key is not null").groupBy("key", group.alias("group")).agg(F.min("doc_id").alias("least"))
    named = least.join(least.groupBy("group").agg(F.min("least").alias("component_id")), "group").select("key", "component_id")
    number = lambda name: F.coalesce(name, F.lit(0)).cast("long")
    return placed.join(named, "key", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.col("key").alias("class_key"), number("links").alias("links_found"),
        F.when(F.col("key").isNull(), 0).otherwise(number("rows") + F.col("held") - 1).cast("long").alias("row_links"),
    )


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component of near copies: that of smallest doc_id (rows without one last), then content.

    Rows are told apart by doc_id and text, so an unlinked row stays whatever other rows have its doc_id; of rows that
    agree in both, one stays. Null, empty and blank texts are no copies of each other and all stay. All columns are
    kept as they are, under whatever names; an empty table gives none.
    """
    name = free_name(docs, "row")
    placed = stage(_placed(docs, WIDTH, PERCENT).where("key is not null").select("row", "doc_id", F.coalesce("root", "key").alias("group")), "join-placed")
    rows = placed.groupBy("group", "row").agg(F.first("doc_id").alias("doc_id"), F.count("*").alias("times"))
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    first = rows.groupBy("group").agg(F.min(rank)["row"].alias("kept"))
    gone = bounded(stage(rows.join(first, "group").where("row <> kept").select(F.col("row").alias(name)), "join-gone"))
    repeated = bounded(stage(rows.where("times > 1").select(F.col("row").alias(name)), "join-repeated"))
    left = docs.withColumn(name, F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))).join(gone, name, "left_anti")
    once = left.join(repeated, name, "left_anti")
    several = left.join(repeated, name, "left_semi").dropDuplicates([name])
    return once.unionByName(several).drop(name)
