"""Approximate nearest neighbours by cosine: a forest of random-projection trees with one priority queue per query.

The trees are fitted on SAMPLE distinct vectors at most and every vector is then dealt to its leaf of each tree. A query
walks all trees through one priority queue, most promising branch first, and collects leaves until they hold as many
vectors as its budget says; the vectors of those leaves are ranked exactly.

The budget is found, not given: for some queries the true neighbours are looked up by a full scan, and the budget is what
the queue needs to reach the share RECALL of them. On clustered vectors that is a few leaves; on vectors that are nearly
independent it is a good part of the table, because there no tree can tell near from far.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netlens.llm.common import stage
from netlens.llm.topk import usable

TREES = 8
#: Distinct vectors the trees are fitted on, and the size at which a node of the sample is not split further.
SAMPLE, LEAF = 16_384, 32
#: Queries whose true neighbours calibrate the budget, and the share of those to reach.
CALIBRATION, RECALL = 200, 0.96
#: Vectors of a leaf that a task holds; larger leaves are dealt over several.
SPAN = 8192
_DEPTH = 40


@dataclass
class Forest:
    """Per tree: normals and offsets of its nodes, children (negative: leaf -1 - n), and number of leaves."""

    normals: list[np.ndarray]
    offsets: list[np.ndarray]
    children: list[np.ndarray]
    leaves: list[int]

    def route(self, vectors: np.ndarray) -> np.ndarray:
        """Leaf of each (normalised) vector in each tree."""
        found = np.zeros((len(vectors), len(self.normals)), np.int32)
        for t, (normals, offsets, children) in enumerate(zip(self.normals, self.offsets, self.children)):
            node = np.zeros(len(vectors), np.int64) if len(normals) else np.full(len(vectors), -1)
            while True:
                open_ = np.flatnonzero(node >= 0)
                if not len(open_):
                    break
                at = node[open_]
                side = (np.einsum("ij,ij->i", vectors[open_], normals[at]) > offsets[at]).astype(int)
                node[open_] = children[at, side]
            found[:, t] = -1 - node
        return found

    def leaves_for(self, vector: np.ndarray, sizes: list[np.ndarray], budget: float) -> Iterator[tuple[int, int, int]]:
        """tree, leaf and the vectors seen so far, in the order of the shared queue, until the budget is spent."""
        margins = [normals @ vector - offsets for normals, offsets in zip(self.normals, self.offsets)]
        queue = [(-np.inf, t, 0 if len(m) else -1) for t, m in enumerate(margins)]
        heapq.heapify(queue)
        seen = 0
        while queue and seen < budget:
            bound, tree, node = heapq.heappop(queue)
            if node < 0:
                seen += int(sizes[tree][-1 - node])
                yield tree, -1 - node, seen
            else:
                margin = margins[tree][node]
                low, high = self.children[tree][node]
                # The queue holds the negated least margin on the way: the smaller, the more promising.
                heapq.heappush(queue, (max(bound, -margin), tree, int(high)))
                heapq.heappush(queue, (max(bound, margin), tree, int(low)))


def plant(sample: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = 11) -> Forest:
    """Trees over normalised vectors: each node splits at the median along the line between two drifting random points."""
    forest = Forest([], [], [], [])
    for tree in range(trees):
        rng = np.random.default_rng(seed + tree)
        normals, offsets, children, leaves = [], [], [], 0
        open_ = [(np.arange(len(sample)), -1, 0, 0)]
        while open_:
            rows, parent, side, depth = open_.pop()
            split = _split(sample[rows], rng) if len(rows) > leaf and depth < _DEPTH else None
            if split is None:
                target = -1 - leaves
                leaves += 1
            else:
                normal, offset, above = split
                target = len(normals)
                normals.append(normal)
                offsets.append(offset)
                children.append([0, 0])
                open_ += [(rows[~above], target, 0, depth + 1), (rows[above], target, 1, depth + 1)]
            if parent >= 0:
                children[parent][side] = target
        width = sample.shape[1] if sample.ndim == 2 else 0
        forest.normals.append(np.array(normals).reshape(len(normals), width))
        forest.offsets.append(np.array(offsets))
        forest.children.append(np.array(children, np.int64).reshape(len(children), 2))
        forest.leaves.append(leaves)
    return forest


def _split(points: np.ndarray, rng: np.random.Generator) -> tuple | None:
    """A random projection that halves the points, or None if they do not differ along it."""
    a, b = points[rng.choice(len(points), 2, replace=False)]
    for _ in range(3):
        near = points @ (a - b) > 0
        if near.all() or not near.any():
            break
        a, b = points[near].mean(axis=0), points[~near].mean(axis=0)
    normal = a - b
    size = np.linalg.norm(normal)
    if size < 1e-12:
        return None
    normal = normal / size
    reach = points @ normal
    offset = float(np.median(reach))
    above = reach > offset
    return None if above.all() or not above.any() else (normal, offset, above)


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 0))


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; the same pair gives the same number wherever it is computed."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def _best(query: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per query the ids and exact cosines of its ``k`` nearest rows of ``vectors``, ties to the smaller id."""
    rough, found = _unit(query) @ _unit(vectors).T, []
    for i in range(len(query)):
        if len(ids) > k:
            bar = np.partition(rough[i], -k)[-k] - 1e-9
            chosen = np.flatnonzero(rough[i] >= bar)
        else:
            chosen = np.arange(len(ids))
        exact = cosines(np.repeat(query[i : i + 1], len(chosen), axis=0), vectors[chosen])
        order = np.lexsort((ids[chosen], -exact))[:k]
        found.append((ids[chosen][order], exact[order]))
    return found


def distinct_vectors(vectors: DataFrame, name: str, k: int) -> DataFrame:
    """u (smallest id), v, ids: every distinct non-zero vector with the k + 1 smallest ids that have it.

    More are never needed: of equal vectors the smaller ids win, and a query leaves out one id, its own.
    """
    points = usable(vectors, name).where(F.exists("v", lambda x: x != 0)).distinct()
    first = Window.partitionBy("v").orderBy("id")
    few = points.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
    return few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("u"), "v", "ids")


def _true_neighbours(points: DataFrame, queries: np.ndarray, own: np.ndarray, k: int) -> list[list[np.ndarray]]:
    """The ``k`` nearest distinct vectors of some queries by a full scan; each task keeps k per query."""
    shared = points.sparkSession.sparkContext.broadcast((queries, own))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, own = shared.value
        for batch in batches:
            if batch.num_rows:
                ids, vectors = batch.column(0).to_numpy(), _matrix(batch.column(1))
                for q, (near, exact) in enumerate(_best(asked, vectors, ids, k + 1)):
                    keep = near != own[q]
                    rows = vectors[[int(np.flatnonzero(ids == n)[0]) for n in near[keep]]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(keep.sum(), q)), pa.array(near[keep]), pa.array(exact[keep]), pa.array(list(rows), pa.list_(pa.float64()))], names=["q", "u", "s", "v"]
                    )

    found = points.select("u", "v").mapInArrow(scan, "q long, u long, s double, v array<double>")
    best = Window.partitionBy("q").orderBy(F.desc("s"), "u")
    rows = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).collect()
    near: list[list[np.ndarray]] = [[] for _ in queries]
    for row in rows:
        near[row["q"]].append(np.array(row["v"]))
    return near


def calibrate(forest: Forest, sizes: list[np.ndarray], queries: np.ndarray, near: list[list[np.ndarray]], recall: float) -> int:
    """Vectors to look at per query so that the share ``recall`` of the true neighbours is among them."""
    needed = []
    for query, rows in zip(queries, near):
        if rows:
            homes = forest.route(_unit(np.array(rows)))
            reached = np.full(len(rows), np.inf)
            for tree, leaf, seen in forest.leaves_for(query, sizes, np.inf):
                reached = np.where((homes[:, tree] == leaf) & (seen < reached), seen, reached)
                if np.isfinite(reached).all():
                    break
            needed += reached.tolist()
    return int(np.quantile(needed, recall, method="higher")) if needed else 1


def nearest(vectors: DataFrame, k: int, every: int, name: str = "embedding", recall: float = RECALL) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query the ``k`` nearest rows found, by cosine of the given vectors.

    Queries are the rows whose vec_id is divisible by ``every``, candidates all rows but the query's own; ties go to the
    smaller vec_id. Rows without an id, and vectors that are null, zero, hold null or non-finite components or have
    another than the usual length, take no part. Rows of equal id and vector are one row.
    """
    spark = vectors.sparkSession
    points = stage(distinct_vectors(vectors, name, k), "forest-points")
    asked = stage(
        usable(vectors, name).where(F.exists("v", lambda x: x != 0)).where(F.col("id") % every == 0).distinct()
        .join(points.select("v", "u"), "v").select("id", "u", "v"), "forest-queries",
    )
    sample = points.select("u", "v").orderBy(F.xxhash64("u"), "u").limit(SAMPLE).toArrow()
    sample = _matrix(sample.column("v").combine_chunks()) if sample.num_rows else np.zeros((0, 0))
    forest = plant(_unit(sample) if len(sample) else sample)
    shared = spark.sparkContext.broadcast(forest)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaves = shared.value.route(_unit(_matrix(batch.column(1))))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(leaves), pa.list_(pa.int32()))], names=["u", "v", "leaves"])

    dealt = stage(points.select("u", "v").mapInArrow(route, "u long, v array<double>, leaves array<int>"), "forest-leaves")
    each = dealt.select("u", F.posexplode("leaves").alias("tree", "leaf"))
    sizes = [np.zeros(max(1, n), np.int64) for n in forest.leaves]
    for row in each.groupBy("tree", "leaf").agg(F.count("*").alias("n")).collect():  # one row per leaf of the forest
        sizes[row["tree"]][row["leaf"]] = row["n"]

    some = asked.orderBy(F.xxhash64("id", F.lit(3)), "id").limit(CALIBRATION).collect()
    queries = np.array([r["v"] for r in some], np.float64)
    near = _true_neighbours(points, queries, np.array([r["u"] for r in some], np.int64), k) if some else []
    budget = calibrate(forest, sizes, _unit(queries) if some else queries, near, recall)
    counts = spark.sparkContext.broadcast(sizes)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, unit in enumerate(_unit(_matrix(batch.column(2))) if batch.num_rows else ()):
                found = [(t, n) for t, n, _ in shared.value.leaves_for(unit, counts.value, budget)]
                places = [(t, n, span) for t, n in found for span in range(int(counts.value[t][n]) // SPAN + 1)]
                tree, leaf, span = (np.array(p, np.int32) for p in zip(*places))
                one = pa.array(np.full(len(places), i))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tree), pa.array(leaf), pa.array(span), pa.array(np.ones(len(places), np.int32)), batch.column(0).take(one), batch.column(2).take(one)], names=PLACED
                )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tree, leaf, u = batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(0).to_numpy()
            spans = np.array([counts.value[t][n] // SPAN + 1 for t, n in zip(tree, leaf)], np.int64)
            mixed = (u.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            span = (mixed.astype(np.int64) % np.maximum(spans, 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(span), pa.array(np.zeros(len(u), np.int32)), batch.column(0), batch.column(3)], names=PLACED)

    schema = "tree int, leaf int, span int, side int, id long, v array<double>"
    members = dealt.select("u", F.posexplode("leaves").alias("tree", "leaf"), "v").select("u", "tree", "leaf", "v").mapInArrow(place, schema)
    met = members.union(asked.select("id", "u", "v").mapInArrow(visit, schema)).repartition("tree", "leaf", "span").sortWithinPartitions("tree", "leaf", "span", "side")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A leaf's vectors come first and are held (SPAN on average at most); its queries stream past them.
        held_key, ids, rows = None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in range(4)], axis=1)
            turns = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            out: list[list] = [[], [], []]
            for a, b in zip([0, *turns], [*turns, len(keys)]):
                key, number = tuple(keys[a, :3]), batch.column(4).slice(a, b - a).to_numpy()
                vectors_ = _matrix(batch.column(5).slice(a, b - a))
                if key != held_key:
                    held_key, ids, rows = key, [], []
                if keys[a, 3] == 0:
                    ids.append(number)
                    rows.append(vectors_)
                elif ids:
                    ids, rows = [np.concatenate(ids)], [np.concatenate(rows)]
                    for first in range(0, len(number), 512):
                        mine = number[first : first + 512]
                        for query, (near_, exact) in zip(mine, _best(vectors_[first : first + 512], rows[0], ids[0], k + 1)):
                            out[0].append(np.full(len(near_), query))
                            out[1].append(near_)
                            out[2].append(exact)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], names=["query_id", "u", "score"])

    found = met.mapInArrow(rank, "query_id long, u long, score double").groupBy("query_id", "u").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "u")
    found = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    named = found.join(points.select("u", "ids"), "u").select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


PLACED = ["tree", "leaf", "span", "side", "id", "v"]
