"""Exact top-k inner products on a bit-sliced index.

Vectors are quantised to whole numbers. A segment of SEGMENT rows holds, per component, one bitmap per binary digit. A
query adds up its scores for all rows of a segment at once: every digit of |q_i| selects the shifted slices of component
i (their complements for a negative q_i), and carry-save adders reduce the bitmaps of equal weight until one per digit
of the score is left. From the most significant digit downward the k best rows are then narrowed down; rows that tie at
the boundary are resolved by the smaller id, and the scores of the k rows are read off the score's digits exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netlens.llm.common import stage

#: Rows of a segment and queries of a block, on average; rows are dealt by a hash of their id.
SEGMENT, BLOCK = 65_536, 128
SCALE = 64


def usable(vectors: DataFrame, name: str) -> DataFrame:
    """id, v (array<double>): rows with an id and a vector of finite components, of the length that most vectors have."""
    found = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col(name).cast("array<double>").alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    )
    usual = found.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("times")).orderBy(F.desc("times"), "n").first()
    return found.where(F.size("v") == (usual["n"] if usual else 0))


def quantised(scale: int = SCALE) -> Column:
    """floor(scale * x) of every component, exact for components below 2^24 / scale."""
    return F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("long"))


def slices(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps [component, digit, word] of the whole numbers above each component's least, and those least numbers."""
    least = matrix.min(axis=0)
    above = (matrix - least).astype(np.uint64)
    digits = max(1, int(above.max()).bit_length())
    rows = -(-len(matrix) // 64) * 64
    bits = np.zeros((matrix.shape[1], digits, rows), np.uint8)
    for digit in range(digits):
        bits[:, digit, : len(matrix)] = ((above >> np.uint64(digit)) & np.uint64(1)).T
    return np.packbits(bits, axis=2, bitorder="little").view(np.uint64), least


def add_up(bitmaps: np.ndarray, query: np.ndarray) -> tuple[list[np.ndarray], int]:
    """Digits of sum |q_i| * t_i over all rows, where t_i is the sliced number or, for q_i < 0, its complement.

    Also the constant that the true sum of q_i * x_i lies above that, before the least numbers are put back.
    """
    parts, digits, words = bitmaps.shape
    flat = bitmaps.reshape(parts * digits, words)
    columns: dict[int, list[np.ndarray]] = {}
    size, negative = np.abs(query), query < 0
    for shift in range(int(size.max()).bit_length() if len(size) else 0):
        chosen = np.flatnonzero((size >> shift) & 1)
        plain, turned = chosen[~negative[chosen]], chosen[negative[chosen]]
        for digit in range(digits):
            stack = columns.setdefault(shift + digit, [])
            if len(plain):
                stack.append(flat[plain * digits + digit])
            if len(turned):
                stack.append(~flat[turned * digits + digit])
    result, weight = [], 0
    while weight <= max(columns, default=-1):
        stacks = columns.get(weight, [])
        rows = np.concatenate(stacks) if stacks else np.zeros((0, words), np.uint64)
        carries = columns.setdefault(weight + 1, []) if len(rows) > 1 else []
        while len(rows) > 1:
            third = len(rows) // 3
            if third:
                a, b, c = rows[:third], rows[third : 2 * third], rows[2 * third : 3 * third]
                half = a ^ b
                carries.append((a & b) | (half & c))
                rows = np.concatenate([half ^ c, rows[3 * third :]])
            else:
                carries.append((rows[0] & rows[1])[None])
                rows = (rows[0] ^ rows[1])[None]
        result.append(rows[0] if len(rows) else np.zeros(words, np.uint64))
        weight += 1
    return result, -int(size[negative].sum()) * ((1 << digits) - 1)


def narrow(digits: list[np.ndarray], rows: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` largest among the rows of the bitmap ``rows``; of ties at the boundary the first ones."""
    sure, open_ = np.zeros_like(rows), rows
    for digit in reversed(digits):
        ahead = sure | (open_ & digit)
        count = int(np.bitwise_count(ahead).sum())
        if count > k:
            open_ = open_ & digit
        else:
            sure, open_ = ahead, open_ & ~digit
            if count == k:
                open_ = np.zeros_like(rows)
                break
    chosen = np.flatnonzero(np.unpackbits(sure.view(np.uint8), bitorder="little"))
    tied = np.flatnonzero(np.unpackbits(open_.view(np.uint8), bitorder="little"))
    return np.concatenate([chosen, tied[: k - len(chosen)]])


def build_index(points: DataFrame, rows: int) -> DataFrame:
    """segment, ids, least, shape and bitmaps of every segment; ``points`` holds id and q (whole numbers)."""
    segments = rows // SEGMENT + 1

    def build(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id", kind="stable")
        bitmaps, least = slices(np.stack(part["q"].to_numpy()).astype(np.int64))
        return pd.DataFrame(
            {"segment": [int(part["segment"].iloc[0])], "ids": [part["id"].to_numpy(np.int64).tobytes()], "least": [least.tobytes()],
             "shape": [list(bitmaps.shape)], "bitmaps": [bitmaps.tobytes()]}
        )

    dealt = points.select("id", "q", F.pmod(F.xxhash64("id"), F.lit(segments)).alias("segment"))
    return dealt.groupBy("segment").applyInPandas(build, "segment long, ids binary, least binary, shape array<int>, bitmaps binary")


def top_inner_products(vectors: DataFrame, k: int, every: int, name: str = "embedding", scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` largest inner products of the quantised vectors, exact.

    Queries are the rows whose vec_id is divisible by ``every``, candidates all other rows; ties go to the smaller
    vec_id. Rows without an id, null vectors, vectors with null or non-finite components and vectors of another than
    the usual length take no part. Rows of equal id and vector are one row.
    """
    points = stage(usable(vectors, name).select("id", quantised(scale).alias("q")).distinct(), "slices-points")
    asked = points.where(F.col("id") % every == 0)
    total, queries = points.count(), asked.count()
    index = stage(build_index(points, total), "slices-index")
    blocks = queries // BLOCK + 1
    asked = asked.select(F.col("id").alias("query_id"), F.col("q").alias("query"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).alias("block"))
    asked = asked.groupBy("block").agg(F.collect_list(F.struct("query_id", "query")).alias("queries"))
    # Every segment meets every block of the stated query set: an equi-join on the block number.
    work = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>"))).join(asked, "block")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {n: i for i, n in enumerate(batch.schema.names)}
            for row in range(batch.num_rows):
                ids = np.frombuffer(batch.column(at["ids"])[row].as_buffer(), np.int64)
                least = np.frombuffer(batch.column(at["least"])[row].as_buffer(), np.int64)
                shape = batch.column(at["shape"])[row].as_py()
                bitmaps = np.frombuffer(batch.column(at["bitmaps"])[row].as_buffer(), np.uint64).reshape(shape)
                full = np.packbits(np.arange(shape[2] * 64) < len(ids), bitorder="little").view(np.uint64)
                out: list[list] = [[], [], []]
                for entry in batch.column(at["queries"])[row].as_py():
                    query = np.array(entry["query"], np.int64)
                    digits, constant = add_up(bitmaps, query)
                    rows = full.copy()
                    for own in range(np.searchsorted(ids, entry["query_id"]), np.searchsorted(ids, entry["query_id"], side="right")):
                        rows[own // 64] &= ~(np.uint64(1) << np.uint64(own % 64))
                    best = narrow(digits, rows, k)
                    score = np.full(len(best), constant + int(query @ least))
                    for weight, digit in enumerate(digits):
                        score += ((digit[best // 64] >> (best % 64).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << weight
                    out[0].append(np.full(len(best), entry["query_id"]))
                    out[1].append(ids[best])
                    out[2].append(score)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o).astype(np.int64)) for o in out], names=["query_id", "vec_id", "score"])

    found = work.select("ids", "least", "shape", "bitmaps", "queries").mapInArrow(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
