"""Packing into length buckets of least padding, and token-budget batches inside each bucket.

Lengths are rounded up to UNIT tokens. A global histogram of them, bounded by BUDGET / UNIT entries whatever the size of
the corpus, is all that reaches the driver; dynamic programming over it finds the bucket bounds that pad least. Texts
are then numbered inside their bucket without any window over a whole bucket: counts per (bucket, shard) give each shard
its offset, and a text's number is that offset plus its place in its shard.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netlens.llm.common import stage

#: Padded tokens of a batch. A longer text is a batch of its own, padded to the unit only.
BUDGET = 16_384
UNIT = 8
BUCKETS = 8
#: Texts of a shard on average, all buckets together.
SHARD = 4096
WORD = "[^\\x20\\x09-\\x0D]+"


def token_count(text: Column) -> Column:
    """White-space separated words of the whole text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def best_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets over ascending ``lengths`` with the least padded total.

    best[k][j]: least padded tokens of the first j lengths in k buckets; the last one takes lengths i+1 to j, padded to
    the j-th. Of equal choices the smallest i.
    """
    if not len(lengths):
        return []
    lengths, before = lengths.astype(np.int64), np.concatenate([[0], np.cumsum(counts.astype(np.int64))])
    size, far = len(lengths), np.iinfo(np.int64).max // 4
    best, choice = np.full(size + 1, far), []
    best[0] = 0
    for _ in range(min(buckets, size)):
        following, chosen = np.full(size + 1, far), np.zeros(size + 1, np.int64)
        for j in range(1, size + 1):
            cost = best[:j] + lengths[j - 1] * (before[j] - before[:j])
            chosen[j] = int(np.argmin(cost))
            following[j] = min(int(cost[chosen[j]]), far)
        best = following
        choice.append(chosen)
    bounds, j = [], size
    for chosen in reversed(choice):
        bounds.append(int(lengths[j - 1]))
        j = int(chosen[j])
    return bounds[::-1]


def pack(docs: DataFrame, n_tokens: Column | None = None, budget: int = BUDGET, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_tokens, bucket (its padded length), batch (numbered from 0 in its bucket), slot (from 0 in its batch).

    One row per row of ``docs`` (doc_id, text; other columns are ignored), none dropped or cut. Null and empty texts
    have no tokens and take the shortest bucket. Batches hold budget / bucket texts, all full but the last of a bucket.
    Texts longer than the budget get the bucket of their own rounded length and batches of one. Inside a bucket texts are
    ordered by shard (doc_id modulo the number of shards), doc_id and length, so repeated rows are told apart; rows
    without doc_id are sharded by a hash of their text.
    """
    tokens = token_count(F.col("text").cast("string")) if n_tokens is None else n_tokens
    counted = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), tokens.alias("n_tokens")), "packing-lengths")
    rounded = F.greatest(F.ceil(F.col("n_tokens") / UNIT), F.lit(1)) * UNIT
    counted = counted.withColumn("rounded", rounded.cast("long"))
    histogram = counted.where(F.col("rounded") <= budget).groupBy("rounded").agg(F.count("*").alias("n")).orderBy("rounded").collect()
    bounds = best_bounds(np.array([r["rounded"] for r in histogram], np.int64), np.array([r["n"] for r in histogram], np.int64), buckets)
    bucket = F.col("rounded")
    for bound in reversed(bounds):
        bucket = F.when(F.col("rounded") <= bound, F.lit(bound).cast("long")).otherwise(bucket)
    shards = counted.count() // SHARD + 1
    placed = counted.select(
        "doc_id", "mark", "n_tokens", bucket.alias("bucket"), F.pmod(F.coalesce("doc_id", "mark"), F.lit(shards)).alias("shard")
    )
    sizes = placed.groupBy("bucket", "shard").agg(F.count("*").alias("n"))
    running = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("offset", F.coalesce(F.sum("n").over(running), F.lit(0))).drop("n")
    place = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("doc_id", "n_tokens", "mark"))
    numbered = placed.withColumn("place", place).join(offsets, ["bucket", "shard"]).withColumn("number", F.col("offset") + F.col("place") - 1)
    per_batch = F.greatest(F.expr(f"{budget} div bucket"), F.lit(1))
    return numbered.select(
        "doc_id", "n_tokens", "bucket", F.expr("number").alias("number"), per_batch.alias("per_batch")
    ).select(
        "doc_id", "n_tokens", "bucket", F.expr("number div per_batch").alias("batch"), F.expr("number % per_batch").alias("slot")
    )


def pack_sql(budget: int = BUDGET, buckets: int = BUCKETS, docs: str = "documents") -> str:
    """The same rows as DuckDB SQL; a relation per round of the dynamic programme."""
    parts = [
        f"c AS MATERIALIZED (SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens FROM {docs})",
        f"t AS MATERIALIZED (SELECT *, greatest((n_tokens + {UNIT - 1}) // {UNIT}, 1) * {UNIT} AS rounded FROM c)",
        f"""h AS MATERIALIZED (SELECT row_number() OVER (ORDER BY rounded) AS j, rounded AS len, CAST(sum(n) OVER (ORDER BY rounded) AS BIGINT) AS upto
              FROM (SELECT rounded, count(*) AS n FROM t WHERE rounded <= {budget} GROUP BY rounded))""",
        "z AS (SELECT CAST(0 AS BIGINT) AS j, CAST(0 AS BIGINT) AS upto UNION ALL SELECT j, upto FROM h)",
        "f0 AS MATERIALIZED (SELECT CAST(0 AS BIGINT) AS j, CAST(0 AS BIGINT) AS cost, CAST(0 AS BIGINT) AS i)",
    ]
    for k in range(1, buckets + 1):
        parts.append(
            f"""f{k} AS MATERIALIZED (SELECT j, cost, i FROM (SELECT h.j, f.cost + h.len * (h.upto - z.upto) AS cost, f.j AS i,
                  row_number() OVER (PARTITION BY h.j ORDER BY f.cost + h.len * (h.upto - z.upto), f.j) AS r
                  FROM h JOIN f{k - 1} f ON f.j < h.j JOIN z ON z.j = f.j) WHERE r = 1)"""
        )
    parts.append(f"m AS (SELECT least(count(*), {buckets}) AS k, max(j) AS j FROM h)")
    parts.append(f"b{buckets} AS (SELECT k, j FROM m)")
    for k in range(buckets, 0, -1):
        parts.append(f"b{k - 1} AS (SELECT k, CASE WHEN k >= {k} THEN (SELECT i FROM f{k} WHERE f{k}.j = b{k}.j) ELSE j END AS j FROM b{k})")
    ends = " UNION ".join(f"SELECT j FROM b{k} WHERE k >= {k}" for k in range(1, buckets + 1))
    parts += [
        f"bounds AS MATERIALIZED (SELECT h.len FROM h WHERE j IN ({ends}))",
        f"s AS (SELECT count(*) // {SHARD} + 1 AS shards FROM t)",
        "p AS (SELECT doc_id, n_tokens, coalesce((SELECT min(len) FROM bounds WHERE len >= t.rounded), t.rounded) AS bucket, doc_id % shards AS shard FROM t, s)",
        f"n AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY shard, doc_id, n_tokens) - 1 AS number, greatest({budget} // bucket, 1) AS per_batch FROM p)",
    ]
    return "WITH " + ", ".join(parts) + " SELECT doc_id, n_tokens, bucket, number // per_batch AS batch, number % per_batch AS slot FROM n"
