"""Connected components of an edge list as repeated star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens.llm.common import Stage


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``node``, ``root`` (smallest node of its component) for every node of ``edges`` (a, b long).

    Alternating large-star and small-star steps: each node hands its larger (then its smaller) neighbours to the
    smallest one it knows. A step is a grouped minimum, combined before its shuffle, and an inner join that Spark can
    split at a hot node. Each round is written to the shared folder, so the plan stays short and a lost executor
    costs one round at most. Rounds grow with the logarithm of the component's diameter.
    """
    now = Stage(_tidy(edges.select("a", "b")), label)
    mark = _mark(now.frame)
    while True:
        following = Stage(_tidy(_small_star(_large_star(now.frame))), label)
        now.drop()
        now, before = following, mark
        mark = _mark(now.frame)
        if mark == before:
            break
    pairs = now.frame
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def _tidy(edges: DataFrame) -> DataFrame:
    """Larger node first, no loops, each edge once."""
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
