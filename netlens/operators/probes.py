"""Statistics over stored probe results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens.functions.numbers import half_even


def sample_stats(samples: DataFrame, key: list[str], value: str = "sample_ms", address: str = "address") -> DataFrame:
    """Least, mean and largest sample, two decimals, and the number of distinct addresses."""
    return samples.groupBy(*key).agg(
        F.count(value).alias("samples"),
        half_even(F.min(value), 2).alias("min_ms"),
        half_even(F.avg(value), 2).alias("avg_ms"),
        half_even(F.max(value), 2).alias("max_ms"),
        F.countDistinct(address).alias("addresses"),
    )


def sample_addresses(samples: DataFrame, key: list[str], address: str = "address") -> DataFrame:
    """The sorted distinct addresses of each key; a probe of one name has few."""
    distinct = samples.where(F.col(address).isNotNull()).select(*key, address).distinct()
    return distinct.groupBy(*key).agg(F.array_sort(F.collect_list(address)).alias("listed"))


def dns_comparison(results: DataFrame, key: list[str]) -> DataFrame:
    """Fastest answering server and whether the servers' answers differ.

    ``results`` has one row per asked server with ``pos``, ``ok``, ``duration_ms`` and its sorted
    ``answers``; the first asked wins a tie.
    """
    good = F.col("ok")
    return results.groupBy(*key).agg(
        F.min_by("server", F.when(good, F.struct("duration_ms", "pos"))).alias("fastest"),
        (F.countDistinct(F.when(good, F.col("answers"))) > 1).alias("answers_differ"),
    )


def trace_stats(hops: DataFrame) -> DataFrame:
    """Mean of the samples, timeout flag and distinct addresses in order, per hop."""
    samples = F.coalesce("samples_ms", F.array().cast("array<double>"))
    total = F.aggregate(samples, F.lit(0.0), lambda acc, item: acc + item)
    return hops.select(
        *[name for name in hops.columns if name not in ("addresses", "samples_ms", "raw")],
        F.array_distinct("addresses").alias("addresses"),
        samples.alias("samples_ms"),
        F.when(F.size(samples) > 0, half_even(total / F.size(samples), 2)).alias("average_ms"),
        (F.col("raw").contains("*") & (F.size(samples) == 0)).alias("timeout"),
        "raw",
    )
