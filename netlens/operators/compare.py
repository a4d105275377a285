"""Before/after comparison of sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlens.functions.numbers import half_even
from netlens.operators.scores import SCORE_NAMES

# Summary metrics that are compared.
COMPARED_METRICS = (
    "requests", "domains", "transfer_bytes", "page_span_ms", "failed", "http_errors", "third_party", "trackers",
    "slow_requests", "large_requests",
)


#: Marks of the two periods in front of a session id.
EARLIER, LATER = "0:", "1:"


def in_periods(requests: DataFrame, later: Column) -> DataFrame:
    """Requests whose session id names its period, so that one pass profiles a session's two periods apart.

    Rows for which ``later`` is NULL belong to neither period and are left out.
    """
    mark = F.when(later, LATER).otherwise(EARLIER)
    return requests.where(later.isNotNull()).withColumn("session_id", F.concat(mark, "session_id"))


def split_periods(profiles: DataFrame) -> DataFrame:
    """Profiles or scores of ``in_periods`` sessions with their own session id and ``later``."""
    sid = F.col("session_id")
    return profiles.withColumn("later", sid.startswith(LATER)).withColumn("session_id", F.substring(sid, len(LATER) + 1, 1 << 30))


def _sides(before: DataFrame, after: DataFrame, key: Sequence[str], names: Sequence[str]) -> DataFrame:
    kept = lambda side: [name for name in names if name in side.columns]
    early = before.select(*key, *kept(before), F.lit(False).alias("later"))
    return early.unionByName(after.select(*key, *kept(after), F.lit(True).alias("later")), allowMissingColumns=True)


def _paired(sides: DataFrame, key: Sequence[str], names: Sequence[str]) -> DataFrame:
    """(key, metric, before, after) of rows told apart by ``later``, by one aggregation; what a side lacks is 0."""
    def value(name: str, side: Column) -> Column:
        return F.coalesce(F.max(F.when(side, F.col(name).cast("double"))), F.lit(0.0))

    cells = [
        F.struct(F.lit(name).alias("metric"), value(name, ~F.col("later")).alias("before"), value(name, F.col("later")).alias("after"))
        for name in names if name in sides.columns
    ]
    return sides.groupBy(*key).agg(F.array(*cells).alias("_cells")).select(*key, F.inline("_cells"))


def compare_summaries(before: DataFrame, after: DataFrame, key: Sequence[str]) -> DataFrame:
    """Metric differences; ``percent`` is NULL where there was nothing before. More is worse."""
    return summary_differences(_sides(before, after, key, COMPARED_METRICS), key)


def summary_differences(profiles: DataFrame, key: Sequence[str]) -> DataFrame:
    """``compare_summaries`` of profiles whose period ``later`` tells (see ``split_periods``)."""
    delta = F.col("after") - F.col("before")
    return _paired(profiles, key, COMPARED_METRICS).withColumns(
        {
            "delta": half_even(delta, 2),
            "percent": F.when(F.col("before") != 0, half_even(delta / F.col("before") * 100, 1)),
            "worse": delta > 0,
        }
    )


def compare_scores(before: DataFrame, after: DataFrame, key: Sequence[str], names: Sequence[str] = SCORE_NAMES) -> DataFrame:
    """Score differences over the union of score names. More is better."""
    return score_differences(_sides(before, after, key, names), key, names)


def score_differences(marks: DataFrame, key: Sequence[str], names: Sequence[str] = SCORE_NAMES) -> DataFrame:
    """``compare_scores`` of scores whose period ``later`` tells."""
    delta = F.col("after") - F.col("before")
    return _paired(marks, key, names).withColumns({"delta": delta, "better": delta > 0})
