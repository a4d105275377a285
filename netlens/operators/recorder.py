"""What the browser recorder counts while it runs, from its event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netlens.functions import url as U
from netlens.functions.numbers import half_even, whole
from netlens.operators.correlate import FAILED, FINISHED, RESPONSE, START
from netlens.operators.skew import BLOCK_BITS, block_totals, by_block
from netlens.operators.summary import frequency_counts

PAGE_LOADED = "Page.loadEventFired"
ACTIVITY = (START, RESPONSE, FINISHED, FAILED)


def _get(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("body", "$.params." + path, kind)


def recorder_counters(events: DataFrame) -> DataFrame:
    """Counter tables of a recording: domains, resource types and methods of starts, statuses of responses."""
    method = F.col("method")
    cell = lambda name, value: F.struct(F.lit(name).alias("dimension"), value.alias("value"))
    starts = F.array(
        cell("domains", F.coalesce(U.url_host(_get("request.url")), F.lit("unknown"))),
        cell("resource_types", F.coalesce(_get("type"), F.lit("Other"))),
        cell("methods", F.coalesce(_get("request.method"), F.lit("?"))),
    )
    replies = F.array(cell("statuses", whole(_get("response.status")).cast("string")))
    rows = events.where((F.col("type") == "cdp_event") & method.isin(START, RESPONSE)).select(
        "session_id", "seq", F.inline(F.when(method == START, starts).otherwise(replies))
    )
    return frequency_counts(rows)


def recorder_summary(events: DataFrame) -> DataFrame:
    """Distinct request ids, failures, HTTP errors, encoded bytes and observed seconds per session."""
    method = F.col("method")
    wall = F.col("timestamp").try_cast("timestamp")
    rows = events.where(F.col("type") == "cdp_event").select(
        "session_id", "method", "request_id", wall.alias("wall"),
        F.when(method == RESPONSE, whole(_get("response.status"))).alias("status"),
        F.when(method == FINISHED, whole(_get("encodedDataLength"))).alias("encoded"),
    )
    totals = rows.groupBy("session_id").agg(
        F.countDistinct(F.when(method == START, F.col("request_id"))).alias("requests"),
        F.count_if(method == FAILED).alias("network_failures"),
        F.count_if(F.col("status") >= 400).alias("http_errors"),
        F.coalesce(F.sum("encoded"), F.lit(0)).alias("encoded_bytes"),
        half_even(
            (F.unix_micros(F.max("wall")) - F.unix_micros(F.min("wall"))) / F.lit(1_000_000.0), 2
        ).alias("observed_seconds"),
    )
    return totals.withColumn("failed", F.col("network_failures") + F.col("http_errors"))


def activity(events: DataFrame) -> DataFrame:
    """(session_id, request_id, seq, ts, kind) of the network and load events that the idle rule looks at."""
    stamp = F.coalesce(_get("timestamp", "double"), F.unix_micros(F.col("timestamp").try_cast("timestamp")) / 1e6)
    return events.where((F.col("type") == "cdp_event") & F.col("method").isin(*ACTIVITY, PAGE_LOADED)).select(
        "session_id", "request_id", "seq", stamp.alias("ts"), F.col("method").alias("kind")
    )


def _turn() -> Column:
    """1 where a request id opens, -1 where it ends, NULL elsewhere and without an id."""
    kind = F.col("kind")
    return F.when(F.col("request_id").isNull(), None).when(kind == START, 1).when(kind.isin(FINISHED, FAILED), -1)


def _scanned(rows: DataFrame, bits: int) -> DataFrame:
    """Rows with ``in_flight``, the next move's time in ``_next`` and the session's load time in ``_load``.

    The open ids form a set: a second start of an open id adds nothing, a second end removes nothing. Every block of
    ``seq`` is scanned as if nothing were open before it. An id that was open on entry is off by one up to its first
    turn in the block, so a block needs two things from outside: how many ids were open on entry, and at which rows one of
    them has its first turn. Both come from one summary per (block, id), chained by id. Open counts, first moves and load
    times of the blocks are folded once over the blocks of a session.
    """
    cut = ["session_id", "_block"]
    blocked = by_block(rows.withColumn("_turn", _turn()), ["session_id"], "seq", bits)
    moved = F.when(F.col("kind") != PAGE_LOADED, F.struct("ts"))
    turned = F.when(F.col("_turn").isNotNull(), F.col("seq"))
    ids = block_totals(
        blocked, [*cut, "request_id"], F.min(turned).alias("_first"), F.max_by("_turn", turned).alias("_left"),
        F.min(F.when(moved.isNotNull(), F.struct("seq", moved.alias("move")))).alias("_move"),
        F.min(F.when(moved.isNull(), F.col("ts"))).alias("_load"),
    ).drop("_touched")
    before = Window.partitionBy("session_id", "request_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    chained = ids.withColumn("_was", F.last("_left", ignorenulls=True).over(before))
    entered = F.col("_first").isNotNull() & F.coalesce(F.col("_was") == 1, F.lit(False))

    per_block = chained.groupBy(*cut).agg(
        (F.count_if(F.col("_left") == 1) - F.count_if(entered)).alias("_net"), F.min("_move").alias("_move"), F.min("_load").alias("_load")
    )
    by_session = Window.partitionBy("session_id").orderBy("_block")
    backwards = Window.partitionBy("session_id").orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    folded = per_block.select(
        *cut, F.coalesce(F.sum("_net").over(by_session.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_entry"),
        F.last("_move", ignorenulls=True).over(backwards)["move"].alias("_later"),
        F.min("_load").over(Window.partitionBy("session_id")).alias("_load"),
    )

    marks = chained.where(entered).select(*cut, F.col("_first").alias("seq"), F.lit(-1).alias("_effect")).repartition(*cut)
    earlier = F.lag("_turn").over(Window.partitionBy(*cut, "request_id", F.col("_turn").isNull()).orderBy("seq"))
    known = F.coalesce(earlier, F.lit(-1))
    effect = F.when((F.col("_turn") == 1) & (known == -1), 1).when((F.col("_turn") == -1) & (known == 1), -1).otherwise(0)
    local = blocked.select("*", effect.alias("_effect"), moved.alias("_moved"), F.lit(True).alias("_real")).unionByName(
        marks, allowMissingColumns=True
    )
    # A mark stands just before the row whose turn it corrects.
    inside = Window.partitionBy(*cut).orderBy("seq", F.col("_real").asc_nulls_first())
    scanned = local.withColumns({
        "_open": F.sum("_effect").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        "_ahead": F.lead("_moved").over(Window.partitionBy(*cut, F.col("_moved").isNull()).orderBy("seq")),
    }).where("_real")
    return scanned.join(folded, cut).select(
        *rows.columns, (F.col("_open") + F.col("_entry")).alias("in_flight"),
        F.coalesce("_ahead", "_later")["ts"].alias("_next"), "_load",
    )


def in_flight(rows: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """Add the number of open request ids after each row; rows without a request id change nothing."""
    return _scanned(rows, bits).drop("_next", "_load")


def in_flight_peak(rows: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """Most requests open at once and requests still open at the end, per session."""
    return in_flight(rows, bits).groupBy("session_id").agg(
        F.max("in_flight").alias("peak"), F.max_by("in_flight", "seq").alias("open_at_end")
    )


def network_idle(rows: DataFrame, idle_seconds: float, bits: int = BLOCK_BITS) -> DataFrame:
    """First moment per session at which the page is loaded, nothing is open and nothing has moved for a while.

    Activity means a request, response, end or failure; the load event itself is not. The session's
    last row is quiet for good, so it qualifies as well.
    """
    ready = F.greatest(F.col("ts") + F.lit(idle_seconds), F.col("_load"))
    return (
        _scanned(rows, bits)
        .where((F.col("kind") != PAGE_LOADED) & (F.col("in_flight") == 0) & F.col("_load").isNotNull())
        .where(F.col("_next").isNull() | (F.col("_next") - F.col("ts") >= idle_seconds) & (ready <= F.col("_next")))
        .groupBy("session_id")
        .agg(F.min(ready).alias("idle_at"))
    )
