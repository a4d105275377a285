"""Socket snapshots: lifecycle, roll-ups, listings and interface rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netlens.functions import address as A
from netlens.operators.skew import attach_by_key, previous_value, rolling, rolling_sum
from netlens.operators.summary import frequency_counts, most_common

# History length of the live view, least time between two samples.
HISTORY = 60
MIN_ELAPSED = 0.001
CLOSED = "CLOSED"
LISTEN = "LISTEN"

PRESENT = ("local", "remote")


def with_key(connections: DataFrame) -> DataFrame:
    c = F.col
    return connections.withColumn(
        "conn_key", A.connection_key(c("pid"), c("fd"), c("protocol"), c("local"), c("remote"))
    )


# --- lifecycle ----------------------------------------------------------------------------------


def snapshot_order(snapshots: DataFrame) -> DataFrame:
    """Each (host, snapshot_no) with the number of the next snapshot and whether it is the first."""
    distinct = snapshots.select("host", "snapshot_no").distinct()
    before = previous_value(distinct, ["host"], "snapshot_no", ["snapshot_no"])
    after = before.where(F.col("prev_snapshot_no").isNotNull()).select(
        "host", F.col("prev_snapshot_no").alias("snapshot_no"), F.col("snapshot_no").alias("next_no")
    )
    return before.join(after, ["host", "snapshot_no"], "left").select(
        "host", "snapshot_no", "next_no", F.col("prev_snapshot_no").isNull().alias("is_first")
    )


def connection_changes(connections: DataFrame, snapshots: DataFrame, count_initial: bool = True) -> DataFrame:
    """Open and close records: (host, snapshot_no, conn_key, change).

    ``connections`` has (host, snapshot_no, conn_key); ``snapshots`` lists every snapshot taken, also
    empty ones. A key is open where the snapshot before lacked it and closed at the next snapshot
    that lacks it. Each row says "here now" and "was here one snapshot ago", and both meet under a
    key that includes the snapshot, so a long-lived connection is spread over its snapshots. The
    first snapshot counts as opens only if asked (a recording does, the live view does not).
    """
    order = snapshot_order(snapshots)
    seen = connections.select("host", "snapshot_no", "conn_key").distinct()
    sizes = seen.groupBy("host", "snapshot_no").agg(F.count("*").alias("_size"))
    facts = order.join(sizes, ["host", "snapshot_no"], "left")
    placed = attach_by_key(seen, facts, ["host", "snapshot_no"], "_size", ["conn_key"])
    marks = F.array(
        F.struct(F.col("snapshot_no").alias("at"), F.lit(True).alias("here"), F.col("is_first").alias("first")),
        F.struct(F.col("next_no").alias("at"), F.lit(False).alias("here"), F.lit(False).alias("first")),
    )
    merged = (
        placed.select("host", "conn_key", F.inline(marks))
        .where(F.col("at").isNotNull())
        .groupBy("host", "conn_key", "at")
        .agg(
            F.bool_or("here").alias("here"),
            F.bool_or(~F.col("here")).alias("before"),
            F.bool_or("first").alias("first"),
        )
    )
    opened = F.col("here") & ~F.col("before") & (F.lit(count_initial) | ~F.col("first"))
    closed = ~F.col("here")
    change = F.when(opened, "open").when(closed, "close")
    return merged.select("host", F.col("at").alias("snapshot_no"), "conn_key", change.alias("change")).where(
        F.col("change").isNotNull()
    )


def record_summary(changes: DataFrame, connections: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Per host: snapshots, opened, closed and connections in the last snapshot."""
    counted = changes.groupBy("host").agg(
        F.count_if(F.col("change") == "open").alias("opened"), F.count_if(F.col("change") == "close").alias("closed")
    )
    taken = snapshots.groupBy("host").agg(
        F.countDistinct("snapshot_no").alias("snapshots"), F.max("snapshot_no").alias("last_no")
    )
    held = connections.groupBy("host", F.col("snapshot_no").alias("last_no")).agg(
        F.countDistinct("conn_key").alias("active")
    )
    zero = F.lit(0).cast("bigint")
    return (
        taken.join(held, ["host", "last_no"], "left")
        .join(counted, "host", "left")
        .select(
            "host", "snapshots", F.coalesce("opened", zero).alias("opened"), F.coalesce("closed", zero).alias("closed"),
            F.coalesce("active", zero).alias("active_at_end"),
        )
    )


def two_snapshot_difference(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Keys that opened and closed between two snapshots, by two anti joins."""
    opened = after.join(before, key, "left_anti").select(*key, F.lit("open").alias("change"))
    closed = before.join(after, key, "left_anti").select(*key, F.lit("close").alias("change"))
    return opened.unionByName(closed)


# --- roll-ups -----------------------------------------------------------------------------------


def process_rollup(connections: DataFrame, key: tuple[str, ...] = ("host",)) -> DataFrame:
    """Per process and pid: sockets, remote ones, TCP, UDP, listeners, distinct remote hosts."""
    protocol, state = F.col("protocol"), F.coalesce("state", F.lit(""))
    return connections.groupBy(*key, "process", "pid").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("remote").isNotNull()).alias("remote"),
        F.count_if(protocol == "TCP").alias("tcp"),
        F.count_if(protocol == "UDP").alias("udp"),
        F.count_if(state == LISTEN).alias("listen"),
        F.countDistinct("remote.host").alias("targets"),
    )


def process_order() -> list[Column]:
    return [F.desc("remote"), F.desc("total"), F.lower(F.col("process")).asc()]


def overview(connections: DataFrame) -> DataFrame:
    """Per host: sockets, remote ones, listeners, TCP and UDP among the remote ones."""
    remote = F.col("remote").isNotNull()
    return connections.groupBy("host").agg(
        F.count("*").alias("connections"),
        F.count_if(remote).alias("remote"),
        F.count_if(F.col("state") == LISTEN).alias("listen"),
        F.count_if(remote & (F.col("protocol") == "TCP")).alias("tcp"),
        F.count_if(remote & (F.col("protocol") == "UDP")).alias("udp"),
    )


def top_processes(connections: DataFrame, n: int = 8, seq: str = "seq") -> DataFrame:
    """Processes with most remote sockets per host, ties first seen first."""
    return most_common(connections.where(F.col("remote").isNotNull()), ["host"], "process", n, seq)


def connection_summary(connections: DataFrame) -> DataFrame:
    """Sockets by process and by protocol per host, with totals, in one pass."""
    cells = F.array(
        F.struct(F.lit("by_process").alias("dimension"), F.col("process").alias("value")),
        F.struct(F.lit("by_protocol").alias("dimension"), F.col("protocol").alias("value")),
        F.struct(F.lit("total").alias("dimension"), F.lit("all").alias("value")),
        F.struct(
            F.lit("total").alias("dimension"), F.when(F.col("remote").isNotNull(), F.lit("remote")).alias("value")
        ),
    )
    rows = connections.select("host", F.inline(cells)).where(F.col("value").isNotNull())
    return rows.groupBy("host", "dimension", "value").agg(F.count("*").alias("count"))


def recording_summary(events: DataFrame) -> DataFrame:
    """Connection recording: events, opened, closed, distinct processes."""
    return events.groupBy("session_id").agg(
        F.count("*").alias("events"),
        F.count_if(F.col("type") == "connection_open").alias("opened"),
        F.count_if(F.col("type") == "connection_close").alias("closed"),
        F.countDistinct(F.coalesce("process", F.lit("unknown"))).alias("processes"),
    )


def recording_processes(events: DataFrame) -> DataFrame:
    """Events per process of a connection recording."""
    cell = F.array(F.struct(F.lit("processes").alias("dimension"), F.coalesce("process", F.lit("unknown")).alias("value")))
    return frequency_counts(events.select("session_id", "seq", F.inline(cell)))


# --- listings -----------------------------------------------------------------------------------


def filter_connections(
    connections: DataFrame, process: str = "", remote_only: bool = False, state: str = "", text: str = "",
    show_closed: bool = True,
) -> DataFrame:
    """Process substring, remote only, state, free text over seven fields; closed sockets can be hidden."""
    kept = connections
    held = F.coalesce("state", F.lit(""))
    if not show_closed:
        kept = kept.where(held != CLOSED)
    if process:
        kept = kept.where(F.lower("process").contains(process.lower()))
    if remote_only:
        kept = kept.where(F.col("remote").isNotNull())
    if state:
        kept = kept.where(F.lower(held) == state.lower())
    if text:
        fields = F.concat_ws(
            " ", "process", F.col("pid").cast("string"), "protocol", A.endpoint_text(F.col("local")),
            F.coalesce(A.endpoint_text(F.col("remote")), F.lit("")), held, "path",
        )
        kept = kept.where(F.lower(fields).contains(text.lower()))
    return kept


def connection_order(sort: str = "process") -> list[Column]:
    """Listing orders: process, remote, state or pid."""
    target = F.coalesce(A.endpoint_text(F.col("remote")), A.endpoint_text(F.col("local")))
    orders = {
        "process": [F.lower("process").asc(), F.asc("pid"), target.asc()],
        "remote": [target.asc(), F.asc("process"), F.asc("pid")],
        "state": [F.asc("state"), F.asc("process"), F.asc("pid")],
        "pid": [F.asc("pid"), F.asc("process"), target.asc()],
    }
    return orders[sort]


def vpn_default_hosts(routes: DataFrame) -> DataFrame:
    """Per host, whether a default route leaves through a tunnel."""
    tunnel = (F.col("destination") == "default") & A.starts_with_any(F.col("interface"), A.VPN_ROUTE_PREFIXES)
    return routes.groupBy("host").agg(F.bool_or(tunnel).alias("vpn_default"))


def with_paths(connections: DataFrame, routes: DataFrame) -> DataFrame:
    """Set ``path`` of each connection from its addresses and its host's default route."""
    flagged = vpn_default_hosts(routes)
    sizes = connections.groupBy("host").agg(F.count("*").alias("_size"))
    facts = sizes.join(flagged, "host", "left")
    joined = attach_by_key(connections.drop("path"), facts, ["host"], "_size", ["pid", "fd", "local.port"])
    path = A.connection_path(F.col("local.host"), F.col("remote.host"), F.col("vpn_default"))
    return joined.withColumn("path", path).drop("vpn_default")


# --- interface counters -------------------------------------------------------------------------

COUNTERS = ("rx_bytes", "tx_bytes", "rx_packets", "tx_packets", "rx_errors", "tx_errors", "drops")


def deduplicate_counters(counters: DataFrame, key: tuple[str, ...] = ("host", "snapshot_no")) -> DataFrame:
    """One row per interface: every address row repeats the totals, so the largest counts."""
    return counters.groupBy(*key, "name").agg(
        *[F.greatest(F.lit(0).cast("bigint"), F.coalesce(F.max(name), F.lit(0))).alias(name) for name in COUNTERS]
    )


def interfaces_with_counters(interfaces: DataFrame, counters: DataFrame) -> DataFrame:
    """Interfaces with their counters, NULL where there are none."""
    return interfaces.join(counters, ["host", "snapshot_no", "name"], "left")


def interface_rates(samples: DataFrame) -> DataFrame:
    """Bytes per second since the interface's previous sample; 0 at first sight and after a reset.

    ``samples`` has (host, name, ts_ms, rx_bytes, tx_bytes).
    """
    back = previous_value(samples, ["host", "name"], "ts_ms", ["ts_ms", "rx_bytes", "tx_bytes"])
    elapsed = F.greatest(F.lit(MIN_ELAPSED), (F.col("ts_ms") - F.col("prev_ts_ms")) / 1000.0)

    def rate(name: str) -> Column:
        grown = F.greatest(F.lit(0.0), (F.col(name) - F.col("prev_" + name)) / elapsed)
        return F.coalesce(grown, F.lit(0.0))

    return back.select("host", "name", "ts_ms", rate("rx_bytes").alias("rx_rate"), rate("tx_bytes").alias("tx_rate"))


def rate_history(rates: DataFrame, width: int = HISTORY) -> DataFrame:
    """Total rates of a host per sample time and their sums over the last samples."""
    totals = rates.groupBy("host", "ts_ms").agg(F.sum("rx_rate").alias("rx"), F.sum("tx_rate").alias("tx"))
    return rolling_sum(totals, ["host"], "ts_ms", ["rx", "tx"], width)


def live_history(rates: DataFrame, width: int = HISTORY) -> DataFrame:
    """Total rates of a host per sample time, with the last ``width`` totals up to it as lists, oldest first.

    A host's first sample has nothing to be compared with, so it is no total.
    """
    totals = rates.groupBy("host", "ts_ms").agg(F.sum("rx_rate").alias("rx"), F.sum("tx_rate").alias("tx"))
    return rolling(totals, ["host"], "ts_ms", {"history_rx": F.collect_list("rx"), "history_tx": F.collect_list("tx")}, width, skip=1)


def recent_changes(changes: DataFrame, n: int = 100) -> DataFrame:
    """The latest open and close records of each host."""
    latest = Window.partitionBy("host").orderBy(F.desc("snapshot_no"), F.asc("change"), F.asc("conn_key"))
    return changes.withColumn("rank", F.row_number().over(latest)).where(F.col("rank") <= n)
