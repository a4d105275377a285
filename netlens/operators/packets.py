"""Packet and DNS roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlens.operators.skew import top_per_group
from netlens.operators.summary import most_common

# Rows kept.
TOP_ROWS = 30
SAMPLE_ROWS = 50
DOMAIN_ROWS = 25

KEY = ["capture_id"]


def limit_packets(packets: DataFrame, limit: int, order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """The first packets of each capture in file order; 0 keeps all. Every task ends a capture after ``limit`` packets of its own.

    ``order`` may name more columns, where packets share a ``seq``.
    """
    return top_per_group(packets, KEY, [F.asc(name) for name in order], limit, "_n").drop("_n") if limit else packets


def packet_totals(packets: DataFrame, limit: int = 0) -> DataFrame:
    """Packets, observed payload bytes and whether a packet limit was reached, per capture."""
    totals = packets.groupBy(*KEY).agg(F.count("*").alias("packets"), F.sum("length").alias("payload_bytes"))
    reached = F.col("packets") >= limit if limit else F.lit(False)
    return totals.withColumn("limited", reached)


def packet_protocols(packets: DataFrame) -> DataFrame:
    return packets.groupBy(*KEY, "protocol").agg(F.count("*").alias("count"), F.min("seq").alias("first_seq"))


def _ends(packets: DataFrame) -> DataFrame:
    """Both ends of every packet, source first."""
    ends = F.array(F.col("source"), F.col("destination"))
    return (
        packets.select(*KEY, (F.col("seq") * 2).alias("_seq"), F.posexplode(ends).alias("_side", "end"))
        .where(F.col("end").isNotNull())
        .select(*KEY, (F.col("_seq") + F.col("_side")).alias("seq"), "end.host", "end.port")
    )


def top_endpoints(packets: DataFrame, n: int = TOP_ROWS) -> DataFrame:
    return most_common(_ends(packets), KEY, "host", n)


def top_ports(packets: DataFrame, n: int = TOP_ROWS) -> DataFrame:
    return most_common(_ends(packets), KEY, "port", n)


def top_conversations(packets: DataFrame, n: int = TOP_ROWS) -> DataFrame:
    """Unordered pairs of ``host:port`` ends."""

    def text(end: str) -> Column:
        return F.concat(F.col(end + ".host"), F.lit(":"), F.col(end + ".port"))

    pair = F.array_join(F.array_sort(F.array(text("source"), text("destination"))), " ↔ ")
    pairs = packets.where(F.col("source").isNotNull() & F.col("destination").isNotNull())
    return most_common(pairs.select(*KEY, "seq", pair.alias("conversation")), KEY, "conversation", n)


def packet_samples(packets: DataFrame, n: int = SAMPLE_ROWS) -> DataFrame:
    return top_per_group(packets.select(*KEY, "seq", "raw"), KEY, [F.asc("seq")], n)


def dns_totals(packets: DataFrame) -> DataFrame:
    return packets.groupBy(*KEY).agg(
        F.count_if(F.col("direction") == "query").alias("queries"),
        F.count_if(F.col("direction") == "response").alias("responses"),
    )


def _queries(packets: DataFrame) -> DataFrame:
    return packets.where(F.col("direction") == "query")


def top_domains(packets: DataFrame, n: int = DOMAIN_ROWS) -> DataFrame:
    named = _queries(packets).withColumn("domain", F.coalesce("domain", F.lit("unknown")))
    return most_common(named.select(*KEY, "seq", "domain"), KEY, "domain", n)


def dns_servers(packets: DataFrame) -> DataFrame:
    """Queries per server."""
    server = F.col("destination.host")
    return (
        _queries(packets)
        .where(server.isNotNull())
        .groupBy(*KEY, server.alias("server"))
        .agg(F.count("*").alias("count"), F.min("seq").alias("first_seq"))
    )
