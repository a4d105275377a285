"""Host text logs: socket listings, route tables, interface counters, neighbours.

Every reader takes (host, snapshot_no, pos, value) lines, ``pos`` being the line's place in its
listing. A listing is the output of one command on one host, so what precedes a line is found with
a grouped minimum, not with an ordered window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netlens.functions import address as A
from netlens.operators.skew import attach_by_key
from netlens.sources.jsonl import file_position, session_of

LISTING = ["host", "snapshot_no"]


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a folder of ``<host>.<snapshot_no>.txt`` files (snapshot 0 without a number)."""
    name = session_of(spark, path)
    number = F.regexp_extract(name, r"\.([0-9]+)$", 1)
    return spark.read.text(path, recursiveFileLookup=True).select(
        F.regexp_replace(name, r"\.[0-9]+$", "").alias("host"),
        F.coalesce(number.try_cast("bigint"), F.lit(0).cast("bigint")).alias("snapshot_no"),
        file_position(spark).alias("pos"),
        F.make_valid_utf8(F.col("value")).alias("value"),
    )


def _fields(value: Column, limit: int = -1) -> Column:
    return F.split(F.ltrim(value), r"\s+", limit)


def _stripped(value: Column) -> Column:
    return F.regexp_replace(value, r"^\s+|\s+$", "")


def _after_header(lines: DataFrame, header: Column) -> DataFrame:
    """Non-header, non-blank lines that come after the first header line of their listing."""
    facts = lines.groupBy(*LISTING).agg(
        F.min(F.when(header, F.col("pos"))).alias("_header"), F.count("*").alias("_lines")
    )
    placed = attach_by_key(lines.where(~header & F.col("value").rlike(r"\S")), facts, LISTING, "_lines", ["pos"])
    return placed.where(F.col("pos") > F.col("_header")).drop("_header")


def parse_sockets(lines: DataFrame) -> DataFrame:
    """Connections of socket listings; ``path`` is left open (see ``connections.with_paths``)."""
    body = lines.where(F.col("value").rlike(r"\S") & ~F.col("value").startswith("COMMAND"))
    cut = body.withColumn("_f", _fields(F.col("value"), 9)).where(
        (F.size("_f") == 9) & F.get("_f", F.lit(1)).rlike(r"^[0-9]+$")
    )
    field = [F.get("_f", F.lit(index)) for index in range(9)]
    name = F.regexp_replace(field[8], r"\s+\([^)]+\)\s*$", "")
    has_remote = name.contains("->")
    local = A.parse_endpoint(F.when(has_remote, F.substring_index(name, "->", 1)).otherwise(name))
    remote = A.parse_endpoint(F.regexp_replace(name, r"^.*?->", ""))
    return cut.select(
        *LISTING,
        "pos",
        A.decode_escapes(field[0]).alias("process"),
        field[1].try_cast("int").alias("pid"),
        field[2].alias("user"),
        field[3].alias("fd"),
        field[4].alias("family"),
        F.upper(field[7]).alias("protocol"),
        local.alias("local"),
        F.when(has_remote, remote).alias("remote"),
        F.regexp_extract(field[8], r"\s+\(([^)]+)\)\s*$", 1).alias("state"),
        F.lit(None).cast("string").alias("path"),
    )


def parse_routes(lines: DataFrame) -> DataFrame:
    """Routes after the ``Destination`` header; rows of fewer than four fields are dropped."""
    rows = _after_header(lines, F.col("value").startswith("Destination")).withColumn(
        "_f", F.split(_stripped(F.col("value")), r"\s+")
    )
    names = ("destination", "gateway", "flags", "interface")
    return rows.where(F.size("_f") >= 4).select(
        *LISTING, "pos",
        *[F.get("_f", F.lit(index)).alias(name) for index, name in enumerate(names)],
        F.coalesce(F.get("_f", F.lit(4)), F.lit("")).alias("expire"),
    )


# Counter columns and the names they are kept under.
COUNTER_COLUMNS = {
    "Ibytes": "rx_bytes", "Obytes": "tx_bytes", "Ipkts": "rx_packets", "Opkts": "tx_packets", "Ierrs": "rx_errors",
    "Oerrs": "tx_errors", "Drop": "drops",
}


def parse_counters(lines: DataFrame) -> DataFrame:
    """Counter rows named by their listing's header; short rows are dropped, ``-`` reads as missing.

    One row per address: combine them with ``connections.deduplicate_counters``.
    """
    fields = F.split(_stripped(F.col("value")), r"\s+")
    cut = lines.where(F.col("value").rlike(r"\S")).withColumn("_f", fields)
    header = (
        (F.get("_f", F.lit(0)) == "Name") & F.array_contains("_f", "Ibytes") & F.array_contains("_f", "Obytes")
    )
    facts = cut.groupBy(*LISTING).agg(
        F.min_by("_f", F.when(header, F.col("pos"))).alias("_names"),
        F.min(F.when(header, F.col("pos"))).alias("_header"),
        F.count("*").alias("_lines"),
    )
    rows = attach_by_key(cut.where(~header), facts, LISTING, "_lines", ["pos"]).where(
        (F.col("pos") > F.col("_header")) & (F.size("_f") >= F.size("_names"))
    )

    def column(name: str) -> Column:
        place = F.array_position("_names", name)
        return F.when(place > 0, F.get("_f", (place - 1).cast("int")))

    return rows.select(
        *LISTING,
        column("Name").alias("name"),
        *[column(source).try_cast("bigint").alias(target) for source, target in COUNTER_COLUMNS.items()],
    ).where(F.col("name") != "")


def parse_arp(lines: DataFrame) -> DataFrame:
    """IPv4 neighbours."""
    shape = r"^(.*?)\s*\(([^)]+)\)\s+at\s+(\S+)\s+on\s+(\S+)(.*)$"
    value = _stripped(F.col("value"))
    names = ("name", "address", "mac", "interface")
    return lines.where(value.rlike(shape)).select(
        *LISTING, "pos",
        *[F.regexp_extract(value, shape, index + 1).alias(name) for index, name in enumerate(names)],
        F.lit("IPv4").alias("family"),
        _stripped(F.regexp_extract(value, shape, 5)).alias("state"),
    )


def parse_ndp(lines: DataFrame) -> DataFrame:
    """IPv6 neighbours, after the ``Neighbor`` header."""
    rows = _after_header(lines, F.col("value").startswith("Neighbor")).withColumn(
        "_f", F.split(_stripped(F.col("value")), r"\s+")
    )
    return rows.where(F.size("_f") >= 3).select(
        *LISTING, "pos",
        F.lit("?").alias("name"),
        *[F.get("_f", F.lit(index)).alias(name) for index, name in enumerate(("address", "mac", "interface"))],
        F.lit("IPv6").alias("family"),
        F.array_join(F.slice("_f", F.lit(4), F.greatest(F.lit(0), F.size("_f") - 3)), " ").alias("state"),
    )


def neighbours(arp_lines: DataFrame, ndp_lines: DataFrame, show_all: bool = False) -> DataFrame:
    """Both neighbour tables; multicast addresses and incomplete entries only on request."""
    both = parse_arp(arp_lines).unionByName(parse_ndp(ndp_lines))
    if show_all:
        return both
    address = F.col("address")
    return both.where(~(A.is_ip(address) & (A.is_multicast(address) | (F.col("mac") == "(incomplete)"))))


def default_routes(routes: DataFrame) -> DataFrame:
    return routes.where(F.col("destination") == "default")
