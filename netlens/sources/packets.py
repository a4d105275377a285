"""Packet logs: one text line per packet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netlens.sources.jsonl import file_position, session_of

# What a host.port pair looks like and how DNS questions and answers are written.
ENDPOINT = r"((?:\d{1,3}\.){3}\d{1,3}|[0-9a-fA-F:]+)\.(\d+)"
ENDPOINT_EXACT = (
    r"(?<![\w.:])((?:\d{1,3}\.){3}\d{1,3}|[0-9a-fA-F]*:[0-9a-fA-F:]*)\.(\d+)(?![\w.])"
)
QUESTION = r"\b(\d+)\+?\s+\[?\d*[a-zA-Z]*\]?\s*(A|AAAA|HTTPS|CNAME|MX|TXT|PTR)\?\s+([^\s]+)"
QUESTION_EXACT = r"\b(\d+)[+%*-]*\s+(?:\[[^\]]*\]\s*)*(AAAA|HTTPS|CNAME|MX|TXT|PTR|A)\?\s+([^\s]+)"
ANSWER = r"(?i)\b(\d+)\s+(?:NXDomain|ServFail|\d+/\d+/\d+)"
ANSWER_EXACT = r"(?i)\b(\d+)[*|$-]*\s+(?:\[[^\]]*\]\s*)*(?:NXDomain|ServFail|\d+/\d+/\d+)"


def read_packet_log(spark: SparkSession, path: str) -> DataFrame:
    """(capture_id, seq, value) lines of a folder of packet logs."""
    return spark.read.text(path, recursiveFileLookup=True).select(
        session_of(spark, path).alias("capture_id"),
        file_position(spark).alias("seq"),
        F.make_valid_utf8(F.col("value")).alias("value"),
    )


def _line(value: Column) -> Column:
    return F.btrim(value, F.lit(" \t\r\n\x0b\x0c"))


def _with_endpoints(lines: DataFrame, compat: bool) -> DataFrame:
    """Add ``source`` and ``destination``, the first two host.port pairs of ``raw``; NULL unless there are two.

    A line may begin with a time of day, whose fraction looks like a port, and an address without a
    port falls apart into shorter pairs. So only what follows the protocol word is searched, for
    whole addresses, unless ``compat`` asks for the plain pattern over the whole line.
    """
    line = F.col("raw")
    text = line
    if not compat:
        for word in ("ARP,", "IP6 ", "IP "):
            place = F.instr(line, word)
            text = F.when(place > 0, F.substring(line, place + len(word), F.length(line))).otherwise(text)
    pairs = F.regexp_extract_all(text, F.lit(ENDPOINT if compat else ENDPOINT_EXACT), F.lit(0))

    def end(index: int) -> Column:
        pair = F.get("_pairs", F.lit(index))
        port = F.substring_index(pair, ".", -1)
        host = F.left(pair, F.length(pair) - F.length(port) - 1)
        return F.when(F.size("_pairs") >= 2, F.struct(host.alias("host"), port.alias("port")))

    # explode() pins the search: filters on either end would otherwise repeat it.
    found = lines.select("*", F.explode(F.array(pairs)).alias("_pairs"))
    return found.withColumns({"source": end(0), "destination": end(1)}).drop("_pairs")


def parse_packets(lines: DataFrame, compat: bool = False) -> DataFrame:
    """Protocol, endpoints and payload length of every non-blank line."""
    line = F.col("raw")
    padded = F.concat(F.lit(" "), line, F.lit(" "))
    protocol = (
        F.when(line.contains(" Flags ["), "tcp")
        .when(line.rlike(r"\bUDP, length\s+\d+"), "udp")
        .when(line.contains("ICMP"), "icmp")
        .when(line.contains("ARP,"), "arp")
        .when(padded.contains(" IP6 "), "ipv6")
        .when(padded.contains(" IP "), "ipv4")
        .otherwise("other")
    )
    stripped = lines.where(F.col("value").rlike(r"\S")).select("capture_id", "seq", _line(F.col("value")).alias("raw"))
    return _with_endpoints(stripped, compat).select(
        "capture_id", "seq", protocol.alias("protocol"), "source", "destination",
        F.coalesce(F.regexp_extract(line, r"\blength\s+(\d+)", 1).try_cast("bigint"), F.lit(0)).alias("length"),
        "raw",
    )


def parse_dns_packets(lines: DataFrame, compat: bool = False) -> DataFrame:
    """DNS questions and answers among packet lines.

    Lines to and from port 53 are kept; ``compat`` keeps only those the original gate accepts
    (``.53:``, so answers are mostly lost) and its question pattern (which reads AAAA as A).
    """
    line = F.col("raw")
    gate = line.contains(".53:") if compat else line.contains(".53:") | line.contains(".53 > ")
    question, answer = (QUESTION, ANSWER) if compat else (QUESTION_EXACT, ANSWER_EXACT)
    asked = line.rlike(question)
    answered = ~asked & line.rlike(answer)
    number = F.when(asked, F.regexp_extract(line, question, 1)).when(answered, F.regexp_extract(line, answer, 1))
    kept = lines.select("capture_id", "seq", _line(F.col("value")).alias("raw")).where(line.contains(" > ") & gate)
    return _with_endpoints(kept, compat).select(
        "capture_id", "seq", "source", "destination",
        F.when(asked, "query").when(answered, "response").otherwise("unknown").alias("direction"),
        number.try_cast("bigint").alias("transaction_id"),
        F.when(asked, F.regexp_extract(line, question, 2)).alias("query_type"),
        F.when(asked, F.regexp_replace(F.regexp_extract(line, question, 3), r"\.+$", "")).alias("domain"),
        "raw",
    )
