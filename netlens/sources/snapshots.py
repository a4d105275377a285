"""Host snapshots and probe reports: JSON documents with a known shape.

A document is one record; every table in it is exploded to flat rows. Several documents per host
make a fleet history: ``snapshot_no`` is the document's time in milliseconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netlens.schemas import CONNECTION_FIELDS
from netlens.sources.jsonl import session_of

COUNTER = (
    "struct<rx_bytes:bigint,tx_bytes:bigint,rx_packets:bigint,tx_packets:bigint,rx_errors:bigint,tx_errors:bigint,"
    "drops:bigint>"
)
ROUTE = "struct<destination:string,gateway:string,flags:string,interface:string,expire:string>"
FINDING = "struct<severity:string,code:string,title:string,detail:string,recommendation:string>"


def _struct(fields: str) -> str:
    from netlens.sources.jsonl import _colon

    return f"struct<{_colon(fields)}>"


SNAPSHOT = (
    "timestamp string, version string, "
    f"connections array<{_struct(CONNECTION_FIELDS)}>, "
    "interfaces array<struct<name:string,flags:array<string>,mtu:int,ipv4:array<string>,ipv6:array<string>,status:string>>, "
    f"routes array<{ROUTE}>, "
    "dns array<struct<id:int,nameservers:array<string>,search_domains:array<string>>>, "
    f"proxy map<string,string>, interface_counters map<string,{COUNTER}>, quality struct<score:int>, "
    f"dns_routes array<struct<server:string,interface:string>>, ipv6_routes array<{ROUTE}>"
)

PROBE = "struct<target:string,ok:boolean,duration_ms:double,details:{0},error:string>"
QUALITY = (
    "timestamp string, score int, "
    f"ping {PROBE.format('struct<packet_loss_percent:double,min_ms:double,avg_ms:double,max_ms:double,jitter_ms:double>')}, "
    f"dns {PROBE.format('struct<samples_ms:array<double>,addresses:array<string>>')}, "
    f"tls {PROBE.format('struct<tcp_ms:double,tls_ms:double,version:string>')}, "
    f"http {PROBE.format('struct<status:int,ttfb_ms:double>')}"
)
DNS_COMPARISON = (
    "timestamp string, domain string, query_type string, results array<struct<server:string,ok:boolean,duration_ms:double,"
    "records:array<struct<section:string,name:string,type:string,ttl:bigint,value:string>>>>"
)
TLS_REPORT = (
    "timestamp string, domain string, port int, ok boolean, tls_version string, "
    "timing_ms struct<dns:double,tcp:double,tls:double,total:double>, certificate struct<not_after:string>"
)
TRACE = (
    "timestamp string, target string, ok boolean, "
    "hops array<struct<hop:int,addresses:array<string>,samples_ms:array<double>,raw:string>>"
)
SUMMARY = (
    "struct<connections:int,remote_connections:int,interfaces:int,active_interfaces:array<string>,dns_servers:array<string>,"
    f"vpn_active:boolean,default_routes:array<{ROUTE}>>"
)
DIAGNOSIS = f"timestamp string, score int, summary {SUMMARY}, findings array<{FINDING}>"
LEAK_REPORT = (
    "timestamp string, dns_routes array<struct<server:string,interface:string>>, "
    f"ipv6_default_routes array<{ROUTE}>, findings array<{FINDING}>"
)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(host, value) rows, one JSON document per file."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(
        session_of(spark, path).alias("host"), F.make_valid_utf8(F.col("value")).alias("value")
    )


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """(host, snapshot_no, value) of stored reports: JSON lines that name their host, as ``sinks.documents`` writes them.

    A line that cannot be read, or names no host, keeps a NULL host; ``rejected_documents`` tells those that are no JSON.
    """
    lines = spark.read.text(path, recursiveFileLookup=True).select(F.make_valid_utf8(F.col("value")).alias("value"))
    named = F.from_json("value", "host string, snapshot_no bigint")
    return lines.select(named["host"].alias("host"), named["snapshot_no"].alias("snapshot_no"), "value")


def reported_findings(reports: DataFrame) -> DataFrame:
    """The findings of stored diagnoses or leak reports in their order, from 1."""
    rows = reports.select("host", "snapshot_no", F.posexplode("findings").alias("position", "_f"))
    return rows.select("host", "snapshot_no", (F.col("position") + 1).alias("position"), "_f.*")


def rejected_documents(documents: DataFrame) -> DataFrame:
    """The documents that ``parse_documents`` leaves out, each with its reason and whole text."""
    bad = documents.where(F.get_json_object("value", "$").isNull())
    kept = [name for name in documents.columns if name != "value"]
    return bad.select(*kept, F.lit("malformed JSON").alias("reason"), "value")


def parse_documents(documents: DataFrame, schema: str) -> DataFrame:
    """Typed columns of the documents; ``snapshot_no`` from their time, unreadable documents are in ``rejected_documents``."""
    read = documents.withColumn("_d", F.from_json("value", schema)).where(F.get_json_object("value", "$").isNotNull())
    kept = [name for name in documents.columns if name != "value"]
    moment = F.unix_millis(F.col("_d.timestamp").try_cast("timestamp"))
    number = [] if "snapshot_no" in kept else [F.coalesce(moment, F.lit(0)).alias("snapshot_no")]
    return read.select(*kept, *number, "_d.*")


def _rows(snapshots: DataFrame, column: str) -> DataFrame:
    return snapshots.select("host", "snapshot_no", F.posexplode(column).alias("pos", "_r")).select(
        "host", "snapshot_no", "pos", "_r.*"
    )


def connections(snapshots: DataFrame) -> DataFrame:
    return _rows(snapshots, "connections")


def interfaces(snapshots: DataFrame) -> DataFrame:
    from netlens.functions.address import is_vpn_interface

    return _rows(snapshots, "interfaces").withColumn("is_vpn", is_vpn_interface(F.col("name")))


def routes(snapshots: DataFrame) -> DataFrame:
    return _rows(snapshots, "routes")


def resolvers(snapshots: DataFrame) -> DataFrame:
    return _rows(snapshots, "dns")


def nameservers(resolver_rows: DataFrame) -> DataFrame:
    """Distinct DNS servers of each host."""
    return resolver_rows.select("host", F.explode("nameservers").alias("server")).distinct()


def counters(snapshots: DataFrame) -> DataFrame:
    exploded = snapshots.select("host", "snapshot_no", F.explode("interface_counters").alias("name", "_c"))
    return exploded.select("host", "snapshot_no", "name", "_c.*")


def quality_probes(reports: DataFrame) -> DataFrame:
    """One row per probe of a quality report, with the columns the quality score reads."""

    def probe(kind: str, loss: Column, average: Column, jitter: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), F.col(kind + ".ok").alias("ok"), F.col(kind + ".duration_ms").alias("duration_ms"),
            loss.alias("packet_loss_percent"), average.alias("avg_ms"), jitter.alias("jitter_ms"),
        )

    none = F.lit(None).cast("double")
    details = [F.col("ping.details." + name) for name in ("packet_loss_percent", "avg_ms", "jitter_ms")]
    probes = F.array(probe("ping", *details), *[probe(kind, none, none, none) for kind in ("dns", "tls", "http")])
    run = F.concat_ws("|", "host", F.col("snapshot_no").cast("string")).alias("run_id")
    return reports.select(run, F.inline(probes))


def dns_results(reports: DataFrame) -> DataFrame:
    """One row per asked server of a DNS comparison, in asking order, with its sorted answers."""
    answers = F.array_sort(
        F.transform(F.filter("records", lambda item: item["section"] == "answer"), lambda item: item["value"])
    )
    return (
        reports.select("host", "snapshot_no", "domain", "query_type", F.posexplode("results").alias("pos", "_r"))
        .select("host", "snapshot_no", "domain", "query_type", "pos", "_r.*")
        .withColumn("answers", F.coalesce(answers, F.array().cast("array<string>")))
        .drop("records")
    )


def trace_hops(reports: DataFrame) -> DataFrame:
    return reports.select("host", "snapshot_no", "target", F.inline("hops"))


def certificates(reports: DataFrame) -> DataFrame:
    """TLS reports with the days their certificate had left when they were taken."""
    from netlens.functions.labels import days_between

    expiry = F.try_to_timestamp(
        F.regexp_replace(F.regexp_replace("certificate.not_after", r"\s+", " "), r" GMT$", ""), F.lit("MMM d HH:mm:ss yyyy")
    )
    taken = F.col("timestamp").try_cast("timestamp")
    left = days_between(F.unix_micros(taken) / 1e6, F.unix_micros(expiry) / 1e6)
    return reports.select("host", "snapshot_no", "domain", "port", "ok", "tls_version", left.alias("days_remaining"))
