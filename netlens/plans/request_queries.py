"""Registered queries over requests and browser recordings."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netlens.functions import redact as R
from netlens.functions import url as U
from netlens.operators import analysis, compare, findings, normalize, recorder, scores, summary, views
from netlens.operators.correlate import correlate
from netlens.plans import derive
from netlens.schemas import CSV_COLUMNS
from netlens.session import checkpoint_root
from netlens.sinks import documents
from netlens.sources import har, jsonl


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.normalize(derive.requests(spark, sf_dir), derive.PATTERNS)


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.session_profile(normalized(spark, sf_dir))


def session_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.session_summary(normalized(spark, sf_dir))


def normalized_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalized(spark, sf_dir).select(
        "session_id", "seq", "domain", "offset_ms", "third_party", "tracker", "compression_ratio", "started_at"
    )


def domain_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.domain_rollup(normalized(spark, sf_dir))


def frequency_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.frequency_tables(derive.requests(spark, sf_dir))


def duplicate_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.duplicate_urls(derive.requests(spark, sf_dir)).drop("first_seq")


def session_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.session_scores(profile(spark, sf_dir))


def score_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.score_classes(session_scores(spark, sf_dir))


def session_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = normalized(spark, sf_dir)
    return (
        findings.session_findings(requests, summary.session_profile(requests))
        .withColumn("evidence", F.array_join("evidence", " | "))
        .drop("recommendation")
    )


def _listing(sort: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = derive.requests(spark, sf_dir) if sort != "start" else normalized(spark, sf_dir)
        return views.top_requests(rows, sort, 10).select(
            "session_id", "seq", "url", "method", "status", "duration_ms", "transfer_bytes", "rank"
        )

    return query


def third_party_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalized(spark, sf_dir).groupBy(U.base_domain(F.col("domain")).alias("base_domain")).agg(
        F.count("*").alias("requests"), F.count_if("third_party").alias("third_party"), F.sum("transfer_bytes").alias("bytes")
    )


def tracker_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = U.is_tracker(F.col("url"), F.col("domain"), derive.PATTERNS)
    return derive.requests(spark, sf_dir).select("session_id", "seq", "url", flag.alias("tracker")).where("tracker")


def waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.waterfall(normalized(spark, sf_dir)).select(
        "session_id", "seq", "rank", "offset_ms", "duration_ms", "is_error",
        F.round("left_percent", 6).alias("left_percent"), F.round("width_percent", 6).alias("width_percent"),
    )


def domain_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.domain_bars(derive.requests(spark, sf_dir).withColumns({"third_party": F.lit(None).cast("boolean"), "tracker": F.lit(None).cast("boolean")})).select(
        "session_id", "domain", "requests", "bytes", "rank", "width_percent"
    )


def aggregate_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = summary.frequency_counts(summary.dimensions(derive.requests(spark, sf_dir)))
    return views.aggregate_bars(counts).drop("first_seq")


def request_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = views.filter_requests(derive.requests(spark, sf_dir), "Example.NET", "error", "click")
    return kept.select("session_id", "seq", "url", "status", "resource_type")


def request_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All detail columns, of requests some of which lack an address, a connection or a priority."""
    seq, kind = F.col("seq"), F.col("resource_type")
    detailed = normalized(spark, sf_dir).withColumns({
        "remote_ip": F.when(seq % 11 == 0, None).when(seq % 13 == 0, "").otherwise(F.col("remote_ip")),
        "remote_port": F.when(seq % 17 == 0, None).otherwise(F.col("remote_port")),
        "connection_id": F.when(seq % 7 != 0, F.concat(F.lit("c"), (seq % 40).cast("string"))), "connection_reused": seq % 2 == 1,
        "initial_priority": F.when(kind == "view", "VeryHigh").when(seq % 5 != 0, "Low"), "initiator_type": F.when(kind == "view", "other").otherwise("script"),
        "security_details": F.to_json(F.struct(F.col("tls_protocol").alias("protocol"))),
    })
    return views.request_details(detailed).select(
        "*", F.array_join("query_keys", ",").alias("keys"), F.array_join("flags", ",").alias("tags"),
        *[F.col("timing." + name).alias(name) for name in ("dns_ms", "connect_ms", "ssl_ms", "send_ms", "ttfb_ms")],
    ).drop("query_keys", "flags", "timing")


def csv_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalized(spark, sf_dir).select(*CSV_COLUMNS)


def report_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.report_cards(profile(spark, sf_dir))


def resource_type_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.resource_type_list(derive.requests(spark, sf_dir))


def _periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session profiles of even days (before) and odd days (after) since the epoch, in one pass."""
    odd = F.floor(F.col("started_monotonic") / 86400) % 2 == 1
    return summary.session_profile(normalize.normalize(compare.in_periods(derive.requests(spark, sf_dir), odd), derive.PATTERNS))


def compare_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.summary_differences(compare.split_periods(_periods(spark, sf_dir)), ["session_id"])


def compare_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.score_differences(compare.split_periods(scores.session_scores(_periods(spark, sf_dir))), ["session_id"])


# --- from event lines ---------------------------------------------------------------------------


def browser_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jsonl.events_of(jsonl.parse_event_lines(derive.cdp_lines(spark, sf_dir)))


def correlate_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate(browser_events(spark, sf_dir)).select(
        "session_id", "seq", "id", "redirect_index", "url", "domain", "method", "resource_type", "status", "protocol",
        "mime_type", "duration_ms", "transfer_bytes", "body_bytes", "failed", "from_cache", "redirect",
        F.col("timing.dns_ms").alias("dns_ms"),
    )


def correlated_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header maps and cache flags of every hop, from lines with the browser's extra events."""
    requests = correlate(jsonl.events_of(jsonl.parse_event_lines(derive.header_lines(spark, sf_dir))))

    def listed(name: str) -> Column:
        pairs = F.array_sort(F.transform(F.map_entries(name), lambda item: F.concat(item["key"], F.lit("="), item["value"])))
        return F.array_join(pairs, ",").alias(name)

    return requests.select("session_id", "seq", "redirect_index", listed("request_headers"), listed("response_headers"), "from_cache", "redirect")


def redirect_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate(browser_events(spark, sf_dir)).groupBy("session_id", "id").agg(
        F.count("*").alias("hops"), F.count_if("redirect").alias("redirects"), F.max("redirect_index").alias("last_index")
    )


def recorded_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = correlate(browser_events(spark, sf_dir))
    return requests.groupBy("session_id").agg(
        F.count("*").alias("requests"), F.sum("transfer_bytes").alias("transfer_bytes"), F.sum("body_bytes").alias("body_bytes"),
        F.count_if("redirect").alias("redirects"), F.count_if("from_cache").alias("cached"),
        F.count_if("failed").alias("failed"), F.count_if(F.col("status") >= 400).alias("http_errors"),
    )


def recorder_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recorder.recorder_summary(browser_events(spark, sf_dir))


def recorder_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recorder.recorder_counters(browser_events(spark, sf_dir)).drop("first_seq")


# --- a mixed folder, end to end -----------------------------------------------------------------


def _analysis(spark: SparkSession, sf_dir: str) -> analysis.Analysis:
    events = jsonl.events_of(jsonl.parse_event_lines(derive.mixed_lines(spark, sf_dir)))
    return analysis.analyze(events, har.split_documents(derive.mixed_archives(spark, sf_dir)), derive.PATTERNS)


def analyzed_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysis(spark, sf_dir).summary()


def analyzed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysis(spark, sf_dir).scores()


def analyzed_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysis(spark, sf_dir).findings().withColumn("evidence", F.array_join("evidence", " | "))


def analyzed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every session with its kind, the reason it was rejected for, and the totals of socket recordings."""
    found = _analysis(spark, sf_dir)
    sockets = found.sockets.select("session_id", "opened", "closed", "processes")
    return found.sources.join(found.rejects, "session_id", "full_outer").join(sockets, "session_id", "left")


# --- written and read back ----------------------------------------------------------------------


def written_folder(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark, tempfile.gettempdir())}/netlens-written-{uuid.uuid4().hex}"


def written_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The CSV files of all sessions, read back as text."""
    path = written_folder(spark)
    documents.write_csv(normalized(spark, sf_dir), path)
    return spark.read.option("header", True).option("escape", '"').csv(path).withColumn("seq", F.col("seq").cast("bigint"))


def written_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per session what its report holds: parts of the head, and request lines by the manifest."""
    path = written_folder(spark)
    documents.write_report(normalized(spark, sf_dir), path)
    heads = spark.read.text(f"{path}/heads").select(
        F.get_json_object("value", "$.session_id").alias("session_id"), F.get_json_object("value", "$.scores.overall").cast("bigint").alias("overall"),
        F.get_json_object("value", "$.summary.transfer_bytes").cast("bigint").alias("transfer_bytes"),
        F.from_json(F.get_json_object("value", "$.findings"), "array<struct<code:string>>").alias("found"),
    )
    tables = spark.read.schema(documents.TABLES).json(f"{path}/tables").groupBy("session_id").agg(
        F.count_if(F.col("dimension") == "domains").alias("domains"), F.sum(F.when(F.col("dimension") == "statuses", F.col("requests"))).alias("counted")
    )
    listed = documents.read_manifest(spark, f"{path}/requests").groupBy("session_id").agg(F.sum("rows").alias("rows"), F.max("last_seq").alias("last_seq"))
    joined = heads.join(tables, "session_id").join(listed, "session_id")
    return joined.select(
        "session_id", "overall", "transfer_bytes", F.array_join(F.transform("found", lambda f: f["code"]), ",").alias("codes"), "domains", "counted", "rows", "last_seq"
    )


def written_har(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The HAR entries of all sessions, read back."""
    path = written_folder(spark)
    documents.write_har(normalized(spark, sf_dir), path)
    kind = (
        "session_id string, seq bigint, entry struct<time:double,request:struct<method:string,url:string,queryString:array<struct<name:string,value:string>>>,"
        "response:struct<status:int,bodySize:bigint,content:struct<size:bigint>>,timings:struct<blocked:double,dns:double,connect:double,send:double,wait:double,receive:double>>"
    )
    e = F.col("entry")
    return spark.read.schema(kind).json(path).select(
        "session_id", "seq", e["time"].alias("time"), e["request"]["method"].alias("method"), e["request"]["url"].alias("url"),
        F.size(e["request"]["queryString"]).alias("queries"), e["response"]["status"].alias("status"), e["response"]["bodySize"].alias("body_size"),
        e["response"]["content"]["size"].alias("content_size"), *[e["timings"][name].alias(name) for name in ("blocked", "dns", "connect", "send", "wait", "receive")],
    )


# --- scalar functions ---------------------------------------------------------------------------


def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return derive.table(spark, sf_dir, "pages").select(
        "page_id", U.url_scheme(url).alias("scheme"), U.url_authority(url).alias("authority"), U.url_host(url).alias("host"),
        U.url_path(url).alias("path"), U.url_query(url).alias("query"), U.url_fragment(url).alias("fragment"),
    )


def base_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = derive.table(spark, sf_dir, "pages").select(U.url_host(F.col("url")).alias("host"))
    return hosts.groupBy(U.base_domain(F.col("host")).alias("base_domain")).agg(
        F.count("*").alias("pages"), F.countDistinct("host").alias("hosts")
    )


def query_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.table(spark, sf_dir, "pages").select(
        "page_id", F.array_join(U.query_keys(F.col("url")), ",").alias("keys")
    )


def redact_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.table(spark, sf_dir, "pages").select(
        "page_id", R.redact_url(F.col("url"), "(?i)page|utm").alias("url")
    )


def redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.table(spark, sf_dir, "documents").select("doc_id", R.redact_message(F.col("text")).alias("message"))


QUERIES = {
    "session_summary": session_summary,
    "normalized_requests": normalized_requests,
    "domain_rollup": domain_rollup,
    "frequency_tables": frequency_tables,
    "duplicate_urls": duplicate_urls,
    "session_scores": session_scores,
    "score_classes": score_classes,
    "session_findings": session_findings,
    "slowest_requests": _listing("slowest"),
    "largest_requests": _listing("largest"),
    "errors_first": _listing("errors"),
    "earliest_requests": _listing("start"),
    "third_party_share": third_party_share,
    "tracker_flags": tracker_flags,
    "waterfall": waterfall,
    "domain_bars": domain_bars,
    "aggregate_bars": aggregate_bars,
    "request_filter": request_filter,
    "request_details": request_details,
    "csv_projection": csv_projection,
    "report_cards": report_cards,
    "resource_type_list": resource_type_list,
    "compare_periods": compare_periods,
    "compare_scores": compare_scores,
    "correlate_requests": correlate_requests,
    "correlated_headers": correlated_headers,
    "redirect_hops": redirect_hops,
    "recorded_summary": recorded_summary,
    "recorder_summary": recorder_summary,
    "recorder_counters": recorder_counters,
    "analyzed_summary": analyzed_summary,
    "analyzed_scores": analyzed_scores,
    "analyzed_findings": analyzed_findings,
    "analyzed_sources": analyzed_sources,
    "written_csv": written_csv,
    "written_report": written_report,
    "written_har": written_har,
    "url_parts": url_parts,
    "base_domain": base_domain,
    "query_keys": query_keys,
    "redact_urls": redact_urls,
    "redact_text": redact_text,
}
