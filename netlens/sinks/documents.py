"""Reports, archives and tables on disk, for any number of sessions of any size.

Every export has one shape. The rows of all sessions lie in files that are clustered by session and block of lines and
sorted by session and ``seq``, one JSON line (or CSV row) per request, so no task lists a session and no session makes a
file of its own. ``heads`` holds a small document per session, ``manifest`` which files hold which rows of it. From these,
``report_lines`` and ``archive_lines`` put together the one nested document that other tools expect of a session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netlens.functions.numbers import decimal_text, half_even
from netlens.operators import findings as findings_of
from netlens.operators import normalize as normalize_of
from netlens.operators import scores as scores_of
from netlens.operators import summary as summary_of
from netlens.operators.skew import BLOCK_BITS
from netlens.schemas import CSV_COLUMNS

CREATOR = "netlens"
#: Rows of a file at most; a cluster with more goes on in another file.
FILE_ROWS = 5_000_000


# --- clustered files ----------------------------------------------------------------------------


def clustered(rows: DataFrame) -> DataFrame:
    """Rows shuffled by session and block of ``seq`` and sorted: a large session takes many tasks, small ones share theirs."""
    block = F.shiftright("seq", BLOCK_BITS)
    return rows.withColumn("_block", block).repartition("session_id", "_block").drop("_block").sortWithinPartitions("session_id", "seq")


def write_lines(rows: DataFrame, path: str, max_rows_per_file: int = FILE_ROWS) -> None:
    """Rows with (session_id, seq, ...) as clustered JSON lines, and their manifest beside them (``<path>-manifest``)."""
    clustered(rows).write.mode("overwrite").option("maxRecordsPerFile", max_rows_per_file).json(path)
    written = rows.sparkSession.read.schema("session_id string, seq bigint").json(path)
    write_manifest(written, f"{path}-manifest")


def write_manifest(written: DataFrame, path: str) -> None:
    """(session_id, file, rows, first_seq, last_seq): where the rows of a session are, by reading back two columns."""
    file = F.element_at(F.split("_metadata.file_path", "/"), -1)
    written.select("session_id", "seq", file.alias("file")).groupBy("session_id", "file").agg(
        F.count("*").alias("rows"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")
    ).write.mode("overwrite").json(path)


MANIFEST = "session_id string, file string, rows bigint, first_seq bigint, last_seq bigint"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(f"{path}-manifest")


def session_files(spark: SparkSession, path: str, session_id: str) -> list[str]:
    """The files that hold rows of a session; a session has few, as it is clustered."""
    found = read_manifest(spark, path).where(F.col("session_id") == session_id).select("file").distinct().collect()
    return sorted(f"{path}/{row.file}" for row in found)


# --- CSV ----------------------------------------------------------------------------------------


def csv_rows(requests: DataFrame, key: tuple[str, ...] = ()) -> DataFrame:
    """The 17 CSV columns in their fixed order; booleans are spelled ``True`` and ``False``, large numbers without exponents."""
    kinds = dict(requests.dtypes)
    spell = {"boolean": lambda name: F.initcap(F.col(name).cast("string")).alias(name), "double": lambda name: decimal_text(F.col(name)).alias(name)}
    return requests.select(*key, *[spell.get(kinds[name], F.col)(name) for name in CSV_COLUMNS])


def write_csv(requests: DataFrame, path: str, max_rows_per_file: int = FILE_ROWS) -> None:
    """Clustered CSV files with a header: ``session_id``, ``seq`` and the 17 columns, and a manifest."""
    ordered = csv_rows(clustered(requests), ("session_id", "seq"))
    ordered.write.mode("overwrite").option("header", True).option("escape", '"').option("maxRecordsPerFile", max_rows_per_file).csv(path)
    written = requests.sparkSession.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    write_manifest(written.select("session_id", F.col("seq").cast("bigint").alias("seq"), "_metadata"), f"{path}-manifest")


def session_csv(spark: SparkSession, path: str, session_id: str) -> DataFrame:
    """The table of one session: exactly the 17 columns, in order. Empty for an unknown session."""
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", True)
    files = session_files(spark, path, session_id)
    if not files:
        return spark.createDataFrame([], ", ".join(f"{name} string" for name in CSV_COLUMNS))
    rows = reader.csv(files).where(F.col("session_id") == session_id)
    return rows.orderBy(F.col("seq").cast("bigint")).select(*CSV_COLUMNS)


# --- reports ------------------------------------------------------------------------------------


def _detail(name: str) -> Column:
    return F.try_parse_json(F.col(name)).alias(name)


def request_payload(requests: DataFrame) -> Column:
    """A request as it stands in a report: JSON detail is nested again, bookkeeping columns are left out."""
    nested = ("associated_cookies", "initiator", "security_details")
    hidden = ("session_id", "seq", "tls_protocol")
    return F.struct(
        *[_detail(name) if name in nested else F.col(name) for name in requests.columns if name not in hidden]
    )


def report_heads(requests: DataFrame, source_types: DataFrame | None = None, browser: DataFrame | None = None) -> DataFrame:
    """(session_id, value): per session the report without its tables, over normalised requests.

    ``source_types`` has (session_id, source_type); ``browser`` has (session_id, browser), the browser facts as JSON text.
    """
    profile = summary_of.session_profile(requests)
    head = profile.select("session_id", F.struct(*summary_of.SUMMARY_METRICS).alias("summary"))
    scored = scores_of.session_scores(profile).select("session_id", F.struct(*scores_of.SCORE_NAMES).alias("scores"))
    fields = ("severity", "category", "code", "title", "recommendation", "evidence")
    order = F.struct(
        findings_of.L.severity_rank(F.col("severity")).alias("rank"), "category", "code", F.struct(*fields).alias("item")
    )
    found = (
        findings_of.session_findings(requests, profile)
        .groupBy("session_id")
        .agg(F.array_sort(F.collect_list(order)).alias("_f"))  # a session has as many findings as there are rules, at most
        .select("session_id", F.transform("_f", lambda row: row["item"]).alias("findings"))
    )
    head = head.join(scored, "session_id").join(found, "session_id")
    for extra in (source_types, browser):
        if extra is not None:
            head = head.join(extra, "session_id", "left")
    document = F.struct(
        F.lit(2).alias("schema_version"),
        *[F.col(name) for name in ("source_type",) if source_types is not None],
        F.col("session_id"), F.col("summary"), F.col("scores"), F.col("findings"),
        *([F.try_parse_json(F.col("browser")).alias("browser")] if browser is not None else []),
    )
    return head.select("session_id", F.to_json(document).alias("value"))


def report_tables(requests: DataFrame) -> DataFrame:
    """(session_id, dimension, value, requests, bytes, errors, third_party, tracker, first_seq): the aggregates of a report.

    Domains carry all figures, the other dimensions only how many requests a value has.
    """
    domains = summary_of.domain_rollup(requests).select(
        "session_id", F.lit("domains").alias("dimension"), F.col("domain").alias("value"), "requests", "bytes", "errors", "third_party", "tracker"
    )
    counts = summary_of.frequency_tables(requests).select("session_id", "dimension", "value", F.col("count").alias("requests"), "first_seq")
    return domains.unionByName(counts, allowMissingColumns=True)


def write_report(
    requests: DataFrame, path: str, source_types: DataFrame | None = None, browser: DataFrame | None = None
) -> None:
    """``heads`` (a JSON line per session), ``tables`` (a line per session, dimension and value), ``requests`` (a line each).

    The parts read the requests some ten times, so they are written first, as Parquet (``table``), and read for each of them.
    """
    requests.write.mode("overwrite").parquet(f"{path}/table")
    _write_report(requests.sparkSession.read.schema(requests.schema).parquet(f"{path}/table"), path, source_types, browser)


def _write_report(kept: DataFrame, path: str, source_types: DataFrame | None = None, browser: DataFrame | None = None) -> None:
    """``write_report`` over requests that are a table already."""
    report_heads(kept, source_types, browser).select("value").write.mode("overwrite").text(f"{path}/heads")
    report_tables(kept).write.mode("overwrite").json(f"{path}/tables")
    write_lines(kept.select("session_id", "seq", request_payload(kept).alias("request")), f"{path}/requests")


ITEM = "part int, a bigint, b bigint, c string, value string"


def _assembled(spark: SparkSession, texts: dict[int, str], items: DataFrame) -> DataFrame:
    """(value) lines in order of part, then a, b, c: ``texts`` stand alone, ``items`` of one part have commas between them.

    The order is a sort and the first item of each part comes from an aggregate, so nothing is listed or numbered.
    """
    order = F.struct("a", "b", "c")
    first = {row["part"]: row["o"] for row in items.groupBy("part").agg(F.min(order).alias("o")).collect()}  # a row per part
    leads = F.lit(False)
    for part, o in first.items():
        leads = leads | ((F.col("part") == part) & (order == F.struct(F.lit(o["a"]).cast("bigint").alias("a"), F.lit(o["b"]).cast("bigint").alias("b"), F.lit(o["c"]).alias("c"))))
    listed = items.withColumn("value", F.concat(F.when(leads, "").otherwise(","), "value"))
    alone = spark.createDataFrame([(part, 0, 0, "", text) for part, text in texts.items()], ITEM)
    return listed.select("part", "a", "b", "c", "value").unionByName(alone).orderBy("part", "a", "b", "c").select("value")


def _items(spark: SparkSession, path: str, session_id: str, name: str, part: int) -> DataFrame:
    """The field ``name`` of a session's lines, as items of a part."""
    files = session_files(spark, path, session_id)
    if not files:
        return spark.createDataFrame([], ITEM)
    rows = spark.read.text(files)
    seq, owner = F.get_json_object("value", "$.seq").cast("bigint"), F.get_json_object("value", "$.session_id")
    return rows.where(owner == session_id).select(
        F.lit(part).alias("part"), seq.alias("a"), F.lit(0).cast("bigint").alias("b"), F.lit("").alias("c"), F.get_json_object("value", f"$.{name}").alias("value")
    )


DIMENSIONS = ("domains", "resource_types", "protocols", "statuses", "methods", "mime_types")
TABLES = (
    "session_id string, dimension string, value string, requests bigint, bytes bigint, errors bigint, third_party boolean, tracker boolean, first_seq bigint"
)


def report_lines(spark: SparkSession, path: str, session_id: str) -> DataFrame:
    """The lines of one session's nested JSON report, put together from what ``write_report`` wrote; none for an unknown session."""
    head = spark.read.text(f"{path}/heads").where(F.get_json_object("value", "$.session_id") == session_id).first()
    if head is None:
        return spark.createDataFrame([], "value string")
    texts = {0: head.value[:-1] + ',"aggregates":{"domains":{'}
    for place, name in enumerate(DIMENSIONS[1:], 1):
        texts[2 * place] = '},"%s":{' % name
    requests = 2 * len(DIMENSIONS)
    texts |= {requests: '}},"requests":[', requests + 2: "]}"}
    tables = spark.read.schema(TABLES).json(f"{path}/tables").where(F.col("session_id") == session_id)
    domain = F.col("dimension") == "domains"
    facts = F.to_json(F.create_map("value", F.struct("requests", "bytes", "errors", "third_party", "tracker")))
    entry = F.when(domain, facts).otherwise(F.to_json(F.create_map("value", "requests")))
    part = F.array_position(F.array(*[F.lit(name) for name in DIMENSIONS]), F.col("dimension")) * 2 - 1
    rows = tables.select(
        part.cast("int").alias("part"), F.when(domain, -F.col("bytes")).otherwise(-F.col("requests")).alias("a"),
        F.when(domain, -F.col("requests")).otherwise(F.col("first_seq")).alias("b"), F.col("value").alias("c"),
        F.substring(entry, F.lit(2), F.length(entry) - 2).alias("value"),
    )
    return _assembled(spark, texts, rows.unionByName(_items(spark, f"{path}/requests", session_id, "request", requests + 1)))


# --- HAR ----------------------------------------------------------------------------------------

KNOWN_PHASES = ("queueing_ms", "dns_ms", "connect_ms", "ssl_ms", "send_ms", "ttfb_ms")


def receive_time() -> Column:
    """Duration less the known phases, never negative."""
    known = F.filter(F.array(*[F.col("timing." + name) for name in KNOWN_PHASES]), lambda value: value >= 0)
    spent = F.aggregate(known, F.lit(0.0), lambda total, value: total + value)
    return half_even(F.greatest(F.lit(0.0), F.coalesce("duration_ms", F.lit(0.0)) - spent), 2)


def har_entry() -> Column:
    """One HAR 1.2 entry of a request."""

    def phase(name: str, missing: float) -> Column:
        return F.coalesce(F.col("timing." + name), F.lit(missing))

    def headers(name: str) -> Column:
        entries = F.map_entries(F.coalesce(name, F.create_map().cast("map<string,string>")))
        return F.transform(entries, lambda item: F.struct(item["key"].alias("name"), item["value"].alias("value")))

    nothing = F.array().cast("array<string>")
    queries = F.transform("query_keys", lambda key: F.struct(key.alias("name"), F.lit("[not retained]").alias("value")))
    request = F.struct(
        F.coalesce("method", F.lit("GET")).alias("method"), F.coalesce("url", F.lit("")).alias("url"), F.col("protocol").alias("httpVersion"),
        nothing.alias("cookies"), headers("request_headers").alias("headers"), queries.alias("queryString"),
        F.lit(-1).alias("headersSize"), F.lit(-1).alias("bodySize"),
    )
    response = F.struct(
        F.coalesce("status", F.lit(0)).alias("status"), F.coalesce("status_text", F.lit("")).alias("statusText"),
        F.col("protocol").alias("httpVersion"), nothing.alias("cookies"), headers("response_headers").alias("headers"),
        F.struct(F.coalesce("body_bytes", F.lit(0)).alias("size"), F.col("mime_type").alias("mimeType")).alias("content"),
        F.lit("").alias("redirectURL"), F.lit(-1).alias("headersSize"), F.coalesce("transfer_bytes", F.lit(0)).alias("bodySize"),
    )
    cached = F.struct(F.when(F.col("from_cache"), F.lit("served from cache")).alias("comment"))
    timings = F.struct(
        phase("queueing_ms", -1.0).alias("blocked"), phase("dns_ms", -1.0).alias("dns"), phase("connect_ms", -1.0).alias("connect"),
        phase("ssl_ms", -1.0).alias("ssl"), phase("send_ms", 0.0).alias("send"), phase("ttfb_ms", 0.0).alias("wait"),
        receive_time().alias("receive"),
    )
    return F.struct(
        F.coalesce("started_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSxxx")).alias("startedDateTime"),
        F.coalesce("duration_ms", F.lit(0.0)).alias("time"), request.alias("request"), response.alias("response"), cached.alias("cache"),
        timings.alias("timings"), F.col("remote_ip").alias("serverIPAddress"), F.coalesce("connection_id", F.lit("")).alias("connection"),
        F.coalesce("failure", F.lit("")).alias("comment"),
    )


LOG = (
    '{"log":{"version":"1.2","creator":{"name":"%s","version":"0.1"},'
    '"comment":"Generated from a normalized recording. Redacted fields cannot be reconstructed.","entries":['
) % CREATOR


def write_har(requests: DataFrame, path: str) -> None:
    """HAR 1.2 entries of normalised requests, one per line; ``archive_lines`` gives a session's whole archive."""
    write_lines(requests.select("session_id", "seq", har_entry().alias("entry")), path)


def archive_lines(spark: SparkSession, path: str, session_id: str) -> DataFrame:
    """The lines of one session's HAR 1.2 archive, put together from what ``write_har`` wrote."""
    return _assembled(spark, {0: LOG, 2: "]}}"}, _items(spark, path, session_id, "entry", 1))


def write_document(lines: DataFrame, path: str) -> None:
    """Ordered lines as one text file; a single task copies them one by one."""
    lines.coalesce(1).write.mode("overwrite").text(path)


# --- other tables -------------------------------------------------------------------------------


def write_comparison(metrics: DataFrame, scores: DataFrame, path: str) -> None:
    """Comparison rows as JSON: ``metrics`` and ``scores`` folders."""
    metrics.write.mode("overwrite").json(path + "/metrics")
    scores.write.mode("overwrite").json(path + "/scores")


def diagnosis_documents(scores: DataFrame, findings: DataFrame) -> DataFrame:
    """(host, value): score and findings of every host; a host has few findings by its rules."""
    fields = ("severity", "code", "title", "detail", "recommendation")
    listed = (
        findings.groupBy("host")
        .agg(F.array_sort(F.collect_list(F.struct("position", "subject", F.struct(*fields).alias("item")))).alias("_f"))
        .select("host", F.transform("_f", lambda row: row["item"]).alias("findings"))
    )
    joined = scores.select("host", "score").join(listed, "host", "left")
    return joined.select("host", F.to_json(F.struct("host", "score", "findings")).alias("value"))


def write_diagnosis(scores: DataFrame, findings: DataFrame, path: str) -> None:
    diagnosis_documents(scores, findings).select("value").write.mode("overwrite").text(path)


def _reports(diagnoses: DataFrame, *fields: object) -> DataFrame:
    taken = F.date_format(F.timestamp_millis("snapshot_no"), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("timestamp")
    return diagnoses.select(F.to_json(F.struct("host", "snapshot_no", taken, *fields)).alias("value"))


def write_diagnoses(diagnoses: DataFrame, path: str) -> None:
    """The diagnosis of every snapshot and its leak report, one JSON line each: ``diagnosis`` and ``leaks`` below ``path``.

    ``sources.snapshots.read_reports`` reads both back. Nothing is shuffled: a line is made from one row. The diagnoses
    are written first, as Parquet (``table``), and read for each of the two.
    """
    diagnoses.write.mode("overwrite").parquet(f"{path}/table")
    diagnoses = diagnoses.sparkSession.read.schema(diagnoses.schema).parquet(f"{path}/table")
    _reports(diagnoses, "score", "summary", "findings").write.mode("overwrite").text(f"{path}/diagnosis")
    audit = ("dns_routes", "ipv6_default_routes", F.col("leaks").alias("findings"))
    _reports(diagnoses, *audit).write.mode("overwrite").text(f"{path}/leaks")


def write_bundle(requests: DataFrame, path: str) -> None:
    """JSON report, CSV and HAR of one analysis. The requests are written first, as Parquet, and read for each of them."""
    clustered(requests).write.mode("overwrite").parquet(f"{path}/table")
    kept = requests.sparkSession.read.schema(requests.schema).parquet(f"{path}/table")
    _write_report(kept, f"{path}/report")
    write_csv(kept, f"{path}/csv")
    write_har(kept, f"{path}/har")


def spool_batch(requests: DataFrame, path: str, number: int) -> None:
    """REQUEST rows of one micro-batch, and what each session's facts are by this batch. A repeated batch overwrites its own folders."""
    requests.write.mode("overwrite").parquet(f"{path}/spool/requests/batch={number}")
    kept = requests.sparkSession.read.schema(requests.schema).parquet(f"{path}/spool/requests/batch={number}")
    normalize_of.partial_facts(kept).write.mode("overwrite").parquet(f"{path}/spool/facts/batch={number}")


def finish_bundle(spark: SparkSession, path: str) -> None:
    """The bundle of all batches spooled so far: the facts of a session are merged over its batches, then its rows normalised."""
    requests, partial = spark.read.parquet(f"{path}/spool/requests").drop("batch"), spark.read.parquet(f"{path}/spool/facts").drop("batch")
    write_bundle(normalize_of.normalize(requests, facts=normalize_of.merged_facts(partial)), path)


def event_lines(events: DataFrame) -> DataFrame:
    """EVENT rows as the JSON lines they came from."""
    return events.select(F.to_json("body").alias("value"))
