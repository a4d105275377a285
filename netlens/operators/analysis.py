"""A folder of recordings of all kinds, analysed end to end.

Archives are known by their name; what the lines of a session are is settled by one aggregate over its events. Browser,
proxy and socket branches read one shuffle of the parsed lines, so the text is parsed once; the branches become one
REQUEST table that a single session pass normalises.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netlens.functions import url as U
from netlens.operators import connections as C
from netlens.operators import findings as findings_of
from netlens.operators import normalize as N
from netlens.operators import scores as scores_of
from netlens.operators import summary as summary_of
from netlens.operators.correlate import correlate
from netlens.operators.skew import by_block
from netlens.sources import har, jsonl

UNSUPPORTED = "recording contains no supported CDP, proxy, or connection events"
BROWSER, PROXY, SOCKETS, ARCHIVE = "chrome-cdp", "proxy-jsonl", "connection-jsonl", "har"


@dataclass(frozen=True)
class Analysis:
    """Results of one folder; a session is a recording.

    ``sources`` has every session with its kind, ``requests`` the normalised requests of browser, proxy and archive
    sessions, ``sockets`` the totals of socket recordings, ``rejects`` (session_id, reason) what could not be analysed.
    """

    sources: DataFrame
    requests: DataFrame
    sockets: DataFrame
    rejects: DataFrame

    @property
    def profile(self) -> DataFrame:
        return summary_of.session_profile(self.requests)

    def summary(self) -> DataFrame:
        """The kind and the 16 metrics of every session that has requests."""
        totals = self.profile.select("session_id", *summary_of.SUMMARY_METRICS)
        return totals.join(self.sources.select("session_id", "source_type"), "session_id")

    def scores(self) -> DataFrame:
        return scores_of.session_scores(self.profile)

    def findings(self) -> DataFrame:
        """Findings with ``position``, their place in the session's report; a session has few by the rules."""
        found = findings_of.session_findings(self.requests, self.profile)
        return found.withColumn("position", F.row_number().over(Window.partitionBy("session_id").orderBy(*findings_of.finding_order())))


def shared_events(events: DataFrame) -> DataFrame:
    """The events behind one shuffle by session and block of lines; every reader that starts here reads the same shuffle."""
    blocked = by_block(events, ["session_id"], "seq", 20).drop("_block")
    # A generator stops the filters and the pruning of the branches, which would make each shuffle another one.
    return blocked.select(F.inline(F.array(F.struct(*[F.col(name) for name in events.columns]))))


def analyze(events: DataFrame, archives: har.Archive | None = None, patterns: Sequence[str] = U.TRACKER_PATTERNS) -> Analysis:
    """Analyse EVENT rows and archives. A session with any browser event is a browser session, whatever else it holds."""
    shared = shared_events(events)
    kinds = jsonl.session_types(shared)

    def only(rows: DataFrame, kind: str) -> DataFrame:
        """Rows of the sessions of this kind; Spark splits a session that is too large for one task of the join."""
        return rows.join(kinds.where(F.col("source_type") == kind).select("session_id"), "session_id", "left_semi")

    requests = correlate(shared).unionByName(N.proxy_requests(only(jsonl.proxy_events(shared), PROXY)))
    sources = kinds.select("session_id", "source_type", "events")
    rejects = kinds.where(~F.col("source_type").isin(BROWSER, PROXY, SOCKETS)).select("session_id", F.lit(UNSUPPORTED).alias("reason"))
    if archives is not None:
        requests = requests.unionByName(N.har_requests(archives.entries))
        sizes = archives.entries.groupBy("session_id").agg(F.count("*").alias("events"))
        sources = sources.unionByName(sizes.select("session_id", F.lit(ARCHIVE).alias("source_type"), "events"))
        rejects = rejects.unionByName(archives.rejects.select("session_id", "reason"))
    sockets = C.recording_summary(only(jsonl.connection_events(shared), SOCKETS))
    return Analysis(sources, N.normalize(requests, patterns), sockets, rejects)


def analyze_folder(spark: SparkSession, path: str, show_sensitive: bool = False, patterns: Sequence[str] = U.TRACKER_PATTERNS) -> Analysis:
    """Analyse all ``.har`` archives and ``.jsonl`` recordings below ``path``. Rejected lines stay in ``jsonl.read_recordings``.

    A recording and an archive of one path but for the extension share their id; keep them apart by name.
    """
    recordings = jsonl.read_recordings(spark, path, "*.jsonl")
    return analyze(recordings.events, har.read_har(spark, path, show_sensitive, "*.[hH][aA][rR]"), patterns)
