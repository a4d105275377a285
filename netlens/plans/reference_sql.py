"""The registered queries once more, as ANSI-style SQL over the given tables.

Each statement is written from the meaning of the query, not from the Spark plan: it derives the
same relations with common table expressions and states the result directly.
"""

from __future__ import annotations

import re

ID_SPAN = 400

HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#]*@)?([^:/?#]*)', 1))"
BASE = r"regexp_extract({0}, '([^.]+\.[^.]+)$', 1)"

EVENTS = """
page_count AS (SELECT count(*) AS np FROM pages),
base_events AS (
  SELECT e.event_id, e.ts, e.user_id, e.event_type, p.url,
         CAST(regexp_extract(e.props, '"k": *([0-9]+)', 1) AS INTEGER) AS k,
         CAST(round(e.value * 100) AS BIGINT) AS v,
         epoch_us(e.ts) // 1000 AS ms
  FROM events e, page_count c, pages p WHERE p.page_id = e.event_id % c.np
)
"""

REQUESTS = EVENTS + f""",
requests AS (
  SELECT CAST(user_id AS VARCHAR) AS session_id, event_id AS seq, url,
         lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\\-]*):', 1)) AS scheme,
         {HOST} AS domain,
         regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS raw_path,
         CASE WHEN event_type IN ('signup', 'purchase') THEN 'POST' ELSE 'GET' END AS method,
         event_type AS resource_type,
         CASE WHEN event_type = 'view' THEN url ELSE '' END AS document_url,
         ms / 1000.0 AS started, ms, v / 10.0 AS duration_ms,
         CASE WHEN event_type = 'error' THEN 500 WHEN k % 7 = 0 THEN 404
              WHEN event_type = 'signup' THEN 302 ELSE 200 END AS status,
         CASE k % 3 WHEN 0 THEN 'http/1.1' WHEN 1 THEN 'h2' ELSE 'h3' END AS protocol,
         CASE event_type WHEN 'view' THEN 'text/html' WHEN 'click' THEN 'application/json'
              WHEN 'purchase' THEN 'text/css' ELSE 'text/plain' END AS mime_type,
         '203.0.113.' || k AS remote_ip,
         v * v // 1000 AS transfer_bytes, v * v // 500 AS body_bytes,
         k % 10 = 0 AS from_cache, (event_type = 'error' AND k < 20) AS failed,
         CASE WHEN k % 50 = 0 THEN 'TLS 1.0' ELSE 'TLS 1.3' END AS tls_protocol,
         k, v, user_id
  FROM base_events
)
"""

NORMALIZED = REQUESTS + f""",
facts AS (
  SELECT session_id, min(started) AS first_start,
         {BASE.format("coalesce(arg_min(domain, seq) FILTER (document_url <> ''), arg_min(domain, seq))")} AS page_domain
  FROM requests GROUP BY session_id
),
normalized AS (
  SELECT r.*, status = 302 AS redirect,
         round_even((r.started - f.first_start) * 1000, 2) AS offset_ms,
         {BASE.format("r.domain")} <> f.page_domain AS third_party,
         contains(lower(r.url), 'utm_source=') OR contains(lower(r.url), 'free-bets') AS tracker,
         CASE WHEN transfer_bytes > 0 AND body_bytes > transfer_bytes
              THEN round_even(body_bytes / transfer_bytes, 2) END AS compression_ratio,
         (failed OR status >= 400) AS is_error
  FROM requests r JOIN facts f USING (session_id)
)
"""

PROFILE = NORMALIZED + """,
profile AS (
  SELECT session_id, count(*) AS requests, count(DISTINCT domain) AS domains,
         CAST(sum(transfer_bytes) AS BIGINT) AS transfer_bytes, CAST(sum(body_bytes) AS BIGINT) AS body_bytes,
         round_even(greatest(0.0, max(offset_ms + duration_ms)), 2) AS page_span_ms,
         count(*) FILTER (failed) AS failed, count(*) FILTER (status >= 400) AS http_errors,
         count(*) FILTER (from_cache) AS cached,
         round_even(count(*) FILTER (from_cache) / count(*) * 100.0, 1) AS cache_percent,
         count(*) FILTER (third_party) AS third_party,
         round_even(count(*) FILTER (third_party) / count(*) * 100.0, 1) AS third_party_percent,
         count(*) FILTER (tracker) AS trackers, count(*) - count(DISTINCT url) AS duplicate_requests,
         count(*) FILTER (redirect) AS redirects, count(*) FILTER (duration_ms >= 1000) AS slow_requests,
         count(*) FILTER (transfer_bytes >= 1000000) AS large_requests,
         count(*) FILTER (is_error) AS errors,
         count(*) FILTER (scheme = 'http' AND domain NOT IN ('localhost', '127.0.0.1', '::1')) AS insecure,
         count(*) FILTER (lower(tls_protocol) IN ('tls 1.0', 'tls 1.1')) AS old_tls,
         count(*) FILTER (lower(protocol) IN ('http/1.0', 'http/1.1')) AS http1
  FROM normalized GROUP BY session_id
)
"""

SCORES = PROFILE + """,
raw_scores AS (
  SELECT session_id,
    100 - least(35, CAST(round_even(slow_requests / requests * 80, 0) AS BIGINT)) - least(25, large_requests * 5)
        - least(15, CAST(round_even(duplicate_requests / requests * 40, 0) AS BIGINT))
        - CASE WHEN page_span_ms > 10000 THEN 20 WHEN page_span_ms > 5000 THEN 10 ELSE 0 END AS performance,
    100 - least(70, (failed + http_errors) * 8) AS reliability,
    100 - least(55, trackers * 7) - least(25, CAST(round_even(third_party_percent / 4, 0) AS BIGINT)) AS privacy,
    100 - least(60, insecure * 15) - least(30, old_tls * 10) AS security
  FROM profile
),
scores AS (
  SELECT session_id,
         greatest(0, CAST(round_even((performance + reliability + privacy + security) / 4, 0) AS BIGINT)) AS overall,
         greatest(0, performance) AS performance, greatest(0, reliability) AS reliability,
         greatest(0, privacy) AS privacy, greatest(0, security) AS security
  FROM raw_scores
)
"""

DIMENSIONS = REQUESTS + """,
cells AS (
  SELECT session_id, seq, 'resource_types' AS dimension, resource_type AS value FROM requests
  UNION ALL SELECT session_id, seq, 'protocols', protocol FROM requests
  UNION ALL SELECT session_id, seq, 'statuses', CAST(status AS VARCHAR) FROM requests
  UNION ALL SELECT session_id, seq, 'methods', method FROM requests
  UNION ALL SELECT session_id, seq, 'mime_types', mime_type FROM requests
),
counts AS (
  SELECT session_id, dimension, value, count(*) AS count, min(seq) AS first_seq
  FROM cells GROUP BY ALL
)
"""

HOPS = REQUESTS + f""",
hops AS (
  SELECT *, session_id || '-' || CAST(seq // {ID_SPAN} AS VARCHAR) AS id,
         row_number() OVER w - 1 AS hop, lead(started) OVER w AS next_start,
         lead(seq) OVER w IS NOT NULL AND status = 302 AS closed
  FROM requests WINDOW w AS (PARTITION BY session_id, seq // {ID_SPAN} ORDER BY seq)
),
correlated AS (
  SELECT session_id, seq * 4 AS seq, id, hop AS redirect_index, url, domain, method, resource_type, status,
         CASE WHEN closed THEN 'http/1.1' ELSE protocol END AS protocol,
         CASE WHEN closed THEN 'unknown' ELSE mime_type END AS mime_type,
         CASE WHEN closed THEN round_even((next_start - started) * 1000.0, 2) ELSE duration_ms END AS duration_ms,
         CASE WHEN failed THEN 0 ELSE transfer_bytes END AS transfer_bytes, body_bytes, failed,
         from_cache AND NOT closed AS from_cache, closed AS redirect,
         CASE WHEN NOT closed THEN CAST(printf('%.2f', (2 * k + 1) * 5 / 1000.0) AS DOUBLE) END AS dns_ms
  FROM hops
)
"""

# A mixed folder: browser recordings, proxy logs and archives as one request table.
MIXED = HOPS + f""",
mixed AS (
  SELECT session_id, seq * 2 AS seq, url, domain, scheme, status, protocol, duration_ms, transfer_bytes, body_bytes, failed, from_cache,
         redirect, started, document_url, CASE WHEN NOT redirect THEN tls_protocol END AS tls_protocol, 'chrome-cdp' AS source_type
  FROM (SELECT c.*, r.scheme, r.started, r.document_url, r.tls_protocol
        FROM correlated c JOIN requests r ON c.session_id = r.session_id AND c.seq = r.seq * 4 WHERE r.user_id % 4 = 0)
  UNION ALL
  SELECT session_id, seq * 8, CASE WHEN method = 'POST' THEN domain || ':443' ELSE url END, domain,
         CASE WHEN method = 'POST' THEN 'https' ELSE scheme END, CASE WHEN method = 'POST' THEN 0 ELSE status END,
         CASE WHEN method = 'POST' THEN 'HTTP/1.1' ELSE protocol END, duration_ms, transfer_bytes + body_bytes, body_bytes, failed, false, false,
         NULL, '', NULL, 'proxy-jsonl' FROM requests WHERE user_id % 4 = 1
  UNION ALL
  SELECT session_id || '-' || CAST(seq // {ID_SPAN} AS VARCHAR),
         row_number() OVER (PARTITION BY session_id, seq // {ID_SPAN} ORDER BY duration_ms DESC, seq) - 1,
         CASE WHEN contains(url, '?') THEN
           regexp_extract(url, '^([^?#]*)', 1) || '?' || array_to_string(list_transform(
             list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda x: x <> ''),
             lambda x: CASE WHEN contains(x, '=') THEN x ELSE x || '=' END), '&') || regexp_extract(url, '^[^#]*(#.*)$', 1)
           ELSE url END, domain, scheme, CASE WHEN failed THEN 0 ELSE status END, protocol, duration_ms,
         body_bytes + CASE WHEN from_cache THEN 0 ELSE 100 END, body_bytes, failed OR status = 0, from_cache, false, NULL, '', NULL, 'har'
  FROM requests WHERE user_id % 4 = 2
),
facts AS (
  SELECT session_id, min(started) AS first_start,
         {BASE.format("coalesce(arg_min(domain, seq) FILTER (document_url <> ''), arg_min(domain, seq))")} AS page_domain
  FROM mixed GROUP BY session_id
),
normalized AS (
  SELECT r.*, coalesce(round_even((r.started - f.first_start) * 1000, 2), 0.0) AS offset_ms,
         {BASE.format("r.domain")} <> f.page_domain AS third_party,
         contains(lower(r.url), 'utm_source=') OR contains(lower(r.url), 'free-bets') AS tracker, (failed OR status >= 400) AS is_error
  FROM mixed r JOIN facts f USING (session_id)
)
"""

MIXED_PROFILE = MIXED + PROFILE.removeprefix(NORMALIZED)

RECOMMENDATIONS = {
    "unencrypted-http": "Use HTTPS for every non-local resource.",
    "legacy-tls": "Disable TLS 1.0/1.1 on the server.",
    "request-errors": "Inspect the failed-request table and fix broken dependencies or blocked resources.",
    "slow-requests": "Reduce server latency, connection setup, or resource size; prioritize critical resources.",
    "large-resources": "Compress, resize, lazy-load, or split large assets.",
    "duplicate-requests": "Deduplicate application fetches and verify caching headers.",
    "tracking-requests": "Review consent, necessity, retention, and third-party privacy terms.",
    "third-party-heavy": "Audit third-party dependencies and self-host critical assets where practical.",
    "http1-heavy": "Enable HTTP/2 or HTTP/3 where supported.",
    "low-cache-hit": "Review Cache-Control, ETag and immutable asset naming.",
    "clean-session": "",
}

DOCUMENT_URLS = "SELECT page_id, url FROM pages"


def _with(ctes: str, body: str) -> str:
    return f"WITH {ctes.strip()}\n{body.strip()}"


SUMMARY_COLUMNS = (
    "session_id, requests, domains, transfer_bytes, body_bytes, page_span_ms, failed, http_errors, cached, cache_percent, "
    "third_party, third_party_percent, trackers, duplicate_requests, redirects, slow_requests, large_requests"
)

LISTED = "session_id, seq, url, method, status, duration_ms, transfer_bytes, rank"


def _top(order: str, n: int, where: str = "true") -> str:
    return _with(
        NORMALIZED,
        f"""SELECT {LISTED} FROM (
              SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY {order}, seq) AS rank
              FROM normalized WHERE {where}) WHERE rank <= {n}""",
    )


def _findings(profile: str, result: str) -> str:
    """``result`` over ``fired`` rules and evidence ``lists`` of the given profile."""
    rules = [
        ("insecure > 0", "'critical'", "security", "unencrypted-http", "insecure || ' unencrypted HTTP requests'"),
        ("old_tls > 0", "'critical'", "security", "legacy-tls", "old_tls || ' requests use legacy TLS'"),
        ("errors > 0", "'warning'", "reliability", "request-errors", "errors || ' requests failed or returned HTTP errors'"),
        ("slow_requests > 0", "'warning'", "performance", "slow-requests", "slow_requests || ' requests take at least one second'"),
        ("large_requests > 0", "'warning'", "performance", "large-resources", "large_requests || ' resources exceed 1 MB'"),
        ("duplicate_requests > 0", "'info'", "performance", "duplicate-requests", "duplicate_requests || ' duplicate network requests'"),
        ("trackers > 0", "CASE WHEN trackers >= 3 THEN 'warning' ELSE 'info' END", "privacy", "tracking-requests", "trackers || ' likely tracking/analytics requests'"),
        ("third_party_percent >= 50", "'warning'", "privacy", "third-party-heavy", "third_party_percent || '% of requests are third-party'"),
        ("http1 >= 5", "'info'", "performance", "http1-heavy", "http1 || ' requests use HTTP/1.x'"),
        ("cache_percent < 10 AND requests >= 20", "'info'", "performance", "low-cache-hit", "'Only ' || cache_percent || '% of requests were served from cache'"),
    ]
    general = " OR ".join(f"({rule[0]})" for rule in rules[2:])
    fired = "\n UNION ALL ".join(
        f"SELECT session_id, {severity} AS severity, '{category}' AS category, '{code}' AS code, {title} AS title FROM profile WHERE {fires}"
        for fires, severity, category, code, title in rules
        + [(f"NOT ({general})", "'ok'", "overview", "clean-session", "'No major issues detected in this recording'")]
    )
    return _with(
        profile
        + f""", fired AS ({fired}),
        evidence AS (
          SELECT session_id, 'request-errors' AS code, url AS line, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS n
          FROM normalized WHERE is_error
          UNION ALL SELECT session_id, 'slow-requests', duration_ms || 'ms ' || url,
                 row_number() OVER (PARTITION BY session_id ORDER BY duration_ms DESC, seq) FROM normalized WHERE duration_ms >= 1000
          UNION ALL SELECT session_id, 'large-resources', transfer_bytes || ' bytes ' || url,
                 row_number() OVER (PARTITION BY session_id ORDER BY transfer_bytes DESC, seq) FROM normalized WHERE transfer_bytes >= 1000000
          UNION ALL SELECT session_id, 'duplicate-requests', count || '× ' || url, n FROM (
                 SELECT session_id, url, count(*) AS count,
                        row_number() OVER (PARTITION BY session_id ORDER BY count(*) DESC, min(seq)) AS n
                 FROM normalized GROUP BY session_id, url) WHERE count > 1
          UNION ALL SELECT session_id, 'tracking-requests', domain,
                 row_number() OVER (PARTITION BY session_id ORDER BY domain) FROM (SELECT DISTINCT session_id, domain FROM normalized WHERE tracker)
        ),
        lists AS (
          SELECT session_id, code, string_agg(line, ' | ' ORDER BY n) AS evidence FROM evidence
          WHERE n <= CASE WHEN code = 'tracking-requests' THEN 10 ELSE 5 END GROUP BY session_id, code
        )""",
        result,
    )


def request_statements() -> dict[str, str]:
    q: dict[str, str] = {}
    q["session_summary"] = _with(PROFILE, f"SELECT {SUMMARY_COLUMNS} FROM profile")
    q["normalized_requests"] = _with(
        NORMALIZED,
        """SELECT session_id, seq, domain, offset_ms, third_party, tracker, compression_ratio,
                  strftime(make_timestamp(ms * 1000), '%Y-%m-%dT%H:%M:%S.%g') || '+00:00' AS started_at FROM normalized""",
    )
    q["domain_rollup"] = _with(
        NORMALIZED,
        """SELECT session_id, domain, count(*) AS requests, CAST(sum(transfer_bytes) AS BIGINT) AS bytes,
                  count(*) FILTER (is_error) AS errors, bool_or(third_party) AS third_party, bool_or(tracker) AS tracker
           FROM normalized GROUP BY session_id, domain""",
    )
    q["frequency_tables"] = _with(
        DIMENSIONS,
        """SELECT session_id, dimension, value, count, first_seq FROM (
             SELECT *, row_number() OVER (PARTITION BY session_id, dimension ORDER BY count DESC, first_seq) AS n FROM counts)
           WHERE dimension <> 'mime_types' OR n <= 30""",
    )
    q["duplicate_urls"] = _with(
        REQUESTS,
        """SELECT session_id, url, count, rank FROM (
             SELECT session_id, url, count(*) AS count,
                    row_number() OVER (PARTITION BY session_id ORDER BY count(*) DESC, min(seq)) AS rank
             FROM requests GROUP BY session_id, url) WHERE rank <= 5 AND count > 1""",
    )
    q["session_scores"] = _with(SCORES, "SELECT * FROM scores")
    q["score_classes"] = _with(
        SCORES,
        """SELECT session_id, score_name, score,
                  CASE WHEN score >= 85 THEN 'good' WHEN score >= 60 THEN 'warn' ELSE 'bad' END AS score_class
           FROM scores UNPIVOT (score FOR score_name IN (overall, performance, reliability, privacy, security))""",
    )
    q["session_findings"] = _findings(
        PROFILE, "SELECT f.*, coalesce(l.evidence, '') AS evidence FROM fired f LEFT JOIN lists l USING (session_id, code)"
    )
    q["slowest_requests"] = _top("duration_ms DESC", 10)
    q["largest_requests"] = _top("transfer_bytes DESC", 10)
    q["errors_first"] = _top("is_error DESC, status DESC", 10)
    q["earliest_requests"] = _top("offset_ms", 10)
    q["third_party_share"] = _with(
        NORMALIZED,
        f"""SELECT {BASE.format('domain')} AS base_domain, count(*) AS requests, count(*) FILTER (third_party) AS third_party,
                  CAST(sum(transfer_bytes) AS BIGINT) AS bytes FROM normalized GROUP BY 1""",
    )
    q["tracker_flags"] = _with(
        NORMALIZED, "SELECT session_id, seq, url, tracker FROM normalized WHERE tracker"
    )
    q["waterfall"] = _with(
        NORMALIZED
        + """, shown AS (
          SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY offset_ms, seq) AS rank FROM normalized)
          WHERE rank <= 80),
        spans AS (SELECT session_id, max(offset_ms + duration_ms) AS span FROM shown GROUP BY session_id),
        lefts AS (
          SELECT s.*, CASE WHEN span = 0 THEN 1.0 ELSE span END AS span,
                 greatest(0.0, least(99.0, offset_ms / CASE WHEN span = 0 THEN 1.0 ELSE span END * 100)) AS left_percent
          FROM shown s JOIN spans USING (session_id))""",
        """SELECT session_id, seq, rank, offset_ms, duration_ms, is_error, round(left_percent, 6) AS left_percent,
                  round(greatest(0.4, least(100.0 - left_percent, duration_ms / span * 100)), 6) AS width_percent FROM lefts""",
    )
    q["domain_bars"] = _with(
        NORMALIZED
        + """, rollup AS (
          SELECT session_id, domain, count(*) AS requests, CAST(sum(transfer_bytes) AS BIGINT) AS bytes
          FROM normalized GROUP BY session_id, domain),
        shown AS (SELECT * FROM (
          SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY bytes DESC, requests DESC, domain) AS rank FROM rollup)
          WHERE rank <= 25)""",
        """SELECT session_id, domain, requests, bytes, rank,
                  greatest(1, CAST(round_even(bytes / CASE WHEN peak = 0 THEN 1 ELSE peak END * 100, 0) AS BIGINT)) AS width_percent
           FROM (SELECT *, max(bytes) OVER (PARTITION BY session_id) AS peak FROM shown)""",
    )
    q["aggregate_bars"] = _with(
        DIMENSIONS,
        """SELECT session_id, dimension, value, count, rank,
                  greatest(1, CAST(round_even(count / peak * 100, 0) AS BIGINT)) AS width_percent FROM (
             SELECT *, row_number() OVER (PARTITION BY session_id, dimension ORDER BY count DESC, first_seq) AS rank,
                    max(count) OVER (PARTITION BY session_id, dimension) AS peak FROM counts) WHERE rank <= 15""",
    )
    q["request_filter"] = _with(
        REQUESTS,
        """SELECT session_id, seq, url, status, resource_type FROM requests
           WHERE (status = 0 OR status >= 400) AND resource_type = 'click'
             AND contains(lower(concat_ws(' ', method, status, domain, url, resource_type, mime_type, protocol)), 'example.net')""",
    )
    q["request_details"] = _with(
        NORMALIZED,
        """SELECT session_id, seq, url,
                  coalesce(CASE WHEN seq % 11 <> 0 AND seq % 13 <> 0 THEN remote_ip END, '—') || ':'
                    || CASE WHEN seq % 17 = 0 THEN '—' ELSE '443' END AS remote,
                  CASE WHEN seq % 7 <> 0 THEN 'c' || seq % 40 END AS connection, seq % 2 = 1 AS reused,
                  CASE WHEN resource_type = 'view' THEN 'VeryHigh' WHEN seq % 5 <> 0 THEN 'Low' END AS priority,
                  CASE WHEN resource_type = 'view' THEN 'other' ELSE 'script' END AS initiator,
                  '{"protocol":"' || tls_protocol || '"}' AS security, CASE WHEN failed THEN 'net::ERR_FAILED' END AS failure,
                  array_to_string(list_sort(list_distinct(list_transform(
                    list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda x: x <> ''),
                    lambda x: url_decode(replace(string_split(x, '=')[1], '+', ' '))))), ',') AS keys,
                  concat_ws(',', CASE WHEN from_cache THEN 'cache' END, CASE WHEN third_party THEN '3rd' END,
                            CASE WHEN tracker THEN 'tracker' END, CASE WHEN failed THEN 'failed' END) AS tags,
                  k / 10.0 AS dns_ms, k / 5.0 AS connect_ms, CAST(NULL AS DOUBLE) AS ssl_ms, CAST(1.0 AS DOUBLE) AS send_ms, k / 4.0 AS ttfb_ms,
                  CASE WHEN is_error THEN 'status-bad' WHEN status BETWEEN 200 AND 399 THEN 'status-ok'
                       WHEN status <> 0 THEN 'status-warn' ELSE 'status-muted' END AS status_class
           FROM normalized""",
    )
    q["csv_projection"] = _with(
        NORMALIZED,
        """SELECT strftime(make_timestamp(ms * 1000), '%Y-%m-%dT%H:%M:%S.%g') || '+00:00' AS started_at, offset_ms, method,
                  status, protocol, resource_type, mime_type, duration_ms, transfer_bytes, body_bytes, domain, remote_ip,
                  from_cache, third_party, tracker, failed, url FROM normalized""",
    )
    q["report_cards"] = _with(
        PROFILE,
        """SELECT session_id, requests, domains, transfer_bytes, page_span_ms, failed + http_errors AS errors,
                  third_party_percent FROM profile""",
    )
    q["resource_type_list"] = _with(REQUESTS, "SELECT DISTINCT session_id, resource_type FROM requests")
    metrics = "requests domains transfer_bytes page_span_ms failed http_errors third_party trackers slow_requests large_requests".split()
    q["compare_periods"] = _compare(metrics)
    q["compare_scores"] = _compare_scores()
    q["correlate_requests"] = _with(HOPS, "SELECT * FROM correlated")
    q["correlated_headers"] = _with(
        HOPS,
        """SELECT session_id, seq * 8 AS seq, hop AS redirect_index, closed AS redirect,
                  concat_ws(',', CASE WHEN k % 6 <> 1 THEN 'x-ask=a' || seq END,
                    'x-early=e' || coalesce(CASE WHEN next_k % 5 = 0 THEN next_seq END, CASE WHEN hop = 0 AND k % 5 = 0 THEN seq END)) AS request_headers,
                  CASE WHEN closed THEN '' ELSE concat_ws(',', 'server=' || protocol, CASE WHEN k % 4 <> 0 THEN 'x-answer=r' || seq END) END AS response_headers,
                  NOT closed AND (from_cache OR k % 6 = 2) AS from_cache
           FROM (SELECT *, lead(k) OVER w AS next_k, lead(seq) OVER w AS next_seq FROM hops
                 WINDOW w AS (PARTITION BY session_id, seq // 400 ORDER BY seq))""",
    )
    q["redirect_hops"] = _with(
        HOPS,
        """SELECT session_id, id, count(*) AS hops, count(*) FILTER (redirect) AS redirects,
                  max(redirect_index) AS last_index FROM correlated GROUP BY session_id, id""",
    )
    q["recorded_summary"] = _with(
        HOPS,
        """SELECT session_id, count(*) AS requests, CAST(sum(transfer_bytes) AS BIGINT) AS transfer_bytes,
                  CAST(sum(body_bytes) AS BIGINT) AS body_bytes, count(*) FILTER (redirect) AS redirects,
                  count(*) FILTER (from_cache) AS cached, count(*) FILTER (failed) AS failed,
                  count(*) FILTER (status >= 400) AS http_errors
           FROM correlated GROUP BY session_id""",
    )
    q["recorder_summary"] = _with(
        HOPS,
        """SELECT session_id, count(DISTINCT id) AS requests, count(*) FILTER (failed) AS network_failures,
                  count(*) FILTER (status >= 400) AS http_errors,
                  CAST(sum(CASE WHEN failed THEN 0 ELSE transfer_bytes END) AS BIGINT) AS encoded_bytes,
                  CAST(printf('%.2f', (max(ms) - min(ms)) / 1000.0) AS DOUBLE) AS observed_seconds,
                  count(*) FILTER (failed) + count(*) FILTER (status >= 400) AS failed
           FROM hops GROUP BY session_id""",
    )
    q["recorder_counters"] = _with(
        REQUESTS,
        """SELECT session_id, dimension, value, count(*) AS count FROM (
             SELECT session_id, 'domains' AS dimension, domain AS value FROM requests
             UNION ALL SELECT session_id, 'resource_types', resource_type FROM requests
             UNION ALL SELECT session_id, 'methods', method FROM requests
             UNION ALL SELECT session_id, 'statuses', CAST(status AS VARCHAR) FROM requests)
           GROUP BY ALL""",
    )
    spelled = lambda name: f"CASE WHEN {name} THEN 'True' ELSE 'False' END AS {name}"
    q["written_csv"] = _with(
        NORMALIZED,
        f"""SELECT session_id, seq, strftime(make_timestamp(ms * 1000), '%Y-%m-%dT%H:%M:%S.%g') || '+00:00' AS started_at,
                  CAST(offset_ms AS VARCHAR) AS offset_ms, method, CAST(status AS VARCHAR) AS status, protocol, resource_type, mime_type,
                  CAST(duration_ms AS VARCHAR) AS duration_ms, CAST(transfer_bytes AS VARCHAR) AS transfer_bytes,
                  CAST(body_bytes AS VARCHAR) AS body_bytes, domain, remote_ip, {spelled("from_cache")}, {spelled("third_party")},
                  {spelled("tracker")}, {spelled("failed")}, url FROM normalized""",
    )
    q["written_report"] = _findings(
        PROFILE + SCORES.removeprefix(PROFILE),
        """SELECT session_id, overall, p.transfer_bytes, codes, p.domains, p.requests AS counted, p.requests AS rows, last_seq
           FROM scores JOIN profile p USING (session_id) JOIN (
             SELECT session_id, string_agg(code, ',' ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 WHEN 'info' THEN 2 ELSE 3 END,
                                           category, code) AS codes FROM fired GROUP BY session_id) USING (session_id)
           JOIN (SELECT session_id, max(seq) AS last_seq FROM normalized GROUP BY session_id) USING (session_id)""",
    )
    q["written_har"] = _with(
        NORMALIZED,
        """SELECT session_id, seq, duration_ms AS time, method, url, status, transfer_bytes AS body_size, body_bytes AS content_size,
                  len(list_distinct(list_transform(list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda x: x <> ''),
                    lambda x: string_split(x, '=')[1]))) AS queries,
                  -1.0 AS blocked, k / 10.0 AS dns, k / 5.0 AS connect, 1.0 AS send, k / 4.0 AS wait,
                  round_even(greatest(0.0, duration_ms - (((0.0 + k / 10.0) + k / 5.0) + 1.0 + k / 4.0)), 2) AS receive FROM normalized""",
    )
    q["analyzed_summary"] = _with(
        MIXED_PROFILE, f"SELECT {SUMMARY_COLUMNS}, source_type FROM profile JOIN (SELECT DISTINCT session_id, source_type FROM mixed) USING (session_id)"
    )
    q["analyzed_scores"] = _with(MIXED_PROFILE + SCORES.removeprefix(PROFILE), "SELECT * FROM scores")
    advice = " ".join(f"WHEN '{code}' THEN '{text}'" for code, text in RECOMMENDATIONS.items())
    q["analyzed_findings"] = _findings(
        MIXED_PROFILE,
        f"""SELECT f.*, coalesce(l.evidence, '') AS evidence, CASE code {advice} END AS recommendation,
                   row_number() OVER (PARTITION BY session_id ORDER BY
                     CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 WHEN 'info' THEN 2 ELSE 3 END, category, code) AS position
            FROM fired f LEFT JOIN lists l USING (session_id, code)""",
    )
    q["analyzed_sources"] = _with(
        MIXED,
        """SELECT session_id, source_type, count(*) * CASE WHEN source_type = 'chrome-cdp' THEN 4 + CASE WHEN CAST(session_id AS BIGINT) % 8 = 0 THEN 1 ELSE 0 END
                  WHEN source_type = 'proxy-jsonl' AND CAST(session_id AS BIGINT) % 8 = 1 THEN 2 ELSE 1 END AS events, CAST(NULL AS VARCHAR) AS reason,
                  CAST(NULL AS BIGINT) AS opened, CAST(NULL AS BIGINT) AS closed, CAST(NULL AS BIGINT) AS processes
           FROM mixed GROUP BY session_id, source_type
           UNION ALL SELECT 'rec-' || user_id % 10, 'connection-jsonl', count(*), NULL, count(*) FILTER (k % 3 <> 0), count(*) FILTER (k % 3 = 0),
                  count(DISTINCT user_id % 7) FROM requests GROUP BY user_id % 10
           UNION ALL SELECT session_id, 'unsupported', count(*), 'recording contains no supported CDP, proxy, or connection events', NULL, NULL, NULL
           FROM requests WHERE user_id % 4 = 3 GROUP BY session_id""",
    )
    q["url_parts"] = """
        SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\\-]*):', 1)) AS scheme,
               regexp_extract(url, '^[^:]*://([^/?#]*)', 1) AS authority,
               lower(regexp_extract(url, '^[^:]*://(?:[^/?#]*@)?([^:/?#]*)', 1)) AS host,
               regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1) AS path,
               regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS query,
               regexp_extract(url, '^[^#]*#(.*)$', 1) AS fragment FROM pages"""
    q["base_domain"] = f"""
        SELECT CASE WHEN regexp_extract(host, '([^.]+\\.[^.]+)$', 1) IN
                    ('co.uk', 'org.uk', 'com.au', 'com.br', 'co.jp', 'co.in', 'com.cn', 'com.ru', 'co.nz')
                    AND len(string_split(host, '.')) > 2
               THEN regexp_extract(host, '([^.]+\\.[^.]+\\.[^.]+)$', 1)
               ELSE regexp_extract(host, '([^.]+\\.[^.]+)$', 1) END AS base_domain,
               count(*) AS pages, count(DISTINCT host) AS hosts
        FROM (SELECT {HOST} AS host FROM pages) GROUP BY 1"""
    q["query_keys"] = """
        SELECT page_id, array_to_string(list_sort(list_distinct(list_transform(
                 list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda x: x <> ''),
                 lambda x: url_decode(replace(string_split(x, '=')[1], '+', ' '))))), ',') AS keys FROM pages"""
    q["redact_urls"] = """
        WITH parts AS (
          SELECT page_id, regexp_extract(url, '^([^?#]*)', 1) AS head, regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS query,
                 regexp_extract(url, '^[^#]*(#.*)$', 1) AS tail FROM pages),
        safe AS (
          SELECT page_id, head, tail, array_to_string(list_transform(
                   list_filter(string_split(query, '&'), lambda x: x <> ''),
                   lambda x: string_split(x, '=')[1] || '=' || CASE WHEN regexp_matches(string_split(x, '=')[1], '(?i)page|utm')
                        THEN '%5BREDACTED%5D' ELSE coalesce(string_split(x, '=')[2], '') END), '&') AS query FROM parts)
        SELECT page_id, head || CASE WHEN query <> '' THEN '?' || query ELSE '' END || tail AS url FROM safe"""
    q["redact_text"] = """
        SELECT doc_id, left(regexp_replace(text, '(?i)(authorization|token|password)=([^\\s&]+)', '\\1=[REDACTED]', 'g'), 500) AS message
        FROM documents"""
    return q


def _compare(metrics: list[str]) -> str:
    long = lambda side: " UNION ALL ".join(
        f"SELECT session_id, '{name}' AS metric, CAST({name} AS DOUBLE) AS value FROM {side}" for name in metrics
    )
    return f"""
      WITH {_period_profile('b', 0)}, {_period_profile('a', 1)},
      old AS ({long('b_profile')}), new AS ({long('a_profile')}),
      pairs AS (SELECT session_id, metric, coalesce(old.value, 0.0) AS before, coalesce(new.value, 0.0) AS after
                FROM old FULL OUTER JOIN new USING (session_id, metric))
      SELECT session_id, metric, before, after, round_even(after - before, 2) AS delta,
             CASE WHEN before <> 0 THEN round_even((after - before) / before * 100, 1) END AS percent,
             after - before > 0 AS worse FROM pairs"""


def _period_profile(prefix: str, half: int) -> str:
    """PROFILE over one half of the period (odd or even days since the epoch), with every relation renamed."""
    names = "page_count|base_events|requests|facts|normalized|profile|raw_scores|scores"
    text = re.sub(rf"\b({names}) AS \(", rf"{prefix}_\1 AS (", SCORES.strip())
    text = re.sub(rf"\b(FROM|JOIN) ({names})\b", rf"\1 {prefix}_\2", text)
    text = text.replace(", page_count c,", f", {prefix}_page_count c,")
    return text.replace("% c.np", f"% c.np AND epoch_us(e.ts) // 86400000000 % 2 = {half}")


def _compare_scores() -> str:
    names = ("overall", "performance", "reliability", "privacy", "security")
    long = lambda side: " UNION ALL ".join(
        f"SELECT session_id, '{name}' AS metric, CAST({name} AS DOUBLE) AS value FROM {side}" for name in names
    )
    return f"""
      WITH {_period_profile('b', 0)}, {_period_profile('a', 1)},
      old AS ({long('b_scores')}), new AS ({long('a_scores')}),
      pairs AS (SELECT session_id, metric, coalesce(old.value, 0.0) AS before, coalesce(new.value, 0.0) AS after
                FROM old FULL OUTER JOIN new USING (session_id, metric))
      SELECT session_id, metric, before, after, after - before AS delta, after - before > 0 AS better FROM pairs"""
