"""SQL of the host, socket, packet and probe queries (see ``reference_sql``)."""

from __future__ import annotations

from netlens.plans.reference_sql import ID_SPAN, REQUESTS, _with

BASE = """
e AS (SELECT event_id, user_id, event_type, epoch_us(ts) // 1000 AS ms,
             CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k, CAST(round(value * 100) AS BIGINT) AS v FROM events)
"""

REMOTE = """CASE WHEN event_type = 'signup' THEN NULL WHEN user_id % 4 = 0 THEN '192.168.1.' || user_id % 200
  WHEN user_id % 4 = 1 THEN '8.8.' || user_id % 200 || '.8' WHEN user_id % 4 = 2 THEN '2606:4700::' || user_id % 10
  WHEN user_id % 8 = 3 THEN '127.0.0.1' ELSE '52.1.2.' || user_id % 200 END"""

SOCKETS = BASE + f""",
seen AS (SELECT 'host-' || user_id % 10 AS host, ms // 3600000 AS snapshot_no, user_id, event_type, min(event_id) AS seq
         FROM e GROUP BY ALL),
sockets AS (
  SELECT *, 'App' || user_id % 7 AS process, user_id AS pid, user_id % 9 || 'u' AS fd,
         CASE WHEN event_type = 'error' THEN 'UDP' ELSE 'TCP' END AS protocol,
         CASE WHEN event_type = 'signup' AND user_id % 2 = 0 THEN '*' ELSE '10.0.0.' || user_id % 250 END AS local_host,
         1000 + user_id % 500 AS local_port, {REMOTE} AS remote_host,
         CASE event_type WHEN 'signup' THEN 'LISTEN' WHEN 'purchase' THEN 'CLOSED' WHEN 'error' THEN '' ELSE 'ESTABLISHED' END AS state
  FROM seen),
keyed AS (
  SELECT *, pid || '|' || fd || '|' || protocol || '|' || local_host || ':' || local_port || '|' ||
         CASE WHEN remote_host IS NULL THEN '' WHEN contains(remote_host, ':') THEN '[' || remote_host || ']:443'
              ELSE remote_host || ':443' END AS conn_key FROM sockets),
hours AS (SELECT DISTINCT ms // 3600000 AS snapshot_no FROM e),
taken AS (SELECT 'host-' || h AS host, snapshot_no FROM hours, range(10) t(h)),
ordered AS (SELECT *, lag(snapshot_no) OVER (PARTITION BY host ORDER BY snapshot_no) AS prev_no FROM taken),
here AS (SELECT DISTINCT host, snapshot_no, conn_key FROM keyed),
opened AS (
  SELECT h.host, h.snapshot_no, h.conn_key, 'open' AS change, o.prev_no IS NULL AS initial FROM here h JOIN ordered o USING (host, snapshot_no)
  WHERE NOT EXISTS (SELECT 1 FROM here p WHERE p.host = h.host AND p.conn_key = h.conn_key AND p.snapshot_no = o.prev_no)),
closed AS (
  SELECT p.host, o.snapshot_no, p.conn_key, 'close' AS change, false AS initial FROM here p JOIN ordered o ON o.host = p.host AND o.prev_no = p.snapshot_no
  WHERE NOT EXISTS (SELECT 1 FROM here h WHERE h.host = p.host AND h.conn_key = p.conn_key AND h.snapshot_no = o.snapshot_no)),
changes AS (SELECT * FROM opened UNION ALL SELECT * FROM closed)
"""

SAMPLES = BASE + """,
running AS (
  SELECT 'host-' || user_id % 10 AS host, 'en' || user_id // 10 % 4 AS name, ms, event_id,
         CAST(sum(v) OVER w AS BIGINT) % 100000 AS rx, CAST(sum(k) OVER w AS BIGINT) AS tx
  FROM e WINDOW w AS (PARTITION BY user_id % 10, user_id // 10 % 4 ORDER BY event_id)),
samples AS (SELECT host, name, ms AS ts_ms, arg_max(rx, event_id) AS rx, arg_max(tx, event_id) AS tx FROM running GROUP BY ALL),
rates AS (
  SELECT host, name, ts_ms,
         coalesce(greatest(0.0, (rx - lag(rx) OVER w) / greatest(0.001, (ts_ms - lag(ts_ms) OVER w) / 1000.0)), 0.0) AS rx_rate,
         coalesce(greatest(0.0, (tx - lag(tx) OVER w) / greatest(0.001, (ts_ms - lag(ts_ms) OVER w) / 1000.0)), 0.0) AS tx_rate
  FROM samples WINDOW w AS (PARTITION BY host, name ORDER BY ts_ms))
"""

ACTIVITY = BASE + """,
marks AS (
  SELECT CAST(user_id AS VARCHAR) AS session_id, k % 5 AS rid, event_id AS seq, ms / 1000.0 AS ts,
         CASE WHEN event_type = 'view' AND k % 25 = 0 THEN 'load' WHEN k % 4 < 2 THEN 'start' ELSE 'end' END AS kind FROM e),
turns AS (SELECT *, lag(kind) OVER (PARTITION BY session_id, rid ORDER BY seq) AS last_kind FROM marks WHERE kind <> 'load'),
effects AS (
  SELECT session_id, seq, ts, kind, CASE WHEN kind = 'start' AND coalesce(last_kind, 'end') = 'end' THEN 1
         WHEN kind = 'end' AND last_kind = 'start' THEN -1 ELSE 0 END AS effect FROM turns
  UNION ALL SELECT session_id, seq, ts, kind, 0 FROM marks WHERE kind = 'load'),
flight AS (SELECT *, CAST(sum(effect) OVER (PARTITION BY session_id ORDER BY seq) AS BIGINT) AS open FROM effects)
"""

PACKETS = """
packets AS (
  SELECT 'cap-' || l_orderkey % 8 AS capture_id, l_orderkey * 8 + l_linenumber AS seq,
         '10.0.0.' || l_suppkey % 250 AS src, '10.1.0.' || l_partkey % 250 AS dst, CAST(40000 + l_linenumber AS VARCHAR) AS port,
         CAST(l_quantity AS INTEGER) AS length,
         CASE WHEN l_returnflag = 'A' THEN 'tcp' WHEN l_returnflag = 'N' THEN 'udp' WHEN l_linestatus = 'O' THEN 'icmp' ELSE 'arp' END AS protocol
  FROM lineitem)
"""

DNS = """
dns AS (
  SELECT 'dns-' || o_orderkey % 4 AS capture_id, o_orderkey AS seq, o_orderkey % 65536 AS txid,
         '1.1.1.' || o_custkey % 3 AS server, '192.168.1.' || o_custkey % 200 || '.' || (50000 + o_orderkey % 1000) AS client,
         replace(lower(substring(o_orderpriority, 3, 20)), ' ', '-') || '-' || o_custkey % 40 || '.example.com' AS domain,
         CASE WHEN o_orderkey % 5 = 0 THEN 'AAAA' ELSE 'A' END AS query_type,
         CASE WHEN o_orderkey % 3 = 0 THEN 'response' WHEN o_orderkey % 7 = 1 THEN 'other' ELSE 'query' END AS direction
  FROM orders)
"""

SNAPSHOT = """
hosts AS (
  SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS host, c_custkey % 4 = 0 AS vpn,
         c_custkey % 4 = 0 AND c_custkey % 8 = 0 AS full_tunnel, c_custkey % 4 = 0 AND c_custkey % 3 = 0 AS addressed FROM customer),
servers AS (
  SELECT k, host, CASE WHEN k % 6 = 0 THEN '192.168.1.1' ELSE '9.9.9.9' END AS server, CASE WHEN k % 5 = 0 THEN 'utun3' ELSE 'en0' END AS interface
  FROM hosts WHERE k % 23 <> 0
  UNION ALL SELECT k, host, '1.1.1.1', 'unknown' FROM hosts WHERE k % 23 <> 0),
leaks AS (
  SELECT s.k, s.host, CASE WHEN server = '192.168.1.1' THEN 'warning' ELSE 'critical' END AS severity, 'dns-outside-vpn' AS code,
         'DNS route may bypass the VPN' AS title,
         'Resolver ' || server || ' is reached through ' || interface || ', not a detected tunnel interface.' AS detail
  FROM servers s JOIN hosts h USING (host) WHERE full_tunnel AND interface = 'en0'
  UNION ALL SELECT k, host, 'warning', 'ipv6-outside-vpn', 'IPv6 default route may bypass the VPN', 'IPv6 default route uses en0.'
  FROM hosts WHERE full_tunnel AND k % 2 = 0 AND k % 16 = 0),
all_leaks AS (
  SELECT * FROM leaks
  UNION ALL SELECT k, host, 'info', 'vpn-not-active', 'No active VPN detected', 'Traffic appears to use physical interfaces.' FROM hosts WHERE NOT vpn
  UNION ALL SELECT k, host, 'ok', 'no-obvious-leaks', 'No obvious route-level leaks detected', 'DNS and default-route checks did not find a bypass.'
  FROM hosts WHERE vpn AND host NOT IN (SELECT host FROM leaks)),
early AS (
  SELECT k, host, 'critical' AS severity, 'no-active-interface' AS code, 'No active IP interface' AS title,
         'No active interface with an IPv4 address was found.' AS detail FROM hosts WHERE k % 7 = 0 AND NOT addressed
  UNION ALL SELECT k, host, 'critical', 'no-dns', 'No DNS resolver detected', 'The host did not expose a usable resolver.' FROM hosts WHERE k % 23 = 0
  UNION ALL SELECT k, host, 'info', 'multiple-default-routes', 'Multiple IPv4 default routes',
         'en0→10.0.0.1, ' || CASE WHEN k % 8 = 0 THEN 'utun3' ELSE 'en1' END || '→10.0.0.1' FROM hosts WHERE vpn
  UNION ALL SELECT k, host, 'warning', 'public-listeners', '2 services listen on all interfaces', 'httpd:8080, httpd:8080' FROM hosts WHERE k % 5 = 0
  UNION ALL SELECT k, host, 'info', 'many-closed-sockets', 'Many recently closed sockets',
         'The listing reports 51 CLOSED sockets; this may indicate high connection churn.' FROM hosts WHERE k % 19 = 0
  UNION ALL SELECT l.k, l.host, severity, code, title, detail FROM leaks l JOIN hosts h USING (host) WHERE h.vpn
  UNION ALL SELECT k, host, 'info', 'system-proxy', 'System proxy configuration is active', '{"HTTPProxy":"127.0.0.1"}' FROM hosts WHERE k % 29 = 0),
findings AS (
  SELECT * FROM early
  UNION ALL SELECT k, host, 'ok', 'baseline-clean', 'No obvious local configuration problems',
         'Interfaces, routes and DNS configuration look internally consistent.' FROM hosts WHERE host NOT IN (SELECT host FROM early)
  UNION ALL SELECT k, host, 'critical', 'quality-poor', 'Poor active network quality', 'Active quality score: ' || k % 101 || '/100.' FROM hosts WHERE k % 101 < 50
  UNION ALL SELECT k, host, 'warning', 'quality-degraded', 'Degraded active network quality', 'Active quality score: ' || k % 101 || '/100.'
  FROM hosts WHERE k % 101 >= 50 AND k % 101 < 75)
"""


FLEET = SNAPSHOT.replace(
    """  SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS host, c_custkey % 4 = 0 AS vpn,
         c_custkey % 4 = 0 AND c_custkey % 8 = 0 AS full_tunnel, c_custkey % 4 = 0 AND c_custkey % 3 = 0 AS addressed FROM customer),""",
    """  SELECT k, id AS host, k % 4 = 0 AS vpn, k % 8 = 0 AS full_tunnel, k % 12 = 0 AS addressed
  FROM (SELECT c_custkey + 7 * n AS k, c_custkey || '|' || n AS id FROM customer, range(2) t(n))),""",
).replace("FROM hosts WHERE k % 23 <> 0", "FROM hosts WHERE k % 23 <> 0 AND k % 31 <> 0")

#: Report order of the findings, and their recommendations.
CODES = (
    "no-active-interface", "no-dns", "multiple-default-routes", "public-listeners", "many-closed-sockets", "dns-outside-vpn", "ipv6-outside-vpn",
    "system-proxy", "baseline-clean", "quality-poor", "quality-degraded", "vpn-not-active", "no-obvious-leaks",
)
ADVICE = {
    "multiple-default-routes": "This is normal with many VPNs; verify priority if traffic uses the wrong path.",
    "public-listeners": "Confirm that each service is expected and protected by the firewall.",
    "dns-outside-vpn": "Enable the VPN DNS option or block DNS on physical interfaces.",
    "ipv6-outside-vpn": "Route IPv6 through the tunnel or disable IPv6 while using the VPN.",
}


def _common(ctes: str, value: str, alias: str, source: str, n: int) -> str:
    return _with(
        ctes,
        f"""SELECT capture_id, {alias}, count, rank FROM (
              SELECT capture_id, {value} AS {alias}, count(*) AS count,
                     row_number() OVER (PARTITION BY capture_id ORDER BY count(*) DESC, min(seq), {value}) AS rank
              FROM {source} GROUP BY capture_id, {value}) WHERE rank <= {n}""",
    )


def host_statements() -> dict[str, str]:
    q: dict[str, str] = {}
    q["proxy_requests"] = _with(
        REQUESTS,
        """SELECT session_id, seq, 'proxy-' || (row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1) AS id,
                  CASE WHEN method = 'POST' THEN domain || ':443' ELSE url END AS url,
                  CASE WHEN method = 'POST' THEN 'https' ELSE scheme END AS scheme, domain,
                  CASE WHEN method = 'POST' THEN '443' WHEN raw_path = '' THEN '/' ELSE raw_path END AS path,
                  CASE WHEN method = 'POST' THEN 'CONNECT' ELSE 'GET' END AS method,
                  CASE WHEN method = 'POST' THEN 'tunnel' ELSE 'http' END AS resource_type,
                  CASE WHEN method = 'POST' THEN 0 ELSE status END AS status,
                  CASE WHEN method = 'POST' THEN 'HTTP/1.1' ELSE protocol END AS protocol,
                  CASE WHEN method = 'POST' THEN 'unknown' ELSE mime_type END AS mime_type,
                  CASE WHEN method = 'POST' THEN '443' ELSE '80' END AS remote_port,
                  transfer_bytes + body_bytes AS transfer_bytes, body_bytes, duration_ms, failed FROM requests""",
    )
    archive = REQUESTS + f""",
    entries AS (
      SELECT session_id || '-' || CAST(seq // {ID_SPAN} AS VARCHAR) AS session_id, seq, url, domain, method,
             CASE WHEN failed THEN 0 ELSE status END AS status, protocol, mime_type, duration_ms, body_bytes,
             body_bytes + CASE WHEN from_cache THEN 0 ELSE 100 END AS transfer_bytes, from_cache, k / 10.0 AS dns_ms
      FROM requests)"""
    q["har_entries"] = _with(
        archive,
        """SELECT session_id, 'har-' || (row_number() OVER (PARTITION BY session_id ORDER BY duration_ms DESC, seq) - 1) AS id,
                  CASE WHEN contains(url, '?') THEN
                    regexp_extract(url, '^([^?#]*)', 1) || '?' || array_to_string(list_transform(
                      list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda x: x <> ''),
                      lambda x: CASE WHEN contains(x, '=') THEN x ELSE x || '=' END), '&') || regexp_extract(url, '^[^#]*(#.*)$', 1)
                    ELSE url END AS url,
                  domain, method, status, protocol, mime_type, duration_ms, body_bytes, transfer_bytes, status = 0 AS failed,
                  from_cache, dns_ms, CAST(NULL AS DOUBLE) AS queueing_ms FROM entries""",
    )
    q["har_summary"] = _with(
        archive,
        """SELECT session_id, count(*) AS requests, count(*) FILTER (status = 0 OR status >= 400) AS failed,
                  count(DISTINCT domain) AS domains, CAST(sum(body_bytes) AS BIGINT) AS total_body_bytes,
                  CAST(sum(transfer_bytes) AS BIGINT) AS total_transfer_bytes, max(duration_ms) AS longest_request_ms
           FROM entries GROUP BY session_id""",
    )
    q["har_counters"] = _with(
        archive,
        """SELECT session_id, dimension, value, count(*) AS count FROM (
             SELECT session_id, 'domain_counts' AS dimension, domain AS value FROM entries
             UNION ALL SELECT session_id, 'methods', method FROM entries
             UNION ALL SELECT session_id, 'statuses', CAST(status AS VARCHAR) FROM entries
             UNION ALL SELECT session_id, 'protocols', protocol FROM entries
             UNION ALL SELECT session_id, 'mime_types', mime_type FROM entries) GROUP BY ALL""",
    )
    q["session_types"] = """
        SELECT 'web-' || user_id AS session_id, 'chrome-cdp' AS source_type, count(*) * 4 AS events FROM events GROUP BY user_id
        UNION ALL SELECT 'proxy-' || user_id, 'proxy-jsonl', count(*) FROM events GROUP BY user_id
        UNION ALL SELECT 'rec-' || user_id % 10, 'connection-jsonl', count(*) FROM events GROUP BY 1"""
    q["inflight_peak"] = _with(
        ACTIVITY, "SELECT session_id, max(open) AS peak, arg_max(open, seq) AS open_at_end FROM flight GROUP BY session_id"
    )
    q["network_idle"] = _with(
        ACTIVITY
        + """,
        loads AS (SELECT session_id, min(ts) AS load_ts FROM flight WHERE kind = 'load' GROUP BY session_id),
        quiet AS (SELECT session_id, ts AS since, open, lead(ts) OVER (PARTITION BY session_id ORDER BY seq) AS until FROM flight WHERE kind <> 'load')""",
        """SELECT session_id, min(greatest(since + 3600.0, load_ts)) AS idle_at FROM quiet JOIN loads USING (session_id)
           WHERE open = 0 AND (until IS NULL OR (until - since >= 3600.0 AND greatest(since + 3600.0, load_ts) <= until)) GROUP BY session_id""",
    )
    q["lifecycle_changes"] = _with(SOCKETS, "SELECT host, snapshot_no, conn_key, change FROM changes")
    q["live_changes"] = _with(
        SOCKETS,
        """SELECT * FROM (SELECT host, snapshot_no, conn_key, change,
                    row_number() OVER (PARTITION BY host ORDER BY snapshot_no DESC, change, conn_key) AS rank
             FROM changes WHERE NOT initial) WHERE rank <= 100""",
    )
    q["lifecycle_summary"] = _with(
        SOCKETS,
        """SELECT t.host, count(DISTINCT t.snapshot_no) AS snapshots,
                  (SELECT count(*) FROM changes c WHERE c.host = t.host AND change = 'open') AS opened,
                  (SELECT count(*) FROM changes c WHERE c.host = t.host AND change = 'close') AS closed,
                  (SELECT count(*) FROM here h WHERE h.host = t.host AND h.snapshot_no = (SELECT max(snapshot_no) FROM hours)) AS active_at_end
           FROM taken t GROUP BY t.host""",
    )
    q["snapshot_difference"] = _with(
        SOCKETS,
        """SELECT host, conn_key, 'open' AS change FROM (SELECT host, conn_key FROM here WHERE snapshot_no % 24 >= 4
             EXCEPT SELECT host, conn_key FROM here WHERE snapshot_no % 24 < 4)
           UNION ALL SELECT host, conn_key, 'close' FROM (SELECT host, conn_key FROM here WHERE snapshot_no % 24 < 4
             EXCEPT SELECT host, conn_key FROM here WHERE snapshot_no % 24 >= 4)""",
    )
    q["process_rollup"] = _with(
        SOCKETS,
        """SELECT host, process, pid, count(*) AS total, count(remote_host) AS remote, count(*) FILTER (protocol = 'TCP') AS tcp,
                  count(*) FILTER (protocol = 'UDP') AS udp, count(*) FILTER (state = 'LISTEN') AS listen,
                  count(DISTINCT remote_host) AS targets FROM sockets GROUP BY host, process, pid""",
    )
    q["socket_overview"] = _with(
        SOCKETS,
        """SELECT host, count(*) AS connections, count(remote_host) AS remote, count(*) FILTER (state = 'LISTEN') AS listen,
                  count(remote_host) FILTER (protocol = 'TCP') AS tcp, count(remote_host) FILTER (protocol = 'UDP') AS udp
           FROM sockets GROUP BY host""",
    )
    q["top_processes"] = _with(
        SOCKETS,
        """SELECT host, process, count, rank FROM (SELECT host, process, count(*) AS count,
                  row_number() OVER (PARTITION BY host ORDER BY count(*) DESC, min(seq)) AS rank
             FROM sockets WHERE remote_host IS NOT NULL GROUP BY host, process) WHERE rank <= 8""",
    )
    q["connection_summary"] = _with(
        SOCKETS,
        """SELECT host, 'by_process' AS dimension, process AS value, count(*) AS count FROM sockets GROUP BY ALL
           UNION ALL SELECT host, 'by_protocol', protocol, count(*) FROM sockets GROUP BY ALL
           UNION ALL SELECT host, 'total', 'all', count(*) FROM sockets GROUP BY ALL
           UNION ALL SELECT host, 'total', 'remote', count(*) FROM sockets WHERE remote_host IS NOT NULL GROUP BY ALL""",
    )
    q["connection_filter"] = _with(
        SOCKETS,
        """SELECT host, snapshot_no, process, pid, protocol, state FROM sockets
           WHERE process = 'App3' AND remote_host IS NOT NULL AND state = 'ESTABLISHED'
             AND (contains(remote_host, '8.8.') OR contains(local_host || ':' || local_port, '8.8.'))""",
    )
    q["connection_listing"] = _with(
        SOCKETS,
        """SELECT host, rank, state, process, pid, snapshot_no FROM (
             SELECT *, row_number() OVER (PARTITION BY host ORDER BY state, process, pid, snapshot_no, seq) AS rank FROM sockets)
           WHERE rank <= 20""",
    )
    q["connection_paths"] = _with(
        SOCKETS
        + """, vpn AS (SELECT 'host-' || s_suppkey % 10 AS host, bool_or(s_suppkey % 3 = 0 AND s_suppkey % 20 = 6) AS vpn_default
                       FROM supplier GROUP BY 1)""",
        """SELECT host, CASE WHEN remote_host = '127.0.0.1' THEN 'loopback' WHEN remote_host LIKE '192.168.%' THEN 'local-network'
                  WHEN remote_host IS NOT NULL AND vpn_default THEN 'vpn-default' ELSE 'direct' END AS path, count(*) AS sockets
           FROM sockets LEFT JOIN vpn USING (host) GROUP BY 1, 2""",
    )
    q["recording_summary"] = _with(
        BASE,
        """SELECT 'rec-' || user_id % 10 AS session_id, count(*) AS events, count(*) FILTER (k % 3 <> 0) AS opened,
                  count(*) FILTER (k % 3 = 0) AS closed, count(DISTINCT user_id % 7) AS processes FROM e GROUP BY 1""",
    )
    q["recording_processes"] = _with(
        BASE,
        """SELECT 'rec-' || user_id % 10 AS session_id, 'App' || user_id % 7 AS value, count(*) AS count, min(event_id) AS first_seq
           FROM e GROUP BY 1, 2""",
    )
    q["interface_rates"] = _with(
        SAMPLES, "SELECT host, name, ts_ms, round(rx_rate, 6) AS rx_rate, round(tx_rate, 6) AS tx_rate FROM rates"
    )
    q["rate_history"] = _with(
        SAMPLES
        + """, totals AS (SELECT host, ts_ms, CAST(sum(CAST(floor(rx_rate * 1000) AS BIGINT)) AS BIGINT) AS rx,
                                 CAST(sum(CAST(floor(tx_rate * 1000) AS BIGINT)) AS BIGINT) AS tx FROM rates GROUP BY host, ts_ms)""",
        """SELECT *, CAST(sum(rx) OVER w AS BIGINT) AS last_rx, CAST(sum(tx) OVER w AS BIGINT) AS last_tx FROM totals
           WINDOW w AS (PARTITION BY host ORDER BY ts_ms ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)""",
    )
    q["socket_log"] = """
        SELECT CAST(c_nationkey AS VARCHAR) AS host, c_custkey + 2 AS pos, 'Web App' AS process, c_custkey AS pid,
               CASE WHEN c_custkey % 2 = 0 THEN 'TCP' ELSE 'UDP' END AS protocol,
               CASE c_custkey % 3 WHEN 0 THEN '*' WHEN 1 THEN '10.0.0.2' ELSE '[fe80::1]' END || ':' || (1000 + c_custkey % 1000) AS local,
               CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '1.1.1.1:443' ELSE '[2606:4700::1]:443' END AS remote,
               CASE c_custkey % 3 WHEN 0 THEN 'LISTEN' WHEN 1 THEN 'ESTABLISHED' ELSE '' END AS state
        FROM customer WHERE c_custkey % 13 <> 0"""
    q["route_log"] = """
        SELECT CAST(c_nationkey AS VARCHAR) AS host, c_custkey + 2 AS pos,
               CASE WHEN c_custkey % 10 = 0 THEN 'default' ELSE '10.0.' || c_custkey % 250 END AS destination, 'link#1' AS gateway,
               'UGSc' AS flags, 'en' || c_custkey % 3 AS interface, CASE WHEN c_custkey % 2 = 0 THEN '900' ELSE '' END AS expire
        FROM customer WHERE c_custkey % 11 <> 0"""
    q["default_routes"] = """
        SELECT CAST(c_nationkey AS VARCHAR) AS host, 'en' || c_custkey % 3 AS interface, count(*) AS routes
        FROM customer WHERE c_custkey % 11 <> 0 AND c_custkey % 10 = 0 GROUP BY 1, 2"""
    q["counter_log"] = """
        SELECT CAST(c_nationkey AS VARCHAR) AS host, 'en' || c_custkey % 4 AS name, max(c_custkey * 1000) AS rx_bytes,
               max(c_custkey * 500) AS tx_bytes, max(c_custkey * 3) AS rx_packets, max(c_custkey * 2) AS tx_packets,
               max(c_custkey % 5) AS rx_errors, 0 AS tx_errors, coalesce(max(c_custkey % 7) FILTER (c_custkey % 2 = 1), 0) AS drops
        FROM customer WHERE c_custkey % 17 <> 0 GROUP BY 1, 2"""
    q["neighbour_union"] = """
        SELECT CAST(c_nationkey AS VARCHAR) AS host, 'IPv4' AS family, c_custkey AS pos, '192.168.1.' || c_custkey % 250 AS address,
               'aa:bb:cc:dd:ee:ff' AS mac, 'en0' AS interface, 'ifscope [ethernet]' AS state
        FROM customer WHERE c_custkey % 9 <> 0 AND c_custkey % 7 <> 0
        UNION ALL SELECT CAST(c_nationkey AS VARCHAR), 'IPv6', c_custkey + 2, 'fe80::' || (c_custkey % 9 + 1) || '%en0', 'aa:bb:cc:dd:ee:ff',
               'en0', '23h S R' FROM customer WHERE c_custkey % 9 <> 0 AND c_custkey % 7 <> 0"""
    q["packet_totals"] = _with(
        PACKETS, "SELECT capture_id, count(*) AS packets, CAST(sum(length) AS BIGINT) AS payload_bytes, false AS limited FROM packets GROUP BY 1"
    )
    q["packet_protocols"] = _with(PACKETS, "SELECT capture_id, protocol, count(*) AS count FROM packets GROUP BY 1, 2")
    ends = PACKETS + """, ends AS (
      SELECT capture_id, seq * 2 AS seq, src AS host, port FROM packets WHERE protocol IN ('tcp', 'udp')
      UNION ALL SELECT capture_id, seq * 2 + 1, dst, '443' FROM packets WHERE protocol IN ('tcp', 'udp')),
    pairs AS (SELECT capture_id, seq, src || ':' || port || ' ↔ ' || dst || ':443' AS pair FROM packets WHERE protocol IN ('tcp', 'udp'))"""
    q["packet_endpoints"] = _common(ends, "host", "host", "ends", 30)
    q["packet_ports"] = _common(ends, "port", "port", "ends", 30)
    q["packet_conversations"] = _common(ends, "pair", "conversation", "pairs", 30)
    q["packet_samples"] = _with(
        DNS,
        """SELECT capture_id, seq, '2024-01-01 12:00:00.5 IP ' || CASE WHEN direction = 'response'
                    THEN server || '.53 > ' || client || ': ' || txid || ' 1/0/0 A 9.9.9.9 (45)'
                    ELSE client || ' > ' || server || '.53: ' || txid || '+ ' || query_type || '? ' || domain || '. (29)' END AS raw
           FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY seq) AS n FROM dns WHERE direction <> 'other') WHERE n <= 50""",
    )
    q["dns_totals"] = _with(
        DNS,
        """SELECT capture_id, count(*) FILTER (direction = 'query') AS queries, count(*) FILTER (direction = 'response') AS responses
           FROM dns WHERE direction <> 'other' GROUP BY 1""",
    )
    asked = DNS + ", asked AS (SELECT * FROM dns WHERE direction = 'query')"
    q["dns_domains"] = _common(asked, "domain", "domain", "asked", 25)
    q["dns_servers"] = _with(asked, "SELECT capture_id, server, count(*) AS count FROM asked GROUP BY 1, 2")
    q["dns_query_types"] = _with(
        asked, "SELECT query_type, count(*) AS queries, count(DISTINCT domain) AS domains, max(txid) AS last_id FROM asked GROUP BY 1"
    )
    q["quality_scores"] = """
        WITH p AS (SELECT c_custkey AS k FROM customer),
        lost AS (
          SELECT k, CASE WHEN k % 10 = 0 THEN 45.0 ELSE least(35.0, k % 6 * 4.0 * 2.5)
                   + greatest(0.0, least(20.0, (k % 300 - 30) / 10)) + greatest(0.0, least(10.0, (k % 50 - 5) / 4)) END
                 + CASE WHEN k % 7 = 0 THEN 20.0 WHEN k % 200 > 150 THEN 10.0 WHEN k % 200 > 60 THEN 4.0 ELSE 0.0 END
                 + CASE WHEN k % 8 = 0 THEN 15.0 ELSE 0.0 END + CASE WHEN k % 9 = 0 THEN 15.0 ELSE 0.0 END AS points FROM p)
        SELECT CAST(k AS VARCHAR) AS run_id, CAST(greatest(0, least(100, round_even(round(100.0 - points, 6), 0))) AS BIGINT) AS score FROM lost"""
    q["probe_stats"] = """
        SELECT o_orderpriority, count(*) AS samples, CAST(min(floor(o_totalprice)) AS BIGINT) AS min_ms, round_even(avg(CAST(floor(o_totalprice) AS BIGINT)), 2) AS avg_ms,
               CAST(max(floor(o_totalprice)) AS BIGINT) AS max_ms, count(DISTINCT o_custkey) AS addresses FROM orders GROUP BY 1"""
    q["fastest_server"] = """
        WITH asked AS (SELECT c_custkey AS k, i, (c_custkey + i) % 4 <> 0 AS ok, c_custkey * (i + 3) % 50 AS ms FROM customer, range(4) t(i))
        SELECT CAST(k AS VARCHAR) AS host, '1.1.1.' || arg_min(i, ms * 10 + i) FILTER (ok) AS fastest, k % 3 = 0 AS answers_differ FROM asked GROUP BY k"""
    q["trace_stats"] = """
        SELECT CAST(p_partkey AS VARCHAR) AS host, i AS hop, '10.0.0.' || i || ',10.9.9.9' AS addresses,
               CASE WHEN (p_partkey + i) % 5 <> 0 THEN (p_partkey % 40 + p_partkey % 60) / 2 END AS average_ms, (p_partkey + i) % 5 = 0 AS timeout
        FROM part, range(1, 4) t(i)"""
    q["certificate_days"] = """
        SELECT CAST(p_partkey AS VARCHAR) AS host, 152.5 + p_partkey % 28 AS days_remaining FROM part"""
    q["snapshot_tables"] = _with(
        SNAPSHOT,
        """SELECT 'connections' AS table_name, CAST(sum(CASE WHEN k % 19 = 0 THEN 51 ELSE 1 END + CASE WHEN k % 5 = 0 THEN 2 ELSE 0 END) AS BIGINT) AS rows,
                  count(*) AS hosts FROM hosts
           UNION ALL SELECT 'interfaces', count(*) * 2, count(*) FROM hosts UNION ALL SELECT 'routes', count(*) * 2, count(*) FROM hosts
           UNION ALL SELECT 'resolvers', count(*), count(*) FROM hosts WHERE k % 23 <> 0 UNION ALL SELECT 'counters', count(*), count(*) FROM hosts""",
    )
    q["interface_counters"] = _with(
        SNAPSHOT,
        """SELECT host, 'en0' AS name, false AS is_vpn, k * 10 AS rx_bytes, k AS tx_bytes, k % 7 <> 0 AS is_active FROM hosts
           UNION ALL SELECT host, 'utun3', true, NULL, NULL, addressed FROM hosts""",
    )
    q["nameservers"] = _with(SNAPSHOT, "SELECT host, server FROM servers")
    q["vpn_status"] = _with(
        SNAPSHOT,
        """SELECT host, vpn AS active, full_tunnel AS full_tunnel_likely,
                  CASE WHEN vpn AND NOT full_tunnel THEN 1 ELSE 0 END + CASE WHEN full_tunnel AND NOT addressed THEN 1 ELSE 0 END AS warnings FROM hosts""",
    )
    q["leak_findings"] = _with(SNAPSHOT, "SELECT host, severity, code, detail FROM all_leaks")
    q["websocket_totals"] = _with(
        BASE,
        """SELECT CAST(user_id AS VARCHAR) AS session_id, count(*) FILTER (k % 10 = 0 AND k % 2 = 0) AS opened,
                  count(*) FILTER (k % 10 = 0 AND k % 2 = 1) AS closed, count(*) FILTER (k % 10 <> 0 AND k % 2 = 0) AS sent_frames,
                  count(*) FILTER (k % 10 <> 0 AND k % 2 = 1) AS received_frames,
                  CAST(coalesce(sum(2 * k) FILTER (k % 10 <> 0 AND k % 2 = 0), 0) AS BIGINT) AS sent_bytes,
                  CAST(coalesce(sum(2 * k) FILTER (k % 10 <> 0 AND k % 2 = 1), 0) AS BIGINT) AS received_bytes
           FROM e WHERE event_type = 'click' GROUP BY 1""",
    )
    q["performance_metrics"] = _with(
        BASE,
        """SELECT CAST(user_id AS VARCHAR) AS session_id, 'm' || k % 3 AS name, CAST(arg_max(v, event_id) AS DOUBLE) AS value
           FROM e WHERE event_type = 'purchase' GROUP BY 1, 2""",
    )
    q["lifecycle_list"] = _with(
        BASE,
        """SELECT CAST(user_id AS VARCHAR) AS session_id, event_id AS seq, 'Page.lifecycleEvent' AS method, '{"name":' || k || '}' AS params
           FROM e WHERE event_type = 'view'""",
    )
    q["session_metadata"] = _with(
        BASE,
        """SELECT CAST(user_id AS VARCHAR) AS session_id,
                  '{"n":' || max(event_id) FILTER (event_type = 'signup') || ',"type":"session_start"}' AS source_metadata,
                  '{"requests":' || arg_max(v, event_id) FILTER (event_type = 'error') || '}' AS recorder_summary
           FROM e WHERE event_type IN ('signup', 'error') GROUP BY 1""",
    )
    q["quarantine"] = _with(
        BASE,
        """SELECT CAST(user_id AS VARCHAR) AS session_id, CASE WHEN k % 17 = 0 THEN 'malformed JSON' WHEN k % 19 = 0 THEN 'expected an object'
                  ELSE 'accepted' END AS outcome, count(*) AS lines FROM e WHERE k % 17 = 0 OR k % 19 = 0 OR k % 23 <> 0 GROUP BY 1, 2""",
    )
    q["dns_event_view"] = _with(
        DNS,
        """SELECT capture_id AS session_id, seq, CASE direction WHEN 'query' THEN server ELSE regexp_extract(client, '^(.*)\\.[0-9]+$', 1) END AS dst_host,
                  CASE direction WHEN 'query' THEN 53 ELSE CAST(regexp_extract(client, '([0-9]+)$', 1) AS INTEGER) END AS dst_port, direction,
                  txid AS transaction_id, CASE direction WHEN 'query' THEN query_type END AS query_type,
                  CASE direction WHEN 'query' THEN domain END AS domain FROM dns WHERE direction <> 'other'""",
    )
    q["address_classes"] = """
        WITH a AS (
          SELECT c_custkey AS k, c_custkey % 256 AS b, c_custkey // 7 % 256 AS c, c_custkey % 3 = 0 AS six,
                 ([10, 127, 169, 172, 192, 198, 224, 240, 8, 100])[c_custkey % 10 + 1] AS a,
                 (['fe80', 'fd00', 'ff02', '2606'])[c_custkey % 4 + 1] AS head FROM customer)
        SELECT k AS c_custkey, CASE WHEN six THEN head || '::' || k % 10 ELSE a || '.' || b || '.' || c || '.1' END AS address,
               CASE WHEN six THEN head IN ('fe80', 'fd00')
                    ELSE a IN (10, 127, 240) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168)
                         OR (a = 192 AND b = 0 AND c IN (0, 2)) OR (a = 198 AND b IN (18, 19)) OR (a = 198 AND b = 51 AND c = 100) END AS private,
               NOT six AND a = 127 AS loopback, CASE WHEN six THEN head = 'fe80' ELSE a = 169 AND b = 254 END AS link_local,
               CASE WHEN six THEN head = 'ff02' ELSE a = 224 END AS multicast FROM a"""
    q["captured_headers"] = "SELECT page_id, 'Cookie,Host,Referer,content-type' AS names, '[REDACTED]' AS cookie, url AS host FROM pages"
    q["host_facts"] = _with(
        SNAPSHOT,
        """SELECT host, CASE WHEN k % 19 = 0 THEN 51 ELSE 1 END + CASE WHEN k % 5 = 0 THEN 2 ELSE 0 END AS connections,
                  CASE WHEN k % 19 = 0 THEN 51 ELSE 1 END AS remote_connections, CASE WHEN k % 5 = 0 THEN 2 ELSE 0 END AS public_listeners,
                  CASE WHEN k % 19 = 0 THEN 51 ELSE 1 END AS closed_sockets, CASE WHEN k % 5 = 0 THEN 'httpd:8080, httpd:8080' END AS listener_sample,
                  2 AS interfaces, CASE WHEN k % 7 <> 0 THEN 1 ELSE 0 END + CASE WHEN addressed THEN 1 ELSE 0 END AS active_interfaces,
                  CASE WHEN vpn THEN 2 ELSE 1 END AS default_routes,
                  'en0→10.0.0.1' || CASE WHEN NOT vpn THEN '' WHEN k % 8 = 0 THEN ', utun3→10.0.0.1' ELSE ', en1→10.0.0.1' END AS default_text,
                  CASE WHEN k % 23 = 0 THEN 0 ELSE 2 END AS dns_servers, vpn AS vpn_active,
                  CASE WHEN k % 29 = 0 THEN '{"HTTPProxy":"127.0.0.1"}' END AS proxy, k % 101 AS quality_score FROM hosts""",
    )
    q["diagnosis_findings"] = _with(SNAPSHOT, "SELECT host, severity, code, title, detail FROM findings")
    q["diagnosis_scores"] = _with(
        SNAPSHOT,
        """SELECT host, CAST(greatest(0, 100 - sum(CASE severity WHEN 'critical' THEN 30 WHEN 'warning' THEN 12 ELSE 0 END)) AS BIGINT) AS score,
                  count(*) AS findings FROM findings GROUP BY host""",
    )
    taken = """split_part(host, '|', 1) AS host, 1704067200000 + 86400000 * CAST(split_part(host, '|', 2) AS BIGINT) AS snapshot_no"""
    placed = f"row_number() OVER (PARTITION BY host ORDER BY list_position({list(CODES)}, code)) AS position"
    advice = "CASE code " + " ".join(f"WHEN '{code}' THEN '{text}'" for code, text in ADVICE.items()) + " ELSE '' END AS recommendation"
    q["fleet_findings"] = _with(FLEET, f"SELECT {taken}, {placed}, severity, code, title, detail, {advice} FROM findings")
    q["fleet_leaks"] = _with(FLEET, f"SELECT {taken}, {placed}, severity, code, detail FROM all_leaks")
    q["fleet_diagnosis"] = _with(
        FLEET,
        f"""SELECT {taken}, score, findings, CASE WHEN k % 19 = 0 THEN 51 ELSE 1 END + CASE WHEN k % 5 = 0 THEN 2 ELSE 0 END AS connections,
                  CASE WHEN k % 19 = 0 THEN 51 ELSE 1 END AS remote_connections, 2 AS interfaces,
                  concat_ws(',', CASE WHEN k % 7 <> 0 THEN 'en0' END, CASE WHEN addressed THEN 'utun3' END) AS active_interfaces,
                  CASE WHEN k % 23 = 0 OR k % 31 = 0 THEN '' WHEN k % 6 = 0 THEN '1.1.1.1,192.168.1.1' ELSE '1.1.1.1,9.9.9.9' END AS dns_servers,
                  vpn AS vpn_active, 'en0' || CASE WHEN NOT vpn THEN '' WHEN k % 8 = 0 THEN ',utun3' ELSE ',en1' END AS default_routes
           FROM hosts JOIN (SELECT host, CAST(greatest(0, 100 - sum(CASE severity WHEN 'critical' THEN 30 WHEN 'warning' THEN 12 ELSE 0 END)) AS BIGINT) AS score,
                                   count(*) AS findings FROM findings GROUP BY host) USING (host)""",
    )
    q["stored_findings"], q["stored_leaks"] = q["fleet_findings"], q["fleet_leaks"]
    numbers = "host, snapshot_no, score, findings, connections, remote_connections, interfaces, vpn_active"
    q["stored_diagnoses"] = f"SELECT {numbers} FROM ({q['fleet_diagnosis']})"
    q["rejected_snapshots"] = """
        SELECT CAST(c_custkey AS VARCHAR) AS host, CASE WHEN c_custkey % 9 = 0 THEN 'malformed JSON' ELSE 'accepted' END AS outcome, 2 AS documents FROM customer"""
    q["probe_addresses"] = """
        SELECT o_custkey AS probe, count(*) AS samples, min(floor(o_totalprice)) AS min_ms, round_even(avg(floor(o_totalprice)), 2) AS avg_ms,
               max(floor(o_totalprice)) AS max_ms, count(DISTINCT o_orderkey % 7) AS addresses,
               string_agg(DISTINCT '10.0.0.' || o_orderkey % 7, ',' ORDER BY '10.0.0.' || o_orderkey % 7) AS listed FROM orders GROUP BY 1"""
    q["live_history"] = _with(
        SAMPLES
        + """, totals AS (SELECT host, ts_ms, CAST(sum(CAST(floor(rx_rate * 1000) AS BIGINT)) AS BIGINT) AS rx,
                                 CAST(sum(CAST(floor(tx_rate * 1000) AS BIGINT)) AS BIGINT) AS tx FROM rates GROUP BY host, ts_ms),
             later AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY ts_ms) AS n FROM totals) WHERE n > 1)""",
        """SELECT host, ts_ms, rx, tx, array_to_string(list(rx) OVER w, ',') AS history_rx, array_to_string(list(tx) OVER w, ',') AS history_tx FROM later
           WINDOW w AS (PARTITION BY host ORDER BY ts_ms ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)""",
    )
    cut = PACKETS + ", cut AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY seq, length, protocol) AS n FROM packets) WHERE n <= 200)"
    q["limited_totals"] = _with(
        cut, "SELECT capture_id, count(*) AS packets, CAST(sum(length) AS BIGINT) AS payload_bytes, count(*) >= 200 AS limited FROM cut GROUP BY 1"
    )
    q["limited_samples"] = _with(cut, "SELECT capture_id, seq, n AS rank FROM cut WHERE n <= 50")
    q["sanitize_events"] = """
        SELECT doc_id, '[REDACTED ' || octet_length(encode(text)) || ' bytes]' AS body, '[REDACTED]' AS cookie, lang AS accept,
               'https://[REDACTED]@h.example/?token=%5BREDACTED%5D&q=' || lang AS url, '[REDACTED]' AS password, CAST(doc_id AS VARCHAR) AS n,
               'HTTP/1.1 200 OK' || chr(10) || 'Set-Cookie: [REDACTED]' || chr(10) || 'Via: ' || lang AS header_text FROM documents"""
    return q
