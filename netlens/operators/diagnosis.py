"""Host diagnosis: VPN status, leak rules, local configuration rules and score.

Every rule reads one row per host; the tables are first reduced to that row. Fixed values: codes,
titles, texts, thresholds and weights.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlens.functions import address as A

ANY_ADDRESS = ("*", "0.0.0.0", "::")
LISTENER_SAMPLE = 8
CLOSED_LIMIT = 50
WEIGHTS = {"critical": 30, "warning": 12}


def _finding(severity: object, code: str, title: object, detail: object, recommendation: str = "") -> Column:
    def text(value: object) -> Column:
        return F.lit(value) if isinstance(value, str) else value

    return F.struct(
        text(severity).alias("severity"), F.lit(code).alias("code"), text(title).alias("title"),
        F.coalesce(text(detail), F.lit("")).alias("detail"), F.lit(recommendation).alias("recommendation"),
    )


def is_active_interface() -> Column:
    up = F.array_contains("flags", "UP") & (F.size("ipv4") > 0)
    return F.coalesce(F.col("status") == "active", F.lit(False)) | F.coalesce(up, F.lit(False))


def is_public_listener() -> Column:
    return (F.col("state") == "LISTEN") & F.col("local.host").isin(*ANY_ADDRESS)


def vpn_status(interfaces: DataFrame, routes: DataFrame) -> DataFrame:
    """Per host: tunnel up, default route through a tunnel, and the two warnings."""
    up = A.is_vpn_interface(F.col("name")) & F.coalesce(F.array_contains("flags", "UP"), F.lit(False))
    tunnels = interfaces.groupBy("host").agg(
        F.bool_or(up).alias("active"), F.bool_or(up & (F.size("ipv4") > 0)).alias("addressed")
    )
    through = (F.col("destination") == "default") & A.starts_with_any(F.col("interface"), A.VPN_ROUTE_PREFIXES)
    defaults = routes.groupBy("host").agg(F.bool_or(through).alias("full_tunnel_likely"))
    no = F.lit(False)
    joined = tunnels.join(defaults, "host", "full_outer").select(
        "host", F.coalesce("active", no).alias("active"), F.coalesce("full_tunnel_likely", no).alias("full_tunnel_likely"),
        F.coalesce("addressed", no).alias("addressed"),
    )
    warnings = F.array_compact(
        F.array(
            F.when(
                F.col("active") & ~F.col("full_tunnel_likely"),
                F.lit("VPN interfaces exist, but the IPv4 default route does not use them (split tunnel or idle tunnel)."),
            ),
            F.when(
                F.col("full_tunnel_likely") & ~F.col("addressed"),
                F.lit("The VPN default route is active, but its interface has no visible IPv4 address."),
            ),
        )
    )
    return joined.select("host", "active", "full_tunnel_likely", warnings.alias("warnings"))


def dns_routes(servers: DataFrame, server_routes: DataFrame) -> DataFrame:
    """Each DNS server of a host with the interface it is reached through, else ``unknown``."""
    return servers.join(server_routes, ["host", "server"], "left").select(
        "host", "server", F.coalesce("interface", F.lit("unknown")).alias("interface")
    )


def leak_findings(vpn: DataFrame, dns: DataFrame, ipv6_routes: DataFrame) -> DataFrame:
    """Route-level leak findings, one row each: (host, position, severity, code, ...)."""
    full = vpn.select("host", "full_tunnel_likely")
    outside = ~A.starts_with_any(F.col("interface"), A.VPN_INTERFACE_PREFIXES)
    severity = F.when(A.is_private(F.col("server")), "warning").otherwise("critical")
    bypass = F.concat(
        F.lit("Resolver "), F.col("server"), F.lit(" is reached through "), F.col("interface"),
        F.lit(", not a detected tunnel interface."),
    )
    by_dns = (
        dns.join(full, "host")
        .where(F.col("full_tunnel_likely") & (F.col("interface") != "unknown") & outside)
        .select(
            "host", F.lit(1).alias("position"), F.col("server").alias("subject"),
            F.inline(F.array(_finding(
                severity, "dns-outside-vpn", "DNS route may bypass the VPN", bypass,
                "Enable the VPN DNS option or block DNS on physical interfaces.",
            ))),
        )
    )
    by_route = (
        ipv6_routes.where(F.col("destination").isin("default", "::/0") & (F.col("interface") != "") & outside)
        .join(full, "host")
        .where("full_tunnel_likely")
        .select(
            "host", F.lit(2).alias("position"), F.col("interface").alias("subject"),
            F.inline(F.array(_finding(
                "warning", "ipv6-outside-vpn", "IPv6 default route may bypass the VPN",
                F.concat(F.lit("IPv6 default route uses "), F.col("interface"), F.lit(".")),
                "Route IPv6 through the tunnel or disable IPv6 while using the VPN.",
            ))),
        )
    )
    leaks = by_dns.unionByName(by_route)
    counted = leaks.groupBy("host").agg(F.count("*").alias("_leaks"))
    status = F.when(
        ~F.col("active"),
        _finding("info", "vpn-not-active", "No active VPN detected", "Traffic appears to use physical interfaces."),
    ).when(
        F.col("_leaks").isNull(),
        _finding(
            "ok", "no-obvious-leaks", "No obvious route-level leaks detected",
            "DNS and default-route checks did not find a bypass.",
        ),
    )
    verdict = (
        vpn.join(counted, "host", "left")
        .select("host", F.lit(3).alias("position"), F.lit("").alias("subject"), F.inline(F.array_compact(F.array(status))))
    )
    return leaks.unionByName(verdict)


def host_facts(
    hosts: DataFrame, connections: DataFrame, interfaces: DataFrame, routes: DataFrame, servers: DataFrame,
    vpn: DataFrame, proxies: DataFrame, quality: DataFrame,
) -> DataFrame:
    """One row per host with everything the rules read.

    ``proxies`` has (host, proxy) with ``proxy`` as JSON text; ``quality`` has (host, quality_score).
    Samples are the first few rows by position, picked before they are listed.
    """
    from netlens.operators.skew import top_per_group

    listeners = connections.where(is_public_listener())
    sample = (
        top_per_group(listeners, ["host"], [F.asc("pos")], LISTENER_SAMPLE)
        .groupBy("host")
        .agg(F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(":", "process", "local.port").alias("text")))).alias("_s"))
        .select("host", F.array_join(F.transform("_s", lambda item: item["text"]), ", ").alias("listener_sample"))
    )
    sockets = connections.groupBy("host").agg(
        F.count("*").alias("connections"),
        F.count_if(F.col("remote").isNotNull()).alias("remote_connections"),
        F.count_if(is_public_listener()).alias("public_listeners"),
        F.count_if(F.col("state") == "CLOSED").alias("closed_sockets"),
    )
    ports = interfaces.groupBy("host").agg(
        F.count("*").alias("interfaces"), F.count_if(is_active_interface()).alias("active_interfaces")
    )
    defaults = (
        routes.where(F.col("destination") == "default")
        .groupBy("host")
        .agg(
            F.count("*").alias("default_routes"),
            F.array_sort(F.collect_list(F.struct("pos", F.concat_ws("→", "interface", "gateway").alias("text")))).alias("_d"),
        )
        .select("host", "default_routes", F.array_join(F.transform("_d", lambda item: item["text"]), ", ").alias("default_text"))
    )
    named = servers.groupBy("host").agg(F.countDistinct("server").alias("dns_servers"))
    wide = hosts
    for part in (
        sockets, sample, ports, defaults, named, vpn.select("host", F.col("active").alias("vpn_active")), proxies, quality,
    ):
        wide = wide.join(part, "host", "left")
    counts = (
        "connections", "remote_connections", "public_listeners", "closed_sockets", "interfaces", "active_interfaces",
        "default_routes", "dns_servers",
    )
    return wide.fillna(0, list(counts)).withColumn("vpn_active", F.coalesce("vpn_active", F.lit(False)))


def document_facts(snapshots: DataFrame) -> DataFrame:
    """The same row per host, straight from parsed snapshot documents.

    A document holds all tables of its host, so nothing has to be shuffled; its arrays are as long
    as one host's tables. ``servers`` lists the distinct DNS servers.
    """
    empty = lambda name, kind: F.coalesce(name, F.array().cast(kind))
    kinds = dict(snapshots.dtypes)
    tables = snapshots.select(
        "host", "snapshot_no",
        *[empty(name, kinds[name]).alias(name) for name in ("connections", "interfaces", "routes", "dns")],
        F.to_json("proxy").alias("proxy"), F.col("quality.score").alias("quality_score"),
    )
    public = lambda c: (c["state"] == "LISTEN") & c["local"]["host"].isin(*ANY_ADDRESS)
    up = lambda i: F.coalesce(F.array_contains(i["flags"], "UP"), F.lit(False))
    addressed = lambda i: F.coalesce(F.size(i["ipv4"]) > 0, F.lit(False))
    tunnel = lambda i: A.is_vpn_interface(i["name"]) & up(i)
    picked = tables.select(
        "*",
        F.filter("connections", public).alias("_public"),
        F.filter("routes", lambda r: r["destination"] == "default").alias("_defaults"),
        F.filter("interfaces", tunnel).alias("_tunnels"),
        F.array_distinct(F.flatten(F.transform("dns", lambda d: d["nameservers"]))).alias("servers"),
    )

    def count(name: str, test=None) -> Column:
        return F.size(F.filter(name, test) if test else F.col(name)).cast("bigint")

    sample = F.transform(
        F.slice("_public", 1, LISTENER_SAMPLE), lambda c: F.concat_ws(":", c["process"], c["local"]["port"])
    )
    return picked.select(
        "host",
        count("connections").alias("connections"),
        count("connections", lambda c: c["remote"].isNotNull()).alias("remote_connections"),
        count("_public").alias("public_listeners"),
        count("connections", lambda c: c["state"] == "CLOSED").alias("closed_sockets"),
        F.array_join(sample, ", ").alias("listener_sample"),
        count("interfaces").alias("interfaces"),
        count("interfaces", lambda i: F.coalesce(i["status"] == "active", F.lit(False)) | (up(i) & addressed(i))).alias(
            "active_interfaces"
        ),
        count("_defaults").alias("default_routes"),
        F.array_join(F.transform("_defaults", lambda r: F.concat_ws("→", r["interface"], r["gateway"])), ", ").alias(
            "default_text"
        ),
        F.size("servers").cast("bigint").alias("dns_servers"),
        (F.size("_tunnels") > 0).alias("vpn_active"),
        F.exists("_defaults", lambda r: A.starts_with_any(r["interface"], A.VPN_ROUTE_PREFIXES)).alias("full_tunnel_likely"),
        "servers", "proxy", "quality_score",
    )


def local_rules() -> tuple[list[Column], list[Column], list[Column]]:
    """Rules before the leak findings, the proxy rule, and the rules after the all-clear."""
    c = F.col
    first = [
        F.when(c("active_interfaces") == 0, _finding(
            "critical", "no-active-interface", "No active IP interface",
            "No active interface with an IPv4 address was found.")),
        F.when(c("dns_servers") == 0, _finding(
            "critical", "no-dns", "No DNS resolver detected", "The host did not expose a usable resolver.")),
        F.when(c("default_routes") > 1, _finding(
            "info", "multiple-default-routes", "Multiple IPv4 default routes", c("default_text"),
            "This is normal with many VPNs; verify priority if traffic uses the wrong path.")),
        F.when(c("public_listeners") > 0, _finding(
            "warning", "public-listeners",
            F.concat(c("public_listeners").cast("string"), F.lit(" services listen on all interfaces")), c("listener_sample"),
            "Confirm that each service is expected and protected by the firewall.")),
        F.when(c("closed_sockets") > CLOSED_LIMIT, _finding(
            "info", "many-closed-sockets", "Many recently closed sockets",
            F.concat(F.lit("The listing reports "), c("closed_sockets").cast("string"),
                     F.lit(" CLOSED sockets; this may indicate high connection churn.")))),
    ]
    proxy = [
        F.when(c("proxy").isNotNull() & ~c("proxy").isin("", "{}"), _finding(
            "info", "system-proxy", "System proxy configuration is active", c("proxy"))),
    ]
    score = F.concat(F.lit("Active quality score: "), c("quality_score").cast("string"), F.lit("/100."))
    after = [
        F.when(c("quality_score") < 50, _finding("critical", "quality-poor", "Poor active network quality", score))
        .when(c("quality_score") < 75, _finding(
            "warning", "quality-degraded", "Degraded active network quality", score)),
    ]
    return first, proxy, after


# Report order of the rule blocks.
LOCAL_RANK, LEAK_RANK, PROXY_RANK, CLEAN_RANK, QUALITY_RANK = 0, 100, 200, 300, 400


def diagnosis_findings(facts: DataFrame, leaks: DataFrame) -> DataFrame:
    """All findings of a host in report order (host, position, finding columns).

    Leak findings count only while a VPN is active, and only warnings and worse.
    """
    first, proxy, after = local_rules()
    serious = leaks.where(~F.col("severity").isin("ok", "info")).join(
        facts.where("vpn_active").select("host"), "host", "left_semi"
    )
    leaking = serious.groupBy("host").agg(F.count("*").alias("_leaks"))
    early = F.concat(_ranked(first, LOCAL_RANK), _ranked(proxy, PROXY_RANK))
    clean = _ranked([
        _finding(
            "ok", "baseline-clean", "No obvious local configuration problems",
            "Interfaces, routes and DNS configuration look internally consistent.",
        )
    ], CLEAN_RANK)
    listed = F.concat(F.when((F.size(early) == 0) & F.col("_leaks").isNull(), clean).otherwise(early), _ranked(after, QUALITY_RANK))
    local = (
        facts.join(leaking, "host", "left")
        .select("host", F.explode(listed).alias("_r"))
        .select("host", F.col("_r.position").alias("position"), F.lit("").alias("subject"), "_r.finding.*")
    )
    return local.unionByName(serious.withColumn("position", F.col("position") + LEAK_RANK))


def _ranked(findings: list[Column], rank: int) -> Column:
    """The findings of a rule block that are not NULL, each with its place in the report."""
    placed = [F.when(f.isNotNull(), F.struct(F.lit(rank + i).alias("position"), f.alias("finding"))) for i, f in enumerate(findings)]
    return F.array_compact(F.array(*placed))


def diagnosis_scores(hosts: DataFrame, findings: DataFrame) -> DataFrame:
    """100 minus the weights of a host's findings, never below 0."""
    weight = F.coalesce(*[F.when(F.col("severity") == name, value) for name, value in WEIGHTS.items()], F.lit(0))
    lost = findings.groupBy("host").agg(F.sum(weight).alias("_lost"), F.count("*").alias("findings"))
    zero = F.lit(0).cast("bigint")
    return hosts.join(lost, "host", "left").select(
        "host", F.greatest(zero, F.lit(100) - F.coalesce("_lost", zero)).alias("score"),
        F.coalesce("findings", zero).alias("findings"),
    )


# --- one document, one row: diagnosis of every snapshot of every host -----------------------------


def diagnose(documents: DataFrame) -> DataFrame:
    """(host, snapshot_no, score, summary, findings, leaks, dns_routes, ipv6_default_routes) of parsed snapshot documents.

    A snapshot document holds all tables of its host at one time, so every rule reads the arrays of its own row: nothing
    is joined or shuffled, and two snapshots of a host give two scores. ``findings`` and ``leaks`` are in report order;
    ``leaks`` is the route audit, of which only warnings and worse count in the diagnosis, and only while a VPN is active.
    Missing tables read as empty. A resolver without servers is a resolver.
    """
    empty = lambda name, kind: F.coalesce(name, F.array().cast(kind)).alias(name)
    kinds = dict(documents.dtypes)
    arrays = ("connections", "interfaces", "routes", "dns", "dns_routes", "ipv6_routes")
    tables = documents.select(
        "host", "snapshot_no", *[empty(name, kinds[name]) for name in arrays], F.to_json("proxy").alias("proxy"), F.col("quality.score").alias("quality_score")
    )
    up = lambda i: F.coalesce(F.array_contains(i["flags"], "UP"), F.lit(False))
    addressed = lambda i: F.coalesce(F.size(i["ipv4"]) > 0, F.lit(False))
    active = lambda i: F.coalesce(i["status"] == "active", F.lit(False)) | (up(i) & addressed(i))
    picked = tables.select(
        "*",
        F.filter("connections", lambda c: (c["state"] == "LISTEN") & c["local"]["host"].isin(*ANY_ADDRESS)).alias("_public"),
        F.filter("routes", lambda r: r["destination"] == "default").alias("_defaults"),
        F.exists("interfaces", lambda i: A.is_vpn_interface(i["name"]) & up(i)).alias("vpn_active"),
        F.transform(F.filter("interfaces", active), lambda i: i["name"]).alias("_active"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("dns", lambda d: F.coalesce(d["nameservers"], F.array().cast("array<string>")))))).alias("_servers"),
    )
    facts = picked.select(
        "*",
        F.size("_active").alias("active_interfaces"),
        F.size("dns").alias("dns_servers"),  # the rule asks for resolvers, whatever servers they name
        F.size("_defaults").alias("default_routes"),
        F.array_join(F.transform("_defaults", lambda r: F.concat_ws("→", r["interface"], r["gateway"])), ", ").alias("default_text"),
        F.size("_public").alias("public_listeners"),
        F.array_join(
            F.transform(F.slice("_public", 1, LISTENER_SAMPLE), lambda c: F.concat_ws(":", c["process"], c["local"]["port"])), ", "
        ).alias("listener_sample"),
        F.size(F.filter("connections", lambda c: c["state"] == "CLOSED")).cast("bigint").alias("closed_sockets"),
        F.exists("_defaults", lambda r: A.starts_with_any(r["interface"], A.VPN_ROUTE_PREFIXES)).alias("full_tunnel_likely"),
    )
    audited = facts.select("*", F.explode(F.array(_leak_array())).alias("leaks"))  # pinned: read twice below
    first, proxy, after = local_rules()
    serious = F.filter("leaks", lambda item: ~item["severity"].isin("ok", "info"))
    early = F.concat(F.array_compact(F.array(*first)), F.when(F.col("vpn_active"), serious).otherwise(F.slice("leaks", 1, 0)), F.array_compact(F.array(*proxy)))
    clean = _finding(
        "ok", "baseline-clean", "No obvious local configuration problems", "Interfaces, routes and DNS configuration look internally consistent."
    )
    found = audited.select("*", F.explode(F.array(early)).alias("_early"))
    listed = F.concat(F.when(F.size("_early") > 0, F.col("_early")).otherwise(F.array(clean)), F.array_compact(F.array(*after)))
    complete = found.select("*", F.explode(F.array(listed)).alias("findings"))
    weight = lambda item: F.coalesce(*[F.when(item["severity"] == name, value) for name, value in WEIGHTS.items()], F.lit(0))
    lost = F.aggregate("findings", F.lit(0), lambda total, item: total + weight(item))
    summary = F.struct(
        F.size("connections").alias("connections"), F.size(F.filter("connections", lambda c: c["remote"].isNotNull())).alias("remote_connections"),
        F.size("interfaces").alias("interfaces"), F.col("_active").alias("active_interfaces"), F.col("_servers").alias("dns_servers"), "vpn_active",
        F.col("_defaults").alias("default_routes"),
    )
    return complete.select(
        "host", "snapshot_no", F.greatest(F.lit(0), F.lit(100) - lost).alias("score"), summary.alias("summary"), "findings", "leaks", "dns_routes",
        F.filter("ipv6_routes", lambda r: r["destination"].isin("default", "::/0")).alias("ipv6_default_routes"),
    )


def _leak_array() -> Column:
    """The route audit of a row: DNS servers and IPv6 default routes outside a full tunnel, else why there are none."""
    outside = lambda r: ~A.starts_with_any(r["interface"], A.VPN_INTERFACE_PREFIXES)
    asked = F.filter(
        "dns_routes", lambda r: F.col("full_tunnel_likely") & F.array_contains("_servers", r["server"]) & (F.coalesce(r["interface"], F.lit("unknown")) != "unknown") & outside(r)
    )
    by_dns = F.transform(asked, lambda r: _finding(
        F.when(A.is_private(r["server"]), "warning").otherwise("critical"), "dns-outside-vpn", "DNS route may bypass the VPN",
        F.concat(F.lit("Resolver "), r["server"], F.lit(" is reached through "), r["interface"], F.lit(", not a detected tunnel interface.")),
        "Enable the VPN DNS option or block DNS on physical interfaces.",
    ))
    ways = F.filter(
        "ipv6_routes", lambda r: F.col("full_tunnel_likely") & r["destination"].isin("default", "::/0") & (F.coalesce(r["interface"], F.lit("")) != "") & outside(r)
    )
    by_route = F.transform(ways, lambda r: _finding(
        "warning", "ipv6-outside-vpn", "IPv6 default route may bypass the VPN", F.concat(F.lit("IPv6 default route uses "), r["interface"], F.lit(".")),
        "Route IPv6 through the tunnel or disable IPv6 while using the VPN.",
    ))
    verdict = F.when(
        ~F.col("vpn_active"), F.array(_finding("info", "vpn-not-active", "No active VPN detected", "Traffic appears to use physical interfaces."))
    ).when(
        (F.size(by_dns) == 0) & (F.size(by_route) == 0),
        F.array(_finding("ok", "no-obvious-leaks", "No obvious route-level leaks detected", "DNS and default-route checks did not find a bypass.")),
    ).otherwise(F.array_compact(F.array(F.when(F.lit(False), _finding("", "", "", "")))))
    return F.concat(by_dns, by_route, verdict)


def listed(diagnoses: DataFrame, name: str = "findings") -> DataFrame:
    """The findings (or ``leaks``) of diagnoses as rows with their place in the report, from 1."""
    rows = diagnoses.select("host", "snapshot_no", F.posexplode(name).alias("position", "_f"))
    return rows.select("host", "snapshot_no", (F.col("position") + 1).alias("position"), "_f.*")
