"""Endpoints, IP address classes and connection paths."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Networks that are not public, and the public islands inside them.
PRIVATE_V4 = (
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24",
    "192.0.0.170/31", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24",
    "203.0.113.0/24", "240.0.0.0/4", "255.255.255.255/32",
)
PUBLIC_V4 = ("192.0.0.9/32", "192.0.0.10/32")
PRIVATE_V6 = (
    "::1/128", "::/128", "::ffff:0:0/96", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32",
    "2002::/16", "3fff::/20", "fc00::/7", "fe80::/10",
)
PUBLIC_V6 = (
    "2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28",
)
LOOPBACK = ("127.0.0.0/8", "::1/128")
LINK_LOCAL = ("169.254.0.0/16", "fe80::/10")
MULTICAST = ("224.0.0.0/4", "ff00::/8")

# Interface-name prefixes. The three rules differ on purpose.
VPN_INTERFACE_PREFIXES = ("utun", "tun", "tap", "ppp", "ipsec", "wg")
VPN_ROUTE_PREFIXES = ("utun", "tun", "ppp", "wg")

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_V4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"


def without_zone(address: Column) -> Column:
    return F.substring_index(address, "%", 1)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value computed once; keeps deeply shared expressions small."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ipv4_number(address: Column) -> Column:
    """The address as an integer; NULL unless it is dotted IPv4."""
    parts = F.split(address, r"\.")
    number = F.lit(0).cast("bigint")
    for index in range(4):
        number = number * F.lit(256) + F.get(parts, F.lit(index)).try_cast("bigint")
    return F.when(address.rlike(_V4), number)


def _with_hex_tail(address: Column) -> Column:
    """Lower-case text whose dotted tail, if any, is written as two hex groups."""
    tail = F.regexp_extract(address, r":([0-9]+\.[0-9.]+)$", 1)

    def spliced(number: Column) -> Column:
        low = F.lower(F.lpad(F.hex(number), 8, "0"))
        groups = F.concat(F.substring(low, 1, 4), F.lit(":"), F.substring(low, 5, 4))
        return F.when(number.isNull(), address).otherwise(F.regexp_replace(address, r"[0-9]+\.[0-9.]+$", groups))

    return F.lower(bind(ipv4_number(tail), spliced))


def ipv6_hex(address: Column) -> Column:
    """The address as 32 hex digits, so that a network is a string range; NULL unless it is IPv6."""

    def groups(side: Column) -> Column:
        return F.filter(F.split(F.coalesce(side, F.lit("")), ":"), lambda item: item != "")

    def expand(text: Column) -> Column:
        sides = F.split(text, "::")
        parts = F.struct(
            groups(F.get(sides, F.lit(0))).alias("head"),
            groups(F.get(sides, F.lit(1))).alias("rest"),
            F.size(sides).alias("sides"),
        )

        def digits(part: Column) -> Column:
            missing = F.lit(8) - F.size(part["head"]) - F.size(part["rest"])
            filled = F.array_join(
                F.transform(
                    F.concat(
                        part["head"], F.array_repeat(F.lit("0"), F.greatest(F.lit(0), missing)), part["rest"]
                    ),
                    lambda item: F.lpad(item, 4, "0"),
                ),
                "",
            )
            gapped = (part["sides"] == 2) & (missing >= 1) & ~text.rlike(r":::|^:[^:]|[^:]:$")
            full = (part["sides"] == 1) & (missing == 0) & ~text.rlike(r"^:|:$")
            return F.when(gapped | full, filled)

        return F.when(text.rlike(r"^[0-9a-f]{0,4}(?::[0-9a-f]{0,4})+$"), bind(parts, digits))

    return F.when(address.contains(":"), bind(_with_hex_tail(address), expand))


def ip_numbers(address: Column) -> Column:
    """(v4, v6) struct: the IPv4 number, also of an IPv4-mapped address, or the 32 hex digits."""

    def split_kinds(digits: Column) -> Column:
        mapped = F.when(
            digits.startswith("0" * 20 + "ffff"), F.conv(F.substring(digits, 25, 8), 16, 10).cast("bigint")
        )
        return F.struct(
            F.coalesce(ipv4_number(without_zone(address)), mapped).alias("v4"),
            F.when(mapped.isNull(), digits).alias("v6"),
        )

    return bind(ipv6_hex(without_zone(address)), split_kinds)


def _inside(numbers: Column, networks: Sequence[str]) -> Column:
    result = F.lit(False)
    for text in networks:
        network = ipaddress.ip_network(text)
        low, high = int(network.network_address), int(network.broadcast_address)
        hit = (
            numbers["v4"].between(low, high)
            if network.version == 4
            else numbers["v6"].between(f"{low:032x}", f"{high:032x}")
        )
        result = result | F.coalesce(hit, F.lit(False))
    return result


def _private(numbers: Column) -> Column:
    return _inside(numbers, PRIVATE_V4 + PRIVATE_V6) & ~_inside(numbers, PUBLIC_V4 + PUBLIC_V6)


def is_private(address: Column) -> Column:
    return bind(ip_numbers(address), _private)


def is_loopback(address: Column) -> Column:
    return bind(ip_numbers(address), lambda numbers: _inside(numbers, LOOPBACK))


def is_link_local(address: Column) -> Column:
    return bind(ip_numbers(address), lambda numbers: _inside(numbers, LINK_LOCAL))


def is_multicast(address: Column) -> Column:
    return bind(ip_numbers(address), lambda numbers: _inside(numbers, MULTICAST))


def is_ip(address: Column) -> Column:
    return bind(ip_numbers(address), lambda numbers: numbers["v4"].isNotNull() | numbers["v6"].isNotNull())


def is_local_network(address: Column) -> Column:
    """Private, loopback, link-local or multicast addresses, and the two names that mean this host."""
    near = bind(
        ip_numbers(address),
        lambda numbers: _private(numbers) | _inside(numbers, LOOPBACK + LINK_LOCAL + MULTICAST),
    )
    return F.coalesce(address.isin("localhost", "*") | near, F.lit(False))


def starts_with_any(name: Column, prefixes: Sequence[str]) -> Column:
    return name.rlike("^(?:" + "|".join(prefixes) + ")")


def is_vpn_interface(name: Column) -> Column:
    return starts_with_any(F.lower(name), VPN_INTERFACE_PREFIXES)


def parse_endpoint(value: Column) -> Column:
    """``[v6]:port``, ``host:port`` or ``host`` as a (host, port) struct; an empty port is NULL."""
    text = F.trim(value)
    bracket = text.rlike(r"^\[.*\]")
    host = (
        F.when(bracket, F.regexp_extract(text, r"^\[(.*)\]", 1))
        .when(text.contains(":"), F.regexp_extract(text, r"^(.*):[^:]*$", 1))
        .otherwise(text)
    )
    port = F.when(bracket, F.regexp_extract(text, r"^\[.*\]:(.*)$", 1)).when(
        text.contains(":"), F.regexp_extract(text, r":([^:]*)$", 1)
    )
    return F.struct(host.alias("host"), F.nullif(port, F.lit("")).alias("port"))


def parse_host_port(value: Column, default_port: Column) -> Column:
    """Proxy target: only a single ``:`` separates a port; several mean a bare IPv6 host."""
    text = F.trim(value)
    bracket = text.startswith("[")
    single = F.length(text) - F.length(F.replace(text, F.lit(":"))) == 1
    host = (
        F.when(bracket, F.regexp_extract(text, r"^\[([^\]]*)", 1))
        .when(single, F.substring_index(text, ":", 1))
        .otherwise(text)
    )
    port = F.when(bracket, F.regexp_extract(text, r"^\[[^\]]*\]:([0-9]+)$", 1)).when(
        single, F.substring_index(text, ":", -1)
    )
    return F.struct(host.alias("host"), F.coalesce(port.try_cast("int"), default_port).alias("port"))


def endpoint_text(endpoint: Column) -> Column:
    """``host:port`` with brackets around IPv6; the bare host without a port."""
    host, port = endpoint["host"], endpoint["port"]
    bracketed = F.concat(F.lit("["), host, F.lit("]:"), port)
    return (
        F.when(port.isNull(), host)
        .when(host.contains(":") & ~host.startswith("["), bracketed)
        .otherwise(F.concat(host, F.lit(":"), port))
    )


def connection_key(pid: Column, fd: Column, protocol: Column, local: Column, remote: Column) -> Column:
    return F.concat_ws(
        "|", pid.cast("string"), fd, protocol, endpoint_text(local), F.coalesce(endpoint_text(remote), F.lit(""))
    )


def connection_path(local_host: Column, remote_host: Column, vpn_default: Column) -> Column:
    """loopback, then local-network, then vpn-default for remote sockets, else direct."""
    here = ("127.0.0.1", "::1")
    loop = local_host.isin(*here) | F.coalesce(remote_host.isin(*here), F.lit(False))
    near = F.coalesce(is_local_network(remote_host), F.lit(False))
    return (
        F.when(loop, "loopback")
        .when(near, "local-network")
        .when(remote_host.isNotNull() & F.coalesce(vpn_default, F.lit(False)), "vpn-default")
        .otherwise("direct")
    )


def decode_escapes(value: Column) -> Column:
    """``\\xNN`` escapes as Latin-1 characters."""
    escape = r"\\x([0-9a-fA-F]{2})"
    pieces = F.split(value, escape, -1)
    chars = F.transform(
        F.regexp_extract_all(value, F.lit(escape), F.lit(1)),
        lambda code: F.char(F.conv(code, 16, 10).cast("bigint")),
    )
    joined = F.array_join(
        F.zip_with(pieces, chars, lambda piece, char: F.concat(piece, F.coalesce(char, F.lit("")))), ""
    )
    return F.when(value.contains("\\x"), joined).otherwise(value)
