"""Column functions against the Python standard library as an independent model."""

import ipaddress
import re
from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

import pytest
from pyspark.sql import functions as F

from netlens.functions import address as A
from netlens.functions import labels as L
from netlens.functions import redact as R
from netlens.functions import url as U
from netlens.functions.numbers import half_even

URLS = [
    "https://example.com/",
    "http://User:Pa%20ss@Example.COM:8080/a/b?x=1&token=abc&x=2#frag",
    "https://[::1]:8443/p?q=%7E*~&session_id=9",
    "http://a_b.example.com/c d?k=v w",
    "https://example.org?only=query",
    "https://example.org/%zz?a=%zz%20b&&=v&c",
    "example.com:443",
    "/relative/path?api-key=1&ApiKey=2",
    "data:text/plain,hi?x",
    "wss://host/sock#x#y",
    "file:///etc/hosts",
    "https://h/?a=1;b=2&c=%C3%A9+%2B",
    "https://u@v@w.example/z",
    "https://host:/p",
    "",
    "http://exa mple.com/x",
    "https://x.y/p?q=a=b=c",
]
KEYS = re.compile(r"token|secret|password|passwd|authorization|api[-_]?key|session|cookie|jwt|credential", re.I)


def column(spark, values, name="v"):
    return spark.createDataFrame([(index, value) for index, value in enumerate(values)], f"i int, {name} string")


def evaluate(spark, values, **exprs):
    frame = column(spark, values).select("i", *[expr.alias(name) for name, expr in exprs.items()]).orderBy("i")
    return frame.collect()


def test_url_parts(spark):
    v = F.col("v")
    rows = evaluate(
        spark, URLS, scheme=U.url_scheme(v), host=U.url_host(v), path=U.url_path(v), query=U.url_query(v),
        fragment=U.url_fragment(v), authority=U.url_authority(v), keys=U.query_keys(v),
    )
    for url, row in zip(URLS, rows):
        parts = urlsplit(url)
        assert row.scheme == parts.scheme, url
        assert row.host == parts.hostname, url
        assert row.path == parts.path, url
        assert row.query == parts.query, url
        assert row.fragment == parts.fragment, url
        assert row.authority == parts.netloc, url
        assert row["keys"] == sorted({k for k, _ in parse_qsl(parts.query, keep_blank_values=True)}), url


def test_redact_url(spark):
    for url, row in zip(URLS, evaluate(spark, URLS, out=R.redact_url(F.col("v")))):
        parts = urlsplit(url)
        pairs = [
            (k, "[REDACTED]" if KEYS.search(k) else v) for k, v in parse_qsl(parts.query, keep_blank_values=True)
        ]
        netloc = parts.netloc
        if "@" in netloc:
            netloc = "[REDACTED]@" + netloc.rsplit("@", 1)[1]
        expected = urlunsplit((parts.scheme, netloc, parts.path, urlencode(pairs), parts.fragment))
        assert row.out == expected, url
    assert evaluate(spark, ["http://[::1/x?token=1"], out=R.redact_url(F.col("v")))[0].out == "http://[::1/x?token=1"


def test_redact_headers_and_message(spark):
    row = spark.range(1).select(
        R.redact_headers(F.create_map(*map(F.lit, ["Authorization", "Bearer x", "Accept", "json"]))).alias("h"),
        R.redact_message(F.lit("Token=abc&password=p q " + "x" * 600)).alias("m"),
    ).first()
    assert row.h == {"Authorization": "[REDACTED]", "Accept": "json"}
    assert row.m.startswith("Token=[REDACTED]&password=[REDACTED] q xxx") and len(row.m) == 500


@pytest.mark.parametrize(
    "host,expected",
    [
        ("www.Example.com.", "example.com"), ("a.b.co.uk", "b.co.uk"), ("co.uk", "co.uk"), ("10.0.0.1", "10.0.0.1"),
        ("::1", "::1"), ("localhost", "localhost"), ("", ""), (None, ""), ("a.b.c.d", "c.d"), ("x.com.br", "x.com.br"),
    ],
)
def test_base_domain(spark, host, expected):
    assert evaluate(spark, [host], out=U.base_domain(F.col("v")))[0].out == expected


def test_tracker(spark):
    rows = evaluate(
        spark, ["https://www.Google-Analytics.com/collect", "https://example.com/", "https://x/facebook.com/tr?x"],
        out=U.is_tracker(F.col("v"), F.lit("")),
        domain=U.is_tracker(F.lit("u"), F.col("v")),
        custom=U.is_tracker(F.col("v"), F.lit(""), ["example.com/"]),
    )
    assert [r.out for r in rows] == [True, False, True]
    assert [r.domain for r in rows] == [True, False, True]
    assert [r.custom for r in rows] == [False, True, False]


ADDRESSES = [
    "0.1.2.3", "10.1.2.3", "100.64.0.1", "127.0.0.1", "169.254.9.9", "172.15.0.1", "172.16.0.1", "172.32.0.0",
    "192.0.0.8", "192.0.0.9", "192.0.0.10", "192.0.0.11", "192.0.0.170", "192.0.2.5", "192.168.1.1", "198.17.0.1",
    "198.18.0.1", "198.20.0.1", "203.0.113.9", "224.0.0.251", "239.255.255.250", "240.0.0.1", "255.255.255.255",
    "8.8.8.8", "1.1.1.1", "256.1.1.1", "01.2.3.4", "1.2.3", "host", "*", "localhost", "", "::1", "::", "fe80::1",
    "fe80::1%en0", "fc00::5", "fdff::1", "2001:db8::1", "2606:4700::1111", "ff02::fb", "::ffff:10.0.0.1",
    "::ffff:8.8.8.8", "2001:3::1", "2001:1::1", "2001::1", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1::2::3", ":1", "1:",
    "g::1", "2002::1", "64:ff9b:1::9", "12345::1", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9", ":::",
    "FE80::ABCD", "100::1", "2001:20::1",
]


def test_address_classes(spark):
    v = F.col("v")
    rows = evaluate(
        spark, ADDRESSES, ip=A.is_ip(v), private=A.is_private(v), loop=A.is_loopback(v), link=A.is_link_local(v),
        multi=A.is_multicast(v), near=A.is_local_network(v),
    )
    for text, row in zip(ADDRESSES, rows):
        try:
            ip = ipaddress.ip_address(text.split("%", 1)[0])
        except ValueError:
            assert not row.ip, text
            assert not (row.private or row.loop or row.link or row.multi), text
            assert row.near == (text in ("localhost", "*")), text
            continue
        assert row.ip, text
        assert row.private == ip.is_private, text
        assert row.loop == ip.is_loopback, text
        assert row.link == ip.is_link_local, text
        assert row.multi == ip.is_multicast, text
        assert row.near == (ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_multicast), text


def test_endpoints(spark):
    rows = evaluate(
        spark, ["10.0.0.2:443", "[fe80::1]:5353", "host", "*:*", "[::1]", "h:", "a:b:c", "[x"],
        out=A.parse_endpoint(F.col("v")), text=A.endpoint_text(A.parse_endpoint(F.col("v"))),
        proxy=A.parse_host_port(F.col("v"), F.lit(80)),
    )
    assert [(r.out.host, r.out.port) for r in rows] == [
        ("10.0.0.2", "443"), ("fe80::1", "5353"), ("host", None), ("*", "*"), ("::1", None), ("h", None),
        ("a:b", "c"), ("[x", None),
    ]
    assert [r.text for r in rows][:4] == ["10.0.0.2:443", "[fe80::1]:5353", "host", "*:*"]
    assert (rows[0].proxy.host, rows[0].proxy.port) == ("10.0.0.2", 443)
    assert (rows[1].proxy.host, rows[1].proxy.port) == ("fe80::1", 5353)
    assert (rows[6].proxy.host, rows[6].proxy.port) == ("a:b:c", 80)


def test_decode_and_labels(spark):
    rows = evaluate(spark, ["Chrome\\x20", "a\\xe9b\\x41", "plain", "\\xzz"], out=A.decode_escapes(F.col("v")))
    assert [r.out for r in rows] == ["Chrome ", "aébA", "plain", "\\xzz"]
    row = spark.range(1).select(
        L.score_class(F.lit(85)).alias("a"), L.score_class(F.lit(60)).alias("b"), L.score_class(F.lit(59)).alias("c"),
        L.status_class(F.lit(False), F.lit(404)).alias("d"), L.status_class(F.lit(False), F.lit(0)).alias("e"),
        L.status_class(F.lit(False), F.lit(301)).alias("f"), L.status_class(F.lit(False), F.lit(101)).alias("g"),
        L.iso_millis(F.lit(1767225600.02)).alias("iso"), L.compression_ratio(F.lit(1000), F.lit(500)).alias("ratio"),
        L.days_between(F.lit(0.0), F.lit(129600.0)).alias("days"),
    ).first()
    assert row[:7] == ("good", "warn", "bad", "status-bad", "status-muted", "status-ok", "status-warn")
    assert row.iso == "2026-01-01T00:00:00.020+00:00" and row.ratio == 2.0 and row.days == 1.5


def test_connection_path(spark):
    cases = [
        ("127.0.0.1", "8.8.8.8", True, "loopback"), ("10.0.0.2", "192.168.1.1", True, "local-network"),
        ("10.0.0.2", "1.1.1.1", True, "vpn-default"), ("10.0.0.2", "1.1.1.1", False, "direct"),
        ("*", None, True, "direct"), ("h", "localhost", False, "local-network"), ("h", "::1", False, "loopback"),
    ]
    frame = spark.createDataFrame(cases, "l string, r string, vpn boolean, want string")
    got = frame.select(A.connection_path(F.col("l"), F.col("r"), F.col("vpn")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got), got


def test_rounding_by_the_binary_value(spark):
    """All three-decimal ties below 40, their negatives and neighbours, and large, tiny and odd numbers round as Python rounds them."""
    import math
    import random

    rng = random.Random(1)
    values = [n / 1000 for n in range(5, 40_000, 10)] + [0.125, 0.375, 2.5, 1e13 + 0.005, 12345678.125, 5e-324, 1e-9, 0.0, 1e300]
    values += [math.nextafter(v, 1e9) for v in values[:500]] + [math.nextafter(v, -1e9) for v in values[:500]]
    values += [rng.uniform(0, 10 ** rng.randint(-3, 12)) for _ in range(2000)]
    values += [-v for v in values]
    frame = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),), (float("inf"),)], "v double")
    found = frame.select("v", half_even(F.col("v"), 2).alias("two"), half_even(F.col("v"), 1).alias("one")).collect()
    for row in found[: len(values)]:
        assert (row.two, row.one) == (round(row.v, 2), round(row.v, 1)), row.v
    assert found[-3].two is None and math.isnan(found[-2].two) and found[-1].two == float("inf")
