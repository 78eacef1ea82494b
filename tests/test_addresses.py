"""Addresses as browsers read them."""

import pytest
from pyspark.sql import functions as F

from kalendry.functions import addresses as ad


def values(spark, rows, schema, column):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema)
    return [r[1] for r in sorted(df.select("i", column).collect())]


NORMAL = {
    "https://Example.ORG/Dates/#section": "https://example.org/Dates", "https://example.org/": "https://example.org/", "http://a.org:80/x": "http://a.org/x", "https://a.org:443": "https://a.org/",
    "https://a.org:8443/": "https://a.org:8443/", "http://a.org/b/../c/./d": "http://a.org/c/d", "http://a.org/../../x/..": "http://a.org/", "http://a.org/a/%2e%2E/b": "http://a.org/b",
    "http://a.org/a b?q=x y#z": "http://a.org/a%20b?q=x%20y", "http://a.org/é": "http://a.org/%C3%A9", "http://a.org/%7e/%c3": "http://a.org/%7e/%c3", "http://u:p@A.org:081/": "http://u:p@a.org:81/",
    "HTTP:\\\\a.org\\x\\y": "http://a.org/x/y", "http://0x7f.1/": "http://127.0.0.1/", "http://2130706433/x/": "http://127.0.0.1/x", "  http://a.org/\n x ": "http://a.org/%20x", "http://a.org?x=/": "http://a.org/?x=/",
    "http://a.org/x/?y=1/": "http://a.org/x/?y=1", "http://[::1]:80/a": "http://[::1]/a", "http://a.org//b//": "http://a.org//b/", "http://a b.org/": None, "http://": None, "not a url": None, "http://a.org:99999/": None,
    "http://1.2.3.4/5": "http://1.2.3.4/5", "http://256.1.1.1/": None, "mailto:x@y": None, None: None,
}


def test_normal(spark):
    assert dict(zip(NORMAL, values(spark, [(u,) for u in NORMAL], "u string", ad.normal(F.col("u"))), strict=True)) == NORMAL


@pytest.mark.parametrize(
    ("base", "pairs"),
    [
        ("http://a/b/c/d;p?q", {"g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g/", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q#s",
          "": "http://a/b/c/d;p?q", ".": "http://a/b/c/", "..": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/", "../../../g": "http://a/g", "/./g": "http://a/g", "g.": "http://a/b/c/g.", "..g": "http://a/b/c/..g",
          "./../g": "http://a/b/g", "g/./h": "http://a/b/c/g/h", "g/../h": "http://a/b/c/h", "https://x.org/../y": "https://x.org/y", " g ": "http://a/b/c/g", "mailto:a@b": None}),
        ("https://Conf.org:443", {"dates": "https://conf.org/dates", "?x": "https://conf.org/?x", "\\y": "https://conf.org/y"}),
    ],
)
def test_resolved(spark, base, pairs):
    got = values(spark, [(h, base) for h in pairs], "h string, b string", ad.resolved(F.col("h"), F.col("b")))
    assert dict(zip(pairs, got, strict=True)) == pairs


def test_refused(spark):
    bad = ["ftp://example.org/x", "file:///etc/passwd", "http://localhost/admin", "http://127.0.0.1/x", "http://10.1.2.3/x", "http://172.16.0.1/x", "http://192.168.1.1/x", "http://169.254.1.1/x", "http://[::1]/x", "http://0.0.0.0/x", "http://100.64.0.1/x", "http://100.127.255.1/x", "http://[fe80::1]/x", "http://[fe9f::1]/x", "http://[febf::1]/x", "http://[fd00::1]/x", "http://[::ffff:127.0.0.1]/x", "http://[::ffff:169.254.169.254]/x", "http://[::ffff:10.0.0.1]/x", "not a url", "http://0177.0.0.1/", "http://0x7f000001"]
    good = ["https://example.org/x", "http://100.128.0.1/x", "http://172.32.0.1/", "http://[2001:db8::1]/"]
    got = values(spark, [(u,) for u in bad + good], "u string", ad.refusal(F.col("u")))
    assert all(got[: len(bad)]) and got[len(bad) :] == [None] * len(good)
