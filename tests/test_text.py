"""Page text, links, entities and quotes on cases that the tables do not hold."""

from pyspark.sql import functions as F

from kalendry.functions import deadlines as dl
from kalendry.functions import text as tx
from kalendry.operators import evidence
from kalendry.sources import portal


def _one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]


def test_entities(spark):
    assert _one(spark, "a &#65;&#38;lt; &amp;lt; &#x41; &#1114112; &#55296; &#99999999999; &ndash;&", tx.decoded) == "a A< &lt; &#x41; � � � -&"
    assert _one(spark, None, tx.decoded) is None
    assert _one(spark, "", tx.decoded) == ""


def test_page_text(spark):
    html = "<head><title>t</title></head><header>top</header><SVG a><p>x</p></svg ><table><tr><td>Due</td><td>May&nbsp;1</td></tr></table><!-- no\n --><p>a<br>b</p>"
    assert _one(spark, html, tx.html_text) == "top Due | May 1 |\na\nb"


def test_links(spark):
    html = """<a href='/x/'>X</a><a class=k href="y?z#f"> the <b>y</b> </a><a href="/x">again</a><a href="http://10.0.0.1/">in</a><a href="mailto:a@b">m</a><a href="//H.org">h</a><a href="/e"><img></a><a href=q>q</a>"""
    got = spark.createDataFrame([(html, "https://Site.org/d/p?q")], "h string, u string").select(tx.page_links(F.col("h"), F.col("u"))).first()[0]
    assert [tuple(r) for r in got] == [("https://site.org/x", "X"), ("https://site.org/d/y?z", "the y"), ("https://h.org/", "h")]


def test_zones(spark):
    said = ["23:59 (AoE)", "anywhere  on Earth", "Pacific time", "CEST", "Mars"]
    rows = spark.createDataFrame([(s,) for s in said], "t string").select(dl.zone_of(F.col("t"))).collect()
    assert [r[0] for r in rows] == ["UTC-12", "UTC-12", "America/Los_Angeles", "UTC+2", None]


def test_date_shown(spark):
    cases = [
        ("2026-09-15", "15 September 2026", True), ("2026-09-15", "September 15th, 2026", True), ("2026-09-15", "15/09/2026", True), ("2026-09-15", "due 09-15, 2026", True),
        ("2026-09-15", "Sept. 15 26", True), ("2026-09-15", "September 15 Room 26", False), ("2026-09-15", "September 2026", False), ("2026-01-15", "Hall 151, 2026", False),
        ("2026-05-10", "maybe 10, 2026", False), ("2026-09-05", "September 15, 2026", False), ("2026-09-15", "115 September 2026", False), (None, "15 September 2026", False), ("2026-09-15", None, False),
    ]
    rows = spark.createDataFrame(cases, "d string, e string, want boolean").select(evidence.date_shown(F.col("d").cast("date"), F.col("e")), "want", "d", "e").collect()
    assert [tuple(r) for r in rows if r[0] != r[1]] == []


def test_gate_order_and_zones(spark):
    page = "Paper submission: 1 May 2026. Camera-ready: 2 June 2026."
    base = {"edition": 1, "pos": 0, "year": 2026, "kind": "paper", "date": "2026-05-01", "time": None, "zone_text": None, "evidence": "paper  SUBMISSION: 1 May 2026", "start_date": None, "page": page}
    cases = [({}, None), ({"year": 2031, "evidence": ""}, "year"), ({"evidence": " "}, "not on the page"), ({"evidence": "Camera-ready: 2 June 2026", "date": "2026-06-02"}, "no submission"), ({"date": "2026-05-02"}, "date not stated"),
             ({"start_date": "2026-04-30"}, "after the start"), ({"start_date": "2026-02-31"}, None), ({"time": "25:00"}, "implausible")]
    claims = spark.createDataFrame([base | change | {"pos": i} for i, (change, _) in enumerate(cases)], "edition int, pos int, year int, kind string, date string, time string, zone_text string, evidence string, start_date string, page string")
    got = evidence.gated(claims, F.lit("2026-01-01").cast("timestamp")).orderBy("pos").collect()
    assert [r.drop_reason for r in got] == [want for _, want in cases]


def test_settled_kinds(spark):
    rows = [
        (1, 0, "paper", "Abstract registration"), (1, 1, "paper", "Full paper"),  # said alike, read apart: read
        (2, 0, "abstract", "Paper registration"), (2, 1, "paper", "Full paper"),  # said apart, read alike: said
        (3, 0, "paper", "papers"), (3, 1, "paper", "late papers"),  # alike both ways: the first
    ]
    got = evidence.settled(spark.createDataFrame(rows, "edition int, pos int, kind string, evidence string"))
    assert sorted((r.edition, r.kind, r.pos, r.said, r.kept_said, r.rivals) for r in got.collect()) == [
        (1, "abstract", 0, "paper", False, 0), (1, "paper", 1, "paper", False, 0), (2, "abstract", 0, "abstract", True, 0), (2, "paper", 1, "paper", True, 0), (3, "paper", 0, "paper", False, 1),
    ]


def test_hosts_that_are_refused(spark):
    bad = ["ftp://example.org/x", "file:///etc/passwd", "not a url"] + [f"http://{h}/x" for h in ("localhost", "127.0.0.1", "10.1.2.3", "172.16.0.1", "192.168.1.1", "169.254.1.1", "[::1]", "0.0.0.0", "100.64.0.1", "100.127.255.1", "[fe80::1]", "[fe9f::1]", "[febf::1]", "[fd00::1]", "[::ffff:127.0.0.1]", "0x7f.1", "2130706433", "localhost.")]
    good = ["https://example.org/x", "http://100.128.0.1/", "http://[2001:db8::1]/x", "http://1.2.3.4.5/"]
    rows = spark.createDataFrame([(u, u in good) for u in bad + good], "u string, fine boolean").select("u", "fine", tx.url_refusal(F.col("u")).isNull().alias("got")).collect()
    assert [r.u for r in rows if r.got != r.fine] == []


def test_unknown_zones_do_not_end_the_job(spark):
    rows = spark.createDataFrame([(z,) for z in ("Mars/Base", "UTC+99", "EDT time", "Klingon", None, "America/New_York")], "z string")
    got = rows.select(dl.instant(F.lit("2026-07-01 12:00"), F.col("z")).cast("string").alias("t")).collect()
    assert [r.t for r in got] == [None] * 5 + ["2026-07-01 16:00:00"]


def test_entry_zone_and_flags(spark):
    page = "Paper submission: 1 May 2026"
    rows = [(1, 0, 2026, "paper", "2026-05-01", None, z, page, "2026-02-31", page, own) for z, own in (("Mars/Base", "UTC-12"), (None, "UTC-12"), ("UTC+1", "UTC-12"), ("", None))]
    claims = spark.createDataFrame(rows, "edition int, pos int, year int, kind string, date string, time string, zone_text string, evidence string, start_date string, page string, entry_zone string")
    got = evidence.gated(claims, F.lit("2026-01-01").cast("timestamp")).select(F.col("at").cast("string").alias("at"), "flags", "drop_reason").collect()
    assert [r.at for r in got] == ["2026-05-02 11:59:00", "2026-05-02 11:59:00", "2026-05-01 22:59:00", "2026-05-01 23:59:00"]
    assert [list(r.flags) for r in got] == [["unknown zone", "start is no date"]] + [["start is no date"]] * 3 and {r.drop_reason for r in got} == {None}


def test_portal_values_that_are_no_text(spark):
    content = '{"a": {"value": "x"}, "b": {"value": {"a": 1}}, "c": {"value": 3}, "d": {"value": ""}, "e": {"value": ["p"]}}'
    row = spark.createDataFrame([(content,)], "c string").select(*[portal.value_of(F.col("c"), k).alias(k) for k in "abcdef"]).first()
    assert tuple(row) == ("x", None, None, None, None, None)
