"""Values that the catalogue's rules are known to give, one by one."""

import datetime

import pytest
from pyspark.sql import functions as F

from kalendry.functions import deadlines as dl
from kalendry.operators import catalog, evidence, merge, venues
from kalendry.sources import extraction

def noon():
    return F.lit("2026-05-10 12:00:00").cast("timestamp")


@pytest.mark.parametrize(
    ("quote", "shown"),
    [
        ("10 May 2026", True), ("May 10, 2026", True), ("10th May 2026", True), ("10 May 26", True), ("10.05.2026", True), ("2026-05-10", True), ("10/5/26", True),
        ("Deadline: 10 May. 2026!", True), ("10May 2026", False), ("May10, 2026", False), ("10thMay 2026", False), ("Hall 1005 2026", False), ("May 10", False),
        ("xMay 10 2026", False), ("_May 10 2026", False), ("10 May_ 2026", False), ("10 May26", False), ("due 10 may", False), ("10 Mayday 2026", False), (None, False),
    ],
)
def test_date_shown(spark, quote, shown):
    df = spark.createDataFrame([(datetime.date(2026, 5, 10), quote)], "d date, q string")
    assert df.select(evidence.date_shown(F.col("d"), F.col("q"))).first()[0] is shown


def test_starts_round_up_and_sort_by_the_moment(spark):
    rows = [(1, "2026-05-10", "UTC-8"), (2, "2026-05-10", "Asia/Tokyo"), (3, "2026-05-10", None), (4, "2026-05-09", None), (5, "2026-05-11", "Asia/Tokyo"), (6, "2026-05-10", "America/New_York")]
    df = spark.createDataFrame(rows, "id int, start string, zone string")
    got = [(r.id, r.days_left) for r in catalog.upcoming_starts(df, noon()).collect()]
    assert got == [(2, 0), (3, 0), (6, 1), (1, 1), (5, 1)]
    assert [r.id for r in catalog.upcoming_starts(df, noon(), 2).collect()] == [2, 3]


def test_zone_names(spark):
    said = {"Japan": "Japan", "singapore": "Singapore", "europe/PARIS": "Europe/Paris", "EST": "UTC-5", "est5edt": "EST5EDT", "UTC+99": None, "Mars/Base": None, "UTC+5:30": "UTC+5:30", " AoE ": "UTC-12"}
    df = spark.createDataFrame([(k,) for k in said], "z string")
    assert {r.z: r.zone for r in df.select("z", dl.zone_of(F.col("z")).alias("zone")).collect()} == said


def test_configuration_keeps_what_it_does_not_know(spark):
    text = '{\n  "B x": {\n    "url": "http://a",\n    "note": "it\'s \\"q\\"",\n    "multiEntry": true,\n    "made_up": 3\n  },\n  "A": {\n    "home": "h"\n  },\n  "C": {}\n}\n'
    rows = venues.configured(spark.createDataFrame([(text,), ("no object",)], "config string"))
    assert venues.config_text(rows).first().config == text
    assert {r.title: (r.url, r.note, r.multi_entry) for r in rows.collect()} == {"B x": ("http://a", 'it\'s "q"', True), "A": (None, None, False), "C": (None, None, False)}
    found = spark.createDataFrame([("B x", "http://b"), ("A", 'http://c"')], "title string, source_url string")
    assert venues.config_text(venues.moved(rows, found)).first().config == text.replace('"http://a"', '"http://b"').replace('"home": "h"', '"home": "h",\n    "url": "http://c\\""')
    assert venues.config_text(rows.limit(0)).first().config == "{}\n"


def test_answers_have_the_extractor_s_keys(spark):
    answer = '{"page_has_dates": true, "editions": [{"year": 2027, "full_name": null, "location": "", "start_date": "2027-01-04", "end_date": null, "deadlines": [{"kind": "paper", "date": "2026-09-01", "time": null, "timezone_text": "AoE", "evidence": "Papers due 1 September 2026"}]}]}'
    rows = extraction.editions(spark.createDataFrame([(1, answer), (2, "{")], "id int, answer string"), F.col("answer"))
    paper = rows.select(*extraction.facts(F.col("edition"))).first().paper
    assert (paper.timezone_text, paper.evidence) == ("AoE", "Papers due 1 September 2026")


def test_unknown_order_is_the_rows_own(spark):
    df = spark.createDataFrame([(2, 0, 5, 5, 9), (1, 1, 3, 3, 7), (3, 2, 1, 1, 8)], "ord int, tier int, key1 int, key2 int, hindex int")
    assert [r.ord for r in catalog.ordered(df, "no such order").collect()] == [1, 2, 3]


def test_the_last_fact_counts(spark):
    current = spark.createDataFrame([("a", "x", "p", [])], "id string, f string, g string, sync_pin array<string>")
    facts = spark.createDataFrame([("a", 1, "z", "q"), ("a", 2, "b", None)], "id string, seq int, f string, g string")
    assert merge.upsert(current, facts, "id", ["f", "g"]).first()[1:3] == ("b", "q")
