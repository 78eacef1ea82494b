"""Catalogue files, calendars, reports, digests, subscriptions: whole documents and round trips."""

import glob

import pytest
from pyspark.sql import functions as F

from kalendry.operators import budget, documents, merge, quality
from kalendry.sources import catalogue
from kalendry.streaming import subscriptions

TEXT = """# events
- title: Example One
  year: 2026
  id: one26
  full_name: 'It''s: the first'
  link: https://one.org/
  deadline: 2026-05-10 23:59
  start: '2026-06-22'
  hindex: 12
  sub: [AA, B B]
  note: a long note that
      goes on

- title: Two
  year: 2027
  id: two27
  sub:
    - CC
    - DD
  sync_pin:
    - full_name
- title: "Three \\"3\\""
  year: 2027
  id: three27
  sub: EE
"""


@pytest.fixture
def rows(spark, tmp_path):
    (tmp_path / "a.txt").write_text(TEXT)
    (tmp_path / "b.txt").write_text("- title: Four\n  id: four27\n")
    return catalogue.read(spark, [str(tmp_path / "a.txt"), str(tmp_path / "b.txt")])


def test_catalogue(rows):
    got = rows.orderBy("ord").collect()
    assert [r.id for r in got] == ["one26", "two27", "three27", "four27"]
    assert (got[0].full_name, got[0].deadline, got[0].start, got[0].sub, got[0].note) == ("It's: the first", "2026-05-10 23:59", "2026-06-22", ["AA", "B B"], "a long note that goes on")
    assert (got[1].sub, got[1].sync_pin, got[2].title, got[2].sub, got[3].sub) == (["CC", "DD"], ["full_name"], 'Three "3"', ["EE"], None)
    full = catalogue.with_defaults(rows).orderBy("ord").collect()
    assert (full[3].full_name, full[3].place, full[3].hindex, full[3].sub, full[0].year, full[0].hindex) == ("Four", "TBA", 0.0, ["General"], 2026, 12.0)


def test_catalogue_refuses_other_text(spark, tmp_path):
    (tmp_path / "c.txt").write_text("just words\n")
    with pytest.raises(Exception, match="no entry"):
        catalogue.read(spark, [str(tmp_path / "c.txt")]).collect()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        catalogue.read(spark, [str(tmp_path / "missing.txt")]).collect()


def test_catalogue_round_trip(spark, rows, tmp_path):
    catalogue.write(rows, str(tmp_path / "out"))
    parts = sorted(glob.glob(str(tmp_path / "out" / "part-*")))
    again = catalogue.read(spark, parts)
    keys = list(catalogue.KEYS)
    assert [r.asDict() for r in again.orderBy("ord").select(*keys).collect()] == [r.asDict() for r in rows.orderBy("ord").select(*keys).collect()]


def test_calendar(spark, tmp_path):
    day, at = "cast('2026-12-31' as date)", "cast('2026-05-01 23:30:00' as timestamp)"
    r = spark.range(1).selectExpr("'x' as id", "1 as ord", "'T; 1' as title", "2026 as year", "'a\\nb' as full_name", "null as place", "'http://x' as link", f"{day} as start", f"{day} as end", f"{at} as abstract_at", "cast(null as timestamp) as deadline_at")
    documents.write_lines(documents.calendar(r, "ord", F.lit("2026-01-01").cast("timestamp")), str(tmp_path / "cal"), "\r\n")
    text = "".join(open(p, newline="").read() for p in sorted(glob.glob(str(tmp_path / "cal" / "part-*"))))
    lines = text.split("\r\n")
    assert lines[:2] == ["BEGIN:VCALENDAR", "VERSION:2.0"] and lines[-2:] == ["END:VCALENDAR", ""]
    assert "DTSTART;VALUE=DATE:20261231" in lines and "DTEND;VALUE=DATE:20270101" in lines and "SUMMARY:T\\; 1 2026" in lines and "DESCRIPTION:a\\nb" in lines
    assert "DTSTART:20260501T233000Z" in lines and "DTEND:20260502T003000Z" in lines and lines.count("BEGIN:VEVENT") == 2 and not any(x.startswith("LOCATION") for x in lines)


def test_report(spark):
    empty = {"updates": "seq int, id string, field string, old string, new string", "drafted": "seq int, id string, title string, year int", "flags": "seq int, message string", "skipped": "seq int, message string"}
    none = {k: spark.createDataFrame([], v) for k, v in empty.items()}
    lines = lambda d: [r.line for r in d.orderBy("section", "seq").collect()]
    assert lines(documents.report("Sync", **none)) == ["## Sync", "", "No changes.", ""]
    some = none | {"updates": spark.createDataFrame([(0, "a", "place", None, "Rome")], empty["updates"]), "flags": spark.createDataFrame([(0, "z"), (1, "a"), (2, "z")], empty["flags"])}
    assert lines(documents.report("Sync", **some)) == ["## Sync", "", "### Updated entries", "", "| Entry | Field | Old | New |", "|---|---|---|---|", "| a | place |  | Rome |", "", "### Needs attention", "", "- z", "- a", ""]


def test_digest_without_rows(spark):
    assert documents.digest([("D", spark.createDataFrame([], "days_left int, ord int, line string"))]).count() == 0


def test_upsert_is_idempotent(spark):
    now = spark.createDataFrame([("a", "x", "p", ["place"]), ("b", "y", "q", None)], "id string, full_name string, place string, sync_pin array<string>")
    facts = spark.createDataFrame([("a", "X", "P"), ("b", None, "Q")], "id string, full_name string, place string")
    once = merge.upsert(now, facts, "id", ["full_name", "place"])
    assert sorted((r.id, r.full_name, r.place) for r in once.collect()) == [("a", "X", "p"), ("b", "y", "Q")]
    assert merge.upsert(once, facts, "id", ["full_name", "place"]).exceptAll(once).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    schema = "channel string, at timestamp, seq int, joined boolean"
    rows = spark.range(60).selectExpr("concat('c', id % 7) as channel", "timestamp_seconds(id * 37 % 50) as at", "cast(id as int) as seq", "id % 3 > 0 as joined")
    for i in range(3):
        rows.where(F.col("seq") % 3 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = subscriptions.stream(spark, events, str(tmp_path / "state"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, subscriptions.active(rows).collect()))


def test_stream_runs_again_without_new_events(spark, tmp_path):
    schema = "channel string, at timestamp, seq int, joined boolean"
    spark.range(9).selectExpr("concat('c', id % 4) as channel", "timestamp_seconds(id) as at", "cast(id as int) as seq", "id % 2 = 0 as joined").write.parquet(str(tmp_path / "in"))
    run = lambda: sorted(map(tuple, subscriptions.stream(spark, spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "state")).collect()))
    first = run()
    assert first and run() == first and run() == first


def test_upsert_takes_one_fact_a_key(spark):
    now = spark.createDataFrame([("a", "x", None)], "id string, place string, sync_pin array<string>")
    facts = spark.createDataFrame([("a", "y"), ("a", "z")], "id string, place string")
    assert [tuple(r) for r in merge.upsert(now, facts, "id", ["place"]).select("id", "place").collect()] == [("a", "z")]


def test_failures_end_subscriptions(spark):
    active = spark.createDataFrame([("a", "t"), ("b", "t"), ("c", "u"), ("d", "v")], "channel string, team string")
    failed = spark.createDataFrame([("a", "t", "is_archived"), ("c", "u", "token_revoked"), ("d", "v", "ratelimited")], "channel string, team string, error string")
    assert sorted(r.channel for r in subscriptions.after_failures(active, failed).collect()) == ["b", "d"]


def test_catalogue_rules_on_files(spark, rows):
    found = quality.findings(rows, F.col("id"), quality.catalogue_rules())
    got = {(r.id, r.rule) for r in found.collect()}
    assert ("four27", "year missing") in got and ("one26", "subject") in got and not any(i == "two27" and r in ("sync_pin", "id ending") for i, r in got)
    assert not quality.verdict(found).first().passed and quality.verdict(found.limit(0)).first().passed


def test_budget_limits_fall_inside_later_blocks(spark):
    steps = spark.range(2000).selectExpr("id % 2 as run", "id div 2 as seq", "case when id = 1 then null else 1 end as tokens")
    got = {r.run: (r.stopped_at, r.spent) for r in budget.stops(steps, "run", "seq", "tokens", 600).collect()}
    assert got == {0: (600, 601), 1: (601, 601)}
    assert budget.stops(steps, "run", "seq", "tokens", 1000).count() == 0


def test_usage_sections(spark):
    quotes = spark.createDataFrame([(0, "a26", "deadline", " May 1\n| x ", "http://a")], "seq int, id string, field string, quote string, url string")
    usage = spark.createDataFrame([(0, "A", 1, True, 1000, 200), (1, "B", 2, False, 10, 0), (2, "C", None, False, 0, 0)], "seq int, venue string, tier int, submitted boolean, tokens_in long, tokens_out long")
    lines = [r.line for r in documents.usage_sections(quotes, usage).orderBy("section", "seq").collect()]
    assert lines == [
        "### Evidence", "", "| Entry | Field | Source quote | Page |", "|---|---|---|---|", "| a26 | deadline | May 1 \\| x | http://a |", "",
        "### Usage", "", "- A: tier 1, 1200 tokens", "- B: tier 2, found nothing, 10 tokens", "- C: failed, 0 tokens", "", "Total: 1010 input + 200 output tokens, est. $0.002", "",
    ]
    none = documents.usage_sections(quotes.limit(0), usage.limit(0)).orderBy("section", "seq").collect()
    assert [r.line for r in none] == ["### Usage", "", "", "Total: 0 input + 0 output tokens, est. $0.000", ""]
