"""The apply step: updates, drafts, order, evidence and flags, case by case."""

import datetime

import pytest

from kalendry.operators import apply as ap

ENTRIES = "ord long, id string, title string, year int, timezone string, full_name string, place string, start date, end date, date string, deadline string, abstract_deadline string, sync_pin array<string>, note string, link string"
EDITIONS = "title string, year int, full_name string, location string, start date, paper struct<at:timestamp,quote:string>, abstract struct<at:timestamp,quote:string>, multi_entry boolean, url string"
day = datetime.date.fromisoformat


def entry(ord_=0, id_="hc26", year=2026, deadline="2026-01-01 23:59", start=None, end=None, pins=None, title="HealthConf"):
    return (ord_, id_, title, year, "UTC-12", "Health Conf", "Rome", start and day(start), end and day(end), None, deadline, None, pins, "a note", "https://hc.example")


def edition(year, date=None, start=None, title="HealthConf", multi=False, **more):
    # 23:59 anywhere on earth is 11:59 UTC of the next day
    paper = date and (datetime.datetime.fromisoformat(date + "T11:59") + datetime.timedelta(days=1), f"Deadline: {date}")
    return (title, year, more.get("full_name"), more.get("location"), start and day(start), paper, None, multi, "https://hc.example/dates")


@pytest.fixture
def run(spark):
    def go(entries, editions):
        out = ap.apply(spark.createDataFrame(entries, ENTRIES), spark.createDataFrame(editions, EDITIONS))
        rows = {r.id: r for r in out.entries.collect()}
        return rows, {(r.id, r.field): (r.old, r.new) for r in out.updates.collect()}, {(r.id, r.flag) for r in out.flags.collect()}, {(r.id, r.field, r.quote) for r in out.evidence.collect()}, out

    return go


def test_a_deadline_after_the_start_is_dropped(run):
    rows, updates, flags, evidence, _ = run([entry(start="2026-07-26", deadline=None)], [edition(2026, "2026-11-01")])
    assert rows["hc26"].deadline is None and not updates and not evidence and flags == {("hc26", "deadline after the start, dropped")}


def test_the_page_s_own_start_decides(run):
    rows, updates, flags, _, _ = run([entry(start="2026-06-22", deadline=None)], [edition(2026, "2026-07-01", start="2026-09-10")])
    assert rows["hc26"].deadline == "2026-07-01 23:59" and rows["hc26"].start == day("2026-09-10") and set(updates) == {("hc26", "deadline"), ("hc26", "start")} and not flags


def test_on_the_start_day_is_in_time(run):
    _, updates, flags, evidence, _ = run([entry(start="2026-11-01", deadline=None)], [edition(2026, "2026-11-01")])
    assert updates == {("hc26", "deadline"): (None, "2026-11-01 23:59")} and not flags and evidence == {("hc26", "deadline", "Deadline: 2026-11-01")}


def test_unchecked_and_far_moves_are_flagged(run):
    _, updates, flags, _, _ = run([entry()], [edition(2026, "2026-11-01")])
    assert updates == {("hc26", "deadline"): ("2026-01-01 23:59", "2026-11-01 23:59")} and flags == {("hc26", "no start to check against"), ("hc26", "deadline moved far")}


def test_pins_and_shifted_ends(run):
    entries = [entry(0, "a26", start="2026-06-01", end="2026-06-04", title="A", pins=["deadline", "date"]), entry(1, "b26", start="2026-06-01", end="2026-06-04", title="B", pins=["end"]), entry(2, "c26", title="C", start="2026-06-01")]
    editions = [edition(2026, "2026-02-01", start="2026-06-11", title="A", location="Oslo"), edition(2026, None, start="2026-06-11", title="B", full_name="B."), edition(2026, None, start="2027-06-11", title="C")]
    rows, updates, flags, _, _ = run(entries, editions)
    assert updates == {("a26", "place"): ("Rome", "Oslo"), ("a26", "start"): ("2026-06-01", "2026-06-11"), ("a26", "end"): ("2026-06-04", "2026-06-14"), ("b26", "full_name"): ("Health Conf", "B.")}
    assert flags == {("a26", "deadline pinned"), ("a26", "date pinned"), ("a26", "end shifted"), ("b26", "end pinned"), ("c26", "start in another year")}
    assert rows["b26"].start == day("2026-06-01") and rows["a26"].note == "a note"


def test_drafts_go_behind_their_predecessors_and_follow_each_other(run):
    entries = [entry(0, "hc25", 2025), entry(1, "hc26", start="2026-06-01", end="2026-06-03"), entry(2, "zz26", title="Z")]
    rows, updates, flags, evidence, out = run(entries, [edition(2028, "2028-01-05"), edition(2027, "2027-01-05", start="2027-05-01"), edition(2026, title="New"), edition(2027, "2027-01-01", title="Z", multi=True)])
    assert [i for i, _ in sorted(rows.items(), key=lambda r: r[1].line)] == ["hc25", "hc26", "hc27", "hc28", "zz26"] and not updates
    assert (rows["hc27"].start, rows["hc27"].end, rows["hc27"].deadline, rows["hc27"].note, rows["hc27"].link) == (day("2027-05-01"), day("2027-05-03"), "2027-01-05 23:59", None, "https://hc.example")
    assert (rows["hc28"].start, rows["hc28"].deadline, rows["hc28"].place) == (None, "2028-01-05 23:59", "Rome")
    assert {tuple(r) for r in out.drafts.collect()} == {("hc27", "HealthConf", 2027, "hc26"), ("hc28", "HealthConf", 2028, "hc27")}
    assert {("New 2026", "no earlier edition"), ("Z 2027", "several entries a year, add by hand"), ("hc27", "end inferred"), ("hc28", "no start to check against")} <= flags
    assert evidence == {("hc27", "deadline", "Deadline: 2027-01-05"), ("hc28", "deadline", "Deadline: 2028-01-05")}


def test_several_entries_a_year_take_deadlines_alone(run):
    _, updates, _, _, _ = run([entry(0, "a26", start="2026-06-01"), entry(1, "b26", start="2026-07-01")], [edition(2026, "2026-02-01", start="2026-08-01", multi=True, location="Oslo")])
    assert updates == {(i, "deadline"): ("2026-01-01 23:59", "2026-02-01 23:59") for i in ("a26", "b26")}
