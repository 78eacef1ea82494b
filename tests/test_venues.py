from pyspark.sql import functions as F

from kalendry.operators import runs, venues
from kalendry.sources import extraction, speakers


def test_unreadable_configurations_have_no_rows(spark):
    rows = spark.createDataFrame([("{",), (None,), ('{"A": {"url": "http://a.org", "extra": 1}, "B": null}',)], "config string")
    got = {r.title: r.url for r in venues.venues(rows).collect()}
    assert got == {"A": "http://a.org", "B": None}


def test_a_configuration_goes_through_its_text(spark):
    rows = spark.createDataFrame([("B", "u", None, "p", None), ("A", None, "h", "p", "s")], "title string, url string, home string, prefix string, suffix string")
    assert sorted(map(tuple, venues.venues(venues.config_text(rows)).collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)


def test_the_first_entry_decides_even_without_a_link(spark):
    rows = spark.createDataFrame([("A", "u", None), ("C", "v", None)], "title string, url string, home string")
    entries = spark.createDataFrame([("A", 2, "x"), ("A", 1, None)], "title string, ord int, link string")
    assert {r.title: r.home for r in venues.homes(rows, entries).collect()} == {"A": "u", "C": "v"}


def test_runs_end_at_the_third_request(spark):
    log = spark.createDataFrame([(1, i, u) for i, u in enumerate(["http://A.org", "http://a.org/", "http://b.org", "http://a.org/#x", "http://a.org"])] + [(2, 0, "nothing"), (2, 1, None)], "run int, seq int, url string")
    assert [(r.run, r.seq) for r in runs.stuck(log).where("run = 1").collect()] == [(1, 3)]


def test_a_source_must_have_been_read_in_its_run(spark):
    read = spark.createDataFrame([(1, "http://a.org", "http://b.org/", True), (2, "http://a.org", None, False)], "run int, url string, final_url string, ok boolean")
    said = spark.createDataFrame([(1, "http://B.org"), (2, "http://a.org"), (1, "nothing"), (1, None)], "run int, source_url string")
    assert sorted((r.run, str(r.source_url), r.known) for r in runs.sourced(said, read).collect()) == [(1, "None", False), (1, "http://B.org", True), (1, "nothing", False), (2, "http://a.org", False)]


def test_editions_of_an_answer(spark):
    answers = spark.createDataFrame([(1, "{"), (2, '{"editions": []}'), (3, '{"editions": [{"year": 2030, "location": "", "deadlines": []}]}'), (4, None)], "id int, answer string")
    assert [r.ok for r in answers.orderBy("id").select(extraction.readable(F.col("answer")).alias("ok")).collect()] == [False, True, True, False]
    rows = extraction.editions(answers, F.col("answer")).select("id", *extraction.facts(F.col("edition"))).collect()
    assert [tuple(r) for r in rows] == [(3, 2030, None, None, None, None, None)]


def test_speakers(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"name": "A", "presentations": [{"title": "t"}, {"title": "u"}]}\n{"name": "B"}\n')
    got = speakers.with_counts(speakers.read(spark, str(tmp_path / "s.json")))
    assert {r.name: r.given for r in got.collect()} == {"A": 2, "B": 0}
    labels = spark.range(1, 124, 61).select(speakers.members(F.col("id")).alias("x")).collect()
    assert [r.x for r in labels] == ["01 member", "62 members", "123 members"]
