import pytest
from pyspark.sql import functions as F

from kalendry.operators import commands


@pytest.fixture(scope="module")
def rows(spark):
    data = [
        (0, "neur26", "NeurIPS", "Neural Systems", 2026, ["ML", "AI"], "conference", "2026-05-10 23:59:00"),
        (1, "cv26", "CVX", "Vision", 2026, ["CV"], "conference", "2026-03-01 00:00:00"),
        (2, "old25", "Old", "Past neural", 2025, ["ML"], "workshop", "2025-01-01 00:00:00"),
        (3, "none26", "None", "No date", 2026, ["ML"], "summit", None),
    ]
    return spark.createDataFrame(data, "ord int, id string, title string, full_name string, year int, sub array<string>, type string, at string").withColumn("next_at", F.col("at").cast("timestamp"))


@pytest.mark.parametrize(
    ("name", "argument", "want"),
    [("upcoming", "", ["cv26", "neur26"]), ("search", "neurips 2026", ["neur26"]), ("search", " NEURAL", ["neur26", "old25"]), ("subject", " ml ", ["neur26"]), ("subject", "art", []), ("info", "CV26", ["cv26"]), ("info", "visi", ["cv26"]), ("info", "nothing", [])],
)
def test_commands(rows, name, argument, want):
    assert [r.id for r in commands.run(name, rows, argument, F.lit("2026-02-01").cast("timestamp")).collect()] == want


def test_unknown_command(rows):
    with pytest.raises(ValueError, match="no command"):
        commands.run("drop", rows, "", F.lit(None))


def test_parsing(spark):
    df = spark.createDataFrame([(" health ai", "30, 7d,x,,3", "2026-01-01 00:00:00", "2026-01-01 00:05:00"), ("Art", "", "2026-01-01 00:10:01", "2026-01-01 00:05:00")], "s string, d string, a string, b string")
    got = df.select(commands.subject_code(F.col("s")), commands.reminder_days(F.col("d")), commands.fresh(F.col("a").cast("timestamp"), F.col("b").cast("timestamp"))).collect()
    assert [tuple(r) for r in got] == [("Health AI", [30, 7, 3], True), (None, [], False)]
