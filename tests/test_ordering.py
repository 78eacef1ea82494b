"""Dense row numbers, deep pages and the order of a file."""

import random

from pyspark.sql import functions as F

from kalendry.operators import ordering


def test_numbered_is_a_sort(spark):
    rng = random.Random(5)
    values = [(i, rng.choice([None, *range(50)])) for i in range(3000)]
    df = spark.createDataFrame(values, "id long, v long").repartition(7)
    got = ordering.numbered(df, F.col("v").desc_nulls_last(), F.col("id"))
    want = sorted(values, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert [(r.id, r.v) for r in sorted(got.collect(), key=lambda r: r.place)] == want
    assert sorted(r.place for r in got.collect()) == list(range(3000))
    assert ordering.numbered(df.limit(0), F.col("id")).count() == 0


def test_no_task_sorts_everything(spark):
    plan = ordering.numbered(spark.range(100).withColumnRenamed("id", "x"), F.col("x"))._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan and "Window" not in plan


def test_deep_page(spark):
    df = spark.range(1000).select((F.lit(999) - F.col("id")).alias("id"))
    assert sorted(r.id for r in ordering.page(df, 84, 12, F.col("id")).collect()) == [996, 997, 998, 999]
    assert ordering.page(df, 85, 12, F.col("id")).count() == 0


def test_drafts_go_behind_their_predecessors(spark):
    entries = spark.createDataFrame([("a26", 0), ("b26", 1), ("c26", 2)], "id string, place long")
    drafts = spark.createDataFrame([("a27", "a26", 0), ("a28", "a26", 1), ("c27", "c26", 0), ("new", None, 0), ("odd", "gone", 1)], "id string, after string, seq int")
    got = sorted(ordering.behind(entries, drafts).collect(), key=lambda r: r.place)
    assert [r.id for r in got] == ["a26", "a27", "a28", "b26", "c26", "c27", "new", "odd"]
    assert [r.place for r in got] == list(range(8))
