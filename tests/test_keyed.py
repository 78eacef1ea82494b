"""Keyed tables: batches that come again, failures before the commit, two writers, and bytes that follow the touched buckets."""

import datetime
import os

import pytest

from kalendry.sources.keyed import Conflict, KeyedTable, add_new, upsert
from kalendry.streaming import delivery

SCHEMA = "user string, version int, text string"


def rows_of(table):
    return sorted(map(tuple, table.read().collect()))


def test_upserts_keep_the_latest(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path), SCHEMA, ["user"], 8)
    make = lambda rows: spark.createDataFrame(rows, SCHEMA)
    assert rows_of(table) == []
    assert upsert(table, make([("a", 1, "x"), ("b", 1, "y"), ("a", 2, "z")]), "version", 0)
    assert upsert(table, make([("b", 0, "late"), ("c", 1, "n")]), "version", 1)
    want = [("a", 2, "z"), ("b", 1, "y"), ("c", 1, "n")]
    assert rows_of(table) == want
    assert not upsert(table, make([("a", 9, "again")]), "version", 1) and rows_of(table) == want
    assert upsert(table, make([]), "version", 2) and rows_of(table) == want


def test_a_failure_before_the_commit_loses_nothing(spark, tmp_path, monkeypatch):
    table = KeyedTable(spark, str(tmp_path), SCHEMA, ["user"], 4)
    upsert(table, spark.createDataFrame([("a", 1, "x")], SCHEMA), "version", 0)
    fresh = spark.createDataFrame([("a", 2, "y"), ("b", 1, "z")], SCHEMA)
    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            upsert(table, fresh, "version", 1)
    assert rows_of(table) == [("a", 1, "x")]
    assert upsert(table, fresh, "version", 1) and rows_of(table) == [("a", 2, "y"), ("b", 1, "z")]


def test_of_two_writers_one_starts_again(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path), SCHEMA, ["user"], 4)
    add_new(table, spark.createDataFrame([("a", 1, "x")], SCHEMA))

    def slow(old, new):
        add_new(table, spark.createDataFrame([("b", 1, "other")], SCHEMA))
        return old.unionByName(new)

    with pytest.raises(Conflict):
        table.merge(spark.createDataFrame([("c", 1, "y")], SCHEMA), slow)
    assert rows_of(table) == [("a", 1, "x"), ("b", 1, "other")]
    (tmp_path / "versions" / "3").write_text('{"batch": 0, "buck')  # a version that is still being written
    assert rows_of(table) == [("a", 1, "x"), ("b", 1, "other")]
    table.repair()
    assert add_new(table, spark.createDataFrame([("c", 1, "y")], SCHEMA)) and len(rows_of(table)) == 3


def test_bytes_follow_the_touched_buckets(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path), SCHEMA, ["user"], 16)
    add_new(table, spark.createDataFrame([(f"u{i}", 1, f"text {i} " * 20) for i in range(4000)], SCHEMA))
    size = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(tmp_path / "data") for f in names if f.endswith(".parquet"))
    first = size()
    before = table.version()[1]["buckets"]
    upsert(table, spark.createDataFrame([("u1", 2, "new")], SCHEMA), "version")
    after = table.version()[1]["buckets"]
    assert size() - first < first / 8 and sum(before[b] != after[b] for b in after) == 1 and table.read().count() == 4000


def test_a_batch_sends_what_is_new(spark, tmp_path):
    table, day = delivery.ledger(spark, str(tmp_path), 4), datetime.date(2024, 1, 1)
    make = lambda rows: spark.createDataFrame(rows, "target string, event string, day date, text string")
    assert delivery.take(table, make([("a", "e", day, "1"), ("a", "e", day, "2"), ("b", "e", day, "3")]), 0).count() == 2
    again = make([("a", "e", day, "1"), ("c", "e", day, "4")])
    assert [r.target for r in delivery.take(table, again, 1).collect()] == ["c"]
    assert [r.target for r in delivery.take(table, again, 1).collect()] == ["c"]  # the batch runs again
    assert delivery.take(table, again, 2).count() == 0
