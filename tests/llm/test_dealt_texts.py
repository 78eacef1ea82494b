"""What is shuffled on the way to texts and shared places, and that nothing is lost by it."""

import random
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from kalendry.llm import substring
from kalendry.llm.common import perhaps


def test_shared_places_by_a_scan():
    rng = random.Random(5)
    rows = sorted((rng.randrange(3), rng.randrange(60), i) for i in range(100))
    batches, at = [], 0
    while at < len(rows):
        size = rng.randrange(4)
        part = rows[at : at + size]
        columns = list(zip(*part, strict=True)) or [()] * 3
        batches.append(pa.RecordBatch.from_arrays([pa.array(columns[c], pa.int64()) for c in (0, 1, 2, 2, 2, 2)], names=["value", "shingle", "doc_id", "row", "packed", "at"]))
        at += size
    got = [x for b in substring._shared(iter(batches)) for x in b.column("at").to_pylist()]
    often = Counter(r[:2] for r in rows)
    assert sorted(got) == sorted(i for v, s, i in rows if often[v, s] > 1)


def test_texts_that_nothing_asks_for_are_not_dealt(spark):
    """No loss by the bitmap, and few rows beside those asked for; keys may be negative."""
    held = spark.range(20_000).selectExpr("id", "xxhash64(id) AS key")
    asked = held.where("id % 100 = 0").select("key").union(held.where("id % 500 = 0").select("key"))
    got = {r.id for r in perhaps(held, F.col("key"), asked).collect()}
    assert got >= set(range(0, 20_000, 100)) and len(got) < 210
    assert perhaps(held, F.col("key"), asked.limit(0)).count() == 0
