"""Operator 10: sorted rows in batches of any size give what whole groups give, and texts are dealt once."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import functions as F

from kalendry.llm import substring
from kalendry.llm.common import table_of

LEAST, NEED = 46, 37
NAMES = ["value", "doc_id", "row", "packed", "open", "core", "context", "side", "i", "j"]
TYPES = [*[pa.int64()] * 4, pa.bool_(), pa.int64(), pa.binary(), *[pa.int64()] * 3]


def _windows(rng):
    """Windows of many small and some larger blocks, sorted by block; passages are shared, changed or none."""
    rows = []
    for value in range(160):
        passage = [rng.randrange(1 << 32) for _ in range(60)]
        for k in range(rng.choice([2, 2, 3, 5, 8, 12, 30])):
            changed = rng.choice([0, 0.05, 0.6])
            own = [rng.randrange(1 << 32) if rng.random() < changed else x for x in passage]
            own = [rng.choice(own[:4]) for _ in own] if rng.random() < 0.05 else own
            left = rng.randrange(20, 40)
            packed = (1000 + k) << substring._CENTRE | left << substring._LEFT | (59 - left) << substring._RIGHT
            doc = rng.choice([None, *range(40)])
            rows.append((value - 80, doc, 7 if doc is None else doc, packed, rng.random() < 0.7, rng.choice([1, k + 100, k + 200]), np.array(own, "<u4").tobytes(), 2, 0, 0))
    return rows


def test_blocks_in_batches_give_the_pairs_of_each_block(monkeypatch):
    rng = random.Random(5)
    rows = _windows(rng)
    table = pa.Table.from_batches([table_of(rows, NAMES, TYPES)])
    every = [p for value in sorted({r[0] for r in rows}) for p in substring._block_pairs(table.filter(pa.compute.equal(table["value"], value)), NEED, LEAST, 0.8)]
    assert len(every) > 300
    for gathered, size in ((1, 7), (200, 64), (8000, 1000)):
        monkeypatch.setattr(substring, "GATHERED", gathered)
        got = [tuple(r.values()) for b in substring._blocks(iter(table.to_batches(size)), NEED, LEAST, 0.8) for r in b.to_pylist()]
        assert Counter(got) == Counter(every)


def test_values_that_occur_once_go(monkeypatch):
    monkeypatch.setattr(substring, "GATHERED", 3)
    rng = random.Random(3)
    values = sorted(rng.randrange(60) for _ in range(90))
    rows = [(v, i, i, i) for i, v in enumerate(values)]
    batches = [table_of(rows[a : a + 2], substring._MEMBER) for a in range(0, len(rows), 2)]
    got = [x for b in substring._not_alone(iter(batches)) for x in b.column("row").to_pylist()]
    assert got == [i for i, v in enumerate(values) if values.count(v) > 1]


def test_a_text_is_shuffled_once(spark, make_docs):
    search = substring._Search(make_docs(["a b c d e f", (None, "g h i j k l"), (None, "g h i j k l"), "m"]), 50, 0.8)
    rows = search.source.where("text != 'm'").select("doc_id", "row").withColumn("n", F.lit(1))
    wanted = rows.repartition("row").groupBy("doc_id", "row").agg(F.collect_set("n").alias("n"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        met = search.texts(wanted, rows.select("row"))
        assert sorted(r.text for r in met.collect()) == ["a b c d e f", "g h i j k l"]
        plan = met._jdf.queryExecution().executedPlan().toString()
        moved = [x for x in plan.split("Initial Plan")[-1].splitlines() if "Exchange hashpartitioning" in x]
        assert len(moved) == 3  # the keys, the texts, the bitmap's parts; before, the texts met again by doc_id and row
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_equal_contexts_of_a_large_run_are_counted_once(spark, monkeypatch):
    """Copies pass without a row for each of their places, and still vouch for others; a window alone goes."""
    base = list(range(60))
    rows = [(1, d, d, 30 << substring._CENTRE | 30 << substring._LEFT | 29 << substring._RIGHT, True, d, np.array(x, "<u4").tobytes(), 9, 9) for d, x in enumerate([base, base, base, [*base[:50], *range(900, 910)], list(range(100, 160))])]
    names = ["value", "doc_id", "row", "packed", "open", "core", "context", "n", "n_open"]
    types = [*[pa.int64()] * 4, pa.bool_(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
    large = spark.createDataFrame(pa.Table.from_batches([table_of(rows, names, types)]))
    thin, kinds = substring._Search(spark.createDataFrame([(1, "x")], "doc_id long, text string"), 50, 0.8).thinned(large)
    assert sorted(r.doc_id for r in thin.collect()) == [0, 1, 2, 3]
    assert kinds.count() == 3
