"""Dense row numbers over a whole table, and what follows from them: pages deep in a list, the order of a file.

A window without partitions would sort everything in one task. Here rows are dealt out by ranges of the sort keys,
each range is sorted by its own task and written with the places within it; the sizes of the ranges, one number
for each task, add up to the offsets.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kalendry.sources.shared import written

#: The low bits of monotonically_increasing_id(): the place within a task.
_WITHIN = (1 << 33) - 1


def numbered(df: DataFrame, *keys: Column, name: str = "place") -> DataFrame:
    """df with a long column `name`: 0, 1, 2 ... in the order of keys, without gaps.

    Rows that agree in all keys are numbered in any order, and stay in one task: give a tie-breaking key where many
    rows may agree. An empty table stays empty. `name` must not be a column of df.
    """
    if name in df.columns:
        raise ValueError(f"{name} is a column already")
    row = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns]).alias("row")
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    kept = written(dealt.select(row, F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit(_WITHIN)).alias("within")), "numbered")
    sizes = sorted((r["part"], r["count"]) for r in kept.groupBy("part").count().collect())  # one row for each range
    before = [0, *accumulate(n for _, n in sizes)]
    offsets = df.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sizes, before, strict=False)], "part int, before long")
    return kept.join(F.broadcast(offsets), "part").select("row.*", (F.col("before") + F.col("within")).alias(name))


def page(df: DataFrame, number: int, size: int, *keys: Column) -> DataFrame:
    """Page `number` (from 1) of `size` rows in the order of keys, however deep; a page past the end is empty."""
    first = (max(number, 1) - 1) * size
    return numbered(df, *keys).where(F.col("place").between(first, first + size - 1))


def behind(entries: DataFrame, drafts: DataFrame) -> DataFrame:
    """The order of a file after drafts go in behind their predecessors: (id, place) for entries and drafts.

    entries(id, place) is the file's order, drafts(id, after, seq) names each draft's predecessor, an entry or another
    draft's entry at the root of a chain; drafts behind one predecessor stand in the order of seq, then id. A draft
    whose predecessor is null or unknown goes to the end of the file. The result has dense places from 0.
    """
    at = entries.select(F.col("id").alias("after"), F.col("place").alias("anchor"))
    placed = drafts.join(at, "after", "left").select("id", "anchor", F.col("seq").cast("long").alias("seq"))
    rows = entries.select("id", F.col("place").alias("anchor"), F.lit(-1).cast("long").alias("seq")).unionByName(placed)
    keys = (F.col("anchor").asc_nulls_last(), F.col("seq").asc_nulls_last(), F.col("id"))
    return numbered(rows, *keys).select("id", "place")
