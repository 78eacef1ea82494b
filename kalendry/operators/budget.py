"""When a recorded run would have stopped: turns, tokens and time against their limits, in this order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Steps of one run that are summed together before runs are cumulated.
BLOCK = 256


def stops(steps: DataFrame, run: str, seq: str, tokens: str, most: int) -> DataFrame:
    """Of each run whose tokens exceed `most`: the first step at which they do, and their sum there.

    Totals of blocks of BLOCK steps are cumulated first, so the window over a run has one row a block; only the
    block in which the limit falls is then cumulated step by step. Steps of one seq count as one; null tokens as 0.
    """
    rows = steps.groupBy(run, seq).agg(F.coalesce(F.sum(tokens), F.lit(0)).alias("t")).withColumn("block", F.floor(F.col(seq) / BLOCK))
    blocks = rows.groupBy(run, "block").agg(F.sum("t").alias("sum"))
    so_far = F.sum("sum").over(Window.partitionBy(run).orderBy("block").rowsBetween(Window.unboundedPreceding, 0))
    over = blocks.withColumn("upto", so_far).where(F.col("upto") > most)
    first = over.groupBy(run).agg(F.min("block").alias("block"), F.min_by(F.col("upto") - F.col("sum"), "block").alias("before"))
    inside = rows.join(first, [run, "block"])
    running = F.col("before") + F.sum("t").over(Window.partitionBy(run).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0))
    return inside.withColumn("spent", running).where(F.col("spent") > most).groupBy(run).agg(F.min(seq).alias("stopped_at"), F.min_by("spent", seq).alias("spent"))


def tripped(turns, tokens, millis, most_turns: int = 6, most_tokens: int = 80_000, most_millis: int = 120_000):
    """turns, tokens or time: the first limit that is exceeded (strictly), or null."""
    return F.when(turns > most_turns, "turns").when(tokens > most_tokens, "tokens").when(millis > most_millis, "time")
