"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kalendry.llm.common import materialize


def _stars(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Hangs neighbours of each u under the least node of u's neighbourhood."""
    around = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if both_ways:
        around = around.union(edges.select("b", "a"))
    least = around.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    met = around.join(least, "u")
    if both_ways:
        out = met.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("low").alias("b"))
    else:
        out = met.select(F.col("v").alias("a"), F.col("low").alias("b")).union(least.select("u", "low"))
    return out.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """links(a, b) -> (node, root): root is the least node of the component; nodes without links are absent.

    Every round is written to the shared folder, so a lost executor costs one round at most. The rounds
    needed grow with the logarithm of the largest component, never with the number of its links.
    """
    edges = materialize(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    seen = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == seen or not now[0]:
            break
        seen = tuple(now)
        edges = materialize(_stars(_stars(edges, True), False), label)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
