"""Recorded runs of a page reader: refetches, and whether a stated source was read."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kalendry.functions.text import normal_url


def stuck(log: DataFrame, most: int = 3) -> DataFrame:
    """log(run, seq, url) -> (run, seq) where a run asks for the same page the `most`th time: there it is ended."""
    keyed = log.select("run", "seq", normal_url(F.col("url")).alias("page"))
    often = keyed.withColumn("turn", F.row_number().over(Window.partitionBy("run", "page").orderBy("seq")))
    return often.where(F.col("turn") == most).groupBy("run").agg(F.min("seq").alias("seq"))


def sourced(submitted: DataFrame, read: DataFrame) -> DataFrame:
    """submitted(run, source_url) with `known`: whether read(run, url, final_url, ok) got that page in the same run."""
    pages = read.where("ok").select("run", F.explode(F.array("url", "final_url")).alias("page"))
    pages = pages.select("run", normal_url(F.col("page")).alias("page")).where("page is not null").distinct().withColumn("known", F.lit(True))
    met = submitted.withColumn("page", normal_url(F.col("source_url"))).join(pages, ["run", "page"], "left")
    return met.withColumn("known", F.coalesce("known", F.lit(False))).drop("page")
