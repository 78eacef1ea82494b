"""Speakers with their presentations, kept as files of entries or as JSON lines (name, team, presentations)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kalendry.sources import blocks

SCHEMA = "name string, team string, presentations array<struct<title:string,date:string,link:string>>"
_TALKS = "array<struct<topic:string,event:string,eventType:string,link:string,year:int>>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of SCHEMA."""
    return spark.read.schema(SCHEMA).json(path)


def from_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """ord, id, name, image_urls (one address or several, as an array), presentations (topic, event, eventType, link, year)."""
    rows = blocks.parsed(blocks.entries(spark, paths))
    of = lambda name, kind: F.try_variant_get("entry", f"$.{name}", kind)
    one = of("imageUrl", "string")
    urls = F.coalesce(of("imageUrl", "array<string>"), F.when(one.isNotNull(), F.array(one)))
    return rows.select("ord", of("id", "string").alias("id"), of("name", "string").alias("name"), urls.alias("image_urls"), of("presentations", _TALKS).alias("presentations"))


def write(speakers: DataFrame, folder: str) -> None:
    """The opposite of from_files(): entries in the order of ord; absent fields are left out."""
    image = F.when(F.size("image_urls") > 0, F.col("image_urls"))
    entry = F.to_json(F.struct("id", "name", image.alias("imageUrl"), "presentations"))
    blocks.write(speakers, entry, folder, F.col("ord"))


def with_counts(speakers: DataFrame) -> DataFrame:
    """How many presentations each speaker has; none where the list is absent."""
    return speakers.withColumn("given", F.coalesce(F.size("presentations"), F.lit(0)))


def members(n: Column) -> Column:
    """A count as `01 member`, `12 members`."""
    digits = n.cast("string")
    return F.concat(F.lpad(digits, F.greatest(F.length(digits), F.lit(2)), F.lit("0")), F.when(n == 1, F.lit(" member")).otherwise(F.lit(" members")))
