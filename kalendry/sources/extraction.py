"""Editions that an extractor read from a page, as JSON text, and the facts that they state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_DEADLINE = "struct<kind:string,date:string,time:string,timezone_text:string,evidence:string>"
_EDITIONS = f"struct<page_has_dates:boolean,editions:array<struct<year:int,full_name:string,location:string,start_date:string,end_date:string,deadlines:array<{_DEADLINE}>>>>"


def editions(rows: DataFrame, answer: Column) -> DataFrame:
    """rows with a row for each edition of the answer (year, full_name, ..., deadlines); of an unreadable answer none."""
    return rows.withColumn("edition", F.explode(F.from_json(answer, _EDITIONS).editions))


def readable(answer: Column) -> Column:
    """Whether the answer holds a list of editions; one that does not is asked for again elsewhere."""
    return F.from_json(answer, _EDITIONS).editions.isNotNull()


def facts(edition: Column) -> list[Column]:
    """full_name, place and start (null where empty), and the first deadline of each kind. The end is left out: starts decide."""
    stated = lambda name: F.nullif(edition[name], F.lit(""))
    first = lambda kind: F.get(F.filter(edition["deadlines"], lambda d: d["kind"] == kind), F.lit(0))
    return [
        edition["year"].alias("year"),
        stated("full_name").alias("full_name"),
        stated("location").alias("place"),
        stated("start_date").alias("start"),
        first("abstract").alias("abstract"),
        first("paper").alias("paper"),
    ]
