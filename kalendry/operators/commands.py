"""The catalogue's commands: each takes (rows, argument, asof) and returns a frame; rows as operators.catalog reads them.

rows: ord, id, title, full_name, year, sub (array), type, next_at (UTC instant or null), start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kalendry.functions import deadlines as dl
from kalendry.operators import catalog
from kalendry.operators.quality import SUBJECTS


def subject_code(text: Column) -> Column:
    """The canonical code for a subject in any case, or null."""
    known = F.create_map(*[F.lit(x) for code in SUBJECTS for x in (code.lower(), code)])
    return F.try_element_at(known, F.lower(F.trim(text)))


def reminder_days(text: Column) -> Column:
    """Whole numbers at the front of comma-separated parts (7d is 7); parts without one are dropped."""
    each = F.transform(F.split(text, ","), lambda p: F.regexp_extract(p, r"^\s*([+-]?\d+)", 1).try_cast("int"))
    return F.array_compact(each)


def fresh(sent: Column, received: Column, seconds: int = 300) -> Column:
    """Whether a request is at most so old, or so far ahead."""
    return F.abs(F.unix_micros(received) - F.unix_micros(sent)) <= seconds * 1_000_000


def upcoming(rows: DataFrame, argument: str, asof: Column) -> DataFrame:
    return catalog.upcoming(rows, "next_at", asof, 5)


def search(rows: DataFrame, argument: str, asof: Column) -> DataFrame:
    return catalog.search(rows, argument, "title", "year", "full_name").orderBy("ord").limit(10)


def subject(rows: DataFrame, argument: str, asof: Column) -> DataFrame:
    """Upcoming deadlines of one subject; an unknown subject has none."""
    code = {c.lower(): c for c in SUBJECTS}.get(argument.strip().lower())
    return catalog.upcoming(catalog.narrow(rows, [code]) if code else rows.limit(0), "next_at", asof, 10)


def info(rows: DataFrame, argument: str, asof: Column) -> DataFrame:
    left = dl.days_left(F.col("next_at"), asof)
    return catalog.lookup(rows, argument).withColumn("days_left", left).withColumn("remaining", dl.remaining(left))


COMMANDS = {"upcoming": upcoming, "search": search, "subject": subject, "info": info}


def run(name: str, rows: DataFrame, argument: str, asof: Column) -> DataFrame:
    if name not in COMMANDS:
        raise ValueError(f"no command {name!r}; there are {', '.join(COMMANDS)}")
    return COMMANDS[name](rows, argument, asof)
