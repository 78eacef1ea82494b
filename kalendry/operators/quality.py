"""Data-quality findings: one pass over rows that are checked alone, one aggregation for repeated ids."""

from __future__ import annotations

import zoneinfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kalendry.functions.text import url_refusal
from kalendry.operators.catalog import repeated
from kalendry.sources.catalogue import KEYS

#: Fixed: what the columns of a catalogue may hold.
SUBJECTS = ("ML", "CV", "NLP", "DM", "HCI", "SEC", "SE", "AI", "Global Health", "Health AI")
TYPES = ("conference", "summit", "workshop")
STATUSES = ("attendance", "tba")
PINNABLE = ("deadline", "abstract_deadline", "full_name", "place", "start", "end", "date")


def findings(rows: DataFrame, id_: Column, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """(id, rule, severity) for every rule (name, severity, condition) that holds for a row."""
    found = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity"))) for n, s, c in rules]))
    return rows.select(id_.alias("id"), F.explode(found).alias("f")).select("id", "f.rule", "f.severity")


def repeated_ids(rows: DataFrame, id_: str) -> DataFrame:
    return repeated(rows, id_).select(F.col(id_).alias("id"), F.lit("duplicate id").alias("rule"), F.lit("E").alias("severity"))


def _moment(c: Column) -> Column:
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}(:\d{2})?$"), F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm[:ss]")))


def _day(c: Column) -> Column:
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd"))


def catalogue_rules(subjects: tuple = SUBJECTS) -> list[tuple[str, str, Column]]:
    """Rules on rows of sources.catalogue.read: (rule, severity E or W, condition).

    An abstract deadline after the paper's is reported, as rules of this kind mean it.
    """
    given = lambda name: F.nullif(name, F.lit("")).isNotNull()
    outside = lambda name, allowed: F.size(F.array_except(name, F.array(*map(F.lit, allowed)))) > 0
    year, hindex = F.col("year").try_cast("double"), F.col("hindex").try_cast("double")
    zone = F.col("timezone").isin(*sorted(zoneinfo.available_timezones())) | F.col("timezone").rlike(r"^UTC([+-]\d{1,2}(:\d{2})?)?$")
    rules = [(f"{name} missing", "E", ~given(name)) for name in ("title", "year", "id", "timezone", "type")]
    rules += [("unknown field", "W", F.size(F.array_except(F.map_keys("raw"), F.array(*map(F.lit, KEYS)))) > 0), ("timezone", "E", given("timezone") & ~zone)]
    rules += [(f"{name} malformed", "E", given(name) & _moment(F.col(name)).isNull()) for name in ("deadline", "abstract_deadline")]
    rules += [(f"{name} malformed", "E", given(name) & _day(F.col(name)).isNull()) for name in ("start", "end")]
    rules += [
        ("deadline_status", "E", given("deadline_status") & ~F.col("deadline_status").isin(*STATUSES)),
        ("sync_pin", "E", F.map_contains_key("raw", "sync_pin") & ((F.coalesce(F.size("sync_pin"), F.lit(0)) < 1) | outside("sync_pin", PINNABLE))),
        ("year", "E", given("year") & (year.isNull() | ~year.between(1900, 2100))),
        ("hindex", "E", F.map_contains_key("raw", "hindex") & (hindex.isNull() | (hindex < 0))),
        ("subject", "E", outside("sub", subjects)),
        ("type", "E", given("type") & ~F.col("type").isin(*TYPES)),
        ("id ending", "W", given("id") & given("year") & ~F.endswith("id", F.right("year", F.lit(2)))),
        ("id case", "W", given("id") & given("year") & (F.col("id") != F.lower("id"))),
        ("start after end", "E", _day(F.col("start")) > _day(F.col("end"))),
        ("abstract after paper", "W", _moment(F.col("abstract_deadline")) > _moment(F.col("deadline"))),
    ]
    full = lambda name: F.when(F.startswith(name, F.lit("http")), F.col(name)).otherwise(F.concat(F.lit("https://"), name))
    rules += [(f"{name} unreadable", "W", given(name) & (F.coalesce(url_refusal(full(name)), F.lit("")).isin("scheme", "host") | full(name).rlike(r"^[^?#]*\s"))) for name in ("link", "paperslink", "pwclink")]
    return rules


def verdict(found: DataFrame) -> DataFrame:
    """One row: errors, warnings, passed."""
    counts = found.agg(F.count_if(F.col("severity") == "E").alias("errors"), F.count_if(F.col("severity") == "W").alias("warnings"))
    return counts.withColumn("passed", F.col("errors") == 0)
