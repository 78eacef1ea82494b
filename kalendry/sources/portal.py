"""Facts from a submission portal's group records: JSON text whose fields are wrapped as {"value": ...}."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def value_in(record: Column, key: str) -> Column:
    """The text of a field of a parsed record (VARIANT); null if it is absent, empty or no text (a number, a list, an object)."""
    value = F.try_variant_get(record, f"$.{key}.value", "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.nullif(F.try_variant_get(value, "$", "string"), F.lit("")))


def value_of(content: Column, key: str) -> Column:
    """value_in() of a record that is still text; text that is no JSON has no values."""
    return value_in(F.try_parse_json(content), key)


def deadline_in(dates: Column, label: str) -> Column:
    """UTC instant of "label: May 07 2026 11:59AM UTC-0" in a list of such segments; the last valid one.

    A segment's last five words are the local time (month, day, year, clock) and the offset; before them stands the label.
    """

    def parsed(words):
        name = F.array_join(F.slice(words, F.lit(1), F.greatest(F.size(words) - 5, F.lit(0))), " ")
        last = lambda n: F.try_element_at(words, F.lit(-n))
        local = F.try_to_timestamp(F.concat_ws(" ", last(5), last(4), last(3), last(2)), F.lit("MMM d yyyy h:mma"))
        offset = F.regexp_extract(last(1), r"^UTC([+-]\d{1,2})$", 1).try_cast("int")
        return F.when(name == f"{label}:", local - F.make_dt_interval(F.lit(0), offset))

    segments = F.filter(F.split(dates, ", "), lambda s: F.contains(s, F.lit(f"{label}:")))
    found = F.array_compact(F.transform(F.transform(segments, lambda s: F.split(F.trim(s), r"\s+")), parsed))
    return F.try_element_at(found, F.lit(-1))


def facts(groups: DataFrame) -> DataFrame:
    """groups(key, content) -> what the record states; what it leaves open (absent, empty, TBD, TBA) is null."""
    # parsed once; a column that is read more than once is not folded into its readers
    rows = groups.select("key", F.try_parse_json("content").alias("record"))
    said = {n: value_in(F.col("record"), n) for n in ("title", "location", "start_date", "submission_id", "date")}
    rows = rows.select("key", *[c.alias(n) for n, c in said.items()])
    place = F.nullif(F.trim("location"), F.lit(""))
    return rows.select(
        "key",
        F.col("title").alias("full_name"),
        F.when(~place.rlike("(?i)^(tbd|tba)$"), place).alias("place"),
        F.try_to_timestamp(F.trim("start_date"), F.lit("MMM d yyyy")).cast("date").alias("start"),
        "submission_id",
        deadline_in(F.col("date"), "Abstract Registration").alias("abstract_deadline"),
        deadline_in(F.col("date"), "Submission Deadline").alias("deadline"),
    )
