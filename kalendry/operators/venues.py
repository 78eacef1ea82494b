"""Venue configurations, kept as JSON text of one object (title -> settings), and what is joined to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kalendry.functions.text import normal_url
from kalendry.sources.portal import value_of

_SETTINGS = "map<string,map<string,variant>>"


def _said(settings: Column, name: str) -> Column:
    return F.try_variant_get(F.try_element_at(settings, F.lit(name)), "$", "string")


def configured(configs: DataFrame) -> DataFrame:
    """configs(config) -> a row for each title: ord, title, url, home, prefix, suffix, note, multi_entry, settings.

    settings holds all keys in their order, known or not, as they were. Text that is no such object has no rows.
    """
    each = configs.select(F.posexplode(F.from_json("config", _SETTINGS)).alias("ord", "title", "settings"))
    known = [_said(F.col("settings"), n).alias(n) for n in ("url", "home", "prefix", "suffix", "note")]
    several = F.coalesce(F.try_variant_get(F.try_element_at("settings", F.lit("multiEntry")), "$", "boolean"), F.lit(False))
    return each.select("ord", "title", *known, several.alias("multi_entry"), "settings")


def venues(configs: DataFrame) -> DataFrame:
    """configs(config) -> title, url, home, prefix, suffix: what the joins below need; configured() is for rewriting."""
    return configured(configs).select("title", "url", "home", "prefix", "suffix")


def with_url(rows: DataFrame) -> DataFrame:
    """rows whose settings hold the column url: in its place where there is one, else as the last key."""
    new = F.variant_get(F.parse_json(F.to_json(F.struct("url"))), "$.url", "variant")
    has = F.map_contains_key("settings", F.lit("url"))
    inside = F.transform_values("settings", lambda k, v: F.when(k == "url", new).otherwise(v))
    added = F.map_concat("settings", F.create_map(F.lit("url"), new))
    return rows.withColumn("settings", F.when(F.col("url").isNull(), F.col("settings")).when(has, inside).otherwise(added))


def config_text(rows: DataFrame) -> DataFrame:
    """The opposite of configured(): one row with the JSON text, two blanks a level, titles and keys in their order.

    rows(title, settings) or, for a new configuration, (title, url, home, prefix, suffix); ord where there is an
    order. A configuration is a small file: one row for each venue that is watched.
    """
    if "settings" not in rows.columns:
        some = F.to_json(F.struct(*[c for c in ("url", "home", "prefix", "suffix") if c in rows.columns]))
        rows = rows.withColumn("settings", F.from_json(some, "map<string,variant>"))
    text = lambda c: F.get_json_object(F.to_json(F.struct(F.array(c).alias("x"))), "$.x")
    quoted = lambda c: F.regexp_replace(text(c), r"^\[|\]$", "")
    lines = F.transform(F.map_entries("settings"), lambda e: F.concat(F.lit("    "), quoted(e["key"]), F.lit(": "), F.to_json(e["value"])))
    block = F.concat(F.lit("  "), quoted(F.col("title")), F.lit(": {"), F.when(F.size("settings") > 0, F.concat(F.lit("\n"), F.concat_ws(",\n", lines), F.lit("\n  "))).otherwise(""), F.lit("}"))
    place = "ord" if "ord" in rows.columns else "title"
    every = F.array_sort(F.collect_list(F.struct(F.col(place).alias("place"), block.alias("block"))))
    body = F.concat_ws(",\n", F.transform(every, lambda x: x["block"]))
    return rows.agg(F.when(F.count(F.lit(1)) > 0, F.concat(F.lit("{\n"), body, F.lit("\n}\n"))).otherwise("{}\n").alias("config"))


def editions(rows: DataFrame, year: Column, more: int = 2) -> DataFrame:
    """Each venue in the given year and `more` years after, with the key of its group at the portal."""
    out = rows.withColumn("year", F.explode(F.sequence(year, year + more)))
    return out.withColumn("key", F.concat_ws("/", "prefix", "year", F.coalesce("suffix", F.lit("Conference"))))


def with_records(wanted: DataFrame, groups: DataFrame, invitations: DataFrame) -> DataFrame:
    """wanted(key, ...) with groups(key, ord, content)' first content, and the due date of its submission.

    invitations(id, ord, duedate: milliseconds); what is not found stays null.
    """
    first = groups.groupBy("key").agg(F.min_by("content", "ord").alias("content"))
    due = invitations.groupBy(F.col("id").alias("submission_id")).agg(F.timestamp_millis(F.min_by("duedate", "ord")).alias("due"))
    met = wanted.join(first, "key", "left").withColumn("submission_id", value_of(F.col("content"), "submission_id"))
    return met.join(due, "submission_id", "left")


def shared_titles(one: DataFrame, other: DataFrame) -> DataFrame:
    """Titles that two configurations both own: a conflict, one of them has to let go."""
    return one.join(other, "title", "left_semi").select("title").distinct()


def homes(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """rows(title, url, home) -> title, home: the venue's own, else the link of the first entry of that title, else url."""
    first = entries.groupBy("title").agg(F.min_by("link", "ord").alias("link"))
    return rows.join(first, "title", "left").select("title", F.coalesce("home", "link", "url").alias("home"))


def moved(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows with the address of found(title, source_url) where it is another page than the configured one; column `changed`.

    A configured address that cannot be read counts as another.
    """
    met = rows.join(found, "title", "left")
    changed = F.col("source_url").isNotNull() & ~normal_url(F.col("url")).eqNullSafe(F.col("source_url"))
    met = met.withColumn("changed", changed)
    met = met.withColumn("url", F.when(F.col("changed"), F.col("source_url")).otherwise(F.col("url"))).drop("source_url")
    return with_url(met).select(*rows.columns, "changed") if "settings" in rows.columns else met
