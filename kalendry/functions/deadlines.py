"""Deadline algebra as columns. Every function of time takes asof; nothing reads the clock."""

from __future__ import annotations

import functools
import zoneinfo
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400_000_000
#: Fixed: zone texts that pages use, and what they mean there; names of places may be followed by "time".
OFFSETS = {"edt": "UTC-4", "cdt": "UTC-5", "mdt": "UTC-6", "pdt": "UTC-7", "cest": "UTC+2", "bst": "UTC+1", "aest": "UTC+10", "aedt": "UTC+11"}
PLACES = {
    "et": "America/New_York", "eastern": "America/New_York", "ct": "America/Chicago", "central": "America/Chicago",
    "mt": "America/Denver", "mountain": "America/Denver", "pt": "America/Los_Angeles", "pacific": "America/Los_Angeles",
}
#: Short names of the zone table that Spark has no fixed meaning for.
_SHORT = {"EST": "UTC-5", "MST": "UTC-7", "HST": "UTC-10"}


def _looked_up(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


@functools.cache
def zone_names() -> dict[str, str]:
    """Lower-case name -> the zone as Spark reads it: all names of the zone database, without its copies for other rules."""
    every = (z for z in zoneinfo.available_timezones() if not z.startswith(("posix/", "right/", "SystemV/")) and z not in ("Factory", "localtime", "posixrules"))
    return {z.lower(): _SHORT.get(z, z) for z in sorted(every)}


@functools.cache
def _zone_table() -> str:
    """The names as one SQL literal, a map for each first part: a row is compared with a region's names, not with all."""
    regions: dict[str, list[str]] = {}
    for key, zone in zone_names().items():
        regions.setdefault(key.split("/")[0] if "/" in key else "", []).append(f"'{key}', '{zone}'")
    return "map(" + ", ".join(f"'{r}', map({', '.join(pairs)})" for r, pairs in regions.items()) + ")"


def _named(key: Column) -> Column:
    """A zone by its name in lower case."""
    region = F.when(key.contains("/"), F.substring_index(key, "/", 1)).otherwise("")
    return F.try_element_at(F.try_element_at(F.expr(_zone_table()), region), key)


def zone_of(text: Column) -> Column:
    """A zone that Spark can read, as pages mean it, or null: unknown names and offsets beyond 14 hours are no zones."""
    name = F.trim(text)
    key = F.lower(name)
    hours, minutes = F.regexp_extract(name, r"^UTC[+-](\d{1,2})(?::(\d{2}))?$", 1).try_cast("int"), F.regexp_extract(name, r"^UTC[+-]\d{1,2}:(\d{2})$", 1).try_cast("int")
    within = (hours * 60 + F.coalesce(minutes, F.lit(0)) <= 14 * 60) & (F.coalesce(minutes, F.lit(0)) < 60)
    anywhere = F.when(name.rlike(r"(?i)aoe|anywhere\s+on\s+earth"), F.lit("UTC-12"))
    return F.coalesce(anywhere, _looked_up(OFFSETS, key), _looked_up(PLACES, F.regexp_replace(key, r"\s+time$", "")), _named(key), F.when(within, name))


def instant(local: Column, zone: Column) -> Column:
    """yyyy-MM-dd HH:mm[:ss] in a zone -> timestamp (session zone UTC), or null."""
    shape = local.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}(:\d{2})?$")
    return F.when(shape, F.to_utc_timestamp(F.try_to_timestamp(local, F.lit("yyyy-MM-dd HH:mm[:ss]")), zone_of(zone)))


def deadlines(abstract: Column, paper: Column) -> Column:
    """Array of (label, at) in this fixed order, of those present."""
    each = [F.when(at.isNotNull(), F.struct(F.lit(label).alias("label"), at.alias("at"))) for label, at in (("Abstract Deadline", abstract), ("Paper Submission", paper))]
    return F.array_compact(F.array(*each))


def next_deadline(array: Column, asof: Column) -> Column:
    """The first in array order that is ahead, else the last in array order (positional, not chronological)."""
    return F.coalesce(F.get(F.filter(array, lambda d: d["at"] > asof), F.lit(0)), F.try_element_at(array, F.lit(-1)))


def days_left(at: Column, asof: Column) -> Column:
    return F.ceil((F.unix_micros(at) - F.unix_micros(asof)) / F.lit(float(DAY)))


def _cases(pairs, other: Column) -> Column:
    return reduce(lambda c, p: c.when(*p), pairs[1:], F.when(*pairs[0])).otherwise(other)


def start_at(start: Column, zone: Column) -> Column:
    """The start's midnight in the event's zone (UTC if it has none)."""
    return F.to_utc_timestamp(start.cast("timestamp"), F.coalesce(zone_of(zone), F.lit("UTC")))


def start_days(start: Column, zone: Column, asof: Column) -> Column:
    """Days from today's midnight (UTC) to start_at(), a started day counts: today west of UTC is 1, east of it 0."""
    return F.ceil((F.unix_micros(start_at(start, zone)) - F.unix_micros(F.date_trunc("day", asof))) / F.lit(float(DAY))).cast("long")


def countdown(at: Column, asof: Column) -> Column:
    """Days, hours, minutes, seconds to a moment, zero-padded; zeros once it is past."""
    left = F.greatest(F.floor((F.unix_micros(at) - F.unix_micros(asof)) / 1_000_000), F.lit(0).cast("long"))
    return F.format_string("%02d:%02d:%02d:%02d", F.floor(left / 86400), F.floor(left / 3600) % 24, F.floor(left / 60) % 60, left % 60)


#: Fixed: what is said of an event without deadlines, by its deadline_status.
NO_DEADLINE = {"attendance": "Registration only, no submission", "tba": "Deadline to be announced"}


def no_deadline_label(status: Column) -> Column:
    return F.coalesce(_looked_up(NO_DEADLINE, status), F.lit("No deadlines on record"))


def urgency(days: Column) -> Column:
    return _cases([(days <= 3, "urgent"), (days <= 7, "soon"), (days <= 30, "month")], F.lit("later"))


def _counted(n: Column, unit: str) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, f" {unit}").otherwise(f" {unit}s"))


def remaining(days: Column) -> Column:
    """Expired, Today!, 1 day, n days, n weeks, n months."""
    whole = days.cast("long")
    return _cases(
        [(days < 0, F.lit("Expired")), (days == 0, F.lit("Today!")), (days < 7, _counted(whole, "day")), (days < 30, _counted(F.floor(whole / 7), "week"))],
        _counted(F.floor(whole / 30), "month"),
    )


def due_in(days: Column) -> Column:
    return F.when(days < 0, "Expired").when(days == 0, "Due today!").otherwise(F.concat(remaining(days), F.lit(" left")))


def starting_in(days: Column) -> Column:
    return F.when(days <= 0, "starting today").otherwise(F.concat(F.lit("in "), remaining(days)))


def date_range(start: Column, end: Column) -> Column:
    """Dec 6-12, 2026 / Nov 30 - Dec 5, 2025 / Dec 28, 2026 - Jan 2, 2027."""
    f = F.date_format
    return (
        F.when(F.year(start) != F.year(end), F.concat(f(start, "MMM d, yyyy"), F.lit(" - "), f(end, "MMM d, yyyy")))
        .when(F.month(start) != F.month(end), F.concat(f(start, "MMM d"), F.lit(" - "), f(end, "MMM d, yyyy")))
        .otherwise(F.concat(f(start, "MMM d"), F.lit("-"), f(end, "d, yyyy")))
    )


def next_id(old: Column, year: Column) -> Column:
    """The closing two digits become the year's."""
    return F.regexp_replace(old, r"\d{2}$", F.right(year.cast("string"), F.lit(2)))
