"""Pinned-field upserts, change logs, large moves, drafts of the next edition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kalendry.functions.deadlines import date_range, next_id


def change_log(current: DataFrame, facts: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, old, new, pinned) where facts say otherwise; null facts say nothing.

    Fields named in current.sync_pin are reported with pinned = true and are not to be written.
    """
    met = current.select(key, "sync_pin", *[F.col(f).cast("string").alias(f"old_{f}") for f in fields]).join(facts.select(key, *[F.col(f).cast("string").alias(f"new_{f}") for f in fields]), key)
    each = [
        F.when(F.col(f"new_{f}").isNotNull() & ~F.col(f"new_{f}").eqNullSafe(F.col(f"old_{f}")), F.struct(F.lit(f).alias("field"), F.col(f"old_{f}").alias("old"), F.col(f"new_{f}").alias("new"), F.coalesce(F.array_contains("sync_pin", f), F.lit(False)).alias("pinned")))
        for f in fields
    ]
    return met.select(key, F.explode(F.array_compact(F.array(*each))).alias("c")).select(key, "c.*")


def upsert(current: DataFrame, facts: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """current with the facts written, except null facts and pinned fields; applying it twice changes nothing.

    Of several facts for one key the last that states a field counts, in the order of facts.seq where there is such a
    column, else of the values; so no entry is doubled.
    """
    last = lambda f: F.max_by(f, F.when(F.col(f).isNotNull(), F.col("seq"))) if "seq" in facts.columns else F.max(f)
    known = facts.groupBy(key).agg(*[last(f).alias(f"__{f}") for f in fields])
    met = current.join(known, key, "left")
    new = {f: F.when(F.coalesce(F.array_contains("sync_pin", f), F.lit(False)), F.col(f)).otherwise(F.coalesce(f"__{f}", f)) for f in fields}
    return met.withColumns(new).select(*current.columns)


def big_moves(changes: DataFrame, fields: list[str], days: int = 60) -> DataFrame:
    """Changes of dated fields by more than `days`, with the rounded number of days."""
    apart = (F.unix_micros(F.col("new").cast("timestamp")) - F.unix_micros(F.col("old").cast("timestamp"))) / F.lit(86_400_000_000.0)
    moved = changes.where(F.col("field").isin(*fields) & F.col("old").isNotNull()).withColumn("days", F.round(F.abs(apart)).cast("long"))
    return moved.where(F.abs(apart) > days)


def moved_starts(current: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """What a newly reported start date does to start, end and the date text.

    current(key, year, start, end, date, sync_pin), facts(key, start); dates as dates. Adds action: wrong year,
    start pinned, end pinned (nothing is written for these), moved, moved with end; rows without news are left out.
    """
    met = current.join(facts.select(key, F.col("start").alias("reported")), key).where("reported is not null and not (start <=> reported)")
    pinned = lambda f: F.coalesce(F.array_contains("sync_pin", f), F.lit(False))
    both = F.col("start").isNotNull() & F.col("end").isNotNull()
    action = (
        F.when(F.year("reported") != F.col("year"), "wrong year")
        .when(pinned("start"), "start pinned")
        .when(both & pinned("end"), "end pinned")
        .when(both, "moved with end")
        .otherwise("moved")
    )
    out = met.withColumn("action", action).withColumn("writes", F.col("action").startswith("moved"))
    end = F.when(F.col("action") == "moved with end", F.date_add("reported", F.datediff("end", "start"))).otherwise(F.col("end"))
    out = out.withColumn("new_end", end).withColumn("new_start", F.when(F.col("writes"), F.col("reported")).otherwise(F.col("start")))
    text = F.when(F.col("writes") & ~pinned("date") & F.col("new_end").isNotNull(), date_range(F.col("new_start"), F.col("new_end"))).otherwise(F.col("date"))
    return out.select(key, "action", F.col("new_start").alias("start"), F.col("new_end").alias("end"), text.alias("date"))


#: Fixed: columns of one edition only, which its successor does not take over.
OF_ONE_EDITION = ("note", "paperslink", "deadline_status", "sync_pin")


def drafts(previous: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """The next editions: previous(key, id, year, full_name, place, timezone, start, end, ...) met by facts(key, year,
    full_name, place, deadline, abstract_deadline as instants, start).

    Facts overwrite, other curated columns are taken over, deadlines that facts lack are unset, and the end keeps
    the former duration. A start outside the edition's year is not used. flags names what a person must look at.
    """
    said = ["full_name", "place", "deadline", "abstract_deadline", "start"]
    met = previous.drop("deadline", "abstract_deadline", "date", *OF_ONE_EDITION).withColumnRenamed("year", "__before").withColumnRenamed("id", "__id").join(facts.select(key, "year", *[F.col(c).alias(f"f_{c}") for c in said]), key)
    fits = F.col("f_start").isNotNull() & (F.year("f_start") == F.col("year"))
    lasted = F.col("start").isNotNull() & F.col("end").isNotNull()
    local = lambda c: F.date_format(F.from_utc_timestamp(c, F.col("timezone")), "yyyy-MM-dd HH:mm")
    given = lambda c: F.coalesce(F.nullif(f"f_{c}", F.lit("")), F.col(c))
    flags = [
        (F.nullif("f_place", F.lit("")).isNull(), "place kept"),
        (F.col("f_deadline").isNull(), "no deadline yet"),
        (F.col("f_start").isNotNull() & ~fits, "start in another year"),
        (fits & lasted, "end inferred"),
        (fits & ~lasted, "no duration to infer the end from"),
        (F.col("f_start").isNull(), "no start yet"),
    ]
    end = F.when(fits & lasted, F.date_add("f_start", F.datediff("end", "start")))
    new = {
        "flags": F.array_compact(F.array(*[F.when(c, name) for c, name in flags])),
        "id": next_id(F.col("__id"), F.col("year")),
        "full_name": given("full_name"),
        "place": given("place"),
        "deadline": local(F.col("f_deadline")),
        "abstract_deadline": local(F.col("f_abstract_deadline")),
        "date": F.when(end.isNotNull(), date_range(F.col("f_start"), end)),
        "end": end,
        "start": F.when(fits, F.col("f_start")),
    }
    return met.withColumns(new).drop("__before", "__id", *[f"f_{c}" for c in said])


def preferences(current: DataFrame, changes: DataFrame, asof) -> DataFrame:
    """current and changes(user, enabled, timezone, reminder_days, subjects; null: as it was), a row a user.

    A new user starts from the defaults: disabled, UTC, 30, 7 and 3 days, no subjects. updated_at moves only for
    users that were there before. Enabling a user that was new or disabled resets the days to the default.
    """
    names = ["enabled", "timezone", "reminder_days", "subjects"]
    usual = F.array(*map(F.lit, (30, 7, 3))).cast("array<bigint>")
    start = {"enabled": F.lit(False), "timezone": F.lit("UTC"), "reminder_days": usual, "subjects": F.array().cast("array<string>")}
    old = current.select("user", F.lit(True).alias("there"), "updated_at", *[F.col(n).alias(f"old_{n}") for n in names])
    met = old.join(changes.select("user", F.lit(True).alias("asked"), *[F.col(n).alias(f"new_{n}") for n in names]), "user", "full_outer")
    now = {n: F.coalesce(f"new_{n}", f"old_{n}", start[n]) for n in names}
    turned_on = F.col("new_enabled") & ~F.coalesce("old_enabled", F.lit(False))
    now["reminder_days"] = F.when(turned_on, F.coalesce("new_reminder_days", usual)).otherwise(now["reminder_days"])
    moved = F.when(F.col("there") & F.col("asked"), asof).otherwise(F.col("updated_at"))
    return met.select("user", *[c.alias(n) for n, c in now.items()], moved.alias("updated_at"))


def applied(current: DataFrame, facts: DataFrame) -> DataFrame:
    """What a run does with facts(title, year, deadline) on current(ord, title, year, deadline).

    action: updated (every row of that title and year, if the fact differs), kept, drafted (a new edition, inserted
    after its title's last earlier one; several new editions of one title follow each other by year) or no earlier
    edition. Rows: action, title, year, ord (of the row, or of the one that it is inserted after), old, new.
    """
    said = facts.groupBy("title", "year").agg(F.max("deadline").alias("new"))
    mine = current.select("ord", "title", "year", F.col("deadline").alias("old"))
    met = mine.join(said, ["title", "year"])
    action = F.when(F.col("new").isNull() | F.col("new").eqNullSafe(F.col("old")), "kept").otherwise("updated")
    matched = met.select(action.alias("action"), "title", "year", "ord", "old", "new")
    fresh = said.join(mine.select("title", "year").distinct(), ["title", "year"], "left_anti")
    before = mine.select("title", F.col("year").alias("y"), "ord")
    last = fresh.join(before, (fresh.title == before.title) & (F.col("y") < F.col("year")), "left").groupBy(fresh.title, "year")
    last = last.agg(F.max("new").alias("new"), F.max(F.struct("y", "ord")).alias("p"))
    kind = F.when(F.col("p.ord").isNull(), "no earlier edition").otherwise("drafted")
    return matched.union(last.select(kind.alias("action"), "title", "year", F.col("p.ord"), F.lit(None).cast(mine.schema["old"].dataType), "new"))


def only_deadlines(facts: DataFrame, fields: tuple = ("deadline", "abstract_deadline")) -> DataFrame:
    """Facts that may write deadlines alone: all others are unset (the key, the title and the year stay)."""
    kept = {"key", "title", "year", *fields}
    return facts.select(*[F.col(c) if c in kept else F.lit(None).cast(facts.schema[c].dataType).alias(c) for c in facts.columns])
