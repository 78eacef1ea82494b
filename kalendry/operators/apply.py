"""A run's editions applied to the entries of a file: updates, drafts, change log, evidence, flags and the new order.

entries(ord, id, title, year, timezone, full_name, place, start, end, date, deadline, abstract_deadline, sync_pin, ...):
start and end are dates, deadlines text in the entry's zone, ord its place in the file; other columns are carried along.
editions(title, year, full_name, location, start, paper, abstract, multi_entry, url): what passed the gates, one row a
title and year; paper and abstract are struct(at: instant, quote), null where the page states none; multi_entry marks
venues that keep several entries a year.

An entry whose title and year an edition has is updated; the outcome of one entry (new values, changes, flags, evidence)
is one struct, made in one pass and taken apart afterwards. Editions of other years become drafts behind the latest
earlier edition, by year, so a draft can follow a draft: as many rounds as one title has new editions, which the gates'
window of years bounds by three.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kalendry.functions import deadlines as dl
from kalendry.operators import merge, ordering
from kalendry.sources.shared import written

FIELDS = ("deadline", "abstract_deadline", "full_name", "place", "start", "end", "date")
#: A move of a deadline by more days is flagged.
FAR = 60
_CHANGE = "array<struct<field:string,old:string,new:string>>"


class Applied(NamedTuple):
    entries: DataFrame  # all rows with their new values, and line: the place in the file from 0; drafts have no ord
    updates: DataFrame  # id, field, old, new
    drafts: DataFrame  # id, title, year, after (id of the entry it goes behind)
    flags: DataFrame  # id (of an entry, a draft, or title and year), flag, value
    evidence: DataFrame  # id, field, quote, url


def _flag(when: Column, flag: str, value: Column | None = None) -> Column:
    said = F.lit(None).cast("string") if value is None else value.cast("string")
    return F.when(when, F.struct(F.lit(flag).alias("flag"), said.alias("value")))


def _outcome() -> Column:
    """struct(new, changes, flags) of an entry met by its edition (columns named e_...)."""
    zone = F.coalesce(dl.zone_of(F.col("timezone")), F.lit("UTC"))
    local = lambda at: F.date_format(F.from_utc_timestamp(at, zone), "yyyy-MM-dd HH:mm")
    pinned = lambda f: F.coalesce(F.array_contains("sync_pin", f), F.lit(False))
    # only the entry's own start can tell that a deadline is late when the page names none
    over = F.to_utc_timestamp(F.date_add("start", 1).cast("timestamp"), zone)
    late = {k: F.coalesce(F.col("e_start").isNull() & (F.col(f"e_{k}.at") >= over), F.lit(False)) for k in ("paper", "abstract")}
    at = {k: F.when(~late[k], F.col(f"e_{k}.at")) for k in late}
    said = {"deadline": local(at["paper"]), "abstract_deadline": local(at["abstract"])}
    said |= {f: F.when(~F.col("e_multi"), F.nullif(f"e_{n}", F.lit(""))) for f, n in (("full_name", "full_name"), ("place", "location"))}

    start = F.when(~F.col("e_multi"), F.col("e_start"))
    moves = F.coalesce(start.isNotNull() & ~start.eqNullSafe(F.col("start")), F.lit(False))
    right_year, both = F.year(start) == F.col("year"), F.col("start").isNotNull() & F.col("end").isNotNull()
    goes = moves & right_year & ~pinned("start") & ~(both & pinned("end"))
    new_start = F.when(goes, start).otherwise(F.col("start"))
    new_end = F.when(goes & both, F.date_add(start, F.datediff("end", "start"))).otherwise(F.col("end"))
    said |= {"start": F.when(goes, new_start), "end": F.when(goes & both, new_end), "date": F.when(goes & new_end.isNotNull(), dl.date_range(new_start, new_end))}

    text = lambda c: c.cast("string")
    differs = {f: said[f].isNotNull() & ~text(said[f]).eqNullSafe(text(F.col(f))) for f in FIELDS}
    changes = [F.when(differs[f] & ~pinned(f), F.struct(F.lit(f).alias("field"), text(F.col(f)).alias("old"), text(said[f]).alias("new"))) for f in FIELDS]
    new = F.struct(*[F.when(differs[f] & ~pinned(f), said[f]).otherwise(F.col(f)).alias(f) for f in FIELDS])
    apart = lambda f: F.abs(F.unix_micros(F.try_to_timestamp(said[f], F.lit("yyyy-MM-dd HH:mm"))) - F.unix_micros(F.coalesce(F.try_to_timestamp(F.col(f), F.lit("yyyy-MM-dd HH:mm")), F.try_to_timestamp(F.col(f), F.lit("yyyy-MM-dd HH:mm:ss"))))) / F.lit(float(dl.DAY))
    flags = [
        _flag(late["paper"], "deadline after the start, dropped", local(F.col("e_paper.at"))),
        _flag(late["abstract"], "abstract_deadline after the start, dropped", local(F.col("e_abstract.at"))),
        _flag(F.col("e_start").isNull() & F.col("start").isNull() & (F.col("e_paper").isNotNull() | F.col("e_abstract").isNotNull()), "no start to check against"),
        *[_flag(differs[f] & ~pinned(f) & (apart(f) > FAR), f"{f} moved far", F.round(apart(f)).cast("long")) for f in ("deadline", "abstract_deadline")],
        *[_flag(differs[f] & pinned(f), f"{f} pinned", text(said[f])) for f in ("deadline", "abstract_deadline", "full_name", "place", "date")],
        _flag(moves & ~right_year, "start in another year", start),
        _flag(moves & right_year & pinned("start"), "start pinned", start),
        _flag(moves & right_year & ~pinned("start") & both & pinned("end"), "end pinned", start),
        _flag(goes & both, "end shifted", new_end),
    ]
    return F.struct(new.alias("new"), F.array_compact(F.array(*changes)).cast(_CHANGE).alias("changes"), F.array_compact(F.array(*flags)).alias("flags"))


def _met(entries: DataFrame, editions: DataFrame) -> DataFrame:
    e = editions.select("title", "year", F.col("full_name").alias("e_full_name"), F.col("location").alias("e_location"), F.col("start").alias("e_start"), F.col("paper").alias("e_paper"), F.col("abstract").alias("e_abstract"), F.col("multi_entry").alias("e_multi"), F.col("url").alias("e_url"), F.lit(True).alias("e_there"))
    return entries.join(e, ["title", "year"], "left")


def apply(entries: DataFrame, editions: DataFrame) -> Applied:
    columns = entries.columns
    editions = editions.withColumn("multi_entry", F.coalesce("multi_entry", F.lit(False)))
    met = _met(entries, editions).withColumn("outcome", F.when(F.col("e_there"), _outcome()))
    met = written(met, "applied")
    new = {f: F.when(F.col("e_there"), F.col(f"outcome.new.{f}")).otherwise(F.col(f)) for f in FIELDS}
    now = met.withColumns(new).select(*columns)
    updates = met.select("id", F.explode("outcome.changes").alias("c"), "e_paper", "e_abstract", "e_url").select("id", "c.*", "e_paper", "e_abstract", "e_url")
    flags = met.select("id", F.explode("outcome.flags").alias("f")).select("id", "f.*")
    quote = F.when(F.col("field") == "deadline", F.col("e_paper.quote")).otherwise(F.col("e_abstract.quote"))
    evidence = updates.where(F.col("field").isin("deadline", "abstract_deadline")).select("id", "field", quote.alias("quote"), F.col("e_url").alias("url"))

    fresh = editions.join(entries.select("title", "year").distinct(), ["title", "year"], "left_anti")
    label = F.concat_ws(" ", "title", "year")
    flags = flags.unionByName(fresh.where("multi_entry").select(label.alias("id"), F.lit("several entries a year, add by hand").alias("flag"), F.col("url").alias("value")))
    fresh = written(fresh.where("not multi_entry").withColumn("turn", F.row_number().over(Window.partitionBy("title").orderBy("year"))), "fresh")
    known, made, drafts = now.withColumn("root", F.col("id")), [], []
    for turn in range(1, (fresh.agg(F.max("turn")).first()[0] or 0) + 1):
        this = fresh.where(F.col("turn") == turn)
        earlier = known.join(this.select("title", F.col("year").alias("y")), "title").where("year < y")
        last = earlier.groupBy("title").agg(F.max_by(F.struct(*known.columns), F.struct("year", "ord")).alias("p")).select("p.*")
        flags = flags.unionByName(this.join(last.select("title"), "title", "left_anti").select(label.alias("id"), F.lit("no earlier edition").alias("flag"), F.lit(None).cast("string").alias("value")))
        facts = this.select("title", "year", "full_name", F.col("location").alias("place"), F.col("paper.at").alias("deadline"), F.col("abstract.at").alias("abstract_deadline"), "start")
        out = merge.drafts(last.withColumn("previous", F.col("id")), facts, "title").withColumn("ord", F.lit(None).cast("long"))
        for c in merge.OF_ONE_EDITION:
            if c in columns:
                out = out.withColumn(c, F.lit(None).cast(entries.schema[c].dataType))
        out = written(out.join(this.select("title", F.col("paper.quote").alias("deadline_quote"), F.col("abstract.quote").alias("abstract_deadline_quote"), "url", F.col("start").isNull().alias("unseen")), "title"), "drafts")
        drafts.append(out.select("id", "title", "year", F.col("previous").alias("after")))
        flags = flags.unionByName(out.select("id", F.explode("flags").alias("flag"), F.lit(None).cast("string").alias("value")))
        unchecked = out.where("unseen and (deadline is not null or abstract_deadline is not null)")
        flags = flags.unionByName(unchecked.select("id", F.lit("no start to check against").alias("flag"), F.lit(None).cast("string").alias("value")))
        for f in ("deadline", "abstract_deadline"):
            evidence = evidence.unionByName(out.where(F.col(f).isNotNull()).select("id", F.lit(f).alias("field"), F.col(f"{f}_quote").alias("quote"), "url"))
        made.append(out.select(*columns, "root"))
        known = known.unionByName(made[-1])
    no_draft = now.limit(0).select("id", "title", "year", F.col("id").alias("after"))
    place = ordering.numbered(now.select("id", "ord"), F.col("ord"), F.col("id")).select("id", "place")
    if made:
        behind = reduce(DataFrame.unionByName, made).select("id", F.col("root").alias("after"), F.col("year").alias("seq"))
        place = ordering.behind(place, behind)
    rows = reduce(DataFrame.unionByName, [now, *(m.drop("root") for m in made)]).join(place.withColumnRenamed("place", "line"), "id")
    return Applied(rows, updates.select("id", "field", "old", "new"), reduce(DataFrame.unionByName, drafts, no_draft), flags, evidence)
