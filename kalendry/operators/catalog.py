"""Catalogue queries: search, filters, facets, tiered order, paging, lookups, earlier editions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kalendry.functions.deadlines import start_at, start_days
from kalendry.functions.text import squeezed


def search(rows: DataFrame, query: str, *columns: str) -> DataFrame:
    """Substring match over the columns run together, without white space or case; a blank query matches all."""
    wanted = "".join(query.lower().split())
    if not wanted:
        return rows
    return rows.where(F.contains(squeezed(F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])), F.lit(wanted)))


def narrow(rows: DataFrame, subjects=(), year: int | None = None, types=()) -> DataFrame:
    """Any of the subjects, and the year, and any of the types; what is empty does not narrow."""
    if subjects:
        rows = rows.where(F.arrays_overlap("sub", F.array(*map(F.lit, subjects))))
    if year is not None:
        rows = rows.where(F.col("year") == year)
    return rows.where(F.col("type").isin(*types)) if types else rows


def upcoming(rows: DataFrame, at: str, asof: Column, limit: int = 0) -> DataFrame:
    """What is strictly ahead, soonest first; 0 is no limit."""
    out = rows.where(F.col(at) > asof).orderBy(at, "ord")
    return out.limit(limit) if limit else out


def page(rows: DataFrame, order: list[Column], number: int, size: int = 12) -> DataFrame:
    """Page `number` (from 1) in this order."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def tiered(rows: DataFrame, asof: Column) -> DataFrame:
    """Adds tier, key1, key2: order by these and ord.

    0: deadline ahead, soonest first. 1: no deadline and not over: dated by start, then undated by year.
    2: deadline past, latest first. 3: no deadline and over, latest start first.
    """
    day = lambda c: F.unix_date(c.cast("date"))
    first_day = F.make_date("year", F.lit(1), F.lit(1))
    start = F.coalesce(F.col("start").cast("date"), F.col("end").cast("date"), first_day)
    end = F.coalesce(F.col("end").cast("date"), F.col("start").cast("date"), F.make_date("year", F.lit(12), F.lit(31)))
    dated = F.col("start").isNotNull() | F.col("end").isNotNull()
    over = F.date_add(end, 1).cast("timestamp") <= asof
    at = F.col("next_at")
    tier = F.when(at > asof, 0).when(at.isNotNull(), 2).when(over, 3).otherwise(1)
    micros = F.unix_micros(at)
    key1 = F.when(tier == 0, micros).when(tier == 2, -micros).when(tier == 3, -day(start).cast("long")).otherwise(F.when(dated, F.lit(0)).otherwise(F.lit(1)).cast("long"))
    key2 = F.when(tier == 1, F.when(dated, day(start)).otherwise(F.col("year"))).otherwise(0).cast("long")
    return rows.withColumns({"tier": tier, "key1": key1, "key2": key2})


def facet(rows: DataFrame, values: Column, name: str) -> DataFrame:
    return rows.select(values.alias(name)).where(F.col(name).isNotNull()).distinct()


def lookup(rows: DataFrame, query: str) -> DataFrame:
    """One row: exact id (any case), else the first in file order whose title or full name holds the query."""
    wanted = "".join(query.lower().split())
    stage = F.when(F.lower("id") == query.lower(), 0).when((squeezed(F.col("title")) == wanted) | F.contains(squeezed(F.col("full_name")), F.lit(wanted)), 1)
    return rows.withColumn("stage", stage).where("stage is not null").orderBy("stage", "ord").limit(1)


def earlier_editions(rows: DataFrame, key: str, year: str, ord_: str, value: str) -> DataFrame:
    """Adds the latest earlier edition of the same key: previous_year and previous; of one year the last in order.

    Editions are reduced to one a year first; one window over years then reads the one before.
    """
    by_year = rows.groupBy(key, year).agg(F.max_by(value, ord_).alias("__last"))
    w = Window.partitionBy(key).orderBy(year)
    before = by_year.select(key, year, F.lag(year).over(w).alias("previous_year"), F.lag("__last").over(w).alias("previous"))
    return rows.join(before, [key, year])


def repeated(rows: DataFrame, *key: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def within(rows: DataFrame, days_left: Column, days: int) -> DataFrame:
    """Rows that are ahead by at most so many days, soonest first."""
    return rows.withColumn("days_left", days_left.cast("long")).where((F.col("days_left") <= days)).orderBy("days_left", "ord")


def extra_occurrences(rows: DataFrame, *key: str) -> DataFrame:
    """Each key once for every occurrence after its first: turn runs from 2 on."""
    return repeated(rows, *key).select(*key, F.explode(F.sequence(F.lit(2).cast("long"), "n")).alias("turn"))


def page_label(rows: DataFrame, number: int, size: int = 12) -> DataFrame:
    """One row: total, pages, and "a-b of n" of page `number` (empty if the page is)."""
    first = (number - 1) * size
    out = rows.agg(F.count(F.lit(1)).alias("total")).withColumn("pages", F.ceil(F.col("total") / size))
    text = F.concat_ws("", F.lit(f"{first + 1}-"), F.least(F.col("total"), F.lit(first + size)).cast("string"), F.lit(" of "), F.col("total").cast("string"))
    return out.withColumn("shown", F.when(F.col("total") > first, text).otherwise(""))


#: The orders that a list may be asked for, as sort keys after operators.catalog.tiered.
ORDERS = {
    "deadline": ["tier", "key1", "key2", "ord"],
    "start": ["-start", "ord"],
    "hindex": ["-hindex", "ord"],
}


def ordered(rows: DataFrame, by: str) -> DataFrame:
    """rows in one of ORDERS; an unknown name leaves them in their own order, by ord."""
    keys = [F.desc_nulls_last(k[1:]) if k.startswith("-") else F.asc(k) for k in ORDERS.get(by, ["ord"])]
    return rows.orderBy(*keys)


def upcoming_starts(rows: DataFrame, asof: Column, n: int | None = None) -> DataFrame:
    """rows(id, start, zone) that start today or later, with days_left, by the moment they start; n of them at most."""
    begun = rows.withColumns({"days_left": start_days(F.to_date("start"), F.col("zone"), asof), "begins": start_at(F.to_date("start"), F.col("zone"))})
    ahead = begun.where("days_left >= 0").orderBy("begins", "id").drop("begins")
    return ahead.limit(n) if n else ahead
