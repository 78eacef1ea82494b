"""Calendars, reports and digests as ordered rows of text.

Every document is a frame of (section, seq, line), so a long one is sorted and written by many tasks and is
never gathered into one cell. write_lines orders the rows into text files whose names keep that order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kalendry.functions import deadlines as dl


def calendar_events(rows: DataFrame) -> DataFrame:
    """rows(id, title, year, full_name, place, link, start, end, abstract_at, deadline_at; the last two as UTC
    instants) -> up to three entries each, numbered by `part`: the event (whole days), and an hour for each deadline.
    """
    name = F.concat_ws(" ", "title", F.col("year").cast("string"))
    none = F.lit(None).cast("string")

    def entry(part: int, kind: str, there: Column, summary: Column, about: Column, place: Column, first: Column, last: Column) -> Column:
        uid = F.concat(F.lit(f"{kind}-"), F.col("id").cast("string"), F.lit("@kalendry"))
        return F.when(there, F.struct(F.lit(part).alias("part"), uid.alias("uid"), summary.alias("summary"), about.alias("description"), place.alias("location"), first.alias("first"), last.alias("last")))

    day = lambda c: F.date_format(c, "yyyyMMdd")
    moment = lambda c: F.date_format(c, "yyyyMMdd'T'HHmmss'Z'")
    parts = [entry(0, "conf", F.col("start").isNotNull() & F.col("end").isNotNull(), name, F.col("full_name"), F.col("place"), F.concat(F.lit(";VALUE=DATE:"), day("start")), F.concat(F.lit(";VALUE=DATE:"), day(F.date_add("end", 1))))]
    for part, kind, word, at in ((1, "abstract", "Abstract", "abstract_at"), (2, "deadline", "Paper", "deadline_at")):
        about = F.concat(F.lit(f"{word} submission deadline for "), F.col("full_name"))
        parts.append(entry(part, kind, F.col(at).isNotNull(), F.concat(F.lit(f"{word} Deadline: "), name), about, none, F.concat(F.lit(":"), moment(at)), F.concat(F.lit(":"), moment(F.col(at) + F.expr("interval 1 hour")))))
    return rows.select("id", "link", F.explode(F.array_compact(F.array(*parts))).alias("e")).select("id", "e.*", F.col("link").alias("url"))


def escaped(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"([,;\\])", r"\\$1"), "\n", r"\\n")


def calendar_block(stamp: Column) -> Column:
    """The lines of one calendar entry, joined by CRLF; absent parts are left out."""
    given = lambda tag, c: F.when(F.nullif(c, F.lit("")).isNotNull(), F.concat(F.lit(f"{tag}:"), c))
    lines = [
        F.lit("BEGIN:VEVENT"),
        F.concat(F.lit("UID:"), F.col("uid")),
        F.concat(F.lit("DTSTAMP:"), F.date_format(stamp, "yyyyMMdd'T'HHmmss'Z'")),
        F.concat(F.lit("DTSTART"), F.col("first")),
        F.concat(F.lit("DTEND"), F.col("last")),
        F.concat(F.lit("SUMMARY:"), escaped(F.col("summary"))),
        given("DESCRIPTION", escaped(F.col("description"))),
        given("LOCATION", escaped(F.col("location"))),
        given("URL", F.col("url")),
        F.lit("END:VEVENT"),
    ]
    return F.concat_ws("\r\n", *lines)


def _fixed(spark: SparkSession, section: int, *lines: str) -> DataFrame:
    return spark.createDataFrame([(section, i, line) for i, line in enumerate(lines)], "section int, seq long, line string")


def calendar(rows: DataFrame, ord_: str, stamp: Column) -> DataFrame:
    """The whole calendar of rows in the order of ord_ (a number), as (section, seq, line)."""
    spark = rows.sparkSession
    places = rows.select(F.col("id"), F.col(ord_).cast("long").alias("__at"))
    body = calendar_events(rows).join(places, "id").select(F.lit(1).alias("section"), (F.col("__at") * 3 + F.col("part")).alias("seq"), calendar_block(stamp).alias("line"))
    head = _fixed(spark, 0, "BEGIN:VCALENDAR", "VERSION:2.0", "PRODID:-//kalendry//EN", "CALSCALE:GREGORIAN")
    return head.unionByName(body).unionByName(_fixed(spark, 2, "END:VCALENDAR"))


def write_lines(lines: DataFrame, folder: str, line_end: str = "\n") -> None:
    lines.orderBy("section", "seq").select("line").write.mode("overwrite").option("lineSep", line_end).text(folder)


def _section(section: int, head: list[str], rows: DataFrame, line: Column) -> DataFrame:
    """A heading if there is any row, the rows' lines, an empty line."""
    edges = lambda at, lines: rows.limit(1).select(F.posexplode(F.array(*map(F.lit, lines))).alias("p", "line")).select(F.lit(section).alias("section"), (F.col("p") + F.lit(at)).cast("long").alias("seq"), "line")
    return edges(-len(head), head).union(rows.select(F.lit(section).alias("section"), F.col("seq").cast("long"), line.alias("line"))).union(edges(2**62, [""]))


def report(title: str, updates: DataFrame, drafted: DataFrame, flags: DataFrame, skipped: DataFrame) -> DataFrame:
    """A run's outcome in Markdown: updates(seq, id, field, old, new), drafted(seq, id, title, year), flags(seq,
    message; each message once, where it came first), skipped(seq, message); seq from 0.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    once = flags.groupBy("message").agg(F.min("seq").alias("seq"))
    any_ = updates.select(F.lit(1)).union(drafted.select(F.lit(1))).limit(1).agg(F.count(F.lit(1)).alias("n"))
    nothing = any_.where("n = 0").select(F.posexplode(F.array(F.lit("No changes."), F.lit(""))).alias("seq", "line")).select(F.lit(1).alias("section"), F.col("seq").cast("long"), "line")
    item = F.concat(F.lit("- "), text("message"))
    parts = [
        _fixed(updates.sparkSession, 0, f"## {title}", ""),
        nothing,
        _section(2, ["### Updated entries", "", "| Entry | Field | Old | New |", "|---|---|---|---|"], updates, F.concat(F.lit("| "), F.concat_ws(" | ", text("id"), text("field"), text("old"), text("new")), F.lit(" |"))),
        _section(3, ["### New editions drafted", ""], drafted, F.concat(F.lit("- "), text("id"), F.lit(" ("), text("title"), F.lit(" "), text("year"), F.lit(")"))),
        _section(4, ["### Needs attention", ""], once, item),
        _section(5, ["### Skipped", ""], skipped, item),
    ]
    return reduce(DataFrame.union, parts)


def digest(sections: list[tuple[str, DataFrame]], most: int = 10) -> DataFrame:
    """Each section's rows(days_left, ord, line), soonest first, `most` of them, then how many more there are.

    The first rows come from a top-k and the rest from a count, so no section is ever sorted whole.
    """
    parts = []
    for number, (title, rows) in enumerate(sections):
        at = lambda seq, line: (F.lit(number).alias("section"), seq.cast("long").alias("seq"), line.alias("line"))  # noqa: E731, B023
        best = rows.orderBy("days_left", "ord").limit(most).agg(F.array_sort(F.collect_list(F.struct("days_left", "ord", "line"))).alias("top"))
        n = rows.agg(F.count(F.lit(1)).alias("n"))
        parts.append(n.where("n > 0").select(*at(F.lit(0), F.lit(title))))
        parts.append(best.select(F.posexplode("top").alias("p", "r")).select(*at(F.col("p") + 1, F.col("r.line"))))
        parts.append(n.where(F.col("n") > most).select(*at(F.lit(most + 1), F.concat(F.lit("+ "), (F.col("n") - most).cast("string"), F.lit(" more")))))
    return reduce(DataFrame.union, parts)


#: Fixed: assumed prices of a million tokens.
PRICE_IN, PRICE_OUT = 0.75, 4.5


def usage_sections(quotes: DataFrame, usage: DataFrame) -> DataFrame:
    """A run's evidence and use of tokens: quotes(seq, id, field, quote, url), usage(seq, venue, tier or null,
    submitted, tokens_in, tokens_out). Quotes lose line breaks, have their bars escaped and end at 200 characters.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    quote = F.left(F.trim(F.regexp_replace(F.regexp_replace(text("quote"), r"(?U)\s+", " "), r"\|", r"\\|")), F.lit(200))
    row = F.concat(F.lit("| "), F.concat_ws(" | ", text("id"), text("field"), quote, text("url")), F.lit(" |"))
    tier = F.concat(F.lit("tier "), F.col("tier").cast("string"))
    where = F.when(F.col("tier").isNull(), "failed").when(F.col("submitted"), tier).otherwise(F.concat(tier, F.lit(", found nothing")))
    each = F.concat(F.lit("- "), text("venue"), F.lit(": "), where, F.lit(", "), (F.col("tokens_in") + F.col("tokens_out")).cast("string"), F.lit(" tokens"))
    sums = usage.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens_in", "tokens_out")])
    cost = (F.col("tokens_in") * PRICE_IN + F.col("tokens_out") * PRICE_OUT) / 1_000_000
    total = F.concat(F.lit("Total: "), F.col("tokens_in").cast("string"), F.lit(" input + "), F.col("tokens_out").cast("string"), F.lit(" output tokens, est. $"), F.format_string("%.3f", cost))
    last = sums.select(F.posexplode(F.array(F.lit(""), total, F.lit(""))).alias("seq", "line")).select(F.lit(3).alias("section"), F.col("seq").cast("long"), "line")
    return reduce(
        DataFrame.union,
        [
            _section(0, ["### Evidence", "", "| Entry | Field | Source quote | Page |", "|---|---|---|---|"], quotes, row),
            _fixed(usage.sparkSession, 1, "### Usage", ""),
            usage.select(F.lit(2).alias("section"), F.col("seq").cast("long"), each.alias("line")),
            last,
        ],
    )


#: Fixed: marks of subjects and of days left.
SUBJECT_MARKS = {
    "ML": "🤖", "CV": "👁️", "NLP": "💬", "DM": "📊", "HCI": "🖱️", "SEC": "🔒", "SE": "⚙️", "AI": "🧠", "Global Health": "🏥", "Health AI": "🏥",
}
SUBJECT_NAMES = {
    "ML": "Machine Learning", "CV": "Computer Vision", "NLP": "Natural Language Processing", "DM": "Data Mining", "HCI": "Human-Computer Interaction",
    "SEC": "Security", "SE": "Software Engineering", "AI": "Artificial Intelligence",
}
URGENCY_MARKS = {"urgent": "🔴", "soon": "🟡", "month": "🟢", "later": "📅"}


def _mapped(table: dict, key: Column, other: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key), other)


def card(kind: str) -> Column:
    """The lines on one event, joined by line breaks: kind deadline (needs label, at) or event (place, at).

    Columns title, year, sub (array), days_left; unknown subjects are shown by their code.
    """
    tag = F.array_join(F.transform("sub", lambda s: F.concat(_mapped(SUBJECT_MARKS, s, F.lit("📌")), F.lit(" "), _mapped(SUBJECT_NAMES, s, s))), ", ")
    head = F.concat(_mapped(URGENCY_MARKS, dl.urgency(F.col("days_left")), F.lit("")), F.lit(" *"), F.col("title"), F.lit(" "), F.col("year").cast("string"), F.lit("*  "), tag)
    day = F.date_format("at", "MMM d, yyyy")
    if kind == "deadline":
        return F.concat_ws("\n", head, F.concat(F.lit("📝 "), F.col("label"), F.lit(": *"), day, F.lit("*")), F.concat(F.lit("⏰ "), dl.due_in(F.col("days_left"))))
    place = F.when(F.nullif("place", F.lit("")).isNotNull(), F.concat(F.lit("📍 "), F.col("place")))
    return F.concat_ws("\n", head, place, F.concat(F.lit("📆 Starts *"), day, F.lit("* · "), dl.starting_in(F.col("days_left"))))
