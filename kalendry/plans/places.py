"""Queries on places in long orders, each with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from kalendry.operators import apply, ordering
from kalendry.plans.queries import query, table
from kalendry.sources import speakers
from kalendry.sources.shared import new_folder


@query("""WITH e AS (SELECT o_orderkey AS k, 'e' || o_orderkey AS id, row_number() OVER (ORDER BY o_orderkey) AS place FROM orders WHERE o_orderkey % 2 = 0),
d AS (SELECT 'd' || o_orderkey || '-' || s AS id, place, s FROM orders CROSS JOIN range(1, 3) AS t(s) LEFT JOIN e ON k = o_orderkey - o_orderkey % 2 WHERE o_orderkey % 5 = 0),
u AS (SELECT id, place, 0 AS s FROM e UNION ALL SELECT id, place, s FROM d)
SELECT id, row_number() OVER (ORDER BY place NULLS LAST, s, id) - 1 AS place FROM u""")
def file_order(spark, sf_dir):
    """A file's entries with two drafts each behind some of them; drafts whose predecessor is not there go to the end."""
    key = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    entries = ordering.numbered(o.where(key % 2 == 0).select(F.concat(F.lit("e"), key.cast("string")).alias("id"), key.alias("k")), F.col("k")).select("id", "place")
    drafts = o.where(key % 5 == 0).select(key, F.concat(F.lit("e"), (key - key % 2).cast("string")).alias("after"), F.explode(F.array(F.lit(1), F.lit(2))).alias("seq"))
    drafts = drafts.select(F.concat(F.lit("d"), key.cast("string"), F.lit("-"), F.col("seq").cast("string")).alias("id"), "after", "seq")
    return ordering.behind(entries, drafts)


@query("""SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS place FROM orders QUALIFY place BETWEEN 1188 AND 1199""")
def deep_page(spark, sf_dir):
    """Page 100 of a list by price, without a task that sorts it all."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice")
    return ordering.page(rows, 100, 12, F.col("o_totalprice").desc(), F.col("id")).select("id", "place")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS id, c_name || ': "' || c_mktsegment || '"' AS name, CASE c_custkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS images, count(o_orderkey) AS talks, min(o_orderkey) AS first_year,
max(CASE WHEN o_orderkey IS NOT NULL THEN o_orderpriority || ' # ' || o_orderstatus END) AS last_topic FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name, c_mktsegment""")
def speakers_reread(spark, sf_dir):
    """Customers as speakers with their orders as presentations, written as files of entries and read back."""
    key = F.col("c_custkey").cast("string")
    talk = F.struct(F.concat("o_orderpriority", F.lit(" # "), "o_orderstatus").alias("topic"), F.lit("line\nline").alias("event"), F.lit("summit").alias("eventType"), F.col("o_orderkey").cast("int").alias("year"))
    talks = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_list(talk).alias("presentations"))  # a speaker's own, one entry of a file
    kind = F.col("c_custkey") % 3
    images = F.when(kind == 1, F.array(F.lit("/a.jpeg"))).when(kind == 2, F.array(F.lit("/a.jpeg"), F.lit("/b: c.jpeg")))
    rows = table(spark, sf_dir, "customer").join(talks, "c_custkey", "left").select(F.col("c_custkey").alias("ord"), key.alias("id"), F.concat("c_name", F.lit(': "'), "c_mktsegment", F.lit('"')).alias("name"), images.alias("image_urls"), "presentations")
    folder = new_folder(spark, "speakers")
    speakers.write(rows, folder)
    back = speakers.with_counts(speakers.from_files(spark, [folder]))
    return back.select("id", "name", F.coalesce(F.size("image_urls"), F.lit(0)).alias("images"), F.col("given").cast("long").alias("talks"), F.array_min("presentations.year").cast("long").alias("first_year"), F.array_max("presentations.topic").alias("last_topic"))


@query("""WITH e AS (SELECT o_custkey AS t, year(o_orderdate) AS y, min(o_orderkey) AS k, min(o_orderdate) AS d FROM orders GROUP BY ALL),
l AS (SELECT *, 't' || t || 'x' AS p, t % 2 = 0 AND t % 3 = 2 AS late FROM e QUALIFY row_number() OVER (PARTITION BY t ORDER BY y DESC) = 1),
n AS (SELECT *, p || right(CAST(y AS VARCHAR), 2) AS id, p || right(CAST(y + 1 AS VARCHAR), 2) AS draft, strftime(d, '%Y-%m-%d 12:00') AS old, strftime(d + INTERVAL 1 DAY * CAST(90 * (t % 3) AS INTEGER), '%Y-%m-%d 12:00') AS new FROM l),
o AS (SELECT 't' || t || 'x' || right(CAST(y AS VARCHAR), 2) AS id, k, 0 AS s FROM e UNION ALL SELECT draft, k, 1 FROM n)
SELECT 'update' AS kind, id, 'deadline' AS field, old || ' > ' || new AS value FROM n WHERE NOT late AND t % 3 > 0 AND t % 5 > 0
UNION ALL SELECT 'evidence', id, 'deadline', 'quote ' || t FROM n WHERE NOT late AND t % 3 > 0 AND t % 5 > 0 UNION ALL SELECT 'evidence', draft, 'deadline', 'next ' || t FROM n
UNION ALL SELECT 'flag', id, 'deadline after the start, dropped', new FROM n WHERE late UNION ALL SELECT 'flag', id, 'no start to check against', NULL FROM n WHERE t % 2 = 1
UNION ALL SELECT 'flag', id, 'deadline moved far', CAST(90 * (t % 3) AS VARCHAR) FROM n WHERE NOT late AND t % 3 > 0 AND t % 5 > 0
UNION ALL SELECT 'flag', id, 'deadline pinned', new FROM n WHERE NOT late AND t % 3 > 0 AND t % 5 = 0
UNION ALL SELECT 'flag', draft, unnest(['place kept', 'no start yet', 'no start to check against']), NULL FROM n
UNION ALL SELECT 'draft', draft, 'after', id FROM n
UNION ALL SELECT 'line', id, NULL, CAST(row_number() OVER (ORDER BY k, s) - 1 AS VARCHAR) FROM o""")
def applied_run(spark, sf_dir):
    """Customers as venues and their years of orders as editions, met by a page's news of the last year and of the next."""
    e = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("t"), F.year("o_orderdate").alias("year")).agg(F.min("o_orderkey").alias("ord"), F.min("o_orderdate").cast("date").alias("d"))
    named = lambda year: F.concat(F.lit("t"), "t", F.lit("x"), F.right(year.cast("string"), F.lit(2)))
    none = F.lit(None).cast("string")
    start = F.when(F.col("t") % 2 == 0, F.date_add("d", 100))
    noon = lambda c: F.date_format(c, "yyyy-MM-dd 12:00")
    pins = F.when(F.col("t") % 5 == 0, F.array(F.lit("deadline")))
    entries = e.select("ord", named(F.col("year")).alias("id"), F.concat(F.lit("t"), "t").alias("title"), "year", F.lit("UTC").alias("timezone"), none.alias("full_name"), F.lit("Rome").alias("place"), start.alias("start"), F.date_add(start, 3).alias("end"), none.alias("date"), noon("d").alias("deadline"), none.alias("abstract_deadline"), pins.alias("sync_pin"))
    last = e.groupBy("t").agg(F.max(F.struct("year", "d")).alias("l"))
    at = lambda days: F.date_add("l.d", days).cast("timestamp") + F.expr("interval 12 hours")
    news = F.array(F.struct(F.col("l.year").alias("year"), at((F.col("t") % 3 * 90).cast("int")).alias("at"), F.concat(F.lit("quote "), "t").alias("quote")), F.struct((F.col("l.year") + 1).alias("year"), at(F.lit(365)).alias("at"), F.concat(F.lit("next "), "t").alias("quote")))
    rows = last.select(F.concat(F.lit("t"), "t").alias("title"), F.explode(news).alias("n"))
    one = F.struct(F.col("n.at").alias("at"), F.col("n.quote").alias("quote"))
    editions = rows.select("title", "n.year", none.alias("full_name"), none.alias("location"), F.lit(None).cast("date").alias("start"), one.alias("paper"), F.lit(None).cast("struct<at:timestamp,quote:string>").alias("abstract"), F.lit(False).alias("multi_entry"), none.alias("url"))
    got = apply.apply(entries, editions)
    kind = lambda name, frame, *columns: frame.select(F.lit(name).alias("kind"), *[c.cast("string").alias(n) for c, n in zip(columns, ("id", "field", "value"), strict=True)])
    c = F.col
    parts = [kind("update", got.updates, c("id"), c("field"), F.concat("old", F.lit(" > "), "new")), kind("evidence", got.evidence, c("id"), c("field"), c("quote")), kind("flag", got.flags, c("id"), c("flag"), c("value")), kind("draft", got.drafts, c("id"), F.lit("after"), c("after")), kind("line", got.entries, c("id"), none, c("line"))]
    return reduce(lambda a, b: a.union(b), parts)
