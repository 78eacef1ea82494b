"""Queries on venue configurations, recorded runs, extracted editions and speakers, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kalendry.functions import text as tx
from kalendry.operators import notify, runs, venues
from kalendry.plans.queries import query, table, text_of
from kalendry.sources import extraction, speakers


def _config(spark, sf_dir):
    """Nations as venues, by way of the configuration's JSON text."""
    key = F.col("n_nationkey")
    rows = table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("title"),
        F.when(key % 5 == 0, "no address").otherwise(F.concat(F.lit("HTTP://Ex.org/"), "n_nationkey", F.lit("/#top"))).alias("url"),
        F.when(key % 3 == 0, F.concat(F.lit("http://home.org/"), "n_nationkey")).alias("home"),
        F.concat("n_name", F.lit(".org")).alias("prefix"),
        F.when(key % 2 == 0, "Workshop").alias("suffix"),
    )
    return venues.venues(venues.config_text(rows))


def _keys(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("title"), F.col("n_nationkey").cast("long").alias("n"))


@query("SELECT n_name AS title, y AS year, n_name || '.org/' || y || CASE WHEN n_nationkey % 2 = 0 THEN '/Workshop' ELSE '/Conference' END AS key FROM nation, range(1998, 2001) AS t(y)")
def venue_editions(spark, sf_dir):
    rows = venues.editions(_config(spark, sf_dir), F.lit(1998).cast("long"))
    return rows.select("title", "year", "key")


@query("""SELECT n_name AS title, y AS year, CASE WHEN y = 1998 AND n_nationkey % 3 > 0 THEN 's' || n_nationkey END AS submission_id,
CASE WHEN y = 1998 AND n_nationkey % 3 = 1 THEN strftime(TIMESTAMP '1970-01-01' + INTERVAL 1 DAY * CAST(n_nationkey AS INTEGER), '%Y-%m-%d %H:%M:%S') END AS due FROM nation, range(1998, 2001) AS t(y)""")
def venue_records(spark, sf_dir):
    wanted = venues.editions(_config(spark, sf_dir), F.lit(1998).cast("long"))
    found = wanted.where("year = 1998").join(_keys(spark, sf_dir), "title")
    content = F.concat(F.lit('{"submission_id": {"value": "s'), "n", F.lit('"}}'))
    groups = found.where("n % 3 > 0").select("key", F.explode(F.array(F.lit(2), F.lit(1))).alias("ord"), content.alias("text"))
    groups = groups.select("key", "ord", F.when(F.col("ord") == 1, F.col("text")).otherwise("{}").alias("content"))
    invitations = found.where("n % 3 = 1").select(F.concat(F.lit("s"), "n").alias("id"), F.lit(1).alias("ord"), (F.col("n") * 86_400_000).alias("duedate"))
    rows = venues.with_records(wanted, groups, invitations)
    return rows.select("title", "year", "submission_id", text_of("due").alias("due"))


@query("SELECT n_name AS title FROM nation WHERE n_nationkey % 6 = 0")
def shared_venues(spark, sf_dir):
    rows = _config(spark, sf_dir)
    return venues.shared_titles(rows.where("suffix is not null"), rows.where("home is not null"))


@query("""WITH f AS (SELECT s_nationkey AS n, arg_min(s_suppkey, s_suppkey) AS s FROM supplier GROUP BY 1)
SELECT n_name AS title, CASE WHEN n_nationkey % 3 = 0 THEN 'http://home.org/' || n_nationkey WHEN s % 2 = 0 THEN 'http://entry.org/' || s
  WHEN n_nationkey % 5 = 0 THEN 'no address' ELSE 'HTTP://Ex.org/' || n_nationkey || '/#top' END AS home FROM nation LEFT JOIN f ON n = n_nationkey""")
def venue_homes(spark, sf_dir):
    link = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("http://entry.org/"), "s_suppkey"))
    entries = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("n"), F.col("s_suppkey").alias("ord"), F.coalesce(link, F.lit("")).alias("link"))
    entries = entries.withColumn("link", F.nullif("link", F.lit(""))).join(_keys(spark, sf_dir), "n")
    # a first entry without a link leaves the configured address, whatever later entries hold
    entries = entries.groupBy("title").agg(F.min(F.struct("ord", "link")).alias("e")).select("title", "e.ord", "e.link")
    return venues.homes(_config(spark, sf_dir), entries)


@query("""SELECT n_name AS title, CASE WHEN n_nationkey % 2 = 0 THEN 'http://ex.org/' || n_nationkey || '/new' WHEN n_nationkey % 5 = 0 THEN 'http://ex.org/' || n_nationkey
ELSE 'HTTP://Ex.org/' || n_nationkey || '/#top' END AS url, n_nationkey % 2 = 0 OR n_nationkey % 5 = 0 AS changed FROM nation""")
def moved_venues(spark, sf_dir):
    source = F.concat(F.lit("http://ex.org/"), "n", F.when(F.col("n") % 2 == 0, "/new").otherwise(""))
    found = _keys(spark, sf_dir).select("title", source.alias("source_url"))
    return venues.moved(_config(spark, sf_dir), found).select("title", "url", "changed")


@query("""WITH t AS (SELECT user_id AS run, event_id AS seq, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS turn FROM events)
SELECT run, min(seq) AS seq FROM t WHERE turn = 3 GROUP BY 1""")
def stuck_runs(spark, sf_dir):
    page = F.concat(F.when(F.col("event_id") % 2 == 0, "http://H.org/").otherwise("http://h.org/"), "event_type", F.when(F.col("event_id") % 3 == 0, "/#x").otherwise(""))
    return runs.stuck(table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("seq"), page.alias("url")))


@query("""SELECT c_custkey AS run, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus <> 'P'
  AND CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE '1-URGENT' END = '1-URGENT') AS known FROM customer""")
def known_sources(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    page = F.concat(F.lit("http://h.org/"), "o_orderpriority")
    read = o.select(F.col("o_custkey").alias("run"), page.alias("url"), F.when(F.col("o_orderkey") % 2 == 1, "http://h.org/1-URGENT/").alias("final_url"), (F.col("o_orderstatus") != "P").alias("ok"))
    submitted = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run"), F.lit("HTTP://H.org/1-URGENT#dates").alias("source_url"))
    return runs.sourced(submitted, read).select("run", "known")


@query("""SELECT o_orderkey AS id, CAST(year(o_orderdate) AS INTEGER) AS year, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS full_name,
strftime(o_orderdate, '%Y-%m-%d') AS start, strftime(o_orderdate, '%Y-%m-%d') AS deadline, CASE WHEN o_orderkey % 2 = 0 THEN 'AoE' END AS abstract_zone FROM orders WHERE o_orderkey % 7 > 0""")
def extracted_facts(spark, sf_dir):
    o, key, day = table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    one = lambda kind, date, zone: F.struct(F.lit(kind).alias("kind"), date.alias("date"), F.lit(zone).alias("timezone_text"))
    twice = F.array(one("paper", day, "UTC"), one("paper", F.lit("1900-01-01"), "UTC"))
    stated = F.when(key % 2 == 0, F.concat(twice, F.array(one("abstract", day, "AoE")))).otherwise(twice)
    edition = F.struct(F.year("o_orderdate").alias("year"), F.when(key % 3 == 0, "").otherwise(F.col("o_orderpriority")).alias("full_name"), day.alias("start_date"), F.lit("1900-01-02").alias("end_date"), stated.alias("deadlines"))
    answers = o.select(key.alias("id"), F.when(key % 7 == 0, "{not JSON").otherwise(F.to_json(F.struct(F.array(edition).alias("editions")))).alias("answer"))
    rows = extraction.editions(answers.where(extraction.readable(F.col("answer"))), F.col("answer"))
    rows = rows.select("id", *extraction.facts(F.col("edition")))
    return rows.select("id", "year", "full_name", "start", F.col("paper.date").alias("deadline"), F.col("abstract.timezone_text").alias("abstract_zone"))


@query("""SELECT c_mktsegment AS team, lpad(CAST(count(DISTINCT c_custkey) AS VARCHAR), CAST(greatest(2, length(CAST(count(DISTINCT c_custkey) AS VARCHAR))) AS INTEGER), '0') || ' members' AS label, count(o_orderkey) AS given
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def speaker_teams(spark, sf_dir):
    talks = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_list(F.struct(F.col("o_orderpriority").alias("title"))).alias("presentations"))
    rows = table(spark, sf_dir, "customer").join(talks, "c_custkey", "left").select("c_mktsegment", "presentations")
    teams = speakers.with_counts(rows).groupBy(F.col("c_mktsegment").alias("team")).agg(F.count(F.lit(1)).alias("n"), F.sum("given").alias("given"))
    return teams.select("team", speakers.members(F.col("n")).alias("label"), "given")


@query("SELECT page_id, left(sha256(url), 24) AS key FROM pages")
def page_keys(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.page_key(F.col("url")).alias("key"))


@query("SELECT s_suppkey FROM supplier WHERE s_acctbal > 0 AND EXISTS (SELECT 1 FROM nation WHERE n_nationkey = s_nationkey AND n_regionkey = 1)")
def active_channels(spark, sf_dir):
    records = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("team"), (F.col("s_acctbal") > 0).alias("on"))
    index = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("team"))
    return notify.active(index, records, "team", "on").select("s_suppkey")
