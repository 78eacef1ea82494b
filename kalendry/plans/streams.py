"""Queries that run as streams over the events table, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kalendry.plans.queries import _TS, query, text_of
from kalendry.sources.shared import new_folder
from kalendry.streaming import delivery, state

_KIND = "CASE WHEN event_type = 'signup' THEN 'joined' WHEN event_type = 'error' THEN 'left' WHEN event_type = 'view' THEN 'posted' WHEN event_type = 'click' AND event_id % 50 = 0 THEN 'removed' WHEN event_type = 'purchase' AND event_id % 9 = 0 THEN 'dead' END"


@query(f"""WITH e AS (SELECT 't' || user_id % 8 AS team, CAST(user_id AS VARCHAR) AS channel, ts, event_id, {_KIND} AS kind FROM events),
g AS (SELECT team, max((ts, event_id)) AS gone FROM e WHERE kind = 'removed' GROUP BY team),
m AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY ts DESC, event_id DESC) AS r FROM e WHERE kind IN ('joined', 'left', 'dead')),
p AS (SELECT channel, max((ts, event_id)) AS posted, max(ts) AS posted_ts FROM e WHERE kind = 'posted' GROUP BY channel)
SELECT m.team, m.channel, strftime(ts, {_TS}) AS since, CASE WHEN posted > (ts, event_id) THEN strftime(posted_ts, {_TS}) END AS last_posted
FROM m LEFT JOIN g ON g.team = m.team LEFT JOIN p ON p.channel = m.channel WHERE r = 1 AND kind = 'joined' AND (gone IS NULL OR (ts, event_id) > gone)""")
def subscription_store(spark, sf_dir):
    """The whole events table through the state store; the state is read back by a batch job."""
    path = f"{sf_dir}/events.parquet"
    # a pattern, as a stream takes a plain path for a folder, and the table may be one file
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/events.parque[t]")
    kind = F.expr(_KIND)
    rows = events.select(F.concat(F.lit("t"), F.col("user_id") % 8).alias("team"), F.when(kind != "removed", F.col("user_id").cast("string")).alias("channel"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), kind.alias("kind")).where("kind is not null")
    folder = new_folder(spark, "subscriptions")
    state.run(rows, folder)
    return state.current(spark, folder).select("team", "channel", text_of("since").alias("since"), text_of("last_posted").alias("last_posted"))


@query("""WITH m AS (SELECT 'u' || user_id AS target, event_type AS event, CAST(ts AS DATE) AS day, max(value) AS v FROM events WHERE event_type <> 'view' GROUP BY ALL)
SELECT target, count(*) AS messages, strftime(min(day), '%Y-%m-%d') AS first_day, CAST(0 AS BIGINT) AS again FROM m GROUP BY target""")
def delivered_once(spark, sf_dir):
    """A message a user, kind and day, handed to the ledger by a stream, and all of them again as later batches."""
    events = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(f"{sf_dir}/events.parque[t]")
    of = lambda rows: rows.where("event_type <> 'view'").select(F.concat(F.lit("u"), "user_id").alias("target"), F.col("event_type").alias("event"), F.to_date("ts").alias("day"), F.col("value").cast("string").alias("text"))
    folder = new_folder(spark, "ledger")
    delivery.run(of(events), folder)
    table = delivery.ledger(spark, folder)
    again = delivery.take(table, of(spark.read.parquet(f"{sf_dir}/events.parquet")), 10).count()
    rows = table.read().groupBy("target").agg(F.count(F.lit(1)).alias("messages"), F.date_format(F.min("day"), "yyyy-MM-dd").alias("first_day"))
    return rows.withColumn("again", F.lit(again).cast("long"))
