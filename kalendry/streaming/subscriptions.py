"""Subscription state from join and leave events: latest event of a channel wins, uninstalling clears a team.

As a batch: one aggregation. As a stream: each micro-batch is reduced to its latest event a channel and
merged with the state so far into the next state table, so a run over any split of the events equals the batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def latest(events: DataFrame) -> DataFrame:
    """events(channel, at, seq, joined) -> one row a channel: its last event by (at, seq)."""
    return events.groupBy("channel").agg(F.max(F.struct("at", "seq", "joined")).alias("e")).select("channel", "e.*")


def active(events: DataFrame) -> DataFrame:
    return latest(events).where("joined").select("channel", F.col("at").alias("since"))


def active_of_teams(events: DataFrame) -> DataFrame:
    """events(channel, team, at, seq, kind: joined, left or removed) -> channels that are subscribed.

    `removed` takes a whole team out (its channel is null): what joined before goes, what joins later stays. Both
    sides are reduced to a row a channel and a row a team before they meet, so no team's channels are gathered.
    """
    last = events.where(F.col("kind") != "removed").groupBy("channel").agg(F.max(F.struct("at", "seq", "kind", "team")).alias("e")).select("channel", "e.*").where("kind = 'joined'")
    gone = events.where(F.col("kind") == "removed").groupBy("team").agg(F.max(F.struct("at", "seq")).alias("gone"))
    met = last.join(gone, "team", "left")
    return met.where(F.col("gone").isNull() | (F.struct("at", "seq") > F.col("gone"))).select("channel", "team", F.col("at").alias("since"))


def after_failures(active_: DataFrame, failures: DataFrame) -> DataFrame:
    """active without the channels that sending found gone, and without teams whose access has ended."""
    of_team = failures.where(F.col("error").isin("account_inactive", "token_revoked")).select("team").distinct()
    of_channel = failures.where(F.col("error").isin("channel_not_found", "is_archived", "not_in_channel")).select("channel").distinct()
    return active_.join(of_team, "team", "left_anti").join(of_channel, "channel", "left_anti")


def stream(spark: SparkSession, events: DataFrame, folder: str) -> DataFrame:
    """Runs the stream over what is there and returns the state; folder is in the cluster's shared storage."""

    def merge(batch: DataFrame, epoch: int) -> None:
        session = batch.sparkSession
        before = f"{folder}/state-{epoch - 1}"
        rows = batch.select("channel", "at", "seq", "joined")
        if epoch:
            rows = rows.unionByName(session.read.parquet(before))
        latest(rows).write.mode("overwrite").parquet(f"{folder}/state-{epoch}")  # a repeated epoch writes the same

    query = events.writeStream.foreachBatch(merge).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    # the newest state there is: a run without new events writes none
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    names = [s.getPath().getName() for s in fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(fs_path)]
    epochs = [int(n[6:]) for n in names if n.startswith("state-")]
    if not epochs:
        return latest(spark.createDataFrame([], "channel string, at timestamp, seq int, joined boolean")).where("joined").select("channel", F.col("at").alias("since"))
    return spark.read.parquet(f"{folder}/state-{max(epochs)}").where("joined").select("channel", F.col("at").alias("since"))
