"""Messages that are handed over once: a stream of outboxes into a keyed ledger, and each batch's new messages from it.

A message is (target, event, day). The ledger keeps in which batch it was first seen, so what a batch has to send is
read from the ledger, not from the batch: a batch that runs again after a failure, or messages that come again later,
give the same messages to the same batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kalendry.sources.keyed import KeyedTable, add_new

SCHEMA = "target string, event string, day date, text string, batch long"
KEY = ["target", "event", "day"]


def ledger(spark: SparkSession, folder: str, buckets: int = 64) -> KeyedTable:
    return KeyedTable(spark, folder, SCHEMA, KEY, buckets)


def take(table: KeyedTable, messages: DataFrame, batch: int) -> DataFrame:
    """Records messages(target, event, day, text) as a batch's, and gives those that were not there before it."""
    add_new(table, messages.select(*KEY, "text", F.lit(batch).cast("long").alias("batch")), batch)
    return table.read().where(F.col("batch") == batch)


def run(messages: DataFrame, folder: str, buckets: int = 64, send=None) -> None:
    """A stream of messages into the ledger; send(frame, batch) gets each batch's new ones after their commit.

    A job that ends between commit and the end of send() sends that batch again: receivers know the batch by its number.
    """

    def each(batch: DataFrame, number: int) -> None:
        fresh = take(ledger(batch.sparkSession, folder, buckets), batch, number)
        if send:
            send(fresh, number)

    messages.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
