"""Subscriptions in Spark's own state store: joins, leaves, dead channels, removed teams and posts, in any order.

Events (team, channel, at, seq, kind, name, added_by) are ordered by (at, seq), not by arrival:

- joined subscribes a channel, left and dead end that (dead: a post found the channel gone);
- removed ends all of a team's subscriptions before it (channel is null: the app was taken out, or its access ended);
- posted marks the last post to a subscribed channel; a new subscription starts without a mark.

What survives is the same for every split and order of batches: of a channel its latest membership event and latest
post, of a team its latest removal. The state of a team is dealt over PARTS keys by channel, so a team with a third of
all channels is no single key; removals go to all its parts. Channels are entries of a map state of their own, so a
batch reads and writes those it mentions and no others; a removal clears the entries that it ends. RocksDB keeps the
state outside the heap and checkpoints the changes alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: Keys that a team's channels are dealt over, and channels of one key that a batch holds before it meets the state.
PARTS, HELD = 16, 10_000
_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
#: Times in the state are microseconds.
_ENTRY = "at long, seq long, kind string, name string, added_by string, posted_at long, posted_seq long"
_CHANGE = "team string, channel string, active boolean, since long, name string, added_by string, last_posted long"
_change = Row(*(field.split()[0] for field in _CHANGE.split(", ")))


def _later(one, other):
    """The later of two (at, seq, ...) or None."""
    return one if other is None or (one is not None and one[:2] >= other[:2]) else other


def merged(entry: tuple | None, member: tuple | None, posted: tuple | None) -> tuple:
    """An entry with a later membership event (at, seq, kind, name, added_by) and a later post (at, seq)."""
    member = _later(member, entry[:5] if entry and entry[0] is not None else None)
    posted = _later(posted, entry[5:7] if entry and entry[5] is not None else None)
    return (*(member or (None,) * 5), *(posted or (None, None)))


def shown(entry: tuple) -> tuple:
    """(active, since, name, added_by, last_posted) of an entry; a post counts if it came after the subscription."""
    at, seq, kind, name, added_by, posted_at, posted_seq = entry
    if kind != "joined":
        return (False, None, None, None, None)
    return (True, at, name, added_by, posted_at if posted_at is not None and (posted_at, posted_seq) > (at, seq) else None)


class Subscriptions(StatefulProcessor):
    """State of one part of a team: its latest removal, and an entry for each channel that something is known of since."""

    def init(self, handle) -> None:
        self.gone = handle.getValueState("gone", "at long, seq long")
        self.channels = handle.getMapState("channels", "channel string", _ENTRY)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = self.gone.get() if self.gone.exists() else None
        gone, held = (tuple(before) if before else None), {}
        for r in rows:
            if r.kind == "removed":
                gone = _later((r.at, r.seq), gone)
                continue
            member, posted = held.get(r.channel, (None, None))
            if r.kind == "posted":
                posted = _later((r.at, r.seq), posted)
            else:
                member = _later((r.at, r.seq, r.kind, r.name, r.added_by), member)
            held[r.channel] = (member, posted)
            if len(held) >= HELD:
                yield from self._meet(key[0], held, gone)
                held = {}
        yield from self._meet(key[0], held, gone)
        if gone and (before is None or gone > tuple(before)):
            self.gone.update(gone)
            yield from self._clear(key[0], gone)

    def _meet(self, team: str, held: dict, gone: tuple | None) -> Iterator[Row]:
        for channel, (member, posted) in held.items():
            known = self.channels.getValue((channel,)) if self.channels.containsKey((channel,)) else None
            entry = merged(tuple(known) if known else None, member, posted)
            if gone and entry[0] is not None and entry[:2] <= gone:
                entry = (*(None,) * 5, *entry[5:])
            if gone and entry[5] is not None and entry[5:] <= gone:
                entry = (*entry[:5], None, None)
            if any(x is not None for x in entry):
                self.channels.updateValue((channel,), entry)
            elif known:
                self.channels.removeKey((channel,))
            yield _change(team, channel, *shown(entry))

    def _clear(self, team: str, gone: tuple) -> Iterator[Row]:
        """Entries that the removal ends; each goes through this once."""
        ended = [(k[0], tuple(v)) for k, v in self.channels.iterator() if (v[0] is None or (v[0], v[1]) <= gone) and (v[5] is None or (v[5], v[6]) <= gone)]
        for channel, _ in ended:
            self.channels.removeKey((channel,))
            yield _change(team, channel, False, None, None, None, None)

    def close(self) -> None:
        pass


def changes(events: DataFrame, parts: int = PARTS) -> DataFrame:
    """The stream of changes: what each channel that a batch touches looks like after it. Events without a team are left out."""
    part = F.pmod(F.xxhash64("channel"), F.lit(parts)).cast("int")
    every = F.sequence(F.lit(0), F.lit(parts - 1))
    names = [F.col(c) if c in events.columns else F.lit(None).cast("string").alias(c) for c in ("name", "added_by")]
    rows = events.where("team is not null and (channel is not null or kind = 'removed')").select(F.col("team").cast("string").alias("team"), F.col("channel").cast("string").alias("channel"), F.unix_micros(F.col("at").cast("timestamp")).alias("at"), F.col("seq").cast("long").alias("seq"), "kind", *names)
    dealt = rows.withColumn("part", F.explode(F.when(F.col("kind") == "removed", every).otherwise(F.array(part))))
    out = dealt.groupBy("team", "part").transformWithState(Subscriptions(), _CHANGE, "Update", "None")
    return out.withColumns({c: F.timestamp_micros(c) for c in ("since", "last_posted")})


@contextmanager
def _state_settings(spark: SparkSession):
    """The state store's settings while a query starts; the session's own are put back."""
    before = {k: spark.conf.get(k, None) for k in _SETTINGS}
    for k, v in _SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run(events: DataFrame, folder: str, parts: int = PARTS) -> None:
    """Takes in what the stream `events` holds now. folder is in the cluster's shared storage and keeps state and progress."""
    with _state_settings(events.sparkSession):
        query = changes(events, parts).writeStream.format("noop").outputMode("update").option("checkpointLocation", folder).trigger(availableNow=True).start()
    query.awaitTermination()


def current(spark: SparkSession, folder: str) -> DataFrame:
    """(team, channel, since, name, added_by, last_posted) of subscribed channels, read from the state by all tasks."""
    with _state_settings(spark):
        rows = spark.read.format("statestore").option("stateVarName", "channels").load(folder)
        gone = spark.read.format("statestore").option("stateVarName", "gone").load(folder)
    flat = rows.select("key.team", "key.part", F.col("user_map_key.channel").alias("channel"), "user_map_value.*")
    ends = gone.select("key.team", "key.part", F.struct("value.at", "value.seq").alias("gone"))
    met = flat.join(ends, ["team", "part"], "left").where("kind = 'joined'").where(F.col("gone").isNull() | (F.struct("at", "seq") > F.col("gone")))
    posted = F.when(F.struct("posted_at", "posted_seq") > F.struct("at", "seq"), F.timestamp_micros("posted_at"))
    return met.select("team", "channel", F.timestamp_micros("at").alias("since"), "name", "added_by", posted.alias("last_posted"))


def batch(events: DataFrame) -> DataFrame:
    """What current() gives after any run over these events, as one batch: aggregations and a join of what is left."""
    rows = events.where("team is not null").withColumn("team", F.col("team").cast("string"))
    names = [F.col(c) if c in events.columns else F.lit(None).cast("string").alias(c) for c in ("name", "added_by")]
    rows = rows.select("team", F.col("channel").cast("string").alias("channel"), F.col("at").cast("timestamp").alias("at"), F.col("seq").cast("long").alias("seq"), "kind", *names)
    order = F.struct("at", "seq")
    gone = rows.where("kind = 'removed'").groupBy("team").agg(F.max(order).alias("gone"))
    member = F.when(F.col("kind") != "posted", F.struct("at", "seq", "kind", "name", "added_by"))
    last = rows.where("channel is not null and kind <> 'removed'").groupBy("team", "channel").agg(F.max(member).alias("m"), F.max(F.when(F.col("kind") == "posted", order)).alias("p"))
    joined = last.where("m.kind = 'joined'").withColumn("own", F.struct("m.at", "m.seq")).join(gone, "team", "left").where(F.col("gone").isNull() | (F.col("own") > F.col("gone")))
    return joined.select("team", "channel", F.col("m.at").alias("since"), "m.name", "m.added_by", F.when(F.col("p") > F.col("own"), F.col("p.at")).alias("last_posted"))
