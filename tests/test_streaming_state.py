"""The subscription state store: equal to the batch over any split and order, through restarts, with small batches."""

import datetime
import os
import random

import pytest

from kalendry.streaming import state

SCHEMA = "team string, channel string, at timestamp, seq long, kind string, name string, added_by string"


def events(seed, n=400):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        kind = rng.choices(["joined", "left", "dead", "posted", "removed"], [5, 2, 1, 4, 0.3])[0]
        at = datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=rng.randrange(n // 2))
        out.append((f"T{rng.randrange(4)}", None if kind == "removed" else f"C{rng.randrange(25)}", at, i, kind, f"n{i}", f"u{i % 7}"))
    return out


def plain(rows):
    """Subscriptions by one pass in the order of (at, seq), as the events say."""
    open_ = {}
    for team, channel, at, _, kind, name, by in sorted(rows, key=lambda r: (r[2], r[3])):
        if kind == "joined":
            open_[team, channel] = [at, name, by, None]
        elif kind in ("left", "dead"):
            open_.pop((team, channel), None)
        elif kind == "removed":
            open_ = {k: v for k, v in open_.items() if k[0] != team}
        elif (team, channel) in open_:
            open_[team, channel][3] = at
    return sorted((*k, *v) for k, v in open_.items())


def take_in(spark, folder, rows):
    """A run of its own: every call starts the query again from what the last one left."""
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    state.run(spark.readStream.schema(SCHEMA).parquet(f"{folder}/in"), f"{folder}/state")
    return sorted(map(tuple, state.current(spark, f"{folder}/state").collect()))


def test_batch_is_a_pass_in_order(spark):
    for seed in range(3):
        rows = events(seed)
        assert sorted(map(tuple, state.batch(spark.createDataFrame(rows, SCHEMA)).collect())) == plain(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_equals_batch_over_any_split(spark, tmp_path, seed):
    rows = events(seed)
    shuffled = random.Random(seed).sample(rows, len(rows))
    cut = sorted(random.Random(seed + 9).sample(range(1, len(rows)), 2))
    folder = str(tmp_path)
    for a, b in zip([0, *cut], [*cut, len(rows)], strict=True):
        got = take_in(spark, folder, shuffled[a:b])
        assert got == plain(shuffled[:b])


def test_a_late_join_before_a_removal_stays_out(spark, tmp_path):
    t = [datetime.datetime(2024, 1, d) for d in range(1, 6)]
    assert take_in(spark, str(tmp_path), [("T", "a", t[0], 1, "joined", "a", None), ("T", "b", t[3], 4, "joined", "b", None), ("U", "c", t[0], 1, "joined", "c", None)]) == [("T", "a", t[0], "a", None, None), ("T", "b", t[3], "b", None, None), ("U", "c", t[0], "c", None, None)]
    assert take_in(spark, str(tmp_path), [("T", None, t[2], 3, "removed", None, None)]) == [("T", "b", t[3], "b", None, None), ("U", "c", t[0], "c", None, None)]
    late = [("T", "a", t[1], 2, "joined", "late", None), ("T", "b", t[4], 5, "posted", None, None), ("U", "c", t[1], 2, "dead", None, None), (None, "d", t[1], 2, "joined", None, None)]
    assert take_in(spark, str(tmp_path), late) == [("T", "b", t[3], "b", None, t[4])]


def test_a_small_batch_writes_little(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    take_in(spark, str(tmp_path), [(f"T{i % 5}", f"C{i}", t, i, "joined", "name " * 20, "u") for i in range(4000)])
    size = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(tmp_path / "state" / "state") for f in names)
    first = size()
    take_in(spark, str(tmp_path), [("T0", "C0", t, 9999, "left", None, None)])
    assert size() - first < first / 5
