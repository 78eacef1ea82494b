"""Operator 1: near-duplicate classes by BagMinHash over multisets of word shingles.

A document is the multiset of its five-word shingles (lower case, split at white space; all words as one
shingle where there are fewer than five). Each shingle with weight w owns the dyadic levels [0,1), [1,2),
[2,4), [4,8) ... of the weight axis up to w; each level is a Poisson process whose points, in order of
time, fall on a random register and a random discretised weight, and count if that weight is below w. A
register keeps the earliest point that reaches it, so two documents agree in a register with a probability
of exactly their weighted Jaccard likeness. Points later than the time at which all registers are filled
are never made. The signature is cut into bands; equal bands make candidates, and every candidate is
verified on the multisets themselves.

Candidates within a band are not expanded into pairs. Each member is first verified against the band's
pivot (its least member). Only members that the pivot does not explain are then compared with the others
of their band, in blocks of bounded size inside tasks, which return links and never candidate pairs.

Defined cases: a null or wordless text is alone in its class. Texts that agree but for case and spacing are
one class. Rows equal in doc_id and text are one document listed twice and get the same class. A null
doc_id is kept, and never names a class unless the class has no other. Empty tables give empty results.
Columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kalendry.llm.common import carried, discard, id_and_text, materialize, mix, perhaps, prepare, restored, row_key, shingles, word_hashes
from kalendry.llm.components import components

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 20, 5
#: Members of a block of unexplained documents, and of the block they are compared with.
BLOCK_A, BLOCK_B = 400, 2000
#: In blocks, pairs whose signatures agree in less than threshold - SLACK of the registers (5 standard
#: deviations at 100 registers) are not verified.
SLACK = 0.2
_STEP = np.uint64(0x9E3779B97F4A7C15)


def multiset(text: str | None, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(shingles(word_hashes(text), size), return_counts=True)


def _key(text: str | None) -> bytes | None:
    """128 bits of the words of a text; null where there are none."""
    words = (text or "").lower().split()
    return xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "surrogatepass")) if words else None


def units(elements: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The multiset as a sorted set of 32-bit units, one for each occurrence: set overlap is multiset overlap."""
    each = np.repeat(elements, counts)
    turn = np.arange(len(each), dtype=np.uint64) - np.repeat((np.cumsum(counts) - counts).astype(np.uint64), counts)
    return np.unique(mix(each + turn * _STEP).astype(np.uint32))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two sorted unit sets."""
    if not len(a) or not len(b):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _draw(key: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    r = mix(key + np.uint64(2 * k + 1) * _STEP)
    s = mix(r + _STEP)
    return -np.log1p(-(r >> np.uint64(11)).astype(np.float64) * 2.0**-53), s


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], registers: int) -> np.ndarray:
    """BagMinHash of each bag (elements, integer weights), as uint32 (bags x registers); zeros for an empty bag."""
    n = len(bags)
    out = np.full(n * registers, np.inf)
    if not n or not sum(len(e) for e, _ in bags):
        return np.zeros((n, registers), np.uint32)
    element = np.concatenate([e for e, _ in bags])
    weight = np.concatenate([c for _, c in bags]).astype(np.int64)
    bag = np.repeat(np.arange(n), [len(e) for e, _ in bags])
    levels = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 2))).astype(np.int64), 0) + 1
    source = np.repeat(np.arange(len(element)), levels)
    level = np.arange(len(source)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)
    width = np.maximum(low, 1)
    key, most, owner = mix(element[source] + (level.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95)), weight[source], bag[source]
    total = np.bincount(bag, weight, n)
    horizon = (np.log(registers) + 5) / np.maximum(total, 1)
    rate = 1.0 / (width * registers)
    gap, mark = _draw(key, 0)
    at, turn = gap * rate, np.zeros(len(key), np.int64)
    marks = mark
    active = np.nonzero(at <= horizon[owner])[0]
    while True:
        while len(active):
            m = marks[active]
            register = ((m & np.uint64(0xFFFFFFFF)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
            height = low[active] + ((m >> np.uint64(32)) * width[active].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
            counts = height < most[active]
            np.minimum.at(out, (owner[active] * registers + register)[counts], at[active][counts])
            turn[active] += 1
            r = mix(key[active] + (2 * turn[active] + 1).astype(np.uint64) * _STEP)
            marks[active] = mix(r + _STEP)
            at[active] += -np.log1p(-(r >> np.uint64(11)).astype(np.float64) * 2.0**-53) * rate[active]
            active = active[at[active] <= horizon[owner[active]]]
        short = np.isinf(out.reshape(n, registers)).any(1) & (total > 0)
        if not short.any():
            break
        horizon[short] *= 2
        active = np.nonzero(short[owner] & (at <= horizon[owner]))[0]
    out[np.isinf(out)] = 0
    return out.astype(np.float32).view(np.uint32).reshape(n, registers)


def _sketch(batches, bands: int, rows: int, size: int):
    """(row, doc_id, text) -> (row, doc_id, key, bands, sig)."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        keys, bags = [_key(t) for t in texts], [multiset(t, size) for t in texts]
        sig = np.concatenate([signatures(bags[i : i + 250], bands * rows) for i in range(0, len(bags), 250)]) if bags else np.zeros((0, bands * rows), np.uint32)
        band = np.zeros((len(bags), bands), np.uint64)
        for r in range(rows):
            band = mix(band * _STEP + sig.reshape(len(bags), bands, rows)[:, :, r] + np.uint64(r + 1))
        band = mix(band + np.arange(bands, dtype=np.uint64) * _STEP).view(np.int64)
        byte = mix(sig.astype(np.uint64) + _STEP).astype(np.uint8)
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("doc_id"), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(len(bags) + 1) * bands, pa.int32()), pa.array(band.ravel(), pa.int64())), pa.array([x.tobytes() for x in byte], pa.binary())],
            names=["row", "doc_id", "key", "bands", "sig"],
        )


def _unit_rows(batches, size: int):
    for batch in batches:
        texts = batch.column("text").to_pylist()
        out = [units(*multiset(t, size)).tobytes() for t in texts]
        yield pa.RecordBatch.from_arrays([pa.array([_key(t) for t in texts], pa.binary()), pa.array(out, pa.binary())], names=["key", "units"])


def _verified(batches, threshold: float):
    """(a, b, left, right) -> the links (a, b) whose multisets are alike enough."""
    for batch in batches:
        good = [likeness(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)) >= threshold for x, y in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(good, pa.bool_())), batch.column("b").filter(pa.array(good, pa.bool_()))], names=["a", "b"])


def _block_links(table: pa.Table, threshold: float, registers: int) -> pa.Table:
    """Links between the unexplained documents of one block (side 0) and another block of their band (side 1)."""
    rows = table.to_pylist()
    left, right = [r for r in rows if r["side"] == 0], [r for r in rows if r["side"] == 1]
    a, b = [], []
    if left and right:
        sets = [np.frombuffer(r["units"], np.uint32) for r in right]
        flat, size = np.concatenate(sets), np.array([len(s) for s in sets])
        start = np.cumsum(size) - size
        sig = np.frombuffer(b"".join(r["sig"] for r in right), np.uint8).reshape(len(right), registers)
        root = {r["key"]: r["core"] for r in rows}
        for x in left:
            mine = np.frombuffer(x["units"], np.uint32)
            near = np.nonzero((sig == np.frombuffer(x["sig"], np.uint8)).mean(1) >= threshold - SLACK)[0]
            near = [j for j in near if right[j]["key"] != x["key"] and (right[j]["core"] != root[x["key"]])]
            for j in near:
                if right[j]["core"] != root[x["key"]] and likeness(mine, flat[start[j] : start[j] + size[j]]) >= threshold:
                    a.append(x["key"])
                    b.append(right[j]["key"])
                    old, new = root[x["key"]], right[j]["core"]
                    for r in rows:  # one class from here on: no need to verify within it again
                        if r["core"] == old:
                            r["core"] = new
                    root = {k: new if v == old else v for k, v in root.items()}
    return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})


def _near(batches, least: float, registers: int):
    """(a, b, sig, other) -> the pairs whose signatures agree in enough registers."""
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, registers) for c in ("sig", "other"))
        good = pa.array((x == y).mean(1) >= least)
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(good), batch.column("b").filter(good)], names=["a", "b"])


def _near_keys(table: pa.Table, least: float, registers: int) -> pa.Table:
    """Keys of one block that are near another key of their band by signature, unless one pivot explains both."""
    rows = table.to_pylist()
    left, right = [r for r in rows if r["side"] == 0], [r for r in rows if r["side"] == 1]
    out = set()
    if left and right:
        sig = np.frombuffer(b"".join(r["sig"] for r in right), np.uint8).reshape(len(right), registers)
        for x in left:
            near = [right[j]["key"] for j in np.nonzero((sig == np.frombuffer(x["sig"], np.uint8)).mean(1) >= least)[0]]
            if near != [x["key"]]:
                out.update(near)
    return pa.table({"key": pa.array(sorted(out), pa.binary())})


def _open_bands(member: DataFrame, links: DataFrame) -> DataFrame:
    """Members of the bands that their pivot does not explain wholly; of bands with the same members, one.

    Bands of two are done with the pivot. -> (band, key, pivot, core: linked to the pivot, n, open).
    """
    linked = links.select(F.col("a").alias("key"), F.col("b").alias("pivot"), F.lit(True).alias("core"))
    state = member.where("n > 2").drop("n").join(linked, ["key", "pivot"], "left").withColumn("core", F.coalesce("core", F.col("key") == F.col("pivot")))
    bands = state.groupBy("band").agg(F.sum((~F.col("core")).cast("long")).alias("open"), F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("key").cast("decimal(38,0)")).alias("members")).where("open > 0 and n > 1")
    once = bands.groupBy("members", "n", "open").agg(F.min("band").alias("band"))
    return state.join(once.select("band", "n", "open"), "band")


def _in_blocks(state: DataFrame):
    """Groups of at most about BLOCK_A unexplained members (side 0) and BLOCK_B members of their band (side 1)."""
    payload = [c for c in state.columns if c in ("sig", "units")]
    i_blocks, j_blocks = F.ceil(F.col("open") / BLOCK_A).cast("long"), F.ceil(F.col("n") / BLOCK_B).cast("long")
    spot = F.xxhash64("key", F.lit(7))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    left = state.where("not core").select("band", F.lit(0).alias("side"), "key", F.col("key").alias("core"), *payload, F.pmod(spot, i_blocks).alias("i"), every(j_blocks).alias("j"))
    right = state.select("band", F.lit(1).alias("side"), "key", F.when(F.col("core"), F.col("pivot")).otherwise(F.col("key")).alias("core"), *payload, every(i_blocks).alias("i"), F.pmod(spot, j_blocks).alias("j"))
    return left.union(right).groupBy("band", "i", "j")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row for each row of docs: (row, doc_id, class_key, class_id, class_size).

    class_id is the least doc_id of the class; row is the row's identity (common.row_key).
    """
    spark = docs.sparkSession
    prepare(spark)
    source = id_and_text(docs)
    sketch = materialize(
        source.withColumn("row", row_key()).mapInArrow(lambda it: _sketch(it, bands, rows, size), "row long, doc_id long, key binary, bands array<long>, sig binary"),
        "minhash-sketch",
    )
    texts = materialize(sketch.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sig").alias("sig")), "minhash-texts")
    member = texts.select("key", F.explode("bands").alias("band"))
    pivots = member.groupBy("band").agg(F.min("key").alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1")
    member = materialize(member.join(pivots, "band"), "minhash-members")
    signed = texts.select("key", "sig")

    # By signatures alone: members near their pivot, and in bands where some are not, who is near whom.
    left, right = (signed.select(F.col("key").alias(k), F.col("sig").alias(v)) for k, v in (("a", "sig"), ("b", "other")))
    near = member.where("key != pivot").select(F.col("key").alias("a"), F.col("pivot").alias("b")).distinct().join(left, "a").join(right, "b").select("a", "b", "sig", "other")
    near = materialize(near.mapInArrow(lambda it: _near(it, threshold - SLACK, bands * rows), "a binary, b binary"), "minhash-near")
    state = _open_bands(member, near).join(signed, "key")
    flagged = _in_blocks(state).applyInArrow(lambda t: _near_keys(t, threshold - SLACK, bands * rows), "key binary")
    used = materialize(near.select(F.col("a").alias("key")).union(near.select("b")).union(flagged).distinct(), "minhash-used")

    wanted = materialize(texts.select("key", "rep", "sig").join(used, "key"), "minhash-wanted")
    discard(texts)
    named = wanted.select("rep").distinct()
    maybe = perhaps(source, F.xxhash64("doc_id"), wanted.select(F.xxhash64("rep")))
    bodies = maybe.join(named, maybe.doc_id.eqNullSafe(named.rep)).select("text").mapInArrow(lambda it: _unit_rows(it, size), "key binary, units binary")
    bodies = materialize(bodies.join(wanted.select("key", "sig"), "key").dropDuplicates(["key"]), "minhash-units")

    def verify(pairs: DataFrame) -> DataFrame:
        left = bodies.select(F.col("key").alias("a"), F.col("units").alias("left"))
        right = bodies.select(F.col("key").alias("b"), F.col("units").alias("right"))
        return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(lambda it: _verified(it, threshold), "a binary, b binary")

    first = materialize(verify(near), "minhash-links")
    # What is near its pivot by signature but not in fact, or near others of its band only, is verified in blocks.
    state = _open_bands(member.join(used, "key", "left_semi"), first).join(bodies, "key")
    second = _in_blocks(state).applyInArrow(lambda t: _block_links(t, threshold, bands * rows), "a binary, b binary")

    roots = components(first.union(second), "minhash-components")
    known = sketch.select("row", "doc_id", "key").join(roots.withColumnRenamed("node", "key"), "key", "left")
    discard(member, near, used, wanted, bodies, first)
    known = materialize(known.select("row", "doc_id", F.coalesce("root", "key", F.unhex(F.hex("row"))).alias("class_key")), "minhash-classes")
    discard(sketch)
    classes = known.groupBy("class_key").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return known.join(classes, "class_key").select("row", "doc_id", "class_key", "class_id", "class_size")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs without all but one document of each class: the one with the least doc_id (then row identity)."""
    classes = near_duplicates(docs, **options)
    kept = classes.groupBy("class_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("least"))
    kept = kept.select(F.struct("least.doc_id", "least.row").alias("k_who"))  # one key for both steps: texts are dealt once
    marked = id_and_text(docs, carried(docs)).withColumn("who", F.struct("doc_id", row_key().alias("row")))
    met = marked.join(kept, F.col("who") == F.col("k_who"), "left_semi")
    return restored(met.dropDuplicates(["who"]), docs)
