"""Operator 2: context-triggered piecewise hashing of whole texts.

Over the UTF-8 bytes of a text a rolling hash of the last seven bytes is taken at every place. A block
size b = 2^k cuts a chunk wherever the hash ends in k ones, so boundaries depend on nearby content alone;
every chunk becomes one of 64 letters by the sum of its mixed rolling hashes. The block size is the least
that expects no more than 48 chunks, doubled while there are more than 64 and halved while there are fewer
than 24 (never below 1), and a fingerprint reads "block:letters:letters at the double block size".
Two fingerprints are compared by edit distance (insertions and deletions) at equal block sizes, or at the
one size that they share if one is double the other; others have likeness 0. As chance alone gives long
signatures some likeness, signatures without a common run of five letters count as unlike.

Defined cases: a null text counts as empty; the empty text has the fingerprint "1::"; equal fingerprints
have likeness 1, also empty ones. The next document follows in ascending doc_id, nulls first, ties by text
hash, then text; rows equal in both are listed next to each other. A lone document is its own next one.
Columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kalendry.llm.common import id_and_text, mix, prepare

WINDOW, LETTERS, RUN = 7, 64, 5
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_PLACE = {c: i for i, c in enumerate(ALPHABET.tobytes().decode())}


def _rolling(raw: np.ndarray) -> np.ndarray:
    padded = np.concatenate([np.zeros(WINDOW - 1, np.uint32), raw.astype(np.uint32)])
    out = np.zeros(len(raw), np.uint32)
    for j in range(WINDOW):
        out = out * np.uint32(0x01000193) + padded[j : j + len(raw)]
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x85EBCA6B)
    return out ^ (out >> np.uint32(13))


def fingerprint(text: str) -> str:
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = len(raw)
    if not n:
        return "1::"
    h = _rolling(raw)
    k = max(0, int(np.ceil(np.log2(n / 48)))) if n > 48 else 0
    # places that end a chunk at the finest size ever needed; coarser sizes cut at a subset of them
    fine = max(0, k - 3)
    ends = np.nonzero((h & np.uint32((1 << fine) - 1)) == (1 << fine) - 1)[0]
    tops = h[ends]
    sums = np.cumsum(mix(h.astype(np.uint64)))

    def cuts(level: int) -> np.ndarray:
        low = np.uint32((1 << level) - 1)
        found = ends[(tops & low) == low] if level >= fine else np.nonzero((h & low) == low)[0]
        return found if len(found) and found[-1] == n - 1 else np.append(found, n - 1)

    at = cuts(k)
    while len(at) > LETTERS:
        k += 1
        at = cuts(k)
    while k and len(at) < 24:
        finer = cuts(k - 1)
        if len(finer) > LETTERS:
            break
        k, at = k - 1, finer

    def letters(at: np.ndarray) -> str:
        total = sums[at]
        chunk = np.concatenate([total[:1], total[1:] - total[:-1]])
        return ALPHABET[(mix(chunk) >> np.uint64(58)).astype(np.int64)].tobytes().decode()

    return f"{1 << k}:{letters(at)}:{letters(cuts(k + 1))}"


def likeness(pairs: list[tuple[str, str]]) -> np.ndarray:
    """Likeness (0 to 1) of each pair of fingerprints, many pairs at once on 64-bit words."""
    out = np.zeros(len(pairs))
    rows, x, y = [], [], []
    for i, (a, b) in enumerate(pairs):
        if a == b:
            out[i] = 1
            continue
        (p, p1, p2), (q, q1, q2) = a.split(":"), b.split(":")
        p, q = int(p), int(q)
        for s, t in [(p1, q1), (p2, q2)] if p == q else [(p1, q2)] if p == 2 * q else [(p2, q1)] if q == 2 * p else []:
            if s and t:
                rows.append(i)
                x.append(s)
                y.append(t)
    for first in range(0, len(rows), 4096):
        part = slice(first, first + 4096)
        np.maximum.at(out, rows[part], _word_likeness(x[part], y[part]))
    return out


def _word_likeness(x: list[str], y: list[str]) -> np.ndarray:
    n = len(x)
    nx, ny = np.array([len(s) for s in x]), np.array([len(s) for s in y])
    one, ones = np.uint64(1), ~np.uint64(0)

    def codes(words, size):
        table = np.full((n, LETTERS), -1, np.int64)
        flat = np.fromiter(map(_PLACE.__getitem__, "".join(words)), np.int64, int(size.sum()))
        table[np.arange(LETTERS) < size[:, None]] = flat
        return table

    cx, cy = codes(x, nx), codes(y, ny)
    where = np.zeros((n, len(ALPHABET)), np.uint64)
    every = np.arange(n)
    for j in range(LETTERS):
        has = cx[:, j] >= 0
        where[every[has], cx[has, j]] |= one << np.uint64(j)
    v = np.full(n, ones)
    need = np.minimum(RUN, np.minimum(nx, ny))
    runs = [np.zeros(n, np.uint64) for _ in range(RUN)]
    found = np.zeros(n, bool)
    for j in range(LETTERS):
        has = cy[:, j] >= 0
        m = np.where(has, where[every, np.maximum(cy[:, j], 0)], np.uint64(0))
        u = v & m
        v = (v + u) | (v - u)
        runs = [m] + [(runs[r - 1] << one) & m for r in range(1, RUN)]
        for r in range(RUN):
            found |= (need == r + 1) & (runs[r] != 0)
    zeros = LETTERS - np.bitwise_count(v | np.where(nx < LETTERS, ones << np.minimum(nx, 63).astype(np.uint64), np.uint64(0))).astype(np.int64)
    return np.where(found, 2 * zeros / (nx + ny), 0.0)


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _rows(batches):
    """Rows sorted by (part, guest, place); a part's guest is the first document of the next part."""
    held = None  # (part, doc_id, text, fingerprint)

    def flush(out):
        columns = list(zip(*out, strict=True)) or [()] * 7
        ids, sizes, shas, prints, edited, following = columns[:6]
        near = likeness(list(zip(prints, edited, strict=True)) + list(zip(prints, following, strict=True)))
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(shas, pa.string()), pa.array(prints, pa.string()), pa.array(edited, pa.string()), pa.array(near[: len(ids)]), pa.array(near[len(ids) :])],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    for batch in batches:
        out = []
        for part, guest, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("part", "guest", "doc_id", "text")), strict=True):
            if guest and (held is None or held[0] != part):
                continue  # the same guest listed twice
            mine = fingerprint(text)
            if held is not None and held[0] == part:
                new = _edited(held[2], text)
                out.append((held[1], len(held[2]), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), held[3], fingerprint(new), mine, None))
            held = None if guest else (part, doc_id, text, mine)
        yield flush(out)


def fingerprints(docs: DataFrame, rows_per_part: int = 20_000) -> DataFrame:
    """One row for each document: its fingerprint, and that of its text with the second half of the next document's start.

    The ids alone are scanned for range bounds and for the first document of each range; then each text
    moves once, to its range, where the neighbours meet. The first document of a range goes to the range
    before as well (that of the first range to the last one).
    """
    spark = docs.sparkSession
    prepare(spark)
    source = id_and_text(docs).withColumn("text", F.coalesce("text", F.lit("")))
    n = source.count()
    parts = min(max(1, n // rows_per_part), 100_000)
    bounds = sorted(set(source.where("doc_id is not null").approxQuantile("doc_id", [i / parts for i in range(1, parts)], min(0.001, 0.1 / parts)))) if parts > 1 else []
    edges = np.array(bounds, np.int64)

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, ids.to_numpy(), side="right").astype(np.int32))

    part = range_of(F.coalesce(F.col("doc_id"), F.lit(-(2**63)))) if len(edges) else F.lit(0)
    placed = source.select(part.cast("int").alias("part"), "doc_id", F.xxhash64("text").alias("tie"), "text")
    firsts = placed.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "tie")).alias("first")).orderBy("part").collect()
    if not firsts:
        heads = spark.createDataFrame([], "known boolean, doc_id long, tie long, target int")
    else:
        turned = [(r.first.known, r.first.doc_id, r.first.tie, firsts[i - 1].part) for i, r in enumerate(firsts)]
        heads = spark.createDataFrame(turned, "known boolean, doc_id long, tie long, target int")
    # one row for each range: its size is checked by the bound on parts above
    met = placed.join(F.broadcast(heads.select(F.col("doc_id").alias("head"), F.col("tie").alias("head_tie"), "target")), F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("tie") == F.col("head_tie")), "left")
    spread = met.select("doc_id", "tie", "text", F.explode(F.when(F.col("target").isNull(), F.array(F.struct("part", F.lit(False).alias("guest")))).otherwise(F.array(F.struct("part", F.lit(False).alias("guest")), F.struct(F.col("target").alias("part"), F.lit(True).alias("guest"))))).alias("at"))
    tasks = max(parts, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = spread.select("at.part", "at.guest", "doc_id", "tie", "text").repartition(tasks, "part").sortWithinPartitions("part", "guest", F.col("doc_id").asc_nulls_first(), "tie", "text")
    return dealt.select("part", "guest", "doc_id", "text").mapInArrow(_rows, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
