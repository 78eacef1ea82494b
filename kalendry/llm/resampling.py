"""Operator 13: importance resampling towards a target, with n-gram checksums put together from those of words.

Words are lower-cased (A-Z) runs of digits, letters and characters beyond ASCII; features are all runs of one to
three words joined by a blank. A feature's bucket is its CRC-32 modulo BUCKETS. The text of an n-gram is never made:
each word's CRC is taken once, and since CRC-32 is linear over GF(2), crc(A + B) is crc(A) carried over the bytes of
B by a 32 x 32 bit matrix, added to crc(B). The matrices of all lengths up to NEAR bytes are kept as byte tables;
longer ones are products of those of powers of two.

Corpus and target are counted into the same buckets (one row a bucket leaves each task). A bucket's gain compares
both; a document's weight is the sum of its features' gains. Adding Gumbel noise, fixed by the id, and taking the
highest scores draws without replacement in proportion to the weights. The draw is by a dense rank over ranges of
scores, so no task sorts them all.

Defined cases: null and empty texts have no features, weight 0 and are never drawn (under MIN_WORDS words); a null
doc_id hashes as empty text; repeated rows are rows of their own; an empty corpus gives no rows, an empty target
counts as T = 0. Columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import functools
import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kalendry.llm.common import id_and_text, materialize, parts_of, prepare
from kalendry.operators.ordering import numbered

BUCKETS, LONGEST, MIN_WORDS, PERCENT = 10_000, 3, 20, 5
#: Lengths in bytes whose matrices are kept one by one.
NEAR = 64
#: Characters of text made into features at once, and of longer texts at a time.
STRETCH = 1 << 20
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _times(m: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A bit matrix, given as the images of the 32 unit vectors, times each number of x."""
    out = np.zeros_like(x)
    for bit in range(32):
        out ^= np.where(x >> np.uint32(bit) & np.uint32(1), m[bit], np.uint32(0))
    return out


def _tables(m: np.ndarray) -> np.ndarray:
    """The matrix as four tables of 256: the image of each value of each byte."""
    byte = np.arange(256, dtype=np.uint32)
    return np.stack([_times(m, byte << np.uint32(8 * k)) for k in range(4)])


@functools.lru_cache(maxsize=1)
def shifts() -> tuple[np.ndarray, list[np.ndarray]]:
    """Tables that carry a CRC over 0 .. NEAR - 1 bytes, and over 2**k bytes."""
    unit = np.uint32(1) << np.arange(32, dtype=np.uint32)
    one = unit.copy()
    for _ in range(8):  # one zero bit: halve, and add the polynomial where a bit falls out
        one = np.where(one & np.uint32(1), one >> np.uint32(1) ^ np.uint32(0xEDB88320), one >> np.uint32(1))
    near, m = [], unit
    for _ in range(NEAR):
        near.append(_tables(m))
        m = _times(one, m)
    powers, m = [], one
    for _ in range(48):
        powers.append(_tables(m))
        m = _times(m, m)
    return np.stack(near), powers


def carry(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Each CRC (uint32) carried over so many bytes."""
    near, powers = shifts()
    short = np.minimum(length, NEAR - 1)
    flat, at = near.reshape(-1), short * 1024
    out = flat[at + (crc & 255)] ^ flat[at + 256 + (crc >> 8 & 255)] ^ flat[at + 512 + (crc >> 16 & 255)] ^ flat[at + 768 + (crc >> 24)]
    far = np.nonzero(length >= NEAR)[0]
    if len(far):
        x, n = crc[far], length[far]
        for k, t in enumerate(powers):
            if not (n >> k).any():
                break
            own = np.nonzero(n >> k & 1)[0]
            y = x[own]
            x[own] = t[0][y & 255] ^ t[1][y >> 8 & 255] ^ t[2][y >> 16 & 255] ^ t[3][y >> 24]
        out[far] = x
    return out


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words as UTF-8: every byte of a character beyond ASCII is 0x80 or more, so bytes split as characters do."""
    return _WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))


def features(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all features of each text, and which text each is of."""
    counts = np.array([len(w) for w in words], np.int64)
    total = int(counts.sum())
    crc = np.fromiter(map(zlib.crc32, chain.from_iterable(words)), np.uint32, total)
    length = np.fromiter(map(len, chain.from_iterable(words)), np.int64, total)
    owner = np.repeat(np.arange(len(words)), counts)
    # a blank and the word after it, as one stretch
    blank = carry(np.full(total, zlib.crc32(b" "), np.uint32), length) ^ crc
    buckets, owners, now = [crc % np.uint32(BUCKETS)], [owner], crc
    for n in range(1, min(LONGEST, total)):
        now = carry(now[:-1], length[n:] + 1) ^ blank[n:]
        own = owner[n:] == owner[:-n]
        buckets.append(now[own] % np.uint32(BUCKETS))
        owners.append(owner[n:][own])
    return np.concatenate(buckets).astype(np.int64), np.concatenate(owners)


def _stretches(texts: list[str | None]):
    """(words of each text or part of a text, which text each part is of, words of it that came before and only lead in).

    A long text is taken in parts; each repeats the last words of the part before, whose own features are not counted again.
    """
    for first, last in parts_of(texts, STRETCH):
        words = [words_of(t) for t in texts[first:last]]
        if last - first == 1 and len(words[0]) > STRETCH:
            for at in range(0, len(words[0]), STRETCH):
                lead = min(at, LONGEST - 1)
                yield first, [words[0][at - lead : at + STRETCH]], lead
        else:
            yield first, words, 0


def _buckets(texts: list[str | None]):
    """(first text, number of texts, words of each, buckets, owners) of stretches of texts; owners count from the first."""
    for first, words, lead in _stretches(texts):
        buckets, owners = features(words)
        counts = np.array([len(w) for w in words], np.int64)
        if lead:  # features among the leading words alone belong to the part before
            again, own = features([words[0][:lead]])
            yield first, 1, counts - lead, (buckets, owners), (again, own)
        else:
            yield first, len(words), counts, (buckets, owners), None


def _count(batches):
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for _, _, _, (buckets, _), again in _buckets(batch.column("text").to_pylist()):
            total += np.bincount(buckets, minlength=BUCKETS)
            if again:
                total -= np.bincount(again[0], minlength=BUCKETS)
    some = np.nonzero(total)[0]
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How many features of all texts fall in each bucket: BUCKETS numbers, whatever the table's size."""
    prepare(texts.sparkSession)
    rows = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(_count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of how much likelier a bucket is in the target), one more counted in each bucket."""
    s, t = corpus.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def _weigh(batches, gain: np.ndarray):
    for batch in batches:
        texts = batch.column("text").to_pylist()
        n_words, n, weight = (np.zeros(len(texts), np.int64) for _ in range(3))
        for first, size, counts, (buckets, owners), again in _buckets(texts):
            own = slice(first, first + size)
            n_words[own] += counts
            for sign, b, o in ((1, buckets, owners), (-1, *(again or ((), ())))):
                if len(b):
                    n[own] += sign * np.bincount(o, minlength=size)
                    # sums of whole numbers stay exact in doubles up to 2**53
                    weight[own] += sign * np.bincount(o, gain[b], minlength=size).astype(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words), pa.array(n), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: str = "42") -> DataFrame:
    """doc_id, n_features, weight, score, rank (from 1 by falling score; null where a document is not drawn), for every row.

    Of the N rows with MIN_WORDS words and more, floor(percent * N / 100) are drawn; ties go to the smaller doc_id.
    """
    gain = gains(bucket_counts(docs), bucket_counts(target))
    rows = id_and_text(docs).mapInArrow(lambda it: _weigh(it, gain), "doc_id long, n_words long, n_features long, weight long")
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    scored = materialize(rows.withColumn("score", F.col("weight") + noise), "weights")
    able = F.col("n_words") >= MIN_WORDS
    drawn = scored.where(able).count() * percent // 100
    keys = (F.when(able, 0).otherwise(1), F.col("score").desc(), F.col("doc_id"), F.xxhash64("n_features", "weight"))
    rank = F.when(F.col("place") < drawn, F.col("place") + 1).alias("rank")
    return numbered(scored, *keys).select("doc_id", "n_features", "weight", "score", rank)
