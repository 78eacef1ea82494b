"""Operator 5: packing documents into sequences by cutting-stock column generation.

Every document becomes its ids and a closing id 0; whole sequences are cut off its front, and what remains
(1 to length - 1 ids) is an item. The items' histogram over lengths, which has a fixed size however large
the corpus is, is the demand of a cutting-stock problem. Its linear program is solved by column
generation: a revised simplex over patterns, for which a knapsack by dynamic programming prices the next
column. Patterns that fill a sequence but for SLACK ids are rounded down, then up as long as the items
suffice. Items are ranked within their length by a salted count, and rank and pattern give sequence and
place in closed form. Items that no pattern took form one stream in order of length, cut wherever a
sequence is full; its last sequences are powers of two, which need no padding.

Defined cases: a null text counts as empty and gives the id 0 alone. Rows that are equal in all columns are
packed each on its own. An empty table gives no rows. Columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import functools
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kalendry.llm.bpe import SPELL
from kalendry.llm.common import id_and_text, materialize, prepare

LENGTH = 1024
#: Ids that a pattern may leave empty; others only shape the stream of what is left.
SLACK = 4
#: Pivots of the linear program at most, its gap to the bound, and columns from one pricing.
ROUNDS, GAP, COLUMNS = 2000, 0.001, 20
#: Items of one length that share a rank counter.
PER_COUNTER = 100_000
LONG_BLANK = 1000


class Ids:
    """Texts to ids of a byte-level BPE file of the tokenizers library.

    The file's vocabulary is read into tiktoken, which encodes Latin text three times as fast to the same
    ids; other texts go to the tokenizers library itself, whose tables decide what a letter is, and so do texts with
    LONG_BLANK blanks in a row, for which tiktoken's pattern goes too deep.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        letters = {c: b for b, c in SPELL.items()}
        ranks = {bytes(map(letters.__getitem__, t)): i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items()}
        self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.apart = re.compile("|".join(["[^\0-\u024f\u2010-\u2027]", *map(re.escape, special), r"\s{%d}" % LONG_BLANK]))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian uint32 ids of each text."""
        slow = [i for i, t in enumerate(texts) if self.apart.search(t)]
        own = dict(zip(slow, self.tokenizer.encode_batch_fast([texts[i] for i in slow], add_special_tokens=False), strict=True))
        return [np.array(own[i].ids if i in own else self.fast(t), "<u4").tobytes() for i, t in enumerate(texts)]


@functools.lru_cache(maxsize=2)
def ids_of(path: str) -> Ids:
    """One for each Python worker."""
    return Ids(path)


def _cut(batches, path: str, length: int):
    """doc_id, doc_tokens, crcs of the whole sequences, then the item: its size, crc and ids."""
    encode = ids_of(path).encode
    for batch in batches:
        docs = batch.column("doc_id").to_pylist()
        texts = [t or "" for t in batch.column("text").to_pylist()]
        out = []
        for first in range(0, len(texts), 200):
            for doc, raw in zip(docs[first : first + 200], encode(texts[first : first + 200]), strict=True):
                raw += b"\0\0\0\0"
                n = len(raw) // 4
                rest = n % length
                tail = raw[4 * (n - rest) :]
                out.append((doc, n, [zlib.crc32(raw[4 * i : 4 * (i + length)]) for i in range(0, n - rest, length)], rest, zlib.crc32(tail), tail))
        columns = list(zip(*out, strict=True)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "doc_tokens", "crcs", "size", "crc", "ids"])


def knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> list[tuple[float, np.ndarray]]:
    """Patterns (copies of each size) that fit, best first: for each size the best pattern that holds it.

    One dynamic program over capacity gives the best value of every capacity; a size and the best of what
    it leaves make a candidate, so one pricing yields many columns.
    """
    some = np.nonzero(values > 1e-12)[0]
    s, v = sizes[some], values[some]
    if not len(s):
        return []
    upto = np.searchsorted(s, np.arange(capacity + 1), side="right")
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if upto[c]:
            total = v[: upto[c]] + best[c - s[: upto[c]]]
            j = int(total.argmax())
            if total[j] > best[c] + 1e-15:
                best[c], pick[c] = total[j], j
    worth = v + best[capacity - s]
    out, seen = [], set()
    for j in np.argsort(-worth)[: 4 * COLUMNS]:
        pattern = np.zeros(len(sizes))
        pattern[some[j]] += 1
        c = capacity - s[j]
        while c:
            if pick[c] < 0:
                c -= 1
            else:
                pattern[some[pick[c]]] += 1
                c -= s[pick[c]]
        if (name := pattern.tobytes()) not in seen:
            seen.add(name)
            out.append((float(worth[j]), pattern))
        if len(out) == COLUMNS:
            break
    return out


def first_basis(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """A feasible start: patterns from the largest size down, each run until one of its sizes is used up.

    Each pattern uses up another size, so the patterns are a triangular basis.
    """
    left = np.zeros(capacity + 1)
    left[sizes] = demand
    spot = np.zeros(capacity + 1, np.int64)
    spot[sizes] = np.arange(len(sizes))
    patterns, often, at = [], [], len(sizes) - 1
    while at >= 0:
        if left[sizes[at]] <= 0:
            at -= 1
            continue
        copies = {int(sizes[at]): 1}
        rest = capacity - int(sizes[at])
        while rest:
            if left[rest] > 0:  # one item fills it
                copies[rest] = copies.get(rest, 0) + 1
                break
            below = np.nonzero(left[:rest] > 0)[0]
            if not len(below):
                break
            two = below[left[rest - below] > 0]  # two items fill it
            take = int(two[-1] if len(two) else below[-1])
            copies[take] = copies.get(take, 0) + 1
            rest -= take
        runs = {size: left[size] / n for size, n in copies.items()}
        spent = min(runs, key=runs.get)
        n = runs[spent]
        pattern = np.zeros(len(sizes))
        for size, k in copies.items():
            pattern[spot[size]] = k
            left[size] -= k * n
        left[spent] = 0
        patterns.append((spot[spent], pattern))
        often.append((spot[spent], n))
    basis, x = np.zeros((len(sizes), len(sizes))), np.zeros(len(sizes))
    for (i, pattern), (_, n) in zip(patterns, often, strict=True):
        basis[:, i], x[i] = pattern, n
    for i in np.nonzero(~basis.any(0))[0]:  # used up to the last bit by another's pattern
        basis[i, i] = capacity // sizes[i]
    return basis, x


def cutting_stock(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = ROUNDS, gap: float = GAP) -> tuple[np.ndarray, np.ndarray]:
    """(patterns as columns, how often each): the linear program by column generation, to within gap of its bound."""
    m = len(sizes)
    basis, x = first_basis(sizes, demand, capacity)
    inverse = np.linalg.inv(basis)
    dual, pivots = inverse.sum(0), 0
    while pivots < rounds:
        columns = knapsack(sizes, dual, capacity)
        if not columns or columns[0][0] <= 1 + 1e-7 or dual @ demand / columns[0][0] >= x.sum() * (1 - gap):
            break
        for _, pattern in columns:
            gain = dual @ pattern - 1
            if gain <= 1e-7:
                continue
            step = inverse @ pattern
            ok = step > 1e-6
            if not ok.any():
                continue
            ratio = np.full(m, np.inf)
            ratio[ok] = x[ok] / step[ok]
            ties = np.nonzero(ratio <= ratio.min() + 1e-12)[0]
            out = int(ties[step[ties].argmax()])  # the largest pivot keeps the inverse sound
            x = np.maximum(x - ratio[out] * step, 0)
            x[out] = ratio[out]
            basis[:, out] = pattern
            row = inverse[out] / step[out]
            dual = dual - gain * row
            touched = np.nonzero(np.abs(step) > 1e-12)[0]
            inverse[touched] -= np.outer(step[touched], row)
            inverse[out] = row
            pivots += 1
        if np.abs(basis @ x - demand).max() > 1e-6 * demand.max():  # rounding has piled up: the counts below bound any harm
            break
    return basis, x


class Plan:
    """Where the item of a size and rank goes; made from the histogram alone."""

    def __init__(self, sizes: np.ndarray, demand: np.ndarray, length: int):
        self.length = length
        left = np.zeros(length, np.int64)
        left[sizes] = demand
        self.slots: dict[int, list[tuple[int, int, int, int]]] = {int(s): [] for s in sizes}  # first rank, copies in a pattern, sequence, offset
        taken = np.zeros(length, np.int64)
        sequence = 0
        if len(sizes):
            patterns, often = cutting_stock(sizes, demand.astype(float), length)
            full = [p for p in range(len(often)) if often[p] > 1e-9 and length - sizes @ patterns[:, p] <= SLACK]
            runs = dict.fromkeys(full, 0)
            for more in (lambda p: int(often[p] + 1e-9), lambda p: 1):
                for p in sorted(full, key=lambda p: -(often[p] % 1)):
                    used = np.nonzero(patterns[:, p])[0]
                    n = min([more(p), *(int(left[sizes[u]]) // int(patterns[u, p]) for u in used)])
                    for u in used:
                        left[sizes[u]] -= n * int(patterns[u, p])
                    runs[p] += n
            for p in full:
                if runs[p]:
                    offset = 0
                    for u in np.nonzero(patterns[:, p])[0]:
                        size, copies = int(sizes[u]), int(patterns[u, p])
                        self.slots[size].append((int(taken[size]), copies, sequence, offset))
                        taken[size] += copies * runs[p]
                        offset += copies * size
                    sequence += runs[p]
        self.stream = sequence  # sequences from here on hold the stream
        self.taken = taken
        total = np.arange(length) * left
        self.begin = np.concatenate([[0], np.cumsum(total)[:-1]])
        end = int(total.sum())
        whole, rest = divmod(end, length)
        # the stream's last ids, as sequences of powers of two
        self.tail = [whole * length]
        for bit in range(rest.bit_length() - 1, -1, -1):
            if rest >> bit & 1:
                self.tail.append(self.tail[-1] + (1 << bit))
        self.whole = whole
        self.sequences = self.stream + whole + len(self.tail) - 1

    def place(self, size: int, rank: int) -> list[tuple[int, int, int, int]]:
        """Pieces (first id, ids, sequence, offset) of the item of this size and rank (from 0)."""
        if rank < self.taken[size]:
            slots = self.slots[size]
            lo, hi = 0, len(slots)
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if slots[mid][0] <= rank else (lo, mid)
            first, copies, sequence, offset = slots[lo]
            turn, slot = divmod(rank - first, copies)
            return [(0, size, sequence + turn, offset + slot * size)]
        at = int(self.begin[size]) + (rank - int(self.taken[size])) * size
        end, out, done = at + size, [], 0
        while at < end:
            k = at // self.length
            if k < self.whole:
                low, high = k * self.length, (k + 1) * self.length
            else:
                k = next(i for i in range(1, len(self.tail)) if at < self.tail[i])
                low, high, k = self.tail[k - 1], self.tail[k], self.whole + k - 1
            n = min(end, high) - at
            out.append((done, n, self.stream + k, at - low))
            done, at = done + n, at + n
        return out


def _placed(batches, plan: Plan):
    for batch in batches:
        out = []
        for doc, total, size, crc, ids, rank in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "size", "crc", "ids", "rank")), strict=True):
            for first, n, sequence, offset in plan.place(size, rank):
                out.append((doc, total - size + first, n, crc if n == size else zlib.crc32(ids[4 * first : 4 * (first + n)]), total, sequence, offset))
        columns = list(zip(*out, strict=True)) or [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def pack(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    prepare(docs.sparkSession)
    cut = id_and_text(docs).mapInArrow(lambda it: _cut(it, path, length), "doc_id long, doc_tokens long, crcs array<long>, size int, crc long, ids binary")
    cut = materialize(cut, "packing-cut")
    histogram = cut.where("size > 0").groupBy("size").agg(F.count(F.lit(1)).alias("n")).orderBy("size").collect()  # at most length - 1 rows
    plan = Plan(np.array([r["size"] for r in histogram], np.int64), np.array([r.n for r in histogram], np.int64), length)

    counters = 1 + max((r.n for r in histogram), default=0) // PER_COUNTER
    items = cut.where("size > 0").select("doc_id", "doc_tokens", "size", "crc", "ids", F.pmod(F.xxhash64("doc_id", "doc_tokens", "crc"), F.lit(counters)).alias("counter"))
    counts = items.groupBy("size", "counter").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("size", "counter", (F.sum("n").over(Window.partitionBy("size").orderBy("counter")) - F.col("n")).alias("before"))
    order = Window.partitionBy("size", "counter").orderBy("doc_id", "doc_tokens", "crc")
    ranked = items.withColumn("turn", F.row_number().over(order)).join(before, ["size", "counter"]).withColumn("rank", F.col("before") + F.col("turn") - 1)
    rest = ranked.select("doc_id", "doc_tokens", "size", "crc", "ids", "rank").mapInArrow(lambda it: _placed(it, plan), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    whole = cut.select("doc_id", "doc_tokens", F.posexplode("crcs").alias("k", "crc")).select(
        "doc_id",
        (F.col("k").cast("long") * length).alias("start"),
        F.lit(length).cast("long").alias("length"),
        F.col("crc").alias("ids_crc32"),
        "doc_tokens",
        (F.lit(plan.sequences) + F.monotonically_increasing_id()).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    return rest.union(whole)
