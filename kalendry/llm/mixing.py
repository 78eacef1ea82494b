"""Operator 12: language-model scores by logistic mixing of hashed-context bit predictors.

A text is its lower-cased (A-Z) words and one end. Each token is a walk down a binary tree whose leaves are the most
frequent training words, the end, and an escape; an escaped word is spelled by walks down a second tree over bytes,
closed by a blank. Both trees are Huffman trees, so every text has one sequence of bits, and a probability for each
bit gives a probability for each text. Four predictors give the chance of a bit from counts over all training
documents: by the tree node alone, and by the node with each of three hashed contexts (the token before, the two
before, the last of the few most frequent words; in spelled words the two bytes before, the four before, the two with
that frequent word). Of tokens that are
not frequent a context only holds the last byte, and the first two contexts stay out of the lower nodes, so contexts
are seen often enough to count. A fifth predictor follows the token that came after the same two tokens earlier in
the text. A mixer adds their log odds by weights of a set that is chosen by how
much the contexts have been seen (the gate), and corrects that set after each bit; an adaptive table by tree depth
and mixed odds refines the result and learns as well.

Counts are sums, so tasks count their documents into tables of fixed size that Spark adds up in a tree; all training
documents count. The weights' start is learned bit by bit on one fold of them, with the counts of the other folds, so
they know how counts of other documents predict; tasks average theirs by how often each set was used. A text is scored
in stretches of SEGMENT symbols, each from that start, many stretches abreast.

Bounds: the tree holds at most WORDS words, the contexts share 3 * 2**MOST_BITS slots (2**bits follows the number of
training tokens up to there), so the model sent to the tasks is at most about 30 MB at any size of corpus. The counts
of all training tokens, which the base score needs exactly, have no bound; they stay a table and are joined.

Defined cases: null and empty texts are the end alone; white space only as well; repeated rows are rows of their own;
a null doc_id counts as empty text for the folds; without training rows every token has base score 0 and the trees
hold the escape and the end alone. Columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections import Counter
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kalendry.llm.common import crc_fold, id_and_text, materialize, mix, parts_of, prepare

WORDS, LEAST_COUNT, LONGEST_WORD, MOST_BITS = 1 << 17, 8, 64, 21
#: Slots of the tree nodes alone: WORDS + 1 of the words, 255 of the bytes.
NODES = 1 << 18
#: Words that are contexts of their own: before and two before (coarse), before (finer), and the last of the few most frequent.
TOPS = (64, 2048, 32)
#: Depths of the words' tree from which the first two contexts are left out, and the slot that stands for that.
DEEPEST, UNUSED = (11, 9, None), NODES - 1
SEGMENT, EVENTS = 64, 1 << 21
INPUTS, GATES, DEPTHS, STEPS = 5, 16, 8, 24
#: Rates of the mixer and of the adaptive table.
RATE, TABLE_RATE, LEARN_RATE = 0.01, 0.03, 0.1
PIECES, FAN_IN, ENTRIES = 64, 64, 1 << 19
LEAST, FOLD = 1 / 65536, 1
END = b"\n"
_TOKEN = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_NODE, _ODD_SLOT = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)


def tokens_of(text: str | None) -> list[bytes]:
    return _TOKEN.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))


def _walks(weights: list[int]) -> list[tuple[list[int], list[int]]]:
    """The walk (nodes, bits) to each leaf of a Huffman tree; the root is node 0."""
    n = len(weights)
    heap = [(w, i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    parent = {}
    for inner in range(n, 2 * n - 1):
        for bit in (0, 1):
            w, i = heapq.heappop(heap)
            parent[i] = (inner, bit)
            total = w if not bit else total + w
        heapq.heappush(heap, (total, inner))
    walk = {2 * n - 2: ([], [])}
    for i in sorted(parent, reverse=True):  # parents have greater numbers
        up, bit = parent[i]
        nodes, bits = walk[up]
        walk[i] = ([*nodes, 2 * n - 2 - up], [*bits, bit])
    return [walk[i] for i in range(n)]


class Code:
    """The two trees. Symbols are the words in order, the escape, the end, and the 256 bytes."""

    def __init__(self, words: list[tuple[bytes, int]], total: int, ends: int):
        self.words = {w: i for i, (w, _) in enumerate(words)}
        self.escape, self.end, self.byte = len(words), len(words) + 1, len(words) + 2
        self.counts = np.array([*(c for _, c in words), 0, ends], np.int64)
        seen = np.ones(256, np.int64)
        for w, c in words:
            for b in w + b" ":
                seen[b] += c
        walks = _walks([*(c for _, c in words), max(total - int(self.counts.sum()), 0) + 1, ends + 1])
        spelled = [([x + WORDS + 1 for x in nodes], bits) for nodes, bits in _walks(seen.tolist())]
        walks += spelled
        self.length = np.array([len(b) for _, b in walks], np.int32)
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]]).astype(np.int32)
        self.nodes = np.fromiter(chain.from_iterable(n for n, _ in walks), np.int32)
        self.bits = np.fromiter(chain.from_iterable(b for _, b in walks), np.int8)
        self.tail = np.array([*(w[-1] for w, _ in words), 0, 10], np.int64)
        depth = np.arange(len(self.nodes)) - np.repeat(self.start, self.length)
        #: Node, bit and depth (up to 63) of each place in one number.
        self.packed = (self.nodes << 7 | self.bits.astype(np.int32) << 6 | np.minimum(depth, 63)).astype(np.int32)


class Symbols:
    """Texts as symbols with the hashes of their contexts, ready to be walked."""

    def __init__(self, code: Code, texts: list[list[bytes]]):
        known, end, escape = code.words, code.end, code.escape
        for t in texts:
            t.append(END)
        flat, sizes = list(chain.from_iterable(texts)), np.fromiter(map(len, texts), np.int64, len(texts))
        token = np.fromiter(map(known.get, flat, repeat(escape)), np.int64, len(flat))
        first = np.cumsum(sizes) - sizes
        last = first + sizes - 1
        token[last] = end
        spelled = np.nonzero(token == escape)[0]
        own, kind = mix((token + 1).astype(np.uint64)), code.tail[token]
        rare = [flat[i] for i in spelled.tolist()]
        own[spelled] = np.fromiter(map(xxhash.xxh3_64_intdigest, rare), np.uint64, len(rare))
        kind[spelled] = np.fromiter((w[-1] for w in rare), np.int64, len(rare))
        text_of = np.repeat(np.arange(len(texts)), sizes)
        place = np.arange(len(token)) - first[text_of]

        def back(values, k):
            """The value k tokens before, -1 before the text starts."""
            out = np.full(len(values), -1, np.int64)
            out[k:] = values[: len(values) - k].astype(np.int64)
            out[place < k] = -1
            return out.astype(np.uint64)

        two = mix(back(own, 1) * _ODD + back(own, 2))
        # contexts are few enough to be seen often: a frequent word, or the last byte of another
        coarse, finer = (np.where(token < top, token, code.byte + kind) for top in TOPS[:2])
        lead = np.maximum.accumulate(np.where(token < TOPS[2], np.arange(len(token)), -1))
        lead = np.concatenate([[-1], lead[:-1]])
        lead = np.where(lead >= first[text_of], token[lead], -1).astype(np.uint64)
        near_words = (back(finer, 1), back(coarse, 1) * _ODD + back(coarse, 2), lead)

        # the token that followed the same two tokens earlier in the text
        order = np.lexsort((np.arange(len(token)), two, text_of))
        same = (two[order[1:]] == two[order[:-1]]) & (text_of[order[1:]] == text_of[order[:-1]])
        guess = np.full(len(token), -1)
        guess[order[1:][same]] = token[order[:-1][same]]

        width = np.ones(len(token), np.int64)
        letters = np.fromiter(map(len, rare), np.int64, len(rare)) + 1
        width[spelled] += letters
        at = np.cumsum(width) - width
        raw = np.frombuffer(b" ".join([*rare, b""]), np.uint8).astype(np.int64)
        is_token = np.zeros(int(width.sum()), bool)
        is_token[at] = True
        place = np.arange(len(raw)) - np.repeat(np.cumsum(letters) - letters, letters)
        near = [np.where(place >= k, np.concatenate([np.full(min(k, len(raw)), 32), raw[:-k]]), 32).astype(np.uint64) for k in (1, 2, 3, 4)]
        pair = near[0] * np.uint64(256) + near[1]
        leads = np.repeat(lead[spelled], letters) + np.uint64(7)
        near_bytes = (pair, (pair * np.uint64(256) + near[2]) * np.uint64(256) + near[3], leads * np.uint64(1 << 24) + pair)
        self.symbol = np.empty(len(is_token), np.int32)
        self.symbol[is_token], self.symbol[~is_token] = token, raw + code.byte
        self.contexts = []
        for tag, (a, b) in enumerate(zip(near_words, near_bytes, strict=True), 1):
            c = np.empty(len(is_token), np.uint32)
            c[is_token], c[~is_token] = (mix(a + np.uint64(tag)) >> np.uint64(32)), (mix(b * np.uint64(16) + np.uint64(8 + tag)) >> np.uint64(32))
            self.contexts.append(c)
        self.guess = np.full(len(is_token), -1, np.int32)
        self.guess[is_token] = guess
        self.spelled = ~is_token
        self.owner = np.repeat(text_of, width)
        self.token, self.rare, self.text_of, self.is_rare = token, rare, text_of, spelled
        self.n_bytes = np.bincount(text_of, np.fromiter(map(len, flat), np.int64, len(flat)) + 1, minlength=len(texts)).astype(np.int64) - 2

    def segments(self, code: Code):
        """(from, to) of stretches of symbols: SEGMENT of one text, or what is left of it."""
        edge = np.nonzero(np.diff(self.owner, prepend=-1))[0]
        size = np.diff(np.append(edge, len(self.owner)))
        n = -(-size // SEGMENT)
        start = np.repeat(edge, n) + SEGMENT * (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))
        stop = np.minimum(start + SEGMENT, np.repeat(edge + size, n))
        return start, stop

    def chunks(self, code: Code):
        """(starts, stops, bits of each) of segments with about EVENTS bits together."""
        start, stop = self.segments(code)
        bits = np.concatenate([[0], np.cumsum(code.length[self.symbol])])
        events = bits[stop] - bits[start]
        total, at = np.cumsum(events), 0
        while at < len(start):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + EVENTS, side="right")))
            yield start[at:to], stop[at:to], events[at:to]
            at = to

    def walk(self, code: Code, start: np.ndarray, stop: np.ndarray):
        """(symbol index, place in the code's walks) of every bit of the symbols of consecutive segments."""
        which, place = _places(code, self.symbol[start[0] : stop[-1]])
        which += np.int32(start[0])
        return which, place

    def slots(self, which: np.ndarray, node: np.ndarray, depth: np.ndarray, bits: int):
        """The slot of each predictor that counts; UNUSED where a predictor leaves the lower nodes of the words' tree alone."""
        yield node
        low = depth - np.int32(1000) * self.spelled[which]
        own = node.astype(np.uint32) * _ODD_NODE
        for k, (c, deep) in enumerate(zip(self.contexts, DEEPEST, strict=True)):
            slot = _slot(c[which], own, k, bits)
            if deep:
                slot[low >= deep] = UNUSED
            yield slot

    def count(self, code: Code, table: np.ndarray, seen: np.ndarray, bits: int) -> None:
        """Adds the symbols to seen, and the bits of their walks to the contexts' slots of table (two numbers a slot).

        A symbol that a context meets often is walked once, with its number.
        """
        seen += np.bincount(self.symbol, minlength=len(seen))
        for k, (c, deep) in enumerate(zip(self.contexts, DEEPEST, strict=True)):
            met = np.sort(c.astype(np.uint64) << np.uint64(32) | self.symbol.astype(np.uint64))
            first = np.nonzero(np.concatenate([[True], met[1:] != met[:-1]]))[0]
            times, met = np.diff(np.append(first, len(met))), met[first]
            symbol = (met & np.uint64(0xFFFFFFFF)).astype(np.int32)
            which, place = _places(code, symbol, deep)
            packed = code.packed[place]
            slot = _slot((met >> np.uint64(32)).astype(np.uint32)[which], (packed >> 7).astype(np.uint32) * _ODD_NODE, k, bits)
            np.add.at(table, 2 * slot + (packed >> 6 & 1), times[which])


def _slot(context: np.ndarray, node: np.ndarray, k: int, bits: int) -> np.ndarray:
    return ((context ^ node) * _ODD_SLOT >> np.uint32(32 - bits)).astype(np.int32) + np.int32(NODES + (k << bits))


def _places(code: Code, symbols: np.ndarray, deep: int | None = None):
    """(index of the symbol, place in the code's walks) of the bits of symbols; of tokens only those above depth deep."""
    n = code.length[symbols]
    if deep:
        n = np.where(symbols < code.byte, np.minimum(n, np.int32(deep)), n)
    which = np.repeat(np.arange(len(symbols), dtype=np.int32), n)
    ahead = code.start[symbols] - (np.cumsum(n) - n).astype(np.int32)
    return which, np.repeat(ahead, n) + np.arange(len(which), dtype=np.int32)


def slots_of(bits: int) -> int:
    return NODES + (3 << bits)


def _parts(texts: list[str | None]):
    for first, last in parts_of(texts, 1 << 20):
        yield first, [tokens_of(t) for t in texts[first:last]]


def _token_counts(batches):
    held = Counter()

    def rows():
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["token", "c"])

    for batch in batches:
        for text in batch.column("text").to_pylist():
            held.update(tokens_of(text))
            held[END] += 1
            if len(held) >= ENTRIES:
                yield from rows()
                held = Counter()
    yield from rows()


def token_counts(docs: DataFrame) -> DataFrame:
    """(token, c) of all tokens of docs, the end among them, as a table in the shared folder."""
    prepare(docs.sparkSession)
    return materialize(docs.select("text").mapInArrow(_token_counts, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c")), "token-counts")


def frequent(counts: DataFrame) -> list[tuple[bytes, int]]:
    """The most frequent words with LEAST_COUNT or more, at most WORDS of them: eighths of powers of two of the count, as many as fit whole."""
    words = counts.where((F.col("c") >= LEAST_COUNT) & (F.octet_length("token") <= LONGEST_WORD) & (F.col("token") != F.lit(END))).withColumn("level", F.floor(8 * F.log2("c")).cast("int"))
    least, total = 1 << 30, 0
    for r in sorted(words.groupBy("level").count().collect(), reverse=True):  # some hundreds of levels
        total += r["count"]
        if total > WORDS:
            break
        least = r.level
    rows = words.where(F.col("level") >= least).select("token", "c").collect()
    return sorted(((bytes(r.token), r.c) for r in rows), key=lambda x: (-x[1], x[0]))


def _count(batches, shared, bits: int):
    code, table = shared.value, np.zeros(2 * slots_of(bits), np.int64)
    seen = np.zeros(len(code.length), np.int64)
    for batch in batches:
        for _, texts in _parts(batch.column("text").to_pylist()):
            Symbols(code, texts).count(code, table, seen, bits)
    met = np.nonzero(seen)[0].astype(np.int32)
    which, place = _places(code, met)
    np.add.at(table, 2 * code.nodes[place] + code.bits[place], seen[met][which])
    task = TaskContext.get().partitionId()
    for k, piece in enumerate(np.array_split(table, PIECES)):
        if piece.any():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([task // FAN_IN], pa.int32()), pa.array([zlib.compress(piece.tobytes(), 1)], pa.binary())], names=["piece", "salt", "counts"])


def _add_up(table: pa.Table) -> pa.Table:
    total = None
    for raw in table.column("counts"):
        own = np.frombuffer(zlib.decompress(raw.as_py()), np.int64)
        total = own.copy() if total is None else total + own
    return pa.table([table.column("piece").slice(0, 1), pa.array([table.column("salt")[0].as_py()], pa.int32()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names=["piece", "salt", "counts"])


_COUNTS = "piece int, salt int, counts binary"


def counted(docs: DataFrame, code, bits: int) -> DataFrame:
    """(piece, salt, counts): bit counts of all slots, PIECES rows of fixed size, in the shared folder."""
    width = docs.rdd.getNumPartitions()
    rows = docs.select("text").mapInArrow(lambda it: _count(it, code, bits), _COUNTS)
    while width > 1:  # FAN_IN tables at a time
        rows, width = rows.groupBy("piece", "salt").applyInArrow(_add_up, _COUNTS).withColumn("salt", F.floor(F.col("salt") / FAN_IN).cast("int")), -(-width // FAN_IN)
    return materialize(rows, "bit-counts")


def _seen(table: pa.Table) -> pa.Table:
    total = np.frombuffer(zlib.decompress(_add_up(table).column("counts")[0].as_py()), np.int64).reshape(-1, 2)
    return pa.table([table.column("piece").slice(0, 1), pa.array([zlib.compress(seen_of(total).tobytes(), 1)], pa.binary())], names=["piece", "seen"])


def seen_of(counts: np.ndarray) -> np.ndarray:
    """A number of 16 bits for each slot: the log odds of a one, in steps of 1/512 from -12, and in the lowest two bits how
    much the slot has been seen (0 never, 1 once or twice, 2 up to 15 times, 3 more)."""
    odds = np.log((counts[:, 1] + 0.4) / (counts[:, 0] + 0.4)).clip(-12, 12)
    return (np.rint((odds + 12) * 512).astype(np.uint16) << np.uint16(2)) + np.digitize(counts.sum(1), [1, 3, 16]).astype(np.uint16)


def tables(counts: DataFrame, bits: int) -> np.ndarray:
    """seen_of() all slots: 2 bytes a slot, at most 14 MB."""
    rows = {r.piece: r.seen for r in counts.groupBy("piece").applyInArrow(_seen, "piece int, seen binary").collect()}
    sizes = [len(x) // 2 for x in np.array_split(np.empty(2 * slots_of(bits), np.int8), PIECES)]
    out = np.concatenate([np.frombuffer(zlib.decompress(rows[k]), np.uint16) if k in rows else np.full(n, 12 * 512 << 2, np.uint16) for k, n in enumerate(sizes)])
    out[UNUSED] = 12 * 512 << 2
    return out


def at_first() -> tuple[np.ndarray, np.ndarray]:
    """Weights (a set for each gate) and adaptive table before anything is learned."""
    weights = np.tile(np.array([0.4, 0.3, 0.2, 0.2, 0.3], np.float32), (GATES, 1))
    table = 1 / (1 + np.exp(-(np.arange(STEPS) - STEPS / 2 + 0.5)))
    return weights, np.tile(table.astype(np.float32), (DEPTHS, 1))


class Mixer:
    """Weights, adaptive table, counted odds; gives the probability of every bit of many segments, side by side."""

    def __init__(self, code: Code, seen: np.ndarray, weights: np.ndarray, table: np.ndarray, bits: int):
        self.code, self.seen, self.bits = code, seen, bits
        self.weights, self.table = weights, table

    def inputs(self, symbols: Symbols, which: np.ndarray, place: np.ndarray):
        """Log odds of the predictors for every bit, its gate and its row of the adaptive table."""
        code, x = self.code, np.empty((len(which), INPUTS), np.float32)
        packed, spelled = code.packed[place], symbols.spelled[which]
        node, depth = packed >> 7, packed & 63
        for k, slot in enumerate(symbols.slots(which, node, depth, self.bits)):
            seen = self.seen[slot]
            np.multiply(seen >> np.uint16(2), np.float32(1 / 512), out=x[:, k])
        x[:, :4] -= np.float32(12)
        guess = symbols.guess[which]
        there = code.packed[np.minimum(code.start[guess] + depth, np.int32(len(code.nodes) - 1))]
        follows = (guess >= 0) & (there >> 7 == node) & (there & 63 == depth)
        x[:, 4] = follows * ((there >> 6 & 1) * np.float32(4) - np.float32(2))
        gate = (spelled * np.int32(4) + (seen & np.uint16(3))) * 2 + follows
        return x, gate, spelled * np.int32(DEPTHS // 2) + np.minimum(depth // 4, DEPTHS // 2 - 1)

    def run(self, symbols: Symbols, start, stop, events, rate: float):
        """(log of each segment's probability, final weights, final tables, uses of each gate) of consecutive segments."""
        order = np.argsort(-events, kind="stable")
        size = events[order]
        abreast = len(size) - np.searchsorted(size[::-1], np.arange(size[0]), side="right")  # segments that reach each step
        edge = np.concatenate([[0], np.cumsum(abreast)])
        step = np.repeat(np.arange(size[0], dtype=np.int32), abreast)
        lane = np.arange(edge[-1], dtype=np.int32) - np.repeat(edge[:-1].astype(np.int32), abreast)
        turn = (np.cumsum(events) - events).astype(np.int32)[order][lane] + step
        which, place = (a[turn] for a in symbols.walk(self.code, start, stop))
        x, gate, row = self.inputs(symbols, which, place)
        bit = self.code.bits[place]
        y = bit.astype(np.float32)
        at, row = lane * np.int32(GATES) + gate, (lane * np.int32(DEPTHS) + row) * np.int32(STEPS) + np.int32(STEPS // 2)
        weights = np.tile(self.weights, (len(size), 1))
        table = np.tile(self.table.reshape(-1), len(size))
        p = np.empty(len(y), np.float32)
        low, high, rate, slow = (np.float32(v) for v in (-11.9, 11.9, rate, TABLE_RATE))
        for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            own, now, real = x[i:j], at[i:j], y[i:j]
            w = weights.take(now, 0)
            z = np.einsum("ij,ij->i", w, own)
            np.minimum(np.maximum(z, low, out=z), high, out=z)
            cell = row[i:j] + np.floor(z).astype(np.int32)
            np.exp(np.negative(z, out=z), out=z)
            z += 1
            mixed = np.reciprocal(z, out=z)
            fine = table.take(cell)
            np.add(mixed, fine, out=p[i:j])
            table[cell] = fine + (real - fine) * slow
            w += np.multiply((real - mixed) * rate, own.T).T
            weights[now] = w
        p = np.clip(p.astype(np.float64) / 2, LEAST, 1 - LEAST)
        logs = np.log(np.where(bit == 1, p, 1 - p))
        out = np.empty(len(size))
        out[order] = np.bincount(lane, logs, minlength=len(size))
        return out, weights.reshape(len(size), GATES, INPUTS), table.reshape(len(size), DEPTHS, STEPS), np.bincount(at, minlength=len(size) * GATES).reshape(-1, GATES), np.bincount(row // STEPS, minlength=len(size) * DEPTHS).reshape(-1, DEPTHS)

    def logs(self, symbols: Symbols) -> np.ndarray:
        """The log probability of each text."""
        out = np.zeros(int(symbols.owner[-1]) + 1 if len(symbols.owner) else 0)
        for start, stop, events in symbols.chunks(self.code):
            np.add.at(out, symbols.owner[start], self.run(symbols, start, stop, events, RATE)[0])
        return out

    def learn(self, symbols: Symbols):
        """Moves the start to the mean of what the segments learned, by how often each used a set; yields those uses."""
        for start, stop, events in symbols.chunks(self.code):
            _, weights, table, gates, rows = self.run(symbols, start, stop, events, LEARN_RATE)
            for name, own, uses in (("weights", weights, gates), ("table", table, rows)):
                held = getattr(self, name)
                moved = np.einsum("lg,lgk->gk", uses.astype(np.float64), own - held) / np.maximum(uses.sum(0), 1)[:, None]
                setattr(self, name, (held + moved).astype(np.float32))
            yield gates.sum(0), rows.sum(0)


def _learn(batches, shared, bits: int):
    mixer = Mixer(*shared.value, *at_first(), bits)
    uses = [np.zeros(GATES, np.int64), np.zeros(DEPTHS, np.int64)]
    for batch in batches:
        for _, texts in _parts(batch.column("text").to_pylist()):
            for own in mixer.learn(Symbols(mixer.code, texts)):
                uses = [a + b for a, b in zip(uses, own, strict=True)]
    values = np.concatenate([mixer.weights.reshape(-1), mixer.table.reshape(-1)]).astype(np.float64)
    weight = np.concatenate([np.repeat(uses[0], INPUTS), np.repeat(uses[1], STEPS)])
    # whole numbers: their sum is the same in any order
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(np.rint(values * weight * 2**16).astype(np.int64)), pa.array(weight)], names=["place", "value", "uses"])


def learned(docs: DataFrame, shared, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The start of the weights and of the adaptive table, from all of docs."""
    rows = docs.select("text").mapInArrow(lambda it: _learn(it, shared, bits), "place long, value long, uses long")
    rows = rows.groupBy("place").agg(F.sum(F.col("value").cast("decimal(20,0)")).cast("double").alias("value"), F.sum("uses").alias("uses")).where("uses > 0").collect()
    weights, table = at_first()
    flat = np.concatenate([weights.reshape(-1), table.reshape(-1)])
    for r in rows:  # one for each weight and cell
        flat[r.place] = r.value / r.uses / 2**16
    return flat[: weights.size].reshape(weights.shape), flat[weights.size :].reshape(table.shape)


def _score(batches, shared, bits: int, total: float):
    code, seen, weights, table = shared.value
    mixer = Mixer(code, seen, weights, table, bits)
    base = np.log10((code.counts + 0.1) / total)
    base[code.escape] = math.log10(0.1 / total)  # what the counts of other words add comes by a join
    for batch in batches:
        texts, columns = batch.column("text").to_pylist(), [[] for _ in range(6)]
        for _, words in _parts(texts):
            s = Symbols(code, words)
            n = np.bincount(s.text_of)
            known = np.bincount(s.text_of, code.counts[s.token] > 0)
            rest = [[] for _ in words]
            for (own, word), times in Counter(zip(s.text_of[s.is_rare].tolist(), s.rare, strict=True)).items():
                rest[own].append({"token": word, "n": times})
            for c, v in zip(columns, (n, known.astype(np.int64), np.bincount(s.text_of, base[s.token]), mixer.logs(s) / math.log(10), s.n_bytes, rest), strict=True):
                c.extend(v)
        arrays = [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64()), pa.array(columns[3], pa.float64()), pa.array(columns[4], pa.int64())]
        rest = pa.array(columns[5], pa.list_(pa.struct([("token", pa.binary()), ("n", pa.int64())])))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *arrays, rest], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "n_bytes", "rest"])


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for every row of docs.

    It learns from the rows whose crc32 of doc_id leaves no remainder by ten. score is the log10 of the probability
    of the text's tokens; bits_per_byte spreads it over the bytes of its words and one blank after each.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = id_and_text(docs, crc_fold(10).alias("fold"))
    counts = token_counts(docs.where("fold <> 0"))
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    ends = counts.where(F.col("token") == F.lit(END)).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    bits = min(max(total.bit_length(), 16), MOST_BITS)
    share = spark.sparkContext.broadcast
    code = Code(frequent(counts), total, ends)
    coded = share(code)
    others, own = (counted(docs.where(c), coded, bits) for c in (f"fold not in (0, {FOLD})", f"fold = {FOLD}"))
    start = learned(docs.where(f"fold = {FOLD}"), share((code, tables(others, bits))), bits)
    model = share((code, tables(others.unionByName(own), bits), *start))
    of_all = total + 0.1 * (distinct + 1)
    kinds = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long, rest array<struct<token: binary, n: long>>"
    rows = docs.select("doc_id", "text", (F.col("fold") == 0).alias("held_out")).mapInArrow(lambda it: _score(it, model, bits, of_all), kinds)
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "scored")
    # frequent words are in the tree, so only a long word may be a hot key here; Spark's skew join splits its rows
    met = rows.select("row", F.explode("rest").alias("r")).select("row", "r.token", "r.n").join(counts, "token")
    more = met.groupBy("row").agg(F.sum("n").alias("more_known"), F.sum(F.col("n") * (F.log10(F.col("c") + 0.1) - F.log10(F.lit(0.1)))).alias("more"))
    out = rows.drop("rest").join(more, "row", "left").na.fill(0, ["more_known", "more"])
    bpb = -F.col("score") * math.log2(10) / F.greatest("n_bytes", F.lit(1))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.col("more_known")).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base_score") + F.col("more")).alias("base_score"), "score", bpb.alias("bits_per_byte"))
