"""Operator 10: near-duplicate passages by compact windows.

A text is its words (lower case, split at white space) and the sequence of their five-word shingles. For
each of HASHES hash functions, a Cartesian tree over the shingles' hashes gives every place the stretch in
which it is the minimum: all subsequences around it within that stretch share that min-hash, so one compact
window (left, centre, right) stands for all of them. Only places that are the minimum of some stretch as
long as the shortest passage count (about two of every `least` shingles); the tree over these alone has
the same windows. Two texts that share a passage share a window's value for each hash function with the
passage's likeness as probability; runs of equal values hold the candidates. Two rounds find the links:

1. Stars. Each window of a run is joined to the first document of its run and next shingle (or of its run).
   Windows of a pair of documents that overlap in both texts are joined; what two hash functions support is
   fetched from both texts and verified. A passage in n documents costs n rows, never pairs of all.
2. Blocks, the exact way for the rest. A window is open while no verified passage of an earlier document
   covers its centre. Every open window of the first BLOCK_HASHES hash functions is compared with all windows
   of its run, in blocks of bounded size: equal passages have equal windows for every hash function, so none
   is lost; of likeness s a passage that no star found meets here with probability 1 - (1 - s)^BLOCK_HASHES.
   Before, windows go that can be part of no passage: those around which too many shingles are in no other
   text of the run. A block returns one link to each group of documents that are linked already, so a large
   group costs no pairs either.

A passage is a stretch of a Jaccard likeness of 0.8 or more, measured on 32-bit hashes of the shingles. A gap
may be as long as the likeness leaves room for in its stretch: only places that lie in no stretch with that
share of matching shingles are cut off, and where the likeness falls short, the longest gap.

Windows reach at most twice the shortest passage to each side: any such passage has a centre, so longer
ones are covered by the chain of their windows and merged again. In a text that repeats itself, a window that
follows one of equal value within half the shortest passage may be left out without loss: the reach of the
one kept holds every shortest passage around it.

Defined cases: null, empty and shorter texts have no passages. Rows equal in doc_id and text are one
document; equal texts under different ids repeat each other wholly. Repeats within one document are left
alone. A null doc_id sorts first and is kept. Columns other than doc_id and text are not looked at, whatever
their names. `least_words` may be up to 200.
"""

from __future__ import annotations

import math
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kalendry.llm.common import carried, discard, id_and_text, materialize, mix, parts_of, perhaps, prepare, restored, row_key
from kalendry.llm.common import shingles, table_of, word_hashes_of

SHINGLE, LEAST, THRESHOLD = 5, 50, 0.8
HASHES, GRID = 5, 64
#: Hash functions that must support a stretch in the first round, and those of the second, which needs one of them.
AGREE, BLOCK_HASHES = 2, 2
#: Open windows of a block, and windows of the block they are compared with; in runs up to FEW, bounds cost more than they spare.
BLOCK_A, BLOCK_B, FEW = 400, 2000, 8
#: Rows of runs, or of blocks, that numpy takes at once.
GATHERED = 8000
_WORD = re.compile(r"\S+")
#: A window in one long: centre 27 bits, reach to the left and right 9 each, hash function 3, next shingle 15.
_CENTRE, _LEFT, _RIGHT, _HASH = 36, 27, 18, 15
_NINE = 511
_PAIR = "row_a long, doc_a long, row_b long, doc_b long"
_MEMBER = ["value", "doc_id", "row", "packed"]
_JOINED = ["row_a", "doc_a", "row_b", "doc_b", "at_a", "at_b"]
#: The window that a member is joined to, and whether the member is the earlier of both.
_OTHER = ["other_id", "other_row", "other_packed", "earlier"]


def _least_over(x: np.ndarray, span: int, take) -> np.ndarray:
    """take(min or max) over every `span` neighbours, by doubling."""
    width = 1
    while width < span:
        step = min(width, span - width)
        x = take(x[: len(x) - step], x[step:])
        width += step
    return x


def windows(values: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Compact windows (lefts, centres, rights), inclusive, of at least `least` places; the leftmost minimum counts."""
    n = len(values)
    if n < least:
        return (np.empty(0, np.int64),) * 3
    low = _least_over(values, least, np.minimum)
    edge = np.zeros(least - 1, values.dtype)
    centre = np.nonzero(_least_over(np.concatenate([edge, low, edge]), least, np.maximum) == values)[0]
    height, at = values[centre].tolist(), centre.tolist()
    stack, left, right = [], [0] * len(at), [n - 1] * len(at)
    for i, h in enumerate(height):  # the tree's path from its root to the last place
        while stack and height[stack[-1]] > h:
            right[stack.pop()] = at[i] - 1
        if stack:
            left[i] = at[stack[-1]] + 1
        stack.append(i)
    left, right = np.array(left, np.int64), np.array(right, np.int64)
    some = right - left + 1 >= least
    return left[some], centre[some], right[some]


def _reach(packed: int) -> tuple[int, int]:
    c = packed >> _CENTRE
    return c - (packed >> _LEFT & _NINE), c + (packed >> _RIGHT & _NINE)


def _bases(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of many texts end to end, where each text's start and how many they are; 0 between two texts."""
    words, count = word_hashes_of(texts)
    first, size = np.cumsum(count) - count, np.maximum(count - SHINGLE + 1, 0)
    if len(words) < SHINGLE:
        return np.empty(0, np.uint64), first, size
    base = shingles(words, SHINGLE)
    own = np.arange(len(words)) < np.repeat(first + size, count)
    return np.where(own[: len(base)], base, np.uint64(0)), first, size


def _window_rows(batches, least: int):
    """(row, doc_id, text) -> (value, doc_id, row, packed) for every window.

    Many texts go through the tree at once: the zeros between them are less than any hash, so no window crosses them.
    """
    most = 2 * least
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for start, end in parts_of(texts):
            base, first, _ = _bases(texts[start:end])
            gap = base == 0
            follow = np.append(base[1:], np.uint64(0)).astype(np.int64) & 0x7FFF
            values, packed, owner = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for h in range(HASHES if len(base) else 0):
                mixed = mix(base + np.uint64((h + 1) * 0x9E3779B97F4A7C15 % 2**64))
                mixed[gap] = 0
                left, centre, right = windows(mixed, least)
                text = np.searchsorted(first, centre, "right") - 1  # of texts without words the last, which has the words
                own, place = mixed[centre].view(np.int64), centre - first[text]
                order = np.lexsort((centre, own, text))  # of equal values one in half a shortest passage: it reaches the others
                order = order[~gap[centre[order]]]
                v, t, slot = own[order], text[order], place[order] // max(least // 2, 1)
                new = np.append(True, (v[1:] != v[:-1]) | (t[1:] != t[:-1]) | (slot[1:] != slot[:-1]))[: len(order)]
                kept = np.sort(order[new])
                left, centre, right = left[kept], centre[kept], right[kept]
                reach = np.minimum(centre - left, most) << _LEFT | np.minimum(right - centre, most) << _RIGHT
                values.append(own[kept])
                packed.append(place[kept] << _CENTRE | reach | h << _HASH | follow[centre])
                owner.append(text[kept] + start)
            at = pa.array(np.concatenate(owner))
            columns = [pa.array(np.concatenate(c)) for c in (values, packed)]
            yield pa.RecordBatch.from_arrays([columns[0], batch.column("doc_id").take(at), batch.column("row").take(at), columns[1]], names=_MEMBER)


def _earlier(x: tuple):
    """Order of (value, doc_id, row, packed) by document: null ids first, then id, then row."""
    return x[1] is not None, x[1] or 0, x[2], x[3]


def _joined(x: tuple, y: tuple) -> tuple:
    a, b = sorted((x, y), key=_earlier)
    return a[2], a[1], b[2], b[1], a[3], b[3]


def _gathered(batches, rows: int):
    """The same rows in batches of at least so many, but for the last."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _not_alone(batches):
    """Rows sorted by value -> those whose value another one has; the last row waits for the next batch."""
    held, matched = None, False
    for batch in _gathered(batches, GATHERED):
        if held is not None:
            batch = next(iter(pa.Table.from_batches([held, batch]).combine_chunks().to_batches()))
        value = batch.column("value").to_numpy()
        same = value[1:] == value[:-1]
        good = np.append(matched, same) | np.append(same, False)
        matched, held = bool(same[-1]) if len(same) else matched, batch.slice(batch.num_rows - 1)
        yield batch.slice(0, batch.num_rows - 1).filter(pa.array(good[:-1]))
    if held is not None and matched:
        yield held


def _before(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Whether each window of x sorts before that of y by (doc_id known, doc_id, row, packed)."""
    out = x[-1] < y[-1]
    for a, b in zip(x[-2::-1], y[-2::-1], strict=True):
        out = (a < b) | ((a == b) & out)
    return out


def _stars(batches):
    """Rows sorted by (value, follow, doc_id, row) -> members of runs, each joined to the first of its follow or value.

    What a run needs from earlier batches are its first window and that of its last next shingle.
    """
    held, lonely = None, False  # these two rows, and whether the run has no second one yet
    for batch in _gathered(batches, GATHERED):
        known = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
        doc = batch.column("doc_id").fill_null(0).to_numpy()
        rows = np.stack([batch.column("value").to_numpy(), batch.column("follow").to_numpy(), known, doc, *(batch.column(c).to_numpy() for c in ("row", "packed"))])
        if not rows.shape[1]:
            continue
        skip = 0 if held is None else 2
        rows = rows if held is None else np.concatenate([held, rows], axis=1)
        n = rows.shape[1]
        value, follow = rows[0], rows[1]
        new = np.append(True, value[1:] != value[:-1])
        new_follow = new | np.append(True, follow[1:] != follow[:-1])
        place = np.arange(n)
        first = np.maximum.accumulate(np.where(new, place, 0))
        first_follow = np.maximum.accumulate(np.where(new_follow, place, 0))
        more = np.append(value[1:] == value[:-1], False)
        out = ~new | more  # of a run with a second row
        out[:skip] = False
        if skip and lonely and value[2] == value[0]:
            out[0] = True
        other = np.where(first_follow != place, first_follow, first)
        at = np.nonzero(out)[0]
        me, them = rows[2:, at], rows[2:, other[at]]
        apart = ~new[at] & ((me[0] != them[0]) | (me[1] != them[1]) | (me[2] != them[2]))
        swap = _before(list(me), list(them))
        number = lambda x, there: pa.array(x, pa.int64(), mask=~there.astype(bool))
        every = np.ones(len(at), bool)
        again = (me[3] >> _HASH & 7) < BLOCK_HASHES  # the second round asks for these values only
        columns = [number(rows[0, at], again), number(me[1], me[0]), *(number(x, every) for x in me[2:])]
        columns += [number(them[1], apart & them[0].astype(bool)), *(number(x, apart) for x in them[2:]), pa.array(swap)]
        yield pa.RecordBatch.from_arrays(columns, names=_MEMBER + _OTHER)
        last = first[-1]
        whole_run_is_one = last == n - 1 or (skip and last == 0 and n == 2)
        lonely = bool(whole_run_is_one) if last >= skip or not skip else lonely and value[2] != value[0]
        held = rows[:, [last, first_follow[-1]]]


def joined_intervals(at: list[tuple[int, int]], agree: int = 1) -> list[tuple[int, int, int, int]]:
    """Windows of one pair of documents -> stretches (a_from, a_to, b_from, b_to) that `agree` hash functions support."""
    found = [(*_reach(b), *_reach(a), b >> _HASH & 7) for a, b in at]
    done: list[list] = []
    live: list[list] = []
    for low, high, a_low, a_high, h in sorted(found):
        done += [r for r in live if r[1] < low]
        run, others = [low, high, a_low, a_high, {h}], []
        for r in live:
            if r[1] < low:
                continue
            if r[2] <= run[3] and run[2] <= r[3]:
                run = [min(run[0], r[0]), max(run[1], r[1]), min(run[2], r[2]), max(run[3], r[3]), run[4] | r[4]]
            else:
                others.append(r)
        live = [*others, run]
    return [(r[2], r[3], r[0], r[1]) for r in done + live if len(r[4]) >= agree]


def _stretches(batches, agree: int):
    for batch in batches:
        out = []
        ats, lists = batch.column("at"), batch.column("at").flatten()
        edges = np.concatenate([[0], np.cumsum(ats.value_lengths().to_numpy())]).tolist()
        at = list(zip(*(lists.field(c).to_pylist() for c in ("at_a", "at_b")), strict=True))
        pairs = zip(*(batch.column(c).to_pylist() for c in ("row_a", "doc_a", "row_b", "doc_b")), strict=True)
        for pair, low, high in zip(pairs, edges[:-1], edges[1:], strict=True):
            for s in joined_intervals(at[low:high], agree):
                out.append((*pair, *(v // GRID * GRID if i % 2 == 0 else (v // GRID + 1) * GRID for i, v in enumerate(s))))
        yield table_of(out, ["row_a", "doc_a", "row_b", "doc_b", "from_a", "to_a", "from_b", "to_b"])


def _fetched(batches):
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("text", "doc_id", "row", "wanted")]
        for start, end in parts_of(columns[0]):
            out = []
            base, first, size = _bases(columns[0][start:end])
            base = base.astype(np.uint32)
            for f, n, doc, row, wanted in zip(first.tolist(), size.tolist(), *(c[start:end] for c in columns[1:]), strict=True):
                out += [(doc, row, w["low"], w["high"], base[f + w["low"] : f + min(w["high"], n)].tobytes()) for w in wanted]
            yield table_of(out, ["doc_id", "row", "low", "high", "part"], [*[pa.int64()] * 4, pa.binary()])


def _dense(x: np.ndarray, match: np.ndarray, new: np.ndarray | None, least: int, threshold: float) -> list[np.ndarray]:
    """Matching places, by runs of all stretches that have a share of at least `threshold` of them; runs of `least` places.

    new: where shingles are new, None where all are.
    A shingle that does not match counts once (where it is new), and one that matches once where it follows itself,
    as both do for the likeness, so no stretch that is near enough is cut.
    """
    places = match.nonzero()[0]
    if not len(places) or places[-1] - places[0] < least - 1:
        return []
    gain = match - threshold
    if new is not None:
        gain[~match & ~new] = 0
        gain[1:][x[1:] == x[:-1]] = 0
    total = np.zeros(len(match) + 1)
    np.cumsum(gain, out=total[1:])
    inside = np.maximum.accumulate(total[:0:-1])[::-1] - np.minimum.accumulate(total[:-1]) > -1e-9
    apart = (~inside).cumsum()[places]
    edges = [0, *((apart[1:] != apart[:-1]).nonzero()[0] + 1).tolist(), len(places)]
    return [places[i:j] for i, j in zip(edges[:-1], edges[1:], strict=True) if places[j - 1] - places[i] >= least - 1]


def _cut(places: np.ndarray) -> list[np.ndarray]:
    """Places on both sides of their longest gap."""
    if places[-1] - places[0] < len(places):
        return []
    gaps = places[1:] - places[:-1]
    at = int(gaps.argmax()) + 1
    return [places[:at], places[at:]]


class Alike:
    """Near-duplicate stretches of pairs among some shingle sequences; shingles are numbered once for all of them."""

    def __init__(self, sequences: list[np.ndarray], least: int, threshold: float):
        self.least, self.threshold = least, threshold
        number = np.unique(np.concatenate(sequences), return_inverse=True)[1]
        self.ids = np.split(number, np.cumsum([len(x) for x in sequences])[:-1])
        self.mark = np.zeros(len(number) + 1, bool)
        self.new: dict[int, np.ndarray | None] = {}

    def among(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        self.mark[y] = True
        out = self.mark[x]
        self.mark[y] = False
        return out

    def distinct(self, *parts: np.ndarray) -> int:
        for x in parts:
            self.mark[x] = True
        n = int(np.count_nonzero(self.mark))
        for x in parts:
            self.mark[x] = False
        return n

    def firsts(self, i: int) -> np.ndarray | None:
        """Where a sequence's shingles are new in it; None where all are."""
        if i not in self.new:
            out = np.zeros(len(self.ids[i]), bool)
            out[np.unique(self.ids[i], return_index=True)[1]] = True
            self.new[i] = None if out.all() else out
        return self.new[i]

    def near(self, many: np.ndarray, k: int, centre: np.ndarray, need: int) -> np.ndarray:
        """Of which sequences `need` of some `least` places around their centre are in sequence k, or were there before."""
        new = [self.firsts(i) for i in many.tolist()]
        free = np.array([0 if x is None else len(x) - np.count_nonzero(x) for x in new])  # places of shingles that were there before
        ids = [self.ids[i] for i in many.tolist()]
        size = np.array([len(x) for x in ids])
        flags = self.among(np.concatenate(ids), self.ids[k])
        around = (np.maximum(0, centre - self.least + 1) <= np.minimum(centre, size - self.least)) & (size >= self.least)
        return around & (_most_around(flags, size, centre, self.least) + free >= need)

    def stretches(self, i: int, k: int, one: bool = False) -> list[tuple[int, int, int, int]]:
        """Maximal (a_from, a_to, b_from, b_to), inclusive, of sequences i and k that are near-duplicates; one: any of them."""
        a, b, least, threshold = self.ids[i], self.ids[k], self.least, self.threshold
        out = []
        todo = _dense(b, self.among(b, a), self.firsts(k), least, threshold)
        while todo:
            g = todo.pop()
            low, high = int(g[0]), int(g[-1])
            if high - low + 1 < least:
                continue
            mine = b[low : high + 1]
            right, alike = self.distinct(mine), None
            # a pair's common shingles are no more than its places here, its union no less than `right`
            possible = lambda parts: [p for p in parts if len(p) >= threshold * right and p[-1] - p[0] >= least - 1]  # noqa: B023, E731
            others = possible(_dense(a, self.among(a, mine), self.firsts(i), least, threshold)) if len(g) >= threshold * right else []
            while others:
                other = others.pop()
                x, y = int(other[0]), int(other[-1])
                left, union = self.distinct(a[x : y + 1]), self.distinct(a[x : y + 1], mine)
                if left + right - union >= threshold * union:
                    alike = (x, y, low, high)
                    break
                others += possible(_cut(other))
            if alike:
                out.append(alike)
                if one:
                    break
            else:
                todo += _cut(g)
        return sorted(out)


def matching(a: np.ndarray, b: np.ndarray, least: int, threshold: float) -> list[tuple[int, int, int, int]]:
    return Alike([a, b], least, threshold).stretches(0, 1)


def _verified(batches, least: int, threshold: float):
    names = ("row_a", "doc_a", "row_b", "doc_b", "from_a", "from_b", "part_a", "part_b")
    for batch in batches:
        out = []
        for ra, da, rb, db, fa, fb, left, right in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            for a0, a1, b0, b1 in matching(np.frombuffer(left, np.uint32), np.frombuffer(right, np.uint32), least, threshold):
                out.append((ra, da, rb, db, fa + a0, fa + a1 + SHINGLE, fb + b0, fb + b1 + SHINGLE))
        yield table_of(out, ["row_a", "doc_a", "row_b", "doc_b", "start_a", "end_a", "start_b", "end_b"])


_CONTEXT = [*_MEMBER, "open", "core", "context"]


def _contexts(batches):
    """(doc_id, row, text, windows) -> each window with the shingles that it reaches."""
    names = [*_MEMBER, "open", "core", "n", "n_open", "context"]
    types = [*[pa.int64()] * 4, pa.bool_(), *[pa.int64()] * 3, pa.binary()]
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("text", "doc_id", "row", "windows")]
        for start, end in parts_of(columns[0]):
            out = []
            base, first, _ = _bases(columns[0][start:end])
            raw = base.astype("<u4").tobytes()
            for f, doc, row, own in zip(first.tolist(), *(c[start:end] for c in columns[1:]), strict=True):
                for w in own:
                    low, high = _reach(w["packed"])
                    out.append((w["value"], doc, row, w["packed"], w["open"], w["core"], w["n"], w["n_open"], raw[4 * (f + low) : 4 * (f + high) + 4]))
            yield table_of(out, names, types)


def _most_around(flags: np.ndarray, size: np.ndarray, centre: np.ndarray, least: int) -> np.ndarray:
    """Of contexts laid end to end: the most flags in any `least` places around each centre."""
    start = np.cumsum(size) - size
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    sums = np.append(total[least:] - total[:-least], [0] * least)
    first, last = start + np.maximum(0, centre - least + 1), start + np.minimum(centre, size - least)
    edges = np.stack([first, np.maximum(last, first) + 1], axis=1).ravel()
    return np.where(first <= last, np.maximum.reduceat(sums, edges)[::2], 0)


def _possible(contexts: list[np.ndarray], centre: np.ndarray, owner: np.ndarray, least: int, need: int) -> np.ndarray:
    """Which windows have `need` of some `least` places around their centre in a text of another owner.

    A place whose shingle its own context holds twice counts too, as shingles count once for the likeness.
    """
    alive = np.arange(len(contexts))
    while len(alive) > 1:
        size = np.array([len(contexts[i]) for i in alive])
        flat, member = np.concatenate([contexts[i] for i in alive]), np.repeat(np.arange(len(alive)), size)
        who = owner[alive][member]
        order = np.lexsort((member, who, flat))
        f, w, m = flat[order], who[order], member[order]
        new = np.append(True, f[1:] != f[:-1])
        run = np.cumsum(new) - 1
        begin = np.nonzero(new)[0]
        shared = w[begin] != w[np.append(begin[1:], len(f)) - 1]
        twice = np.append(False, (f[1:] == f[:-1]) & (m[1:] == m[:-1]))
        twice[:-1] |= twice[1:]
        flags = np.zeros(len(flat), np.int64)
        flags[order] = shared[run] | twice
        good = _most_around(flags, size, centre[alive], least) >= need
        if good.all():
            break
        alive = alive[good]
    return alive if len(alive) > 1 else alive[:0]


def _near_contexts(sets: list[np.ndarray], least: int, need: int):
    """(context, centre) -> which of these contexts hold `need` of some `least` of its places around the centre."""
    sets = [np.unique(x) for x in sets]
    flat, group = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(flat, kind="stable")
    flat, group = flat[order], group[order]

    def near(x: np.ndarray, centre: int) -> list[int]:
        low = np.searchsorted(flat, x)
        size = np.searchsorted(flat, x, "right") - low
        hit = group[np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())]
        some = np.nonzero(np.bincount(hit, minlength=len(sets)) >= need)[0]
        if not len(some):
            return []
        turn = np.full(len(sets), -1)
        turn[some] = np.arange(len(some))
        own, spot = turn[hit], np.repeat(np.arange(len(x)), size)
        match = np.zeros((len(some), len(x)), np.int64)
        match[own[own >= 0], spot[own >= 0]] = 1
        _, back, times = np.unique(x, return_inverse=True, return_counts=True)
        match[:, times[back] > 1] = 1
        most = _most_around(match.ravel(), np.full(len(some), len(x)), np.full(len(some), centre), least)
        return some[most >= need].tolist()

    return near


def _block_pairs(table: pa.Table, need: int, least: int, threshold: float) -> list[tuple]:
    """Open windows of one block joined to a window of each group of linked documents of another block of their run."""
    rows = table.to_pylist()
    contexts = [np.frombuffer(r["context"], np.uint32) for r in rows]
    members = [[r[c] for c in _MEMBER] for r in rows]
    names: dict = {}
    owner = np.array([names.setdefault((m[1], m[2]), len(names)) for m in members])
    centre = np.array([(m[3] >> _CENTRE) - _reach(m[3])[0] for m in members])
    alive = _possible(contexts, centre, owner, least, need).tolist() if len(rows) > FEW else range(len(rows))
    owner = owner.tolist()
    alive = sorted(alive, key=lambda i: _earlier(members[i]))
    above, out, known = {}, [], {}

    def root(i):
        core = top = rows[i]["core"]
        while top in above:
            top = above[top]
        while core != top:  # the way is shortened, or chains of links would be walked again and again
            above[core], core = top, above[core]
        return top

    held: dict[bytes, list[int]] = {}  # windows of the second block by their context, in order of documents
    for i in alive:
        if rows[i]["side"] != 0:
            held.setdefault(rows[i]["context"], []).append(i)
    groups, place, asked = list(held.values()), {x: k for k, x in enumerate(held)}, {}
    near = _near_contexts([contexts[g[0]] for g in groups], least, need) if len(groups) > FEW else None
    pairs, heads = Alike(contexts, least, threshold), np.array([g[0] for g in groups], np.int64)
    for i in alive:
        if not rows[i]["open"] or rows[i]["side"] == 1:
            continue
        same = place.get(rows[i]["context"])
        if same in asked and same is not None:  # an equal context was compared already: one link to it says the same
            first = asked[same]
            if owner[first] != owner[i] and root(first) != root(i):
                out.append(_joined(members[i], members[first]))
                above[root(i)] = root(first)
            if owner[first] != owner[i]:
                continue
        asked[same] = i
        mine = root(i)
        some = [k for k in (range(len(groups)) if near is None else near(contexts[i], centre[i])) if any(owner[j] != owner[i] and root(j) != mine for j in groups[k])]
        if not some:
            continue
        held_by = heads[some]
        for k, close in zip(some, pairs.near(held_by, i, centre[held_by], need).tolist(), strict=True):
            if not close or not any(owner[j] != owner[i] and root(j) != root(i) for j in groups[k]):
                continue
            pair = (rows[i]["context"], k)
            if pair not in known:
                known[pair] = bool(pairs.stretches(i, groups[k][0], True))
            for j in groups[k] if known[pair] else []:
                if owner[j] != owner[i] and root(j) != root(i):
                    out.append(_joined(members[i], members[j]))
                    above[root(i)] = root(j)
    return out


def _may_match(contexts: list[bytes], group: np.ndarray, owner: np.ndarray, centre: np.ndarray, least: int, need: int) -> tuple[np.ndarray, np.ndarray]:
    """Which windows may be in a pair of their group at all, and which of them as the one that near() looks around.

    Counts places whose shingles another owner of the group has; both are bounds of what near() and stretches() ask for.
    """
    size = np.array([len(x) // 4 for x in contexts], np.int64)
    flat, member = np.frombuffer(b"".join(contexts), "<u4").astype(np.int64), np.repeat(np.arange(len(size)), size)
    key = group[member] << 32 | flat
    order = np.argsort(key)
    begin = np.nonzero(np.append(True, key[order[1:]] != key[order[:-1]]))[0]
    who = owner[member[order]]
    shared = np.minimum.reduceat(who, begin) != np.maximum.reduceat(who, begin)
    flags = np.empty(len(flat), np.int64)
    flags[order] = np.repeat(shared, np.diff(np.append(begin, len(flat))))
    own = np.sort(member << 32 | flat)
    free = np.bincount(own[1:][own[1:] == own[:-1]] >> 32, minlength=len(size))
    some = np.bincount(member, weights=flags, minlength=len(size)) + free >= need
    return some, some & (_most_around(flags, size, centre, least) + free >= need)


def _few_left(table: pa.Table, group: np.ndarray, need: int, least: int) -> np.ndarray:
    """Rows of small blocks that are left when windows go that have no match, and then blocks without a pair to ask about."""
    columns = {c: table.column(c).to_numpy() for c in ("row", "packed", "side")}
    centre = columns["packed"] >> _LEFT & _NINE  # in the context
    known, doc = table.column("doc_id").is_valid().to_numpy(), table.column("doc_id").combine_chunks().fill_null(0).to_numpy()
    owner = np.unique(np.stack([known.astype(np.int64), doc, columns["row"]]), axis=1, return_inverse=True)[1].ravel()
    some, around = _may_match(table.column("context").to_pylist(), group, owner, centre, least, need)
    n = int(group[-1]) + 1
    asks = np.bincount(group, weights=some & table.column("open").to_numpy() & (columns["side"] != 1), minlength=n) > 0
    asks &= np.bincount(group, weights=around & (columns["side"] != 0), minlength=n) > 0
    return np.nonzero(some & asks[group])[0]


def _blocks(batches, need: int, least: int, threshold: float):
    """Rows sorted by (value, i, j) -> the pairs of each block; the last block waits for the batch that ends it."""
    held: list[pa.RecordBatch] = []
    for batch in chain(batches, [None]):
        held += [batch] if batch is not None else []
        n = sum(b.num_rows for b in held)
        if not n or (batch is not None and n < GATHERED):
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        keys = np.stack([table.column(c).to_numpy() for c in ("value", "i", "j")])
        edges = np.concatenate([[0], np.nonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0))[0] + 1, [n]])
        held = []
        if batch is not None:
            held, edges = table.slice(edges[-2]).to_batches(), edges[:-1]
        size, out = np.diff(edges), []
        few = np.nonzero(size <= FEW)[0]
        if len(few):
            group = np.repeat(np.arange(len(few)), size[few])
            small = table.take(edges[few][group] + np.arange(len(group)) - np.repeat(np.cumsum(size[few]) - size[few], size[few]))
            left = _few_left(small, group, need, least)
            small, ends = small.take(left), np.searchsorted(group[left], np.arange(len(few) + 1))
            parts = [small.slice(a, b - a) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True) if b - a > 1]
        else:
            parts = []
        for part in chain(parts, (table.slice(edges[g], size[g]) for g in np.nonzero(size > FEW)[0].tolist())):
            out += _block_pairs(part, need, least, threshold)
        yield table_of(out, _JOINED)


def _spread(batches):
    """Windows of large runs -> (value, shingle, doc_id, row, packed, at, sure) for each place of their contexts."""
    for batch in batches:
        size = np.array([len(x) // 4 for x in batch.column("context").to_pylist()], np.int64)
        flat = np.frombuffer(b"".join(batch.column("context").to_pylist()), np.uint32).astype(np.int64)
        take = pa.array(np.repeat(np.arange(len(size)), size))
        at = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        own = [batch.column(c).take(take) for c in ("doc_id", "row", "packed")]
        columns = [batch.column("value").take(take), pa.array(flat), *own, pa.array(at), batch.column("sure").take(take)]
        yield pa.RecordBatch.from_arrays(columns, names=["value", "shingle", "doc_id", "row", "packed", "at", "sure"])


def _shared(batches):
    """Rows of _spread() sorted by (value, shingle) -> those not sure that agree in both with a neighbour; one row is held between batches."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
        value, shingle = (table.column(c).to_numpy() for c in ("value", "shingle"))
        same = (value[1:] == value[:-1]) & (shingle[1:] == shingle[:-1])
        good = np.append(False, same) | np.append(same, False)
        if held is not None and matched:  # it agreed with a row before it, and went out with that
            good[0] = False
        matched = bool(len(same) and same[-1])
        if "sure" in table.column_names:
            good &= ~table.column("sure").to_numpy()
        yield from table.select(["doc_id", "row", "packed", "value", "at"]).filter(pa.array(good)).to_batches()
        held = batch.slice(batch.num_rows - 1)


def _enough(batches, need: int, least: int):
    """(value, doc_id, row, packed, at: places shared in the run) -> the windows that have enough around their centre."""
    for batch in batches:
        good = []
        for packed, at in zip(*(batch.column(c).to_pylist() for c in ("packed", "at")), strict=True):
            low, high = _reach(packed)
            flags = np.zeros(high - low + 1, np.int64)
            flags[at] = 1
            good.append(len(flags) >= least and _most_around(flags, np.array([len(flags)]), np.array([(packed >> _CENTRE) - low]), least)[0] >= need)
        yield batch.select(_MEMBER).filter(pa.array(good, pa.bool_()))


def _open_runs(member: DataFrame) -> DataFrame:
    """Members of runs of more than one document in which others than the first are open; n and n_open of their run."""
    who = F.struct(F.col("doc_id"), F.col("row"))
    runs = member.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.count_if("open").alias("n_open"), F.min(who).alias("least"), F.max(who).alias("most"), F.max(F.when(F.col("open"), who)).alias("last"))
    runs = runs.where("most != least and last is not null and last != least")
    return member.join(runs.select("value", "n", "n_open"), "value")


def _counted(member: DataFrame) -> DataFrame:
    """member with n and n_open of their run, if it still has two members and an open one."""
    runs = member.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.count_if("open").alias("n_open"))
    return member.join(runs.where("n > 1 and n_open > 0"), "value")


def _still_open(member: DataFrame, found: DataFrame) -> DataFrame:
    """member with `open` (no passage of found that repeats an earlier document covers the centre) and `core`.

    core: of a window that is not open the row of the first document that it repeats, else one of its own.
    """
    held = found.groupBy(F.col("doc_b").alias("doc_id"), F.col("row_b").alias("row"))
    held = held.agg(F.collect_set(F.struct("doc_a", "row_a", "start_b", "end_b")).alias("held"))
    centre = F.shiftright("packed", _CENTRE)
    over = F.filter("held", lambda s: (s["start_b"] <= centre) & (centre < s["end_b"]))
    first = F.array_min(F.transform(over, lambda s: F.struct(s["doc_a"], s["row_a"])))["row_a"]
    met = member.join(held.withColumnsRenamed({"doc_id": "held_id", "row": "held_row"}), (F.col("row") == F.col("held_row")) & F.col("doc_id").eqNullSafe(F.col("held_id")), "left")
    met = met.select(*_MEMBER, first.alias("first"))
    return met.select(*_MEMBER, F.col("first").isNull().alias("open"), F.coalesce("first", F.xxhash64("row", "packed")).alias("core"))


def _in_blocks(state: DataFrame) -> DataFrame:
    """Windows with n and n_open of their run -> with side, i, j: groups of about BLOCK_A open windows and BLOCK_B others.

    side 0: open ones, 1: all that they are compared with, 2: both, in runs of one block.
    """
    i_blocks, j_blocks = F.ceil(F.col("n_open") / BLOCK_A).cast("long"), F.ceil(F.col("n") / BLOCK_B).cast("long")
    spot, none = F.xxhash64("row", "packed", F.lit(7)), F.lit(0).cast("long")
    every = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    entry = lambda side, i, j: F.struct(F.lit(side).alias("side"), i.alias("i"), j.alias("j"))
    left = F.when(F.col("open"), F.transform(every(j_blocks), lambda j: entry(0, F.pmod(spot, i_blocks), j)))
    right = F.transform(every(i_blocks), lambda i: entry(1, i, F.pmod(spot, j_blocks)))
    both = F.concat(F.coalesce(left, F.array().cast("array<struct<side:int,i:bigint,j:bigint>>")), right)
    places = F.when((i_blocks == 1) & (j_blocks == 1), F.array(entry(2, none, none))).otherwise(both)
    return state.select(*_CONTEXT, F.explode(places).alias("at")).select(*_CONTEXT, "at.*")


class _Search:
    """The two rounds over one frame of documents."""

    def __init__(self, docs: DataFrame, least_words: int, threshold: float):
        if not SHINGLE <= least_words <= 200:
            raise ValueError("least_words must lie between 5 and 200")
        self.least, self.threshold = least_words - SHINGLE + 1, threshold
        self.need = math.ceil(threshold * self.least - 1e-9)
        self.source = id_and_text(docs).withColumn("row", row_key())

    def texts(self, wanted: DataFrame, rows: DataFrame) -> DataFrame:
        """The text of each document of wanted(doc_id, row, ...), whose row keys are those of rows, once however often listed.

        All is dealt by row alone (the ids are compared, but are no key of the join), so a text is shuffled once.
        """
        other = wanted.withColumnsRenamed({"doc_id": "w_id", "row": "w_row"})
        same = F.coalesce(F.col("doc_id") == F.col("w_id"), F.col("doc_id").isNull() & F.col("w_id").isNull())
        met = perhaps(self.source, F.col("row"), rows).join(other, (F.col("row") == F.col("w_row")) & same)
        return met.drop("w_id", "w_row").dropDuplicates(["doc_id", "row"])

    def stretches(self, pairs: DataFrame, agree: int, label: str) -> DataFrame:
        pairs = pairs.groupBy("row_a", "doc_a", "row_b", "doc_b").agg(F.collect_set(F.struct("at_a", "at_b")).alias("at"))
        return materialize(pairs.mapInArrow(lambda it: _stretches(it, agree), _PAIR + ", from_a long, to_a long, from_b long, to_b long").distinct(), label)

    def verified(self, spans: DataFrame, label: str) -> DataFrame:
        # what a text is asked for lies on a grid, so a passage's first document is asked for little, however many repeat it
        sides = [spans.select(F.col(f"doc_{s}").alias("doc_id"), F.col(f"row_{s}").alias("row"), F.col(f"from_{s}").alias("low"), F.col(f"to_{s}").alias("high")) for s in "ab"]
        wanted = sides[0].union(sides[1]).repartition("row").groupBy("doc_id", "row").agg(F.collect_set(F.struct("low", "high")).alias("wanted"))
        parts = self.texts(wanted, spans.select("row_a").union(spans.select("row_b"))).select("doc_id", "row", "text", "wanted").mapInArrow(_fetched, "doc_id long, row long, low long, high long, part binary")
        parts = materialize(parts, label + "-parts")
        both = spans
        for s in "ab":
            side = parts.select(F.col("doc_id").alias("p_id"), F.col("row").alias("p_row"), F.col("low").alias("p_low"), F.col("high").alias("p_high"), F.col("part").alias(f"part_{s}"))
            same = (F.col(f"row_{s}") == F.col("p_row")) & (F.col(f"from_{s}") == F.col("p_low")) & (F.col(f"to_{s}") == F.col("p_high"))
            both = both.join(side, same & F.col(f"doc_{s}").eqNullSafe(F.col("p_id"))).drop("p_id", "p_row", "p_low", "p_high")
        both = both.select("row_a", "doc_a", "row_b", "doc_b", "from_a", "from_b", "part_a", "part_b")
        least, threshold = self.least, self.threshold
        out = both.mapInArrow(lambda it: _verified(it, least, threshold), _PAIR + ", start_a long, end_a long, start_b long, end_b long")
        out = materialize(out, label)
        discard(parts)
        return out

    def stars(self) -> tuple[DataFrame, DataFrame]:
        """(members of runs, stretches of their stars)."""
        least = self.least
        found = self.source.mapInArrow(lambda it: _window_rows(it, least), "value long, doc_id long, row long, packed long")
        # most values occur once: those rows go before the sort by all keys, after one by a single number, which is cheap
        found = found.repartition("value").sortWithinPartitions("value").mapInArrow(_not_alone, "value long, doc_id long, row long, packed long")
        runs = found.withColumn("follow", F.col("packed").bitwiseAND((1 << _HASH) - 1))
        runs = runs.sortWithinPartitions("value", "follow", F.col("doc_id").asc_nulls_first(), "row", "packed")
        schema = "value long, doc_id long, row long, packed long, other_id long, other_row long, other_packed long, earlier boolean"
        member = materialize(runs.select("follow", *_MEMBER).mapInArrow(_stars, schema), "substring-members")
        # each number is kept once, in the order of the run; which document is the first of the pair is told when it is read
        sides = (("other_row", "other_id", "other_packed"), ("row", "doc_id", "packed"))
        side = lambda c, first: F.when(F.col("earlier"), F.col(sides[first][c])).otherwise(F.col(sides[1 - first][c]))
        pairs = member.where("other_row is not null").select(*[side(c, first).alias(f"{name}_{'ab'[1 - first]}") for c, name in ((0, "row"), (1, "doc"), (2, "at")) for first in (1, 0)])
        return member, self.stretches(pairs.select(*_JOINED), AGREE, "substring-stretches")

    def thinned(self, large: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(windows of runs of many blocks that have enough around them in other texts of their run, a table they are read from)."""
        least, need = self.least, self.need
        # windows of equal contexts are spread once: all their places are shared, and they need not be counted
        alike = ["value", "left", "one", "two"]
        keyed = large.withColumns({"left": F.shiftright("packed", _LEFT).bitwiseAND(_NINE), "one": F.xxhash64("context"), "two": F.xxhash64(F.lit(1), "context")})
        kinds = keyed.groupBy(*alike).agg(F.count(F.lit(1)).alias("times"), F.first(F.struct("doc_id", "row", "packed", "context")).alias("w"))
        kinds = materialize(kinds.select(*alike, "times", "w.*"), "substring-kinds")
        spread = kinds.select(*_MEMBER, "context", (F.col("times") > 1).alias("sure")).mapInArrow(_spread, "value long, shingle long, doc_id long, row long, packed long, at long, sure boolean")
        # held by another window of the run: another text's, or the same text's, whose shingle is there twice
        runs = spread.repartition("value", "shingle").sortWithinPartitions("value", "shingle")
        shared = runs.mapInArrow(_shared, "doc_id long, row long, packed long, value long, at long")
        places = shared.groupBy(*_MEMBER).agg(F.collect_list("at").alias("at"))
        kept = places.mapInArrow(lambda it: _enough(it, need, least), "value long, doc_id long, row long, packed long")
        kept = kept.withColumnsRenamed({"value": "k_value", "doc_id": "k_id", "row": "k_row", "packed": "k_packed"})
        same = (F.col("value") == F.col("k_value")) & (F.col("row") == F.col("k_row")) & (F.col("packed") == F.col("k_packed"))
        single = kinds.where("times = 1").join(kept, same & F.col("doc_id").eqNullSafe(F.col("k_id")), "left_semi")
        good = kinds.where("times > 1").select(*alike).union(single.select(*alike))
        return keyed.join(good, alike, "left_semi").select(*large.columns), kinds

    def contexts(self, state: DataFrame) -> DataFrame:
        """state with the shingles that each window reaches: a text moves once, to all of its windows."""
        counts = "open boolean, core long, n long, n_open long"
        own = state.repartition("row").groupBy("doc_id", "row").agg(F.collect_set(F.struct("value", "packed", "open", "core", "n", "n_open")).alias("windows"))
        texts = self.texts(own, state.select("row")).select("doc_id", "row", "text", "windows")
        return texts.mapInArrow(_contexts, f"value long, doc_id long, row long, packed long, {counts}, context binary")

    def blocks(self, state: DataFrame) -> DataFrame:
        """Links that blocks find: state holds the windows of open runs, with n and n_open of their run."""
        least, need, threshold = self.least, self.need, self.threshold

        def compared(windows: DataFrame, label: str) -> DataFrame:
            blocks = _in_blocks(windows).repartition("value", "i", "j").sortWithinPartitions("value", "i", "j")
            pairs = blocks.mapInArrow(lambda it: _blocks(it, need, least, threshold), f"{_PAIR}, at_a long, at_b long")
            return self.stretches(pairs, 1, label)

        wide = (F.col("n_open") > BLOCK_A) & (F.col("n") > BLOCK_B)
        small = compared(self.contexts(state.where(~wide)), "substring-blocks")
        if state.where(wide).isEmpty():
            return small
        large = materialize(self.contexts(state.where(wide)), "substring-contexts")
        thin, kinds = self.thinned(large)
        large_pairs = compared(_counted(thin.drop("n", "n_open")), "substring-large")
        discard(large, kinds)
        return small.union(large_pairs).distinct()

    def run(self) -> DataFrame:
        member, spans = self.stars()
        found = self.verified(spans, "substring-first")
        rest = _still_open(member.where(F.shiftright("packed", _HASH).bitwiseAND(7) < BLOCK_HASHES), found)
        state = materialize(_open_runs(rest), "substring-open")
        discard(member)
        more = self.blocks(state).subtract(spans)
        second = self.verified(more, "substring-second")
        discard(state, spans)
        return found.union(second).distinct()


def repeats(docs: DataFrame, least_words: int = LEAST, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each passage of document b that repeats one of document a, which sorts before it.

    row_a, doc_a, row_b, doc_b, then word places [start_a, end_a) and [start_b, end_b). Every passage of a document
    that an earlier one holds is covered, and documents that share a passage are linked, if not directly then by
    others that hold it; copies are not expanded into all their pairs.
    """
    prepare(docs.sparkSession)
    return _Search(docs, least_words, threshold).run()


def _without(batches):
    for batch in batches:
        texts = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            if spans:
                places = [m.span() for m in _WORD.finditer(text)]
                parts, at, done = [], 0, 0
                for s in sorted(spans, key=lambda s: (s["start_b"], s["end_b"])):
                    start, end = max(s["start_b"], done), min(s["end_b"], len(places))
                    if start < end:
                        parts.append(text[at : places[start][0]])
                        at, done = (places[end][0] if end < len(places) else len(text)), end
                text = "".join(parts) + text[at:]
            texts.append(text)
        yield pa.RecordBatch.from_arrays([batch.column("others"), pa.array(texts, pa.string())], names=["others", "text"])


def remove_repeats(docs: DataFrame, **options) -> DataFrame:
    """docs with every passage removed from a text that repeats an earlier document's; all rows and columns stay."""
    found = repeats(docs, **options)
    spans = found.groupBy(F.col("doc_b").alias("s_id"), F.col("row_b").alias("s_row")).agg(F.collect_set(F.struct("start_b", "end_b")).alias("spans"))
    marked = id_and_text(docs, carried(docs)).withColumn("row", row_key())
    met = marked.join(spans, (F.col("row") == F.col("s_row")) & F.col("doc_id").eqNullSafe(F.col("s_id")), "left")
    met = met.select("others", "text", "spans")
    cut = met.mapInArrow(_without, met.select("others", "text").schema)
    return restored(cut, docs)
