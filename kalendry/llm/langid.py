"""Operator 3: language identification by unigram pieces, with all segmentations summed.

The pieces are those of a public vocabulary file; their probabilities are learned here for each language.
A text is its runs of letters, lower case, each marked as a word start. The likelihood of a word is the
sum over all its segmentations into pieces, which the forward algorithm adds up from prefix to prefix;
letters that no piece covers have a small floor. Learning is expectation maximisation over word counts:
forward and backward sums give every piece's expected count, which Spark adds up over the words.

A text's likelihoods are the products over its words; score is the winner's share of their sum. In words
longer than SHORT letters the sums of every place are kept as logarithms, so none underflows. Defined cases: a null text or one without letters is "und" with
score 0; ties go to the language that sorts first; without any training rows every text is "und". Columns
other than doc_id, text and (for training) lang are not looked at.
"""

from __future__ import annotations

import functools

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kalendry.llm.common import WORD_OF_LETTERS, id_and_text, prepare

#: Training rows of each language are sampled by hash to about this many documents; of rarer ones, all are taken.
TRAIN_DOCS = 4000
PASSES, FLOOR, SHORT, KEEP = 3, 1e-9, 32, 400_000
#: Words, and letters of long words, of one call of forward().
WORDS, LETTERS = 20_000, 200_000
#: Keeps forward sums of long words in range: a letter's part of every piece's probability.
SCALE = 30.0


class Pieces:
    """The vocabulary's pieces as an automaton that lists all pieces ending at each place."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        kept = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        self.size = len(kept)
        self.automaton = ahocorasick.Automaton()
        for i, piece in enumerate(kept):
            self.automaton.add_word(piece, i << 8 | len(piece))
        self.automaton.make_automaton()
        self.lengths = np.array([len(p) for p in kept])

    def lattice(self, words: list[str]):
        """All piece matches in the words, by place within their word: (order of levels, start, end, piece, word bounds)."""
        joined = "\n".join(words)
        found = np.fromiter((e << 32 | v for e, v in self.automaton.iter(joined)), np.int64) if joined else np.empty(0, np.int64)
        end, piece, size = (found >> 32) + 1, (found >> 8) & 0xFFFFFF, found & 0xFF
        lengths = np.array([len(w) for w in words])
        first = np.cumsum(lengths + 1) - lengths - 1
        origin = np.repeat(first, lengths + 1)[: len(joined) + 1]
        return end - size, end, piece, end - origin[np.minimum(end, len(origin) - 1)], first, lengths


@functools.lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


def _levels(place: np.ndarray):
    order = np.argsort(place, kind="stable")
    return order, np.searchsorted(place[order], np.arange(1, (int(place.max()) if len(place) else 0) + 2))


def forward(pieces: Pieces, words: list[str], table: np.ndarray):
    """Scaled sums over all segmentations of every prefix: (log likelihood of each word, sums, their logs' offsets, lattice).

    With words of more than SHORT letters, every place's sum is made 1 and its logarithm goes to the offset.
    """
    start, end, piece, place, first, lengths = lattice = pieces.lattice(words)
    weights = table * SCALE ** pieces.lengths[:, None]
    total = int(first[-1] + lengths[-1]) + 1
    sums = np.zeros((total, table.shape[1]))
    sums[first] = 1
    scaled = int(lengths.max()) > SHORT
    logs = np.zeros(sums.shape if scaled else (0, 0))
    order, cuts = _levels(place)
    for p in range(1, int(lengths.max()) + 1):
        here = first[lengths >= p] + p
        sums[here] = sums[here - 1] * (FLOOR * SCALE)
        if scaled:
            logs[here] = logs[here - 1]
        if p < len(cuts):
            m = order[cuts[p - 1] : cuts[p]]
            if len(m):
                at = end[m]
                turns = np.concatenate([[0], np.nonzero(np.diff(at))[0] + 1])  # matches come in order of their end
                flow = sums[start[m]] * weights[piece[m]]
                if scaled:
                    flow *= np.exp(logs[start[m]] - logs[at])
                sums[at[turns]] += np.add.reduceat(flow, turns, axis=0)
        if scaled:
            logs[here] += np.log(sums[here])
            sums[here] = 1
    whole = np.log(sums[first + lengths]) + (logs[first + lengths] if scaled else 0)
    return whole - lengths[:, None] * np.log(SCALE), sums, logs, lattice


def expected(pieces: Pieces, words: list[str], counts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Expected number of times each piece is used in these words of one language (a table of one column)."""
    _, sums, logs, (start, end, piece, place, first, lengths) = forward(pieces, words, table)
    sums, weights = sums[:, 0], (table[:, 0] * SCALE**pieces.lengths)
    logs = logs[:, 0] if len(logs) else None
    used = np.zeros(len(sums))  # expected number of times that a segmentation has a cut here
    used[first + lengths] = counts

    def part(a, b):  # of the sum at b, what comes from a, but for the piece's own factor
        return sums[a] / sums[b] * (1 if logs is None else np.exp(logs[a] - logs[b]))

    order, cuts = _levels(place)
    out = np.zeros(pieces.size)
    for p in range(int(lengths.max()), 0, -1):
        here = first[lengths >= p] + p
        used[here - 1] += used[here] * part(here - 1, here) * (FLOOR * SCALE)
        if p < len(cuts):
            m = order[cuts[p - 1] : cuts[p]]
            flow = used[end[m]] * part(start[m], end[m]) * weights[piece[m]]
            np.add.at(out, piece[m], flow)
            np.add.at(used, start[m], flow)
    return out


def _chunks(words: list[str]):
    """Places in words, of short and of long words apart, as many as one call of forward() takes."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    short, long = np.nonzero(lengths <= SHORT)[0], np.nonzero(lengths > SHORT)[0]
    for i in range(0, len(short), WORDS):
        yield short[i : i + WORDS]
    if len(long):
        yield from np.split(long, np.nonzero(np.diff(np.cumsum(lengths[long]) // LETTERS))[0] + 1)


def words_of(text: str) -> list[str]:
    out = []
    for w in WORD_OF_LETTERS.findall(text.lower()):
        out.append("▁" + w)
    return out


def _count(batches):
    for batch in batches:
        langs, words = [], []
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            own = words_of(text or "")
            langs += [lang] * len(own)
            words += own
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.string())], names=["lang", "word"])


def _expect(batches, path: str, tables: dict[str, np.ndarray]):
    pieces = pieces_of(path)
    out = {}
    for batch in batches:
        by: dict[str, tuple[list, list]] = {}
        for lang, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True):
            own = by.setdefault(lang, ([], []))
            own[0].append(word)
            own[1].append(n)
        for lang, (words, counts) in by.items():
            counts = np.array(counts, float)
            for at in _chunks(words):
                out[lang] = out.get(lang, 0) + expected(pieces, [words[i] for i in at], counts[at], tables[lang])
    for lang, total in out.items():
        some = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(total[some])], names=["lang", "piece", "n"])


def learn(docs: DataFrame, path: str, most: int = TRAIN_DOCS) -> dict[str, np.ndarray]:
    """Piece probabilities of each language in docs(doc_id, text, lang), from about `most` rows of each, one at least."""
    prepare(docs.sparkSession)
    spot = F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit(11)), 1) / F.lit(2.0**63)
    known = id_and_text(docs, F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null").withColumn("spot", spot)
    shares = known.groupBy("lang").agg(F.greatest(F.lit(float(most)) / F.count(F.lit(1)), F.min("spot")).alias("share"))
    known = known.join(F.broadcast(shares), "lang").where("spot <= share").select("doc_id", "text", "lang")
    counts = known.mapInArrow(_count, "lang string, word string").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")).cache()
    pieces = pieces_of(path)
    tables = {r.lang: np.full((pieces.size, 1), 1 / pieces.size) for r in counts.select("lang").distinct().collect()}
    for _ in range(PASSES if tables else 0):
        now = tables
        # at most as many rows as the vocabulary has pieces, for each language
        rows = counts.mapInArrow(lambda it: _expect(it, path, now), "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow()
        langs, piece, n = rows.column("lang").to_numpy(), rows.column("piece").to_numpy(), rows.column("n").to_numpy()
        tables = {}
        for lang in now:
            got = np.zeros(pieces.size)
            got[piece[langs == lang]] = n[langs == lang]
            tables[lang] = ((got + 0.01) / (got.sum() + 0.01 * pieces.size))[:, None]
    counts.unpersist()
    return tables


class Scorer:
    def __init__(self, path: str, langs: list[str], table: np.ndarray):
        self.pieces, self.langs, self.table = pieces_of(path), langs, table
        self._clear()

    def _clear(self):
        self.at: dict[str, int] = {}
        self.rows = np.zeros((KEEP + 1, len(self.langs)))

    def _learn(self, runs: set[str]) -> None:
        """Log likelihoods of runs of text between white space; row KEEP stays zero for those without letters."""
        if len(self.at) + len(runs) > KEEP:
            self._clear()
        words, owner, firsts = [], [], len(self.at)
        for run in runs:
            own = words_of(run)
            words += own
            owner += [len(self.at)] * len(own)
            self.at[run] = len(self.at)
        if len(self.at) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros((len(self.at) - len(self.rows), len(self.langs)))])
        self.rows[firsts : len(self.at)] = 0
        owner = np.array(owner, np.int64)
        for at in _chunks(words):
            np.add.at(self.rows, owner[at], forward(self.pieces, [words[i] for i in at], self.table)[0])

    def score(self, texts: list[str]) -> list[tuple[str, float]]:
        runs = [t.split() for t in texts]
        known = self.at.keys()
        fresh = {r for own in runs for r in own if r not in known}
        if fresh:
            if len(self.at) + len(fresh) > KEEP:
                self._clear()
                fresh = {r for own in runs for r in own}
            self._learn(fresh)
        out = []
        for own in runs:
            total = self.rows[np.fromiter(map(self.at.__getitem__, own), np.int64, len(own))].sum(0)
            if not total.any() or not len(self.langs):
                out.append(("und", 0.0))
            else:
                best = int(total.argmax())
                out.append((self.langs[best], float(1 / np.exp(total - total[best]).sum())))
        return out


_scorers: dict = {}


def _predict(batches, path: str, langs: list[str], table: np.ndarray, name: str):
    if name not in _scorers:  # one for each Python worker and model
        _scorers.clear()
        _scorers[name] = Scorer(path, langs, table)
    scorer = _scorers[name]
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        out = [x for i in range(0, len(texts), 250) for x in scorer.score(texts[i : i + 250])]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])


def predict(docs: DataFrame, held_out, path: str, tables: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs."""
    import uuid

    prepare(docs.sparkSession)
    langs, name = sorted(tables), uuid.uuid4().hex
    table = np.concatenate([tables[x] for x in langs], axis=1) if langs else np.zeros((pieces_of(path).size, 0))
    return id_and_text(docs, held_out.alias("held_out")).mapInArrow(lambda it: _predict(it, path, langs, table, name), "doc_id long, held_out boolean, lang_pred string, score double")
