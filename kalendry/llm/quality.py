"""Operator 6: a quality classifier on random-indexing word vectors.

Every run of text between white space is two words: its letters (lower case), and its shape (case pattern,
length class, punctuation). Words share BUCKETS rows by hash. A row has a fixed sparse random index vector;
its word vector is the sum of the index vectors of the words next to its own occurrences, over all
documents, which tasks add up as dense blocks and Spark sums by block. A document is the mean and the
deviation of its word vectors. A network of two layers, written in numpy, maps that to a probability,
whose temperature is set on training rows that the network has not seen.

Labels are learned from at most about TRAIN_DOCS rows, drawn by id hash. Defined cases: a null or empty
text has zero vectors and gets the network's score for them; null labels are ignored; without labels of
both kinds every score is the share of label 1 (0.5 without any). Rows are scored independently, so
repeated rows get the same score. Columns other than doc_id and text are not looked at.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kalendry.llm.common import WORD_OF_LETTERS, Cache, carried, id_and_text, mix, one_text_each, prepare, restored, spot

BUCKETS, DIMENSIONS, NONZERO = 8192, 64, 2
TRAIN_DOCS, HIDDEN, EPOCHS = 12_000, 32, 60
BLOCKS, FAN_IN = 64, 64


def _bucket(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) % BUCKETS


def _shape(run: str) -> str:
    kinds = []
    for c in run:
        k = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if not kinds or kinds[-1] != k:
            kinds.append(k)
    return "\0" + "".join(kinds) + str(min(len(run).bit_length(), 7))


def run_words() -> Cache:
    return Cache(lambda run: _bucket("".join(WORD_OF_LETTERS.findall(run.lower()))) << 16 | _bucket(_shape(run)))


def _words(texts: list[str], cache: Cache) -> list[np.ndarray]:
    return [np.fromiter(map(cache.__getitem__, r), np.int64, len(r)) for r in (t.split() for t in texts)]


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """(places, signs) of the nonzero entries of each row's index vector."""
    r = mix(np.arange(BUCKETS * NONZERO, dtype=np.uint64) + np.uint64(1)).reshape(BUCKETS, NONZERO)
    return (r % np.uint64(DIMENSIONS)).astype(np.int64), np.where(r >> np.uint64(63), 1.0, -1.0)


def _contexts(batches):
    """(block, salt, sums): this task's part of the word vectors."""
    cache, (place, sign) = run_words(), index_vectors()
    sums = np.zeros(BUCKETS * DIMENSIONS)
    held, size = [], 0

    def add():
        ids = np.concatenate(held)
        letters, shapes = np.append(ids >> 16, 0), np.append(ids & 0xFFFF, 0)
        gap = np.zeros(len(ids), bool)
        gap[np.cumsum([len(x) for x in held])[:-1].astype(int)[np.cumsum([len(x) for x in held])[:-1] < len(ids)]] = True  # first words of texts have none before
        pair = np.nonzero(~gap[1:])[0]
        for own in (letters, shapes):
            for other in (letters, shapes):
                for a, b in ((pair, pair + 1), (pair + 1, pair)):
                    for k in range(NONZERO):
                        sums[:] += np.bincount(own[a] * DIMENSIONS + place[other[b], k], sign[other[b], k], len(sums))

    for batch in batches:
        for ids in _words([t or "" for t in batch.column("text").to_pylist()], cache):
            if len(ids):
                held.append(ids)
                size += len(ids)
                if size > 400_000:
                    add()
                    held, size = [], 0
    if held:
        add()
    salt = TaskContext.get().partitionId() // FAN_IN
    parts = sums.reshape(BLOCKS, -1)
    yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([salt] * BLOCKS, pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["block", "salt", "sums"])


def _add_up(table: pa.Table, salted: bool) -> pa.Table:
    total = sum(np.frombuffer(x, np.float64) for x in table.column("sums").to_pylist())
    out = {"block": pa.array([table.column("block")[0].as_py()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())}
    return pa.table({"block": out["block"], "salt": pa.array([table.column("salt")[0].as_py()], pa.int32()), "sums": out["sums"]} if salted else out)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit word vectors (BUCKETS x DIMENSIONS) from the neighbours of all words of all documents."""
    prepare(docs.sparkSession)
    parts = id_and_text(docs).select("text").mapInArrow(_contexts, "block int, salt int, sums binary")
    # sums of FAN_IN tasks at a time, as often as their number asks for: no task gathers more than FAN_IN blocks
    salted, width = parts, -(-docs.rdd.getNumPartitions() // FAN_IN)
    while True:
        salted = salted.groupBy("block", "salt").applyInArrow(lambda t: _add_up(t, True), "block int, salt int, sums binary")
        if width <= FAN_IN:
            break
        salted, width = salted.withColumn("salt", F.floor(F.col("salt") / FAN_IN).cast("int")), -(-width // FAN_IN)
    rows = salted.groupBy("block").applyInArrow(lambda t: _add_up(t, False), "block int, sums binary").collect()  # BLOCKS rows of fixed size
    out = np.zeros((BLOCKS, BUCKETS * DIMENSIONS // BLOCKS))
    for r in rows:
        out[r.block] = np.frombuffer(bytes(r.sums), np.float64)
    out = out.reshape(BUCKETS, DIMENSIONS)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    out = []
    for own in (ids >> 16, ids & 0xFFFF):
        n = np.bincount(own, minlength=1)
        some = np.nonzero(n)[0]
        weight = n[some].astype(np.float32) / max(len(own), 1)
        v = vectors[some]
        mean = weight @ v
        out += [mean, np.sqrt(np.maximum(weight @ (v * v) - mean * mean, 0))]
    return np.concatenate(out) if len(ids) else np.zeros(4 * vectors.shape[1], np.float32)


class Network:
    """Two layers with tanh between them; full float64, seeded, deterministic."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.temperature, self.constant = 1.0, None
        if len(y) < 10 or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 0.5
            return
        rng = np.random.default_rng(17)
        order = rng.permutation(len(y))
        held, fit = order[: len(y) // 5], order[len(y) // 5 :]
        self.mean, self.scale = x[fit].mean(0), x[fit].std(0) + 1e-3
        z = (x - self.mean) / self.scale
        w = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        m, v, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
        for _ in range(EPOCHS):
            rng.shuffle(fit)
            for i in range(0, len(fit), 128):
                b = fit[i : i + 128]
                h = np.tanh(z[b] @ w[0] + w[1])
                d = (1 / (1 + np.exp(-(h @ w[2] + w[3]))) - y[b]) / len(b)
                back = np.outer(d, w[2]) * (1 - h * h)
                t += 1
                for k, g in enumerate((z[b].T @ back + 1e-3 * w[0], back.sum(0), h.T @ d + 1e-3 * w[2], d.sum(keepdims=True))):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    w[k] = w[k] - 2e-3 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        self.w = w
        s = self.logits(x[held])
        grid = np.exp(np.linspace(-1.5, 2.5, 81))
        loss = [np.logaddexp(0, np.where(y[held] > 0, -s, s) / g).mean() for g in grid]
        self.temperature = float(grid[int(np.argmin(loss))])

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh((x - self.mean) / self.scale @ self.w[0] + self.w[1])
        return h @ self.w[2] + self.w[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


def _features(batches, vectors: np.ndarray):
    cache = run_words()
    for batch in batches:
        x = [pooled(i, vectors).astype(np.float32).tobytes() for i in _words([t or "" for t in batch.column("text").to_pylist()], cache)]
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(x, pa.binary())], names=["label", "x"])


def _scores(batches, vectors: np.ndarray, network: Network):
    cache = run_words()
    for batch in batches:
        ids = _words([t or "" for t in batch.column("text").to_pylist()], cache)
        x = np.array([pooled(i, vectors) for i in ids], np.float64).reshape(len(ids), 4 * vectors.shape[1])
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "text"), pa.array(network.score(x))], names=[*(c for c in batch.schema.names if c != "text"), "score"])


def sample_labels(labels: DataFrame, most: int) -> DataFrame:
    """About `most` labelled rows (doc_id, label), drawn by id hash, one for each id; small enough to broadcast."""
    known = labels.where("doc_id is not null and label is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label")).groupBy("doc_id").agg(F.max("label").alias("label"))
    share = min(1.0, most / max(known.count(), 1))
    return known.where(spot("doc_id", 5) < share) if share < 1 else known


def train(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, most: int = TRAIN_DOCS) -> Network:
    """The network for labels(doc_id, label); the sample is bounded by `most`, so it is broadcast to the texts."""
    prepare(docs.sparkSession)
    own = one_text_each(id_and_text(docs).join(F.broadcast(sample_labels(labels, most)), "doc_id"), "label").select("label", "text")
    rows = own.mapInArrow(lambda it: _features(it, vectors), "label int, x binary").toArrow()
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.float32).reshape(-1, 4 * DIMENSIONS).astype(np.float64)
    y = rows.column("label").to_numpy().astype(np.float64)
    order = np.lexsort(x.T[:8][::-1])  # whatever order rows come in
    return Network(x[order], y[order])


def score(docs: DataFrame, vectors: np.ndarray, network: Network, *more) -> DataFrame:
    """doc_id, the columns in more, score for every row of docs."""
    prepare(docs.sparkSession)
    source = id_and_text(docs, *more)
    kept = T.StructType([f for f in source.schema if f.name != "text"] + [T.StructField("score", T.DoubleType())])
    return source.mapInArrow(lambda it: _scores(it, vectors, network), kept)


def keep_good(docs: DataFrame, vectors: np.ndarray, network: Network, least: float = 0.5) -> DataFrame:
    """The rows of docs with a score of `least` or more, with all their columns; scores travel with the row."""
    good = score(docs, vectors, network, carried(docs), F.col("text").cast("string").alias("kept")).where(F.col("score") >= least)
    return restored(good.select("others", F.col("kept").alias("text")), docs)
