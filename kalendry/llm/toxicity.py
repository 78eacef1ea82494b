"""Operator 9: a chain of linear classifiers over document categories.

Categories are predicted one after the other, and each link's linear model sees the probabilities of the
links before it. While learning, those probabilities are predicted for rows that their models were not
fitted to (out of fold), so later links learn from inputs like those they get later. Features are the
presence of words (letters, lower case) whose share differs most between labelled rows that have a
category and those that have not.

The models are fitted to at most about TRAIN_DOCS labelled rows, drawn by id hash. Defined cases: a null or
empty text has no words and gets the intercepts' probabilities; a category with labels of one kind only is
predicted as that share; without labels, 0. Rows are independent; other columns are not looked at.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kalendry.llm.common import WORD_OF_LETTERS, Cache, carried, id_and_text, one_text_each, prepare, restored, spot

TRAIN_DOCS, WORDS, FOLDS, RIDGE = 12_000, 300, 5, 1.0
#: Labelled rows that are numbers of eight bytes at a time while the driver fits; the rest are a byte a word.
FIT_ROWS = 1000


def _blocks(words: np.ndarray, before: np.ndarray, rows: np.ndarray):
    """(place in rows, inputs with the intercept's column) of FIT_ROWS rows at a time: only they are ever wide numbers."""
    for i in range(0, len(rows), FIT_ROWS):
        part = rows[i : i + FIT_ROWS]
        yield slice(i, i + len(part)), np.column_stack([words[part], before[part], np.ones(len(part))])


def _fit(words: np.ndarray, before: np.ndarray, y: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps over some rows of words (bytes) and of earlier links' probabilities; the last weight is the intercept."""
    y = y[rows]
    w = np.zeros(words.shape[1] + before.shape[1] + 1)
    if not len(y) or y.min() == y.max():
        share = min(max(y.mean() if len(y) else 0.0, 1e-6), 1 - 1e-6)
        w[-1] = np.log(share / (1 - share))
        return w
    penalty = np.full(len(w), RIDGE)
    penalty[-1] = 1e-6
    for _ in range(25):
        curve, slope = np.diag(penalty), -penalty * w
        for at, x in _blocks(words, before, rows):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope += x.T @ (y[at] - p)
            x *= np.sqrt(p * (1 - p) + 1e-9)[:, None]
            curve += x.T @ x
        step = np.linalg.solve(curve, slope)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _probability(words: np.ndarray, before: np.ndarray, w: np.ndarray, rows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows))
    for at, x in _blocks(words, before, rows):
        out[at] = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return out


class Chain:
    """Links in order; link k's inputs are the words (0 or 1, as bytes) and the probabilities of links 0 .. k-1."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        fold, every = np.arange(len(x)) % FOLDS, np.arange(len(x))
        self.links, before = [], np.zeros(y.shape)
        for k in range(y.shape[1]):
            self.links.append(_fit(x, before[:, :k], y[:, k], every))
            for f in range(FOLDS):
                before[fold == f, k] = _probability(x, before[:, :k], _fit(x, before[:, :k], y[:, k], every[fold != f]), every[fold == f])

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(self.links)))
        for k, w in enumerate(self.links):
            out[:, k] = _probability(x, out[:, :k], w, np.arange(len(x)))
        return out


def _finder(vocabulary: list[str]) -> Cache:
    at = {w: i for i, w in enumerate(vocabulary)}
    return Cache(lambda run: tuple(at[w] for w in WORD_OF_LETTERS.findall(run.lower()) if w in at))


def _presence(texts: list[str], find: Cache, n: int) -> np.ndarray:
    x = np.zeros((len(texts), n), np.uint8)
    for i, t in enumerate(texts):
        for found in map(find.__getitem__, t.split()):
            if found:
                x[i, found] = 1
    return x


def _rows(batches, vocabulary: list[str]):
    find = _finder(vocabulary)
    for batch in batches:
        x = _presence([t or "" for t in batch.column("text").to_pylist()], find, len(vocabulary))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("marks"), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "marks", "x"])


def learn(docs: DataFrame, labels: DataFrame, categories: list[str], most: int = TRAIN_DOCS) -> tuple[list[str], Chain]:
    """(vocabulary, chain) from labels(doc_id, one 0/1 column for each category)."""
    prepare(docs.sparkSession)
    known = labels.where(" and ".join(f"{c} is not null" for c in ["doc_id", *categories])).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.array(*[F.max(c).cast("int") for c in categories]).alias("marks"))
    share = min(1.0, most / max(known.count(), 1))
    if share < 1:
        known = known.where(spot("doc_id", 9) < share)
    own = one_text_each(id_and_text(docs).join(F.broadcast(known), "doc_id"), "marks").cache()  # known is bounded by `most`
    words = own.select("marks", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"(\p{L}+(?:\p{M}+\p{L}*)*)"), F.lit(1)))).alias("word"))
    sizes = own.agg(F.count(F.lit(1)), *[F.sum(F.col("marks")[k]) for k in range(len(categories))]).first()
    vocabulary: set[str] = set()
    seen = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("marks")[k]).alias(f"n{k}") for k in range(len(categories))]).where("n >= 3").cache()
    for k in range(len(categories)):
        have, n = float(sizes[k + 1] or 0), float(sizes[0])
        rate = (F.col(f"n{k}") + 0.5) / (have + 1) / ((F.col("n") - F.col(f"n{k}") + 0.5) / (n - have + 1))
        vocabulary |= {r.word for r in seen.orderBy((F.abs(F.log(rate)) * F.sqrt("n")).desc(), "word").limit(WORDS).collect()}
    vocabulary_list = sorted(vocabulary)
    rows = own.mapInArrow(lambda it: _rows(it, vocabulary_list), "doc_id long, marks array<int>, x binary").toArrow().sort_by("doc_id")
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.uint8).reshape(rows.num_rows, len(vocabulary_list))
    y = np.array(rows.column("marks").to_pylist(), np.float64).reshape(rows.num_rows, len(categories))
    own.unpersist()
    seen.unpersist()
    return vocabulary_list, Chain(x, y)


def _scored(batches, vocabulary: list[str], chain: Chain):
    find = _finder(vocabulary)
    for batch in batches:
        p = chain.predict(_presence([t or "" for t in batch.column("text").to_pylist()], find, len(vocabulary)))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "text"), pa.array(list(p), pa.list_(pa.float64()))], names=[*(c for c in batch.schema.names if c != "text"), "probabilities"])


def score(docs: DataFrame, vocabulary: list[str], chain: Chain, *more) -> DataFrame:
    """doc_id, the columns in more, probabilities (one for each category, in order) for every row of docs."""
    prepare(docs.sparkSession)
    source = id_and_text(docs, *more)
    kept = T.StructType([f for f in source.schema if f.name != "text"] + [T.StructField("probabilities", T.ArrayType(T.DoubleType()))])
    return source.mapInArrow(lambda it: _scored(it, vocabulary, chain), kept)


def keep_clean(docs: DataFrame, vocabulary: list[str], chain: Chain, category: int, most: float = 0.5) -> DataFrame:
    """The rows of docs whose probability of a category is below `most`, with all their columns."""
    p = score(docs, vocabulary, chain, carried(docs), F.col("text").cast("string").alias("kept"))
    return restored(p.where(F.col("probabilities")[category] < most).select("others", F.col("kept").alias("text")), docs)
