"""The corpus pipeline: toxicity, quality, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; run() writes every
stage's documents as Parquet in the shared folder and rereads them. Models are fitted to the whole
`documents` and `labels` tables of sf_dir; each stage's own input decides everything else. Rows may repeat,
and texts may be null or empty, as each operator's docstring defines. No stage is SQL: the tests hold the
result against a brute-force version.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kalendry.llm import minhash, packing, quality, substring, toxicity
from kalendry.llm.common import materialize, table

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that operator 9 does not call toxic. Null and empty texts get the intercepts' probability, which is clean."""
    labels = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("junk"), "toxic")
    vocabulary, chain = toxicity.learn(table(spark, sf_dir, "documents"), labels, ["junk", "toxic"])
    return toxicity.keep_clean(docs, vocabulary, chain, 1)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that operator 6 scores 0.5 or more. Null and empty texts get the network's score for no words."""
    vectors = quality.word_vectors(docs)
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    network = quality.train(table(spark, sf_dir, "documents"), labels, vectors)
    return quality.keep_good(docs, vectors, network)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of operator 1, that with the least doc_id; a null or wordless text is a class of its own row."""
    return minhash.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the passages by operator 10 that repeat an earlier document; null texts stay null."""
    return substring.remove_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of operator 5; a null or empty text is the closing id alone."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", drop_low_quality),
    ("minhash near-dedup", drop_near_duplicates),
    ("substring dedup", cut_repeats),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
