"""The queries of this subpackage for the driver: opN_<name>(spark, sf_dir) over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kalendry.llm import bpe, divergence, fingerprint, langid, minhash, mixing, packing, quality, resampling, sharding, substring, topk, toxicity
from kalendry.llm.common import crc_fold, new_folder, table


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id (least doc_id of its near-duplicate class), class_size."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")
    return langid.predict(docs, crc_fold(4) == 2, path, langid.learn(docs.where(crc_fold(4) != 2), path))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appends the documents as small shards, compacts them, and reports every live shard from its rows."""
    shards = sharding.ShardedTable(spark, new_folder(spark, "shards"))
    shards.append(table(spark, sf_dir, "documents"))
    shards.compact()
    return sharding.shard_report(shards)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    vectors = quality.word_vectors(docs)
    network = quality.train(docs, labels.where(crc_fold(3) != 1).select("doc_id", F.col("quality").alias("label")), vectors)
    return quality.score(docs, vectors, network, (crc_fold(3) == 1).alias("held_out")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, toxic (1: reject), p_toxic, p_junk: the chain goes from low quality to toxicity."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    vocabulary, chain = toxicity.learn(docs, labels.select("doc_id", (1 - F.col("quality")).alias("junk"), "toxic"), ["junk", "toxic"])
    p = toxicity.score(docs, vocabulary, chain)
    return p.select("doc_id", (F.col("probabilities")[1] >= 0.5).cast("int").alias("toxic"), F.col("probabilities")[1].alias("p_toxic"), F.col("probabilities")[0].alias("p_junk"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each repeated passage: doc_id and its word places, and those of the earlier document it repeats."""
    found = substring.repeats(table(spark, sf_dir, "documents"))
    return found.select(F.col("doc_b").alias("doc_id"), F.col("start_b").alias("start_word"), F.col("end_b").alias("end_word"), F.col("doc_a").alias("first_doc_id"), F.col("start_a").alias("first_start"), F.col("end_a").alias("first_end"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.score(table(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


DIVERGENCE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), t AS (SELECT doc, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS n FROM t GROUP BY ALL HAVING count(DISTINCT doc) >= 10),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM k GROUP BY lang),
s AS (SELECT lang, source, sum(n)::HUGEINT AS n FROM c GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (coalesce(s.n, 0) + 2 * v.v) AS p,
         1 + 1000000000::HUGEINT * (k.n + 2) // (v.n + 2 * v.v) AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
  LEFT JOIN s ON s.lang = g.lang AND s.source = g.source
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q
), r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 10
"""


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict:
    return {"op8_exact_topk": TOPK_SQL, "op11_source_divergence": DIVERGENCE_SQL}
