"""Every stage of the pipeline on odd rows and on columns whose names operators use themselves."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kalendry.llm import minhash, queries, substring

SF = "/root/testdata/sf0.001"
NAMES = ["score", "probabilities", "kept_text", "kept", "others", "row", "__row", "__spans", "spans", "a-b", "c.d", "windows", "least"]


@pytest.fixture(scope="module")
def odd(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    more = spark.createDataFrame([(900, None), (901, ""), (902, "  "), (903, "same words here"), (903, "same words here"), (None, "no id at all"), (904, "word " * 30000)], "doc_id long, text string")
    rows = docs.unionByName(more, allowMissingColumns=True)
    return rows.select("*", *[F.concat(F.lit("x"), F.col("doc_id").cast("string")).alias(n) for n in NAMES])


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[:-1]])
def test_stage_on_odd_rows(spark, odd, stage):
    got = stage(spark, odd, SF)
    assert got.columns == odd.columns and got.dtypes == odd.dtypes
    rows = got.collect()
    assert rows and all(r[n] == (None if r.doc_id is None else f"x{r.doc_id}") for r in rows for n in NAMES)
    known = {(r.doc_id, r.lang, r.source) for r in odd.collect()}
    assert {(r.doc_id, r.lang, r.source) for r in rows} <= known
    assert stage(spark, odd.limit(0), SF).count() == 0


def test_what_the_stages_keep_of_odd_rows(spark, odd):
    one = minhash.keep_one(odd).collect()
    assert sum(r.doc_id == 903 for r in one) == 1 and {900, 901, 902, 904, None} <= {r.doc_id for r in one}
    cut = substring.remove_repeats(odd).collect()
    assert len(cut) == odd.count() and {r.doc_id: r.text for r in cut}[900] is None


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))
