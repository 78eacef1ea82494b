"""One row of each class, with texts shuffled once."""

from kalendry.llm import minhash


def test_kept_rows_are_dealt_once(spark, make_docs):
    """Rows listed twice and null ids, too; texts go through one shuffle for the choice and the doubles."""
    docs = make_docs([f"one {i} two three four five six" for i in range(20)] * 2).union(make_docs(["same words here"] * 2))
    docs = docs.union(docs.limit(5)).union(docs.limit(1).selectExpr(*["NULL AS doc_id" if c == "doc_id" else c for c in docs.columns]))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = minhash.keep_one(docs)
        plan = kept._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("hashpartitioning(who") == 1 and "hashpartitioning(doc_id" not in plan
    rows = [r.text for r in kept.collect()]
    assert sorted(rows) == sorted({r.text for r in docs.collect()})
