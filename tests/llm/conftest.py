from pyspark.sql import types as T
import pytest

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, extra=False):
        rows = [(i if not isinstance(t, tuple) else t[0], t if not isinstance(t, tuple) else t[1], None, None, None) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, SCHEMA)
        if extra:  # names that operators use for columns of their own
            for name in ("row", "key", "score", "value", "start", "length"):
                df = df.selectExpr("*", f"'x' as {name}")
        return df

    return make


@pytest.fixture(scope="session")
def small_docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
