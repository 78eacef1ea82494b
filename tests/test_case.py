"""Upper case by single characters, so that quotes in capitals are found as the SQL finds them."""

import duckdb
import pytest
from pyspark.sql import functions as F

from kalendry.functions import text as tx
from kalendry.plans import QUERIES, SQL


def test_each_character_by_itself(spark):
    texts = ["Straße ŉ ﬁ ᾳ ά\nz", "plain é", "", None, "".join(tx._ONE_EACH)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(tx.upper_each(F.col("t"))).collect()
    con = duckdb.connect()
    assert [r[0] for r in got] == [con.execute("SELECT upper(?::VARCHAR)", [t]).fetchone()[0] for t in texts]


@pytest.mark.parametrize("name", ["evidence_containment", "quotes_on_pages"])
def test_quotes_with_sharp_s(spark, tmp_path, name):
    start = '<!DOCTYPE html><html lang="de"><title>Zuß ßer Größe, ' + "Maß Fuß weiß heißt und so weiter " * 30
    rows = [(i, f"http://x/{i}", start + f"Nr {i}") for i in range(6)]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame([(1, "heißt und")], "item_id long, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(1, "STRASSE")], "doc_id long, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    for t in ("pages", "benchmark", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    found = con.execute(SQL[name])
    names = [d[0] for d in found.description]
    want = sorted(found.fetchall())
    assert want and sorted(tuple(r[n] for n in names) for r in QUERIES[name](spark, folder).collect()) == want
