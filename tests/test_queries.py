"""Every query against its SQL in DuckDB, on the whole small tables."""

import os

import duckdb
import pytest

from kalendry.plans import QUERIES, SQL

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    got = QUERIES[name](spark, SF)
    names = sorted(got.columns)
    rows = sorted((tuple(r[n] for n in names) for r in got.collect()), key=repr)
    found = oracle.execute(SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == names
    want = sorted((tuple(dict(zip(columns, r, strict=True))[n] for n in names) for r in found.fetchall()), key=repr)
    assert rows == want
    assert rows
