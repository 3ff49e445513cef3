"""The operators' SQL in DuckDB, on whole tables."""

import glob
import os

import duckdb
import pytest

from chronopanel.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(map(str, r)) for r in df.select(*columns).collect())
    cur = con.execute(queries.ORACLES[name])
    at = [[d[0] for d in cur.description].index(c) for c in columns]
    assert got == sorted(tuple(str(r[i]) for i in at) for r in cur.fetchall())
