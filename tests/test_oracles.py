"""Every registered query against its SQL in DuckDB; the others run and return rows."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

from chronopanel import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value) if not isinstance(value, float) else repr(value)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, db, name):
    df = plans.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    if name not in plans.ORACLES:
        assert got
        return
    cur = db.execute(plans.ORACLES[name])
    at = [[d[0] for d in cur.description].index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in cur.fetchall())


@pytest.fixture(scope="module")
def few_trades(tmp_path_factory):
    """Lines dealt anew: most of the 150 entities have no or one closed trade, 20 have several; every 7th has one price only."""
    sf, con = tmp_path_factory.mktemp("few_trades"), duckdb.connect()
    for name in ("supplier", "nation", "region"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    n = "row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate)"
    dealt = f"SELECT * REPLACE (CASE WHEN n % 2 = 0 THEN n // 2 % 150 ELSE n // 2 % 20 END AS l_suppkey) FROM (SELECT *, {n} AS n FROM '{SF}/lineitem.parquet')"
    con.execute(f"COPY (SELECT * EXCLUDE n REPLACE (CASE WHEN l_suppkey % 7 = 0 THEN 1000 ELSE l_extendedprice END AS l_extendedprice) FROM ({dealt})) TO '{sf}/lineitem.parquet'")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{sf}/lineitem.parquet'")
    return str(sf), con


def test_trade_metrics_of_few_trades(spark, few_trades):
    sf, con = few_trades
    columns = ["entity_id", "n_closed", "win_rate", "profit_factor", "mean_win", "mean_loss"]
    got = plans.QUERIES["d34_trade_metrics"](spark, sf).select(*columns).collect()
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({plans.ORACLES['d34_trade_metrics']})").fetchall()
    assert sorted(tuple(map(plain, r)) for r in got) == sorted(tuple(map(plain, r)) for r in want)
    kinds = {(win is None, loss is None) for *_, win, loss in want}
    assert len(kinds) == 4  # both, wins alone, losses alone, neither
