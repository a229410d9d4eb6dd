"""The queries of this package that SQL can express, against DuckDB."""

import glob
import os

import duckdb
import pytest

from lakeproof.llm import queries

DATA = "/root/testdata/sf0.001"


def plain(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(repr(tuple(round(float(r[k]), 6) if isinstance(r[k], float) else r[k] for k in order)) for r in rows)


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    df, want = queries.QUERIES[name](spark, DATA), con.execute(queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns) and plain(df.columns, df.collect()) == plain(columns, want.fetchall())
