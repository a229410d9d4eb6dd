"""Every registered query of the engine against its DuckDB oracle on the smallest tables."""

import datetime
import glob
import os
import random

import duckdb
import pytest

from lakeproof.plans import catalog, reports  # noqa: F401

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return c


def plain(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    cell = lambda v: round(float(v), 6) if isinstance(v, float) else v
    return sorted(repr(tuple(cell(r[k]) for k in order)) for r in rows)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_equals_oracle(spark, con, name):
    df = catalog.QUERIES[name](spark, DATA)
    got = con.execute(catalog.ORACLES[name])
    columns = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(columns)
    assert plain(df.columns, df.collect()) == plain(columns, got.fetchall())


def equals_oracle(spark, name, folder, table):
    c = duckdb.connect()
    c.sql(f"create view {table} as select * from read_parquet('{folder}/{table}.parquet/*.parquet')")
    got = c.execute(catalog.ORACLES[name])
    df = catalog.QUERIES[name](spark, folder)
    found, expected = plain(df.columns, df.collect()), plain([x[0] for x in got.description], got.fetchall())
    return expected if found == expected else (found, expected)


@pytest.mark.parametrize("n_critical, n_other", [(3, 1_000_001), (11, 1_000_001), (11, 1_000_000), (0, 0)])
def test_security_gate_beyond_either_limit(spark, tmp_path, n_critical, n_other):
    orders = spark.range(n_other).selectExpr("5 * id + 4 AS o_orderkey", "id AS o_custkey", "'3-MEDIUM' AS o_orderpriority")
    orders = orders.unionAll(spark.range(n_critical).selectExpr("5 * id", "id", "'1-URGENT'"))
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    reason = f"CRITICAL: {n_critical} > 10" if n_critical > 10 else ""
    assert equals_oracle(spark, "security_gate", str(tmp_path), "orders") == [repr((n_critical <= 10 and n_other <= 1_000_000, reason))]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_sessionize_at_fractions_of_a_second(spark, tmp_path, zone):
    """Pauses of an hour to the microsecond, in the night that clocks change; events without a time, an id or a user. Equal (ts,
    event_id) are left out: the SQL orders them anew in each of its two windows, so at a session's start its result is open."""
    rng, rows = random.Random(7), []
    for user in (*range(40), None):
        at = datetime.datetime(2024, 3, 9, 22) + datetime.timedelta(microseconds=rng.randrange(10**9))
        for _ in range(30):
            at += datetime.timedelta(seconds=rng.choice([5, 3599, 3600, 3600, 3600]), microseconds=rng.choice([0, 0, 1, 400_000, 999_999]))
            rows.append((rng.choice([len(rows), None]), rng.choice([at] * 9 + [None]), user))
    zone_before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long").write.parquet(f"{tmp_path}/events.parquet")
        assert len(equals_oracle(spark, "sessionize", str(tmp_path), "events")) > 200
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone_before)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
