import glob
import os

import duckdb
import pytest

import __spark_entry__
from veritab.plans import catalog


@pytest.fixture(scope="module")
def tables(small):
    con = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def plain(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(round(r[i], 7) if isinstance(r[i], float) else r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, small, tables, name):
    df = catalog.QUERIES[name](spark, small)
    other = tables.execute(catalog.ORACLES[name])
    columns = [c[0] for c in other.description]
    assert sorted(df.columns) == sorted(columns)
    assert plain(df.columns, df.collect()) == plain(columns, other.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_runs(spark, small, name):
    assert catalog.QUERIES[name](spark, small).count() > 0


def test_entry(spark, small):
    assert __spark_entry__.entry(spark).count() == 4 * 52
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
