"""Every query with SQL equals DuckDB's result on the given tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def tables(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, sf_dir, tables, name):
    df = entry.queries()[name](spark, sf_dir)
    got = sorted(repr([r[c] for c in sorted(df.columns)]) for r in df.collect())
    cur = tables.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    assert sorted(columns) == sorted(df.columns)
    assert got == sorted(repr([r[i] for i in order]) for r in cur.fetchall())


def test_entry(spark, sf_dir):
    assert set(entry.entry(spark).columns) == {"pattern", "entity_id", "ts", "n_events"}
