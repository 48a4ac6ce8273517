"""Every registered query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest
from conftest import SF_DIR

import __spark_entry__ as entry_points
from catalogue.oracle import ORACLE
from catalogue.spark_queries import QUERIES


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("SET memory_limit = '4GB'")
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def test_every_oracle_has_a_query():
    assert set(ORACLE) == set(QUERIES)


def test_entry(spark):
    assert set(QUERIES) <= set(entry_points.queries()) and set(ORACLE) <= set(entry_points.oracle_sql())
    assert entry_points.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    mine = QUERIES[name](spark, SF_DIR).toPandas()
    other = sql.sql(ORACLE[name]).df()
    columns = sorted(mine.columns)
    assert columns == sorted(other.columns) and len(mine) == len(other)
    mine, other = (d[columns].sort_values(columns).reset_index(drop=True) for d in (mine, other))
    for c in columns:
        same = (mine[c] == other[c]) | (mine[c].isna() & other[c].isna())
        assert same.all(), (c, mine[c][~same].head(3).tolist(), other[c][~same].head(3).tolist())
