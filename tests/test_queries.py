"""Registered queries against their SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_oracle import compare


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return c


def test_entry(spark):
    assert entry(spark).columns[0] == "domain"
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, sf, con, name):
    got = queries()[name](spark, sf).toPandas()
    sql = oracle_sql().get(name)
    if sql is None:
        assert len(got)
    else:
        assert compare(got, con.execute(sql).fetch_df()) is None
