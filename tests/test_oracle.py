"""Driver contract: every registered query equals its DuckDB oracle (sf0.001),
and entry() runs."""

import hashlib

import duckdb
import pytest

import __spark_entry__ as E
from leadloom.plans.catalog import ORACLES, QUERIES
from leadloom.sources.tables import TABLES
from tools.oracle_check import rows_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(E.queries()) and set(ORACLES) <= set(E.oracle_sql())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "name_key" in df.columns


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF)
    s = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(ORACLES[name])
    cols = [d[0] for d in rel.description]
    d = rows_of(cols, rel.fetchall())
    assert sorted(df.columns) == sorted(cols)
    assert len(s) == len(d)
    assert hashlib.md5("\n".join(s).encode()).hexdigest() == hashlib.md5("\n".join(d).encode()).hexdigest()
