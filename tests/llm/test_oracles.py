"""The queries that SQL can state equal their DuckDB text (sf0.001)."""

import duckdb
import pytest

from leadloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = con.execute(ORACLES[name])
    cols = [d[0] for d in rel.description]
    got = [tuple(r) for r in QUERIES[name](spark, SF).select(*cols).collect()]
    assert sorted(got, key=str) == sorted(rel.fetchall(), key=str)
