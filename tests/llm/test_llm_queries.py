"""Queries with SQL against DuckDB."""

import duckdb
import pytest

from riskloom.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    cursor = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    found = QUERIES[name](spark, small)
    assert sorted(columns) == sorted(found.columns)
    assert sorted(map(tuple, found.select(columns).collect()), key=repr) == sorted(cursor.fetchall(), key=repr)
