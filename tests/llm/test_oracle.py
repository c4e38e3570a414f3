"""The queries that have SQL, against DuckDB on the smallest test tables."""

import duckdb
import pytest

from corpuslab.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(queries.ORACLE[name])
    got = queries.QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    rows = sorted(map(tuple, got.select(*order).collect()))
    assert rows == sorted(want.select(*[f'"{c}"' for c in order]).fetchall())
