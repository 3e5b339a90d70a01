"""Queries with SQL: Spark and DuckDB must agree in every column."""

import duckdb
import pytest

from murmur.llm.catalog import ORACLE, QUERIES
from tests.conftest import SF001


@pytest.mark.parametrize("name", list(ORACLE))
def test_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    df = QUERIES[name](spark, SF001)
    columns = sorted(df.columns)
    cur = con.execute(ORACLE[name])
    at = [[c[0] for c in cur.description].index(c) for c in columns]
    assert sorted(c[0] for c in cur.description) == columns
    want = sorted(tuple(r[i] for i in at) for r in cur.fetchall())
    assert sorted(tuple(r) for r in df.select(*columns).collect()) == want
