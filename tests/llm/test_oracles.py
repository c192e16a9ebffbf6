"""The operators' queries against their SQL."""

import duckdb
import pytest

from siltstone.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, sf, name):
    df = queries.queries()[name](spark, sf)
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    rel = con.sql(queries.oracle_sql()[name])
    cols = sorted(df.columns)
    assert sorted(rel.columns) == cols
    want = sorted(tuple(r[rel.columns.index(c)] for c in cols) for r in rel.fetchall())
    assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == want
