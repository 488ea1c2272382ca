import math

import duckdb
import pytest

from strandflow.llm.oracle import SQL
from strandflow.llm.queries import QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    df, want = QUERIES[name](spark, DIR), con.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    got = sorted(tuple(r[c] for c in want.columns) for r in df.collect())
    for a, b in zip(got, sorted(want.fetchall()), strict=True):
        assert all(x == y or (isinstance(x, float) and math.isclose(x, y, rel_tol=1e-12)) for x, y in zip(a, b, strict=True)), (a, b)
