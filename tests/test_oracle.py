"""Every query with SQL against DuckDB on the same tables."""

import math
import os

import duckdb
import pytest

from strandflow.plans.oracle import SQL
from strandflow.plans.queries import QUERIES

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in ("lineitem", "customer"):
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{DIR}/{name}.parquet')")
    return c


def rows(names, table):
    order = sorted(range(len(names)), key=lambda i: names[i])
    key = lambda r: tuple((x is not None, str(type(x)), x if x is not None else 0) for x in r)
    return sorted((tuple(r[i] for i in order) for r in table), key=key)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_duckdb(spark, con, name):
    df = QUERIES[name](spark, DIR)
    want = con.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    a, b = rows(df.columns, [tuple(r) for r in df.collect()]), rows(want.columns, want.fetchall())
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        for p, q in zip(x, y, strict=True):
            assert p == q or (isinstance(p, float) and math.isclose(p, q, abs_tol=2e-9)), (x, y)


def test_every_query_is_known():
    assert set(SQL) <= set(QUERIES)


def test_haplotypes_are_recovered(spark):
    found = {r.seq for r in QUERIES["local_haplotypes"](spark, DIR).collect()}
    assert found == {r.cseq for r in QUERIES["compact_haplotypes"](spark, DIR).collect()}


def test_fits_recover_the_shares(spark):
    for name in ("stagewise_fit", "lagrangian_fit", "refit"):
        h = {r.hap_id: r.h for r in QUERIES[name](spark, DIR).collect()}
        assert math.isclose(sum(h.values()), 1, abs_tol=1e-3)
        assert h[0] > h[1] > h[2] > 0


def test_fits_and_samplers_run_in_full(spark, monkeypatch):
    from strandflow.operators import cluster, regress

    grid = QUERIES["fit_grid"](spark, DIR).groupBy("rho").agg({"rep": "count"}).collect()
    assert sorted(r[0] for r in grid) == sorted(regress.RHOS) and {r[1] for r in grid} == {100 * 3}
    said = []

    def voted(reads, variants, windows, reference, **sampler):
        said.append((windows.selectExpr("max(w_end - w_start)").first()[0], sampler))
        return reads.selectExpr("start_pos", "seq", "cnt", "seq as voted_seq")

    monkeypatch.setattr(cluster, "clustering_votes", voted)
    QUERIES["clustering_passes"](spark, DIR)
    assert said == [(50, {}), (60, {}), (70, {})]
    monkeypatch.setattr(cluster, "gibbs_assign", lambda *_, **sampler: sampler)
    assert QUERIES["gibbs_assign"](spark, DIR) == {}
    monkeypatch.setattr(regress, "stagewise", lambda g, r, rho=0.0, step=regress.STEP: [step] * len(r))
    assert {r.h for r in QUERIES["stagewise_fit"](spark, DIR).collect()} == {regress.STEP}
