"""Each panel query against the same question in SQL."""

import os

import duckdb
import pytest
from tessera import oracles, oracles_portfolio, oracles_research, queries_portfolio

SF = "/root/testdata/sf0.01"
SQL = oracles.QUERIES | oracles_research.QUERIES | oracles_portfolio.QUERIES
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 8)
    return v.isoformat() if hasattr(v, "isoformat") else v


def rows(names, found):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in found), key=lambda r: [(x is None, str(x) if isinstance(x, str) else x or 0) for x in r])


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    out = queries_portfolio.QUERIES[name](spark, SF)
    want = duck.execute(SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(out.columns)
    for got, exact in zip(rows(out.columns, out.collect()), rows(names, want.fetchall()), strict=True):
        for x, y in zip(got, exact, strict=True):
            # values are rounded to six digits by both sides: one step apart is the same number on an edge
            assert x == pytest.approx(y, rel=1e-9, abs=1.01e-6) if isinstance(y, float) and x is not None else x == y


def test_queries_without_sql():
    assert queries_portfolio.QUERIES.keys() - SQL.keys() == {"pf_qp_neutral"}
