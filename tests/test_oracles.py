"""Every query with SQL gives the rows of that SQL on sf0.001."""

import glob
import os

import duckdb
import pytest

from pagegrain import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_matches_sql(spark, con, name):
    rel = con.execute(plans.ORACLES[name])
    names = [d[0] for d in rel.description]
    expected = rel.fetchall()
    df = plans.QUERIES[name](spark, SF)
    order = sorted(names)
    assert sorted(df.columns) == order
    got = sorted(repr([r[c] for c in order]) for r in df.collect())
    assert got == sorted(repr([r[names.index(c)] for c in order]) for r in expected)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0


def test_flagship(spark):
    assert plans.flagship(spark, SF).columns == ["query_id", "match_id", "score", "cross_page", "rank"]
