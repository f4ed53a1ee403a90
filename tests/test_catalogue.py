"""Every query with SQL gives what DuckDB gives, at the smallest size."""

import math
import os

import duckdb
import pytest

from bitquarry.plans import catalogue, structure  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def same(x, y):
    if isinstance(x, float) or isinstance(y, float):
        return math.isclose(float(x), float(y), rel_tol=1e-6, abs_tol=2e-6)
    return x == y


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    ours = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    q = duck.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in q.description]
    assert sorted(names) == cols
    theirs = sorted((tuple(r[names.index(c)] for c in cols) for r in q.fetchall()), key=repr)
    assert len(ours) == len(theirs) > 0
    for a, b in zip(ours, theirs):
        assert all(map(same, a, b)), (a, b)
