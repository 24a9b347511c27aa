"""Every registered query against its oracle, over the smallest tables."""

import os

import duckdb
import pytest

from foliate.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    rows = sorted((tuple(map(plain, r)) for r in frame.select(columns).collect()), key=repr)
    assert columns
    if name in ORACLES:
        wanted = duck.sql(ORACLES[name])
        assert sorted(wanted.columns) == columns
        order = [wanted.columns.index(c) for c in columns]
        assert rows == sorted((tuple(plain(r[i]) for i in order) for r in wanted.fetchall()), key=repr)
    else:
        assert rows
