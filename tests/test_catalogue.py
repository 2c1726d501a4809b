"""Each catalogue query with SQL against DuckDB over the same tables."""

import math

import duckdb
import pytest

from quire.plans import catalogue, scripts

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


#: The queries that run a document operator per row are tried on the smallest tables, the others on the usual ones.
SMALL = "/root/testdata/sf0.001"


def folder(name, sf):
    return SMALL if name in scripts.QUERIES else sf


@pytest.fixture(scope="module")
def db(sf):
    def connect(where):
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{where}/{t}.parquet'")
        return con

    return {where: connect(where) for where in {SMALL, sf}}


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_matches_sql(spark, sf, db, name):
    df = catalogue.QUERIES[name](spark, folder(name, sf))
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    found = db[folder(name, sf)].execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall()), key=repr)
    assert got and got == want


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_runs(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() > 0
