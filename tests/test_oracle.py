"""Every query with an SQL twin gives the same rows in DuckDB; the others give rows."""

import datetime

import duckdb
import pytest

from tallyloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings labels".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, datetime.datetime):
        return value.date() if value.time() == datetime.time() else value
    return round(value, 9) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    frame = catalog.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=str)
    assert got
    if name in catalog.oracle_sql():
        found = duck.sql(catalog.oracle_sql()[name])
        assert sorted(found.columns) == columns
        at = [found.columns.index(c) for c in columns]
        assert got == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=str)
