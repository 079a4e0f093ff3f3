"""Every query of the catalogue runs and agrees with its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tandem.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for t in ("events", "documents", "benchmark"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, tables, name):
    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    if name in catalogue.oracle_sql():
        found = tables.execute(catalogue.oracle_sql()[name])
        at = [d[0] for d in found.description]
        assert got == sorted(repr(tuple(r[at.index(c)] for c in columns)) for r in found.fetchall())
    else:
        assert got


def test_entry(spark):
    assert entry.entry(spark).count() == 24
    assert set(entry.oracle_sql()) <= set(entry.queries())
