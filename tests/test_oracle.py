"""Every layout query against its SQL in DuckDB, on whole small tables."""

import os

import duckdb
import pytest

from vellum.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    return con


def _row(values):
    return tuple(round(v, 9) if isinstance(v, float) else v for v in values)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    result = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(frame.columns)
    want = sorted((_row(r) for r in result.fetchall()), key=repr)
    got = sorted((_row(r[c] for c in names) for r in frame.collect()), key=repr)
    assert got == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
