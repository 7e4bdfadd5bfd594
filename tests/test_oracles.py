"""Every named query against its SQL, on the smallest data folder."""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_point
from haulmetrics.plans import catalog

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver data not present")
ORACLES = entry_point.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{FOLDER}/{file}'")
    return con


def rows(pdf, columns):
    def plain(v):
        return None if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)) else float(v) if isinstance(v, float) else v
    return sorted((tuple(plain(v) for v in r) for r in pdf[columns].astype(object).itertuples(index=False, name=None)), key=repr)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry_point.queries())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = entry_point.queries()[name](spark, FOLDER).toPandas()
    if name not in ORACLES:
        assert len(got) > 0
        return
    want = duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, list(got.columns)) == rows(want, list(got.columns))


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
