"""Every query with an SQL answer gives that answer; every query gives a row per input row where its contract says so."""

import duckdb
import pytest

from haulmetrics.llm.oracles import ORACLES
from haulmetrics.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for table in ("documents", "benchmark", "labels"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sql, name):
    want = sql.sql(ORACLES[name]).df()
    got = QUERIES[name](spark, FOLDER).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    got, want = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    for column in columns:
        if want[column].dtype == float:
            assert (got[column] - want[column]).abs().max() < 1e-6
        else:
            assert got[column].tolist() == want[column].tolist()


@pytest.mark.parametrize("name, table", [("op1_html_extract", "pages"), ("op2_jaccard_join", "documents"), ("op3_toxicity", "documents"),
                                         ("op4_quality", "documents"), ("op9_suffix_dedup", "documents"), ("op10_pii", "documents")])
def test_a_row_per_row(spark, name, table):
    got = QUERIES[name](spark, FOLDER)
    assert got.count() == spark.read.parquet(f"{FOLDER}/{table}.parquet").count()
    assert got.columns[0] in ("doc_id", "page_id")
