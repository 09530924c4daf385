"""Queries against their DuckDB equivalents at the smallest size."""

import glob
import os

import duckdb
import pytest

from blockweave.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_oracle(spark, name):
    con = duckdb.connect()
    for f in glob.glob(SF + "/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    want, got = con.execute(queries.oracle_sql()[name]).df(), queries.queries()[name](spark, SF).toPandas()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    as_rows = lambda df: sorted(map(tuple, df[cols].convert_dtypes().astype(str).to_numpy()))
    assert as_rows(got) == as_rows(want)
