"""Registered queries that SQL can express, against it."""

import duckdb
import pytest

import __spark_entry__ as contract
from check_queries import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op8_exact_dedup", "op10_minhash_near_dedup", "op11_lexical_search", "op13_decontamination"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    status, detail, _ = compare(spark, con, name, contract.queries()[name], contract.oracle_sql()[name], SF)
    assert status == "OK", detail
