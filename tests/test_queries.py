"""Registered queries against their SQL checks, and their plan shapes."""

import os
import pathlib
import sys

import duckdb
import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as contract  # noqa: E402
from check_plans import findings  # noqa: E402
from check_queries import TABLES, compare  # noqa: E402

SF_DIR = os.environ.get("AMBERLINE_SF_DIR", "/root/testdata/sf0.001")
# one or two per family; tools/check_queries.py runs all of them
NAMES = ("ag03_rates_by_band", "ag21_impossible_states", "ev06_deciles", "ev10_rank_order_exhibit", "ev23_cluster_bootstrap", "fl09_mask_statement_gaps",
         "gr01_partner_counts", "gt03_worst_of", "io06_wide_financials_to_long", "jn12_reported_with_lag", "ml04_isotonic_calibration", "pr24_reason_codes",
         "pv02_family_sources", "sp05_stratified_sample", "ss04_running_bands", "st02_ordered_union", "th08_choose", "wn03_trailing_features",
         "wn18_sustained_signal_lead")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, con, name):
    status, detail, _ = compare(spark, con, name, contract.queries()[name], contract.oracle_sql()[name], SF_DIR)
    assert status == "OK", detail


@pytest.mark.parametrize("name", ["wn03_trailing_features", "ev06_deciles", "gr01_partner_counts", "th04_pick"])
def test_plans_have_no_cross_join_and_no_python(spark, name):
    assert findings(contract.queries()[name](spark, SF_DIR)) == []


def test_every_check_belongs_to_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry_returns_rows(spark):
    assert contract.entry(spark).count() == 6
