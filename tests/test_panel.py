"""Windows, labels and leads on small panels, against row-by-row Python."""

import pathlib
import random
import sys

from pyspark.sql import Window
from pyspark.sql import functions as F

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1] / "tools"))

from amberline.operators import hazard, labels, leads, masks, quality, windows  # noqa: E402
from amberline.sources import star_panel  # noqa: E402
from amberline.sources.panel import null_nan  # noqa: E402


def panel(spark, rows, schema="account_id string, period int, dpd double"):
    return spark.createDataFrame(rows, schema)


def test_run_length_restarts_after_a_gap(spark):
    df = panel(spark, [("a", i, float(v)) for i, v in enumerate([1, 1, 0, 1, 1, 1, 0])])
    runs = [r.run for r in windows.with_run_length(df, F.col("dpd") > 0).orderBy("period").collect()]
    assert runs == [1, 2, 0, 1, 2, 3, 0]


def test_lag_holds_the_first_value(spark):
    df = panel(spark, [("a", i, float(i)) for i in range(5)])
    assert [r.x for r in df.select("period", windows.lag_hold_first(F.col("dpd"), 2).alias("x")).orderBy("period").collect()] == [0, 0, 0, 1, 2]


def test_sma2_label_looks_through_rows_that_are_dropped_later(spark):
    df = panel(spark, [("a", 0, 0.0), ("a", 1, 30.0), ("a", 2, 95.0), ("b", 0, 0.0), ("b", 1, 61.0), ("b", 2, 0.0)])
    rows = labels.standard_rows(labels.with_first_npa(df).withColumn("sma2", labels.sma2_within(6)))
    got = {(r.account_id, r.period): r.sma2 for r in rows.collect()}
    assert got == {("a", 0): 1, ("a", 1): 1, ("b", 0): 1, ("b", 1): 0, ("b", 2): 0}


def test_never_defaulting_accounts_are_never_within_any_horizon(spark):
    df = spark.createDataFrame([(-1,), (0,), (1,), (12,), (13,)], "m int").select(labels.bad_within(F.col("m"), 12).alias("y"))
    assert [r.y for r in df.collect()] == [0, 0, 1, 1, 0]


def test_sustained_lead_equals_a_backward_walk(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for a in range(60):
        n, defaults = rng.randint(1, 20), rng.random() < 0.7
        points = [(i, n - i if defaults else -1, rng.random() < 0.7) for i in range(n)]
        rows += [(f"a{a}", i, m, f) for i, m, f in points]
        lead = 0
        for i, m, f in reversed(points):
            if f and 1 <= m <= 12:
                lead = m
            elif m <= 12:
                break
        want[f"a{a}"] = lead
    df = spark.createDataFrame(rows, "account_id string, period int, to_npa int, flag boolean")
    assert {r.account_id: r.lead for r in leads.sustained_lead(df, F.col("flag")).collect()} == want


def test_sustained_signal_needs_consecutive_offsets(spark):
    fires = {"a": {1, 2, 3, 4}, "b": {2, 3, 5, 6}, "c": {1}, "d": set()}
    rows = [(a, 10 - m, m, 50.0 if m in on else 0.0) for a, on in fires.items() for m in range(1, 8)]
    df = spark.createDataFrame(rows, "account_id string, period int, to_npa int, dpd double")
    got = {r.account_id: r.lead for r in leads.sustained_signal_leads(df, leads.Rule("dpd", "gt", 20.0)).collect()}
    assert got == {"a": 4, "b": 0, "c": 1, "d": 0}


def test_runway_needs_seven_points_and_a_rising_trend(spark):
    def rows(a, n, step):
        return [(a, i, 0.1 + step * i) for i in range(n)]

    df = spark.createDataFrame(rows("short", 6, 0.02) + rows("up", 7, 0.02) + rows("flat", 9, 0.0), "account_id string, period int, decision_score double")
    got = {r.account_id: r.runway for r in windows.runway(windows.trend_slope(df, 99), 0.4).collect()}
    assert got == {"short": None, "up": 9, "flat": None}


def test_reversed_collections_are_credited_the_month_after(spark):
    df = spark.createDataFrame([("a", 0, 80.0, True), ("a", 1, 50.0, False), ("a", 2, 90.0, False)], "account_id string, period int, c double, r boolean")
    got = [r.x for r in df.select("period", windows.carry_forward_reversal(F.col("c"), F.lit(100.0), F.col("r")).alias("x")).orderBy("period").collect()]
    assert got == [0.0, 100.0, 90.0]


def test_hazard_exposure_by_hand(spark):
    df = spark.createDataFrame([(0, 2), (0, -1), (1, -1)], "vintage_0 int, npa_period int")
    got = {r.age: (r.events, r.exposure) for r in hazard.vintage_hazard(df, 3).collect()}
    assert got == {0: (0, 2), 1: (0, 3), 2: (1, 3), 3: (0, 1)}


def test_masks_blank_instead_of_zero_and_gaps_blank_together(spark):
    df = spark.createDataFrame([("a", 0, "X", 5.0, 1), ("a", 1, "X", 6.0, 2), ("b", 0, "Y", 7.0, 3)],
                               "account_id string, period int, portfolio string, inflow double, txn_count int")
    gaps = spark.createDataFrame([("a", 1, 3)], "account_id string, start int, length int")
    got = {(r.account_id, r.period): (r.inflow, r.txn_count) for r in masks.mask_statement_gaps(df, gaps).collect()}
    assert got == {("a", 0): (5.0, 1), ("a", 1): (None, None), ("b", 0): (7.0, 3)}
    got = {r.account_id: r.inflow for r in masks.mask_by_portfolio(df, {"Y": ("cash_flow",)}).where("period = 0").collect()}
    assert got == {"a": 5.0, "b": None}


def test_nan_and_null_are_the_same_after_reading(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, None), (3, 1.0), (4, float("inf"))], "i int, x double")
    assert [r.x for r in null_nan(df).orderBy("i").collect()] == [None, None, 1.0, None]


def test_quality_rules_ignore_unobserved_values(spark):
    df = spark.createDataFrame([("a", 0, -1.0, None), ("a", 0, None, 2)], "account_id string, period int, dpd double, bounce int")
    rules = quality.impossible_states(df.columns, (), ())
    got = {r.check: r.violations for r in quality.count_violations(df, rules).collect()}
    assert got == {"dpd_low": 1, "dpd_high": 0, "bounce_not_0_or_1": 1}
    assert quality.duplicate_keys(df, "account_id", "period").first().surplus == 1


def test_contiguity_finds_holes_and_late_starts(spark):
    df = spark.createDataFrame([("a", 0), ("a", 2), ("b", 1), ("c", 0), ("c", 1)], "account_id string, period int")
    assert {r.account_id for r in windows.contiguity_violations(df).collect()} == {"a", "b"}


def test_calendars_cover_whatever_the_data_covers(spark, tmp_path):
    """An order before and one after the given quarters, an event on a 31st and one in another month."""
    import datetime as dt
    import os

    import duckdb
    from check_queries import compare

    import __spark_entry__ as contract

    given, mine = "/root/testdata/sf0.001", str(tmp_path)
    con = duckdb.connect()
    for name in ("region", "nation", "customer", "orders", "lineitem", "events"):
        df = spark.read.parquet(f"{given}/{name}.parquet")
        if name == "orders":
            row = df.limit(2).withColumn("o_orderkey", -F.row_number().over(Window.orderBy("o_orderkey")).cast(df.schema["o_orderkey"].dataType))
            dates = F.when(F.col("o_orderkey") == -1, F.lit(dt.date(1994, 5, 5))).otherwise(F.lit(dt.date(2002, 2, 2)))
            df = df.unionByName(row.withColumn("o_orderdate", dates.cast(df.schema["o_orderdate"].dataType)))
        if name == "events":
            late = df.limit(2).withColumn("event_id", -F.row_number().over(Window.orderBy("event_id")).cast("long"))
            times = F.when(F.col("event_id") == -1, F.lit(dt.datetime(2024, 1, 31, 5))).otherwise(F.lit(dt.datetime(2024, 2, 3, 5)))
            df = df.unionByName(late.withColumn("ts", times.cast(df.schema["ts"].dataType)))
        df.write.parquet(os.path.join(mine, f"{name}.parquet"))
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{mine}/{name}.parquet/*.parquet'")
    queries, checks = contract.queries(), contract.oracle_sql()
    for name in ("fl03_snapshot", "wn11_to_npa", "wn21_vintage_hazard", "wn23_slippage_ratio", "wn24_densify", "wn25_contiguity", "sp03_out_of_time_split"):
        status, detail, _ = compare(spark, con, name, queries[name], checks[name], mine)
        assert status == "OK", (name, detail)
    panel = star_panel.scored_panel(spark, mine)
    assert panel.agg(F.max("period")).first()[0] == (2002 - 1994) * 4 - 1
    assert queries["wn24_densify"](spark, mine).agg(F.max("period")).first()[0] == 33
