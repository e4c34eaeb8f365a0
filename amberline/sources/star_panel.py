"""Account-by-quarter conduct panel derived from an order-history star schema.

One account per customer, one period per quarter from the first order's to the
last one's. An account is in arrears for every quarter without an order; ten idle
quarters are 90 DPD.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

HORIZON = 4
IDLE_AT_NPA = 10
REFERENCE_PERIOD = 16
AMBER, RED = 0.28, 0.40


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def quarter_number(date: str) -> Column:
    return F.year(date) * 4 + F.quarter(date) - 1


@dataclass(frozen=True)
class Calendar:
    """The quarters the orders cover: the first one's number and how many there are."""

    first: int
    periods: int

    @property
    def last_labelable(self) -> int:
        return self.periods - 1 - HORIZON


def calendar(spark: SparkSession, sf_dir: str) -> Calendar:
    """From one pass over the order dates; orders without a date belong to no quarter."""
    at = read_table(spark, sf_dir, "orders").agg(F.min(quarter_number("o_orderdate")), F.max(quarter_number("o_orderdate"))).first()
    return Calendar(0, 0) if at[0] is None else Calendar(at[0], at[1] - at[0] + 1)


def order_activity(spark: SparkSession, sf_dir: str, quarters: Calendar) -> DataFrame:
    """Activity per (account, quarter).

    Lines are summed per order before the join, so an order holding a large
    share of all lines reaches the join as one row; the account totals are
    likewise combined map-side before their shuffle.
    """
    lines = (
        read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
            F.sum("l_extendedprice").alias("demanded"),
            F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("collected"),
            F.max((F.col("l_returnflag") == "R").cast("int")).alias("bounce"))
    )
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("account_id"),
        (quarter_number("o_orderdate") - quarters.first).alias("period"),
        "o_totalprice")
    return (
        orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .groupBy("account_id", "period").agg(
            F.count("*").alias("txn_count"), F.sum("o_totalprice").alias("inflow"),
            F.sum("demanded").alias("demanded"), F.sum("collected").alias("collected"),
            F.max("bounce").alias("bounce"))
    )


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Static account attributes, one row per customer."""
    key = F.col("c_custkey")
    return (
        read_table(spark, sf_dir, "customer")
        .join(read_table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(read_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            key.alias("account_id"), F.col("c_mktsegment").alias("portfolio"),
            F.col("r_name").alias("region"), F.col("n_name").alias("state"),
            (F.col("c_nationkey") % 2).alias("secured"),
            ((F.col("c_acctbal") + 1000.0) * 1000.0).alias("sanctioned"),
            F.when(key % 14 != 0, 300 + key % 601).alias("bureau_score"),
            F.element_at(F.array(F.lit("Individual"), F.lit("Partnership"), F.lit("Company")),
                         (key % 3 + 1).cast("int")).alias("constitution"),
            (key % 37).alias("vintage_0"))
    )


def dense_conduct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every account in every quarter, with zero activity where nothing happened.

    The activity of an account is folded into one map (at most one entry per
    quarter), joined once per account and exploded along the calendar. The rows
    stay partitioned by account for the windows that follow.
    """
    measures = ("txn_count", "inflow", "demanded", "collected", "bounce")
    quarters = calendar(spark, sf_dir)
    series = order_activity(spark, sf_dir, quarters).where(F.col("period").isNotNull()).groupBy("account_id").agg(
        F.map_from_entries(F.collect_list(F.struct(
            F.col("period").cast("int"), F.struct(*measures)))).alias("by_period"))
    grid = accounts(spark, sf_dir).join(series, "account_id", "left").withColumn(
        "period", F.explode(F.sequence(F.lit(0), F.lit(max(0, quarters.periods - 1))))).where(F.lit(quarters.periods > 0))
    at = F.element_at("by_period", F.col("period"))
    zero = {"txn_count": F.lit(0).cast("bigint"), "bounce": F.lit(0)}
    return grid.withColumns({m: F.coalesce(at[m], zero.get(m, F.lit(0.0))) for m in measures}).drop("by_period")


def scored_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standard (pre-NPA) rows with labels, a demonstration PD and the smoothed score."""
    last_labelable = calendar(spark, sf_dir).last_labelable
    account = W.partitionBy("account_id")
    by_period = account.orderBy("period")
    last_active = F.max(F.when(F.col("txn_count") > 0, F.col("period"))).over(by_period)
    rows = (
        dense_conduct(spark, sf_dir)
        .withColumn("idle", F.col("period") - F.coalesce(last_active, F.lit(-1)))
        .withColumn("npa_period", F.min(F.when(F.col("idle") >= IDLE_AT_NPA, F.col("period"))).over(account))
        .where(F.col("npa_period").isNull() | (F.col("period") < F.col("npa_period")))
    )
    idle, period, demanded = F.col("idle"), F.col("period"), F.col("demanded")
    rows = rows.withColumns({
        "dpd": (9 * idle).cast("double"), "to_npa": F.coalesce(F.col("npa_period") - period, F.lit(-1)),
        "labelable": (period <= last_labelable).cast("int"), "pd": idle.cast("double") / (idle + 6),
        "vintage_months": F.col("vintage_0") + 3 * period, "utilisation": demanded / (demanded + 150000.0)})
    rows = rows.withColumns({
        "went_bad": F.col("to_npa").between(1, HORIZON).cast("int"),
        "decision_score": F.round(F.avg("pd").over(by_period.rowsBetween(-3, 0)), 6)})
    return rows.withColumn(
        "fine_score", F.round(0.8 * F.col("decision_score") + 0.2 * (1 - F.col("utilisation")), 6)).drop("vintage_0")


# The same panel for the SQL check.
PANEL_SQL = """bounds AS (SELECT min(year(o_orderdate) * 4 + quarter(o_orderdate) - 1) AS lo,
                  max(year(o_orderdate) * 4 + quarter(o_orderdate)) - min(year(o_orderdate) * 4 + quarter(o_orderdate)) + 1 AS periods FROM orders),
cal AS (SELECT unnest(range((SELECT periods FROM bounds))) AS q),
ord AS (SELECT o_custkey AS a, year(o_orderdate) * 4 + quarter(o_orderdate) - 1 - (SELECT lo FROM bounds) AS q,
               count(*) AS txn_count, sum(o_totalprice) AS inflow
        FROM orders GROUP BY 1, 2),
li AS (SELECT o.o_custkey AS a, year(o.o_orderdate) * 4 + quarter(o.o_orderdate) - 1 - (SELECT lo FROM bounds) AS q,
              sum(l_extendedprice) AS demanded, sum(l_extendedprice*(1-l_discount)) AS collected,
              max(CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END) AS bounce
       FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey GROUP BY 1, 2),
acc AS (SELECT c.c_custkey AS account_id, c.c_mktsegment AS portfolio, r.r_name AS region,
               n.n_name AS state, c.c_nationkey % 2 AS secured,
               (c.c_acctbal + 1000.0::DOUBLE) * 1000.0::DOUBLE AS sanctioned,
               CASE WHEN c.c_custkey % 14 = 0 THEN NULL ELSE 300 + c.c_custkey % 601 END AS bureau_score,
               CASE c.c_custkey % 3 WHEN 0 THEN 'Individual' WHEN 1 THEN 'Partnership' ELSE 'Company' END AS constitution,
               c.c_custkey % 37 AS vintage_0
        FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey
        JOIN region r ON r.r_regionkey = n.n_regionkey),
grid AS (SELECT acc.*, cal.q::INT AS period, coalesce(ord.txn_count, 0) AS txn_count,
                coalesce(ord.inflow, 0.0::DOUBLE) AS inflow, coalesce(li.demanded, 0.0::DOUBLE) AS demanded,
                coalesce(li.collected, 0.0::DOUBLE) AS collected, coalesce(li.bounce, 0) AS bounce
         FROM acc CROSS JOIN cal
         LEFT JOIN ord ON ord.a = account_id AND ord.q = cal.q
         LEFT JOIN li ON li.a = account_id AND li.q = cal.q),
run AS (SELECT *, period - coalesce(max(CASE WHEN txn_count > 0 THEN period END)
                  OVER (PARTITION BY account_id ORDER BY period), -1) AS idle FROM grid),
npa AS (SELECT account_id, min(period) AS npa_period FROM run WHERE idle >= 10 GROUP BY 1),
std AS (SELECT run.*, npa_period, cast(9 * idle AS DOUBLE) AS dpd, coalesce(npa_period - period, -1) AS to_npa
        FROM run LEFT JOIN npa ON npa.account_id = run.account_id
        WHERE npa_period IS NULL OR period < npa_period),
lab AS (SELECT * EXCLUDE (vintage_0), CASE WHEN to_npa BETWEEN 1 AND 4 THEN 1 ELSE 0 END AS went_bad,
               CASE WHEN period <= (SELECT periods - 5 FROM bounds) THEN 1 ELSE 0 END AS labelable,
               cast(idle AS DOUBLE) / (idle + 6) AS pd,
               round(avg(cast(idle AS DOUBLE) / (idle + 6)) OVER (PARTITION BY account_id ORDER BY period
                     ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS decision_score,
               vintage_0 + 3 * period AS vintage_months,
               demanded / (demanded + 150000.0::DOUBLE) AS utilisation
          FROM std),
panel AS (SELECT *, round(0.8::DOUBLE * decision_score + 0.2::DOUBLE * (1 - utilisation), 6) AS fine_score FROM lab)"""
