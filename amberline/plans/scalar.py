"""Row-wise queries: bands, arithmetic, costs."""

from __future__ import annotations

from pyspark.sql import functions as F

from amberline.config import CostParams
from amberline.functions import bands, costs, numeric
from amberline.plans.registry import Tables, query

KEY = ("account_id", "period")


@query("pr01_vintage_band", """
SELECT account_id, period, CASE WHEN vintage_months <= 6 THEN '0-6' WHEN vintage_months <= 12 THEN '7-12'
 WHEN vintage_months <= 18 THEN '13-18' WHEN vintage_months <= 30 THEN '19-30'
 WHEN vintage_months <= 48 THEN '31-48' ELSE '49+' END AS vintage_band FROM panel""")
def vintage_band(t: Tables):
    return t.panel().select(*KEY, bands.vintage_band(F.col("vintage_months")).alias("vintage_band"))


@query("pr02_vintage_cut", """
SELECT account_id, period, CASE WHEN vintage_months < 12 THEN '[0,12)' WHEN vintage_months < 18 THEN '[12,18)'
 WHEN vintage_months < 30 THEN '[18,30)' WHEN vintage_months < 48 THEN '[30,48)' ELSE '[48,inf)' END AS vintage_cut
FROM panel""")
def vintage_cut(t: Tables):
    return t.panel().select(*KEY, bands.vintage_cut(F.col("vintage_months")).alias("vintage_cut"))


@query("pr03_segment", """
SELECT account_id, CASE WHEN sanctioned <= 1000000 THEN 'Micro' WHEN sanctioned <= 10000000 THEN 'Small'
 ELSE 'Medium' END AS segment FROM acc""")
def segment(t: Tables):
    return t.accounts().select("account_id", bands.segment(F.col("sanctioned")).alias("segment"))


@query("pr04_elapsed_time_band", """
SELECT account_id, period, CASE WHEN months_since_moratorium_end IS NULL THEN NULL
 WHEN months_since_moratorium_end <= -1 THEN 'in moratorium'
 WHEN months_since_moratorium_end <= 6 THEN '0-6' ELSE '7+' END AS months_since_moratorium_end_band
FROM (SELECT account_id, period, CASE WHEN secured = 1 THEN period - 4 END AS months_since_moratorium_end FROM panel)""")
def elapsed_time_band(t: Tables):
    rows = t.panel().select(*KEY, F.when(F.col("secured") == 1, F.col("period") - 4)
                            .alias("months_since_moratorium_end"))
    return bands.elapsed_time_bands(rows).drop("months_since_moratorium_end")


@query("pr05_ticket_band", """
SELECT account_id, CASE WHEN sanctioned < 1000000 THEN 'lt10L' WHEN sanctioned < 5000000 THEN '10Lto50L'
 WHEN sanctioned < 20000000 THEN '50Lto2Cr' ELSE 'gt2Cr' END AS ticket_band FROM acc""")
def ticket_band(t: Tables):
    return t.accounts().select("account_id", bands.ticket_band(F.col("sanctioned")).alias("ticket_band"))


@query("pr06_dpd_band", """
SELECT account_id, period, CASE WHEN dpd <= 0 THEN '0' WHEN dpd <= 30 THEN '1-30' WHEN dpd <= 60 THEN '31-60'
 WHEN dpd <= 90 THEN '61-90' ELSE '90+' END AS dpd_band FROM panel""")
def dpd_band(t: Tables):
    return t.panel().select(*KEY, bands.dpd_band(F.col("dpd")).alias("dpd_band"))


@query("pr07_rag_band", """
SELECT account_id, period, CASE WHEN decision_score >= 0.40 THEN 'red' WHEN decision_score >= 0.28 THEN 'amber'
 ELSE 'green' END AS band FROM panel""")
def rag_band(t: Tables):
    return t.panel().select(*KEY, bands.rag_band(F.col("decision_score"), 0.28, 0.40).alias("band"))


@query("pr08_decision_column", """
SELECT account_id, period, round(coalesce(CASE WHEN period % 3 = 0 THEN decision_score END, pd), 6) AS decision
FROM panel""")
def decision_column(t: Tables):
    rows = t.panel().withColumn("decision_score", F.when(F.col("period") % 3 == 0, F.col("decision_score")))
    return rows.select(*KEY, F.round(bands.decision_column(rows), 6).alias("decision"))


@query("pr09_pct_change", """
SELECT account_id, period, round((inflow - demanded) / greatest(demanded, 1.0), 4) + 0 AS change FROM panel""")
def pct_change(t: Tables):
    return t.panel().select(*KEY, F.round(numeric.pct_change(F.col("inflow"), F.col("demanded")), 4).alias("change"))


@query("pr10_collection_ratio", """
SELECT account_id, period, round(CASE WHEN demanded > 0 THEN collected / greatest(demanded, 1.0) ELSE 1.0 END, 4)
 AS collection_ratio FROM panel""")
def collection_ratio(t: Tables):
    return t.panel().select(*KEY, F.round(numeric.collection_ratio(F.col("collected"), F.col("demanded")), 4)
                            .alias("collection_ratio"))


# Loan terms derived per account: 8% to 14% a year over 24 to 60 months.
TERMS_SQL = "0.08 + 0.01 * (account_id % 7) AS rate, 24 + 12 * (account_id % 4) AS tenor"


def _terms(t: Tables):
    key = F.col("account_id")
    return t.panel().withColumn("rate", 0.08 + 0.01 * (key % 7)).withColumn("tenor", 24 + 12 * (key % 4))


@query("pr11_level_emi", f"""
WITH x AS (SELECT account_id, period, sanctioned, {TERMS_SQL} FROM panel)
SELECT account_id, period, round(sanctioned * rate / 12 * pow(1 + rate / 12, tenor)
 / (pow(1 + rate / 12, tenor) - 1), 2) AS emi FROM x""")
def level_emi(t: Tables):
    return _terms(t).select(*KEY, F.round(numeric.level_emi(
        F.col("sanctioned"), F.col("rate"), F.col("tenor")), 2).alias("emi"))


BALANCE_SQL = """sanctioned * (pow(1 + rate / 12, tenor) - pow(1 + rate / 12, least(3 * period, tenor)))
 / (pow(1 + rate / 12, tenor) - 1)"""


@query("pr12_scheduled_balance", f"""
WITH x AS (SELECT account_id, period, sanctioned, {TERMS_SQL} FROM panel)
SELECT account_id, period, round({BALANCE_SQL}, 2) AS balance FROM x""")
def scheduled_balance(t: Tables):
    return _terms(t).select(*KEY, F.round(_balance(), 2).alias("balance"))


def _balance():
    return numeric.scheduled_balance(F.col("sanctioned"), F.col("rate"), F.col("tenor"), 3 * F.col("period"))


@query("pr13_ltv_vs_schedule", f"""
WITH x AS (SELECT account_id, period, sanctioned, demanded - collected AS short, {TERMS_SQL} FROM panel),
y AS (SELECT account_id, period, least(greatest((b + short) / (sanctioned * 1.25), 0), 3) AS ltv,
 least(greatest(b / (sanctioned * 1.25), 0), 3) AS planned FROM (SELECT *, {BALANCE_SQL} AS b FROM x))
SELECT account_id, period, round(ltv, 4) AS ltv, round((ltv - planned) / greatest(planned, 1.0), 4) AS ltv_vs_schedule
FROM y""")
def ltv_vs_schedule(t: Tables):
    collateral = F.col("sanctioned") * 1.25
    rows = _terms(t).select(
        *KEY, numeric.ltv(_balance() + F.col("demanded") - F.col("collected"), collateral).alias("ltv"),
        numeric.ltv(_balance(), collateral).alias("planned"))
    return rows.select(*KEY, F.round("ltv", 4).alias("ltv"),
                       F.round(numeric.pct_change(F.col("ltv"), F.col("planned")), 4).alias("ltv_vs_schedule"))


@query("pr14_emi_burden", """
SELECT account_id, period, round(least(greatest((0.2 * inflow + demanded) / greatest(inflow, 0.15 * demanded + 1.0), 0), 20), 4)
 AS emi_burden_ratio FROM panel""")
def emi_burden(t: Tables):
    burden = numeric.emi_burden(0.2 * F.col("inflow"), F.col("demanded"), F.col("inflow"), 0.15 * F.col("demanded") + 1.0)
    return t.panel().select(*KEY, F.round(burden, 4).alias("emi_burden_ratio"))


@query("pr15_round_to_step", """
SELECT account_id, period, round_even(inflow / 100.0, 0) * 100.0 AS inflow_100, round_even(dpd / 5.0, 0) * 5.0 AS dpd_5
FROM panel""")
def round_to_step(t: Tables):
    return t.panel().select(*KEY, numeric.round_to_step(F.col("inflow"), 100.0).alias("inflow_100"),
                            numeric.round_to_step(F.col("dpd"), 5.0).alias("dpd_5"))


@query("pr16_finite_or_null", """
SELECT account_id, period, CASE WHEN period % 4 = 0 THEN NULL ELSE round(pd, 6) END AS finite,
 CASE WHEN period % 4 = 1 THEN NULL ELSE idle END::BIGINT AS whole FROM panel""")
def finite_or_null(t: Tables):
    dirty = F.when(F.col("period") % 8 == 0, F.lit(float("nan"))).when(
        F.col("period") % 4 == 0, F.lit(float("inf"))).otherwise(F.col("pd"))
    text = F.when(F.col("period") % 4 == 1, F.lit("n/a")).otherwise(F.col("idle").cast("string"))
    return t.panel().select(*KEY, F.round(numeric.finite_or_null(dirty), 6).alias("finite"),
                            numeric.int_or_null(text).alias("whole"))


EAD_SQL = """CASE WHEN period % 5 <> 0 AND demanded > 0 THEN demanded ELSE coalesce(exp(ln(sanctioned)), 0) END"""
LGD_SQL = """CASE WHEN account_id % 11 = 0 THEN 0.575 WHEN secured > 0.5 THEN 0.4 ELSE 0.75 END"""
LOSS_SQL = f"(({EAD_SQL}) * ({LGD_SQL}) + ({EAD_SQL}) * (14.75 / 100.0 * 6.0 / 12.0))"


def _exposures(t: Tables):
    outstanding = F.when(F.col("period") % 5 != 0, F.col("demanded"))
    secured = F.when(F.col("account_id") % 11 != 0, F.col("secured"))
    return t.panel().withColumn("ead", costs.ead(outstanding, F.log("sanctioned"))).withColumn(
        "lgd", costs.lgd(secured, CostParams()))


@query("pr17_ead", f"SELECT account_id, period, round({EAD_SQL}, 2) AS ead FROM panel")
def ead(t: Tables):
    return _exposures(t).select(*KEY, F.round("ead", 2).alias("ead"))


@query("pr18_lgd", f"SELECT account_id, period, ({LGD_SQL})::DOUBLE AS lgd FROM panel")
def lgd(t: Tables):
    return _exposures(t).select(*KEY, "lgd")


@query("pr19_expected_loss", f"SELECT account_id, period, round({LOSS_SQL}, 7) AS expected_loss FROM panel")
def expected_loss(t: Tables):
    return _exposures(t).select(*KEY, F.round(costs.expected_loss(F.col("ead"), F.col("lgd"), CostParams()), 7)
                                .alias("expected_loss"))


@query("pr20_band_costs", f"""
WITH x AS (SELECT account_id, period, went_bad::DOUBLE AS y, {EAD_SQL} AS ead, {LOSS_SQL} AS el FROM panel)
SELECT account_id, period, round(y * el, 0) AS green,
 round(1500.0 + (1 - y) * 0.02 * ead * 0.1275 + y * el * 0.9, 0) AS amber,
 round(18000.0 + (1 - y) * 0.15 * ead * 0.1275 + y * el * 0.65, 0) AS red FROM x""")
def band_costs(t: Tables):
    by_band = costs.band_costs(F.lit(1), F.col("ead"), F.col("ead") * F.col("went_bad"), F.col("lgd"), CostParams())
    return _exposures(t).select(*KEY, *[F.round(c, 0).alias(b) for b, c in by_band.items()])


@query("pr23_tolerant_parse", """
SELECT o_orderkey, year(o_orderdate)::INT AS yr, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS num
FROM orders""")
def tolerant_parse(t: Tables):
    date_text = F.concat(F.lit("FY "), F.date_format("o_orderdate", "MM/yyyy"))
    num_text = F.when(F.col("o_orderkey") % 3 == 0, F.lit("-")).otherwise(
        F.concat(F.lit(" "), F.col("o_totalprice").cast("string")))
    return t.read("orders").select("o_orderkey", numeric.year_of(date_text).alias("yr"),
                                   numeric.num_of(num_text).alias("num"))


WILSON_SQL = """greatest(0, (k/n + 3.8414588206941227/(2*n) - 1.959963984540054 * sqrt(k/n*(1-k/n)/n + 3.8414588206941227/(4*n*n)))
 / (1 + 3.8414588206941227/n))"""
WILSON_HIGH_SQL = WILSON_SQL.replace("greatest(0,", "least(1,").replace("- 1.9599", "+ 1.9599")


@query("pr33_wilson", f"""
WITH x AS (SELECT portfolio, period, sum(went_bad)::DOUBLE AS k, count(*)::DOUBLE AS n FROM panel GROUP BY ALL)
SELECT portfolio, period, round({WILSON_SQL}, 6) AS ci_lo, round({WILSON_HIGH_SQL}, 6) AS ci_hi FROM x""")
def wilson(t: Tables):
    cells = t.panel().groupBy("portfolio", "period").agg(F.sum("went_bad").alias("k"), F.count("*").alias("n"))
    return cells.select("portfolio", "period",
                        F.round(numeric.wilson_low(F.col("k"), F.col("n")), 6).alias("ci_lo"),
                        F.round(numeric.wilson_high(F.col("k"), F.col("n")), 6).alias("ci_hi"))


@query("pr34_clipped_logit", """
SELECT account_id, period, round(ln(p / (1 - p)), 6) AS logit FROM (
 SELECT account_id, period, least(greatest(pd, 0.000001), 0.999999) AS p FROM panel)""")
def clipped_logit(t: Tables):
    return t.panel().select(*KEY, F.round(numeric.clipped_logit(F.col("pd")), 6).alias("logit"))


@query("pr37_crop_year", """
SELECT o_orderkey, (CASE WHEN month(o_orderdate) >= 7 THEN year(o_orderdate) ELSE year(o_orderdate) - 1 END)::INT AS crop_year
FROM orders""")
def crop_year(t: Tables):
    return t.read("orders").select("o_orderkey", numeric.crop_year(F.col("o_orderdate")).alias("crop_year"))
