"""Window and label queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from amberline.operators import hazard, labels, leads, windows
from amberline.plans.registry import Tables, query
from amberline.sources import star_panel

KEY = ("account_id", "period")
W6 = "(PARTITION BY account_id ORDER BY period ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)"
W3 = "(PARTITION BY account_id ORDER BY period ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"
WO = "(PARTITION BY account_id ORDER BY period)"


@query("wn01_rolling", f"""
SELECT account_id, period, round(sum(inflow) OVER {W6}, 2) AS inflow_6, round(avg(demanded) OVER {W3}, 3) AS demanded_3,
 max(dpd) OVER {W6} AS dpd_6, min(dpd) OVER {W6} AS dpd_min_6 FROM panel""")
def rolling(t: Tables):
    return t.panel().select(
        *KEY, F.round(windows.rolling_sum(F.col("inflow"), 6), 2).alias("inflow_6"),
        F.round(windows.rolling_mean(F.col("demanded"), 3), 3).alias("demanded_3"),
        windows.rolling_max(F.col("dpd"), 6).alias("dpd_6"), windows.rolling_min(F.col("dpd"), 6).alias("dpd_min_6"))


@query("wn02_lag_hold_first", f"""
SELECT account_id, period, coalesce(lag(dpd, 3) OVER {WO}, first_value(dpd) OVER {WO}) AS dpd_3_ago FROM panel""")
def lag_hold_first(t: Tables):
    return t.panel().select(*KEY, windows.lag_hold_first(F.col("dpd"), 3).alias("dpd_3_ago"))


def _signals(t: Tables):
    return t.panel().withColumn("minbal_breach", (F.col("inflow") < 0.5 * F.col("demanded")).cast("int")) \
        .withColumn("gst_sales", F.when(F.col("portfolio") != "HOUSEHOLD", F.col("collected"))) \
        .withColumn("adverse_remark", F.when(F.col("secured") == 1, (F.col("idle") > 4).cast("int")))


@query("wn03_trailing_features", f"""
WITH s AS (SELECT *, CASE WHEN inflow < 0.5 * demanded THEN 1 ELSE 0 END AS minbal_breach,
  CASE WHEN portfolio <> 'HOUSEHOLD' THEN collected END AS gst_sales,
  CASE WHEN secured = 1 THEN CASE WHEN idle > 4 THEN 1 ELSE 0 END END AS adverse_remark FROM panel),
l AS (SELECT *, coalesce(lag(inflow, 3) OVER {WO}, first_value(inflow) OVER {WO}) AS inflow_3,
  coalesce(lag(gst_sales, 3) OVER {WO}, first_value(gst_sales) OVER {WO}) AS sales_3,
  avg(inflow) OVER {W6} AS inflow_6, avg(txn_count) OVER {W6} AS txn_6 FROM s)
SELECT account_id, period, max(dpd) OVER {W6} AS dpd_max_6m,
 (sum(CASE WHEN dpd > 0 THEN 1 ELSE 0 END) OVER {W6})::BIGINT AS times_late_6m,
 (sum(bounce) OVER {W6})::BIGINT AS bounces_6m, (sum(minbal_breach) OVER {W6})::BIGINT AS minbal_breach_6m,
 round(avg(utilisation) OVER {W3}, 6) AS util_avg_3m, round(max(utilisation) OVER {W6}, 6) AS util_max_6m,
 (sum(CASE WHEN utilisation > 0.9 THEN 1 ELSE 0 END) OVER {W6})::BIGINT AS months_over_90pct_util_6m,
 round((inflow - inflow_3) / greatest(inflow_3, 1.0), 4) + 0 AS inflow_trend_3m,
 round((inflow - inflow_6) / greatest(inflow_6, 1.0), 4) + 0 AS inflow_vs_6m_avg,
 round(CASE WHEN gst_sales IS NOT NULL THEN (gst_sales - sales_3) / greatest(sales_3, 1.0) END, 4) + 0 AS sales_trend_3m,
 CASE WHEN txn_count < 0.6::DOUBLE * txn_6 THEN 1 ELSE 0 END AS txn_drop_flag,
 (sum(adverse_remark) OVER {W6})::BIGINT AS adverse_remark_6m FROM l""")
def trailing_features(t: Tables):
    out = windows.trailing_features(_signals(t))
    rounded = {c: F.round(c, d) for c, d in {
        "util_avg_3m": 6, "util_max_6m": 6, "inflow_trend_3m": 4, "inflow_vs_6m_avg": 4, "sales_trend_3m": 4}.items()}
    return out.withColumns(rounded).select(
        *KEY, "dpd_max_6m", "times_late_6m", "bounces_6m", "minbal_breach_6m", "util_avg_3m", "util_max_6m",
        "months_over_90pct_util_6m", "inflow_trend_3m", "inflow_vs_6m_avg", "sales_trend_3m", "txn_drop_flag",
        "adverse_remark_6m")


@query("wn04_channel_features", f"""
WITH a AS (SELECT *, CASE WHEN demanded > 0 THEN collected / greatest(demanded, 1.0) ELSE 1.0 END AS cr,
  CASE WHEN portfolio IN ('HOUSEHOLD', 'AUTOMOBILE') THEN inflow END AS salary,
  avg(CASE WHEN portfolio IN ('HOUSEHOLD', 'AUTOMOBILE') THEN inflow END) OVER {W6} AS salary_6,
  avg(collected) OVER {W6} AS rent_6, avg(demanded) OVER {W6} AS commute_6 FROM panel),
b AS (SELECT *, CASE WHEN salary IS NOT NULL THEN CASE WHEN salary < 0.5 * salary_6 THEN 1 ELSE 0 END END AS missed FROM a)
SELECT account_id, period, round(avg(cr) OVER {W3}, 6) AS collection_ratio_3m,
 round(CASE WHEN salary IS NOT NULL THEN (salary - salary_6) / greatest(salary_6, 1.0) END, 4) + 0 AS salary_vs_6m_avg,
 (sum(missed) OVER {W6})::BIGINT AS salary_gap_6m, round(min(inflow - collected) OVER {W6}, 4) + 0 AS min_balance_6m,
 round((collected - rent_6) / greatest(rent_6, 1.0), 4) + 0 AS rental_vs_6m_avg,
 round((demanded - commute_6) / greatest(commute_6, 1.0), 4) + 0 AS commute_vs_6m_avg,
 round((inflow - 150000.0) / 150000.0, 6) AS crop_receipt_vs_norm FROM b""")
def channel_features(t: Tables):
    rows = t.panel().select(
        *KEY, "demanded", "collected", F.when(F.col("portfolio").isin("HOUSEHOLD", "AUTOMOBILE"), F.col("inflow"))
        .alias("salary_credit"), (F.col("inflow") - F.col("collected")).alias("balance"),
        F.col("collected").alias("rental_income"), F.col("demanded").alias("commute_spend"),
        F.col("inflow").alias("crop_receipt"), F.lit(150000.0).alias("crop_norm"))
    digits = {"collection_ratio_3m": 6, "salary_vs_6m_avg": 4, "min_balance_6m": 4, "rental_vs_6m_avg": 4,
              "commute_vs_6m_avg": 4, "crop_receipt_vs_norm": 6}
    out = windows.channel_features(rows)
    return out.select(*KEY, "salary_gap_6m", *[F.round(c, d).alias(c) for c, d in digits.items()])


@query("wn05_run_length", f"""
WITH i AS (SELECT account_id, period, txn_count, sum(CASE WHEN txn_count = 0 THEN 0 ELSE 1 END) OVER {WO} AS island FROM panel)
SELECT account_id, period, (sum(CASE WHEN txn_count = 0 THEN 1 ELSE 0 END)
 OVER (PARTITION BY account_id, island ORDER BY period))::BIGINT AS run FROM i""")
def run_length(t: Tables):
    return windows.with_run_length(t.panel(), F.col("txn_count") == 0).select(*KEY, "run")


@query("wn06_cumulative_arrears", f"""
SELECT account_id, period, round(sum(demanded - collected) OVER {WO}, 4) + 0 AS arrears,
 round(greatest(100000.0 - 2000.0 * period + sum(demanded - collected) OVER {WO}, 0), 4) AS outstanding FROM panel""")
def cumulative_arrears(t: Tables):
    d, c = F.col("demanded"), F.col("collected")
    return t.panel().select(
        *KEY, F.round(windows.cumulative_arrears(d, c), 4).alias("arrears"),
        F.round(windows.outstanding_with_arrears(100000.0 - 2000.0 * F.col("period"), d, c), 4).alias("outstanding"))


@query("wn07_periods_overdue", f"""
WITH d AS (SELECT account_id, period, CASE WHEN (vintage_months // 3) % 4 = 0 AND period > 0 THEN period END AS due, bounce FROM panel),
l AS (SELECT account_id, period, last_value(due IGNORE NULLS) OVER {WO} AS due_at FROM d)
SELECT l.account_id, l.period, CASE WHEN b.bounce = 1 THEN l.period - due_at ELSE 0 END AS overdue
FROM l LEFT JOIN panel b ON b.account_id = l.account_id AND b.period = l.due_at""")
def periods_overdue(t: Tables):
    due = (F.floor(F.col("vintage_months") / 3) % 4 == 0) & (F.col("period") > 0)
    return windows.periods_overdue(t.panel(), due, F.col("bounce") == 1).select(*KEY, "overdue")


@query("wn08_decision_score", """SELECT account_id, period, decision_score FROM panel""")
def decision_score(t: Tables):
    return t.panel().select(*KEY, F.round(windows.decision_score(F.col("pd")), 6).alias("decision_score"))


@query("wn09_bad_within", "SELECT account_id, period, CASE WHEN to_npa BETWEEN 1 AND 2 THEN 1 ELSE 0 END AS bad_2 FROM panel")
def bad_within(t: Tables):
    return t.panel().select(*KEY, labels.bad_within(F.col("to_npa"), 2).alias("bad_2"))


def _dense(t: Tables):
    rows = star_panel.dense_conduct(t.spark, t.sf_dir)
    last = F.max(F.when(F.col("txn_count") > 0, F.col("period"))).over(windows.by_period())
    return rows.withColumn("dpd", 9.0 * (F.col("period") - F.coalesce(last, F.lit(-1))))


@query("wn10_sma2_within", """
SELECT account_id, period, sma2 FROM (SELECT account_id, period, npa_period, 9.0 * idle AS dpd,
 CASE WHEN max(9.0 * idle) OVER (PARTITION BY account_id ORDER BY period ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) >= 61
 THEN 1 ELSE 0 END AS sma2 FROM run LEFT JOIN npa USING (account_id)) WHERE npa_period IS NULL OR period < npa_period""")
def sma2_within(t: Tables):
    rows = labels.with_first_npa(_dense(t)).withColumn("sma2", labels.sma2_within(2))
    return labels.standard_rows(rows).select(*KEY, "sma2")


@query("wn11_to_npa", """
SELECT account_id, period, coalesce(npa_period - period, -1) AS to_npa FROM run LEFT JOIN npa USING (account_id)""")
def to_npa(t: Tables):
    return labels.with_first_npa(_dense(t)).select(
        *KEY, labels.to_npa(F.col("npa_period"), F.col("period")).alias("to_npa"))


@query("wn12_recognition_shift", """
SELECT acc.account_id, CASE WHEN npa_period IS NULL THEN -1
 WHEN npa_period + CASE WHEN portfolio = 'FURNITURE' THEN 8 ELSE 0 END < (SELECT periods FROM bounds)
 THEN npa_period + CASE WHEN portfolio = 'FURNITURE' THEN 8 ELSE 0 END ELSE -1 END AS recognised
FROM acc LEFT JOIN npa USING (account_id)""")
def recognition_shift(t: Tables):
    lag = F.when(F.col("portfolio") == "FURNITURE", 8)
    per = _dense(t).groupBy("account_id", "portfolio").agg(
        F.coalesce(F.min(F.when(F.col("dpd") >= 90, F.col("period"))), F.lit(-1)).alias("npa_period"))
    return per.select("account_id", labels.shift_recognition(F.col("npa_period"), lag, t.quarters().periods).alias("recognised"))


TREND_SQL = """ranked AS (SELECT account_id, decision_score AS s, row_number() OVER (PARTITION BY account_id ORDER BY period DESC) - 1 AS age,
  count(*) OVER (PARTITION BY account_id) AS n FROM panel WHERE period <= 16),
slopes AS (SELECT account_id, sum((2.5::DOUBLE - age) * s) / 17.5 AS slope, max(CASE WHEN age = 0 THEN s END) AS score, max(n) AS n
  FROM ranked WHERE age < 6 GROUP BY 1),
trend AS (SELECT account_id, score, CASE WHEN n >= 7 AND slope > 0.002 THEN slope END AS slope FROM slopes)"""


@query("wn13_trend_slope", f"WITH {TREND_SQL} SELECT account_id, round(slope, 6) AS slope FROM trend")
def trend_slope(t: Tables):
    return windows.trend_slope(t.panel(), 16).select("account_id", F.round("slope", 6).alias("slope"))


@query("pr36_runway", f"""
WITH {TREND_SQL} SELECT account_id, CASE WHEN slope IS NOT NULL THEN least(greatest(
 ceil((CASE WHEN score < 0.40 THEN 0.40 ELSE 0.85 END - score) / slope)::INT, 1), 12) END AS runway FROM trend""")
def runway(t: Tables):
    return windows.runway(windows.trend_slope(t.panel(), 16), 0.40).select("account_id", "runway")


@query("wn14_labelable", "SELECT account_id, period, labelable FROM panel")
def labelable(t: Tables):
    return labels.with_labelable(t.panel().drop("labelable"), 4).select(*KEY, "labelable")


def flagged():
    return F.col("decision_score") >= 0.28


LEAD_SQL = """b AS (SELECT account_id, min(CASE WHEN decision_score < 0.28 AND to_npa <= 4 THEN to_npa END) AS brk FROM panel GROUP BY 1),
leads AS (SELECT p.account_id, coalesce(max(CASE WHEN to_npa BETWEEN 1 AND 4 AND to_npa < coalesce(brk, 5) THEN to_npa END), 0) AS lead
  FROM panel p JOIN b USING (account_id) GROUP BY 1)"""


@query("wn15_sustained_lead", f"WITH {LEAD_SQL} SELECT account_id, lead FROM leads")
def sustained_lead(t: Tables):
    return leads.sustained_lead(t.panel(), flagged(), 4)


@query("wn16_lead_before_delinquency", """
SELECT account_id, min(CASE WHEN dpd > 0 THEN period END) AS first_late, min(CASE WHEN decision_score >= 0.28 THEN period END) AS first_flag,
 min(CASE WHEN dpd > 0 THEN period END) - min(CASE WHEN decision_score >= 0.28 THEN period END) AS lead
FROM panel GROUP BY 1 HAVING max(CASE WHEN to_npa BETWEEN 1 AND 4 THEN 1 ELSE 0 END) = 1""")
def lead_before_delinquency(t: Tables):
    return leads.lead_before_delinquency(t.panel(), flagged(), 4)


BASE_SQL = """base AS (SELECT account_id, coalesce(median(CASE WHEN to_npa > 8 THEN inflow END),
  median(CASE WHEN period < 3 THEN inflow END)) AS baseline FROM panel GROUP BY 1 HAVING min(period) < 3)"""
SUMMARY_SQL = "coalesce(median(CASE WHEN lead > 0 THEN lead END), 0)::DOUBLE AS median_lead, round(avg(CASE WHEN lead > 0 THEN 1 ELSE 0 END), 6) AS coverage"
INFLOW_RULE = leads.Rule("inflow", "rel_lt", 0.8)
BOUNCE_RULE = leads.Rule("dpd", "gt", 20.0)


def _summary(df):
    return leads.lead_summary(df).withColumn("coverage", F.round("coverage", 6))


@query("jn10_account_baseline", f"WITH {BASE_SQL} SELECT account_id, round(baseline, 3) AS baseline FROM base")
def account_baseline(t: Tables):
    return leads.account_baseline(t.panel(), "inflow", 8).select("account_id", F.round("baseline", 3).alias("baseline"))


@query("wn17_signal_lead", f"""
WITH {BASE_SQL}, l AS (SELECT account_id, coalesce(max(CASE WHEN inflow < 0.8 * baseline THEN to_npa END), 0) AS lead
 FROM panel LEFT JOIN base USING (account_id) WHERE to_npa BETWEEN 1 AND 8 GROUP BY 1) SELECT {SUMMARY_SQL} FROM l""")
def signal_lead(t: Tables):
    return _summary(leads.signal_leads(t.panel(), INFLOW_RULE, 8))


def _sustained_sql(name: str, condition: str) -> str:
    """Offsets 1..8 are all present in the data, so position = offset."""
    return f"""{name}_f AS (SELECT account_id, to_npa AS o FROM panel LEFT JOIN base USING (account_id)
  WHERE to_npa BETWEEN 1 AND 8 AND {condition}),
{name}_i AS (SELECT account_id, o, o - row_number() OVER (PARTITION BY account_id ORDER BY o) AS isl FROM {name}_f),
{name}_r AS (SELECT account_id, o, row_number() OVER (PARTITION BY account_id, isl ORDER BY o) AS run FROM {name}_i),
{name} AS (SELECT a.account_id, coalesce(max(CASE WHEN run >= least(o, 3) THEN o END), 0) AS lead
  FROM (SELECT DISTINCT account_id FROM panel WHERE to_npa BETWEEN 1 AND 8) a LEFT JOIN {name}_r USING (account_id) GROUP BY 1)"""


@query("wn18_sustained_signal_lead", f"""
WITH {BASE_SQL}, {_sustained_sql('s1', 'inflow < 0.8 * baseline')} SELECT {SUMMARY_SQL} FROM s1""")
def sustained_signal_lead(t: Tables):
    return _summary(leads.sustained_signal_leads(t.panel(), INFLOW_RULE, 8))


@query("wn19_first_warning", f"""
WITH {BASE_SQL}, {_sustained_sql('s1', 'inflow < 0.8 * baseline')}, {_sustained_sql('s2', 'dpd > 20')}
SELECT account_id, max(lead) AS lead FROM (SELECT * FROM s1 UNION ALL SELECT * FROM s2) GROUP BY 1""")
def first_warning(t: Tables):
    return leads.first_warning(t.panel(), [INFLOW_RULE, BOUNCE_RULE], 8)


@query("wn20_lag_autocorrelation", f"""
WITH n AS (SELECT account_id, count(*) AS n, avg(inflow) AS m FROM panel GROUP BY 1 HAVING count(*) >= 8),
x AS (SELECT account_id, period, inflow - m AS x FROM panel JOIN n USING (account_id)),
l AS (SELECT account_id, x, lag(x, 4) OVER {WO} AS x4 FROM x)
SELECT account_id, round(sum(x * x4) / sum(x * x), 6) + 0 AS autocorr FROM l GROUP BY 1 HAVING sum(x * x) > 0""")
def lag_autocorrelation(t: Tables):
    return windows.lag_autocorrelation(t.panel(), "inflow", 4).withColumn("autocorr", F.round("autocorr", 6))


def _npa_accounts(t: Tables):
    return _dense(t).groupBy("account_id").agg(
        F.min(F.when(F.col("dpd") >= 90, F.col("period"))).alias("npa_period")).withColumn(
        "vintage_0", F.col("account_id") % 37)


HAZARD_SQL = """a AS (SELECT account_id, account_id % 37 AS v0, npa_period FROM (SELECT DISTINCT account_id FROM grid) LEFT JOIN npa USING (account_id)),
e AS (SELECT v0, npa_period, CASE WHEN npa_period IS NULL THEN v0 + (SELECT periods - 1 FROM bounds) ELSE v0 + npa_period END AS fin FROM a),
ages AS (SELECT unnest(range(37 + (SELECT periods FROM bounds))) AS age),
haz AS (SELECT age, sum(CASE WHEN npa_period IS NOT NULL AND fin = age THEN 1 ELSE 0 END)::BIGINT AS events, count(*) AS exposure
  FROM ages JOIN e ON age BETWEEN v0 AND fin GROUP BY 1)"""


@query("wn21_vintage_hazard", f"WITH {HAZARD_SQL} SELECT age, events, exposure, round(events / exposure, 6) AS hazard FROM haz")
def vintage_hazard(t: Tables):
    return hazard.vintage_hazard(_npa_accounts(t), t.quarters().periods).withColumn("hazard", F.round("hazard", 6))


@query("wn22_hazard_hump", f"""
WITH {HAZARD_SQL}, m AS (SELECT sum(CASE WHEN age <= 12 THEN events END) / sum(CASE WHEN age <= 12 THEN exposure END) AS young,
 sum(CASE WHEN age BETWEEN 18 AND 30 THEN events END) / sum(CASE WHEN age BETWEEN 18 AND 30 THEN exposure END) AS hump,
 CASE WHEN sum(CASE WHEN age BETWEEN 48 AND 60 THEN exposure END) >= 500
  THEN sum(CASE WHEN age BETWEEN 48 AND 60 THEN events END) / sum(CASE WHEN age BETWEEN 48 AND 60 THEN exposure END)
  ELSE sum(CASE WHEN age BETWEEN 36 AND 48 THEN events END) / sum(CASE WHEN age BETWEEN 36 AND 48 THEN exposure END) END AS old FROM haz)
SELECT round(young, 6) AS young, round(hump, 6) AS hump, round(old, 6) AS old,
 coalesce(hump > 1.3 * young AND hump > 1.15 * old, false) AS passed FROM m""")
def hazard_hump(t: Tables):
    out = hazard.hazard_hump(hazard.vintage_hazard(_npa_accounts(t), t.quarters().periods), old=(48, 60), fallback=(36, 48))
    return out.select(*[F.round(c, 6).alias(c) for c in ("young", "hump", "old")], "passed")


@query("wn23_slippage_ratio", """
WITH a AS (SELECT DISTINCT account_id, npa_period FROM grid LEFT JOIN npa USING (account_id)),
w AS (SELECT s, sum(CASE WHEN npa_period IS NULL OR npa_period >= s THEN 1 ELSE 0 END) AS standard,
 sum(CASE WHEN npa_period BETWEEN s AND s + 3 THEN 1 ELSE 0 END) AS fresh FROM a, (SELECT unnest(range((SELECT periods // 4 FROM bounds))) * 4 AS s) GROUP BY 1)
SELECT count(*)::INT AS windows, round(avg(fresh / standard), 6) AS slippage_ratio FROM w WHERE standard > 0""")
def slippage_ratio(t: Tables):
    return hazard.slippage_ratio(_npa_accounts(t), t.quarters().periods, 4).withColumn("slippage_ratio", F.round("slippage_ratio", 6))


def _daily_events(t: Tables):
    """Events per user and day since the first event; the count is combined before the shuffle."""
    events = t.read("events")
    first = events.agg(F.min(F.to_date("ts"))).scalar()
    return events.groupBy(F.col("user_id").alias("account_id"), F.date_diff(F.to_date("ts"), first).alias("period")).agg(
        F.count("*").alias("n"))


DAYS_SQL = """d AS (SELECT user_id AS account_id, (ts::DATE - (SELECT min(ts)::DATE FROM events))::INT AS period, count(*) AS n FROM events GROUP BY 1, 2),
full_days AS (SELECT u.account_id, c.range::INT AS period, coalesce(d.n, 0) AS n FROM (SELECT DISTINCT account_id FROM d) u, (SELECT unnest(range((SELECT max(period) + 1 FROM d))) AS range) c
  LEFT JOIN d ON d.account_id = u.account_id AND d.period = c.range)"""


@query("wn24_densify", f"WITH {DAYS_SQL} SELECT * FROM full_days")
def densify(t: Tables):
    at = t.read("events").agg(F.date_diff(F.to_date(F.max("ts")), F.to_date(F.min("ts")))).first()[0]
    return windows.densify(_daily_events(t), 0, at or 0, {"n": 0})


@query("wn25_contiguity", f"""
WITH {DAYS_SQL} SELECT account_id, min(period) AS "first", max(period) AS "last", count(DISTINCT period) AS n FROM d
GROUP BY 1 HAVING min(period) <> 0 OR count(DISTINCT period) <> max(period) + 1""")
def contiguity(t: Tables):
    return windows.contiguity_violations(_daily_events(t))


@query("wn27_carry_forward_reversal", f"""
SELECT account_id, period, round(least(CASE WHEN bounce = 1 THEN 0 ELSE collected END
 + coalesce(lag(CASE WHEN bounce = 1 THEN collected END) OVER {WO}, 0), demanded), 4) AS collected_net FROM panel""")
def carry_forward_reversal(t: Tables):
    net = windows.carry_forward_reversal(F.col("collected"), F.col("demanded"), F.col("bounce") == 1)
    return t.panel().select(*KEY, F.round(net, 4).alias("collected_net"))


@query("ag29_rates_by_rule", """
WITH r AS (SELECT portfolio, 'idle>=10' AS rule, went_bad, to_npa FROM panel WHERE labelable = 1
 UNION ALL SELECT portfolio, 'idle>=8', CASE WHEN b - period BETWEEN 1 AND 4 THEN 1 ELSE 0 END, coalesce(b - period, -1)
 FROM run LEFT JOIN (SELECT account_id, min(period) AS b FROM run WHERE idle >= 8 GROUP BY 1) USING (account_id)
 WHERE period <= (SELECT periods - 5 FROM bounds) AND (b IS NULL OR period < b))
SELECT portfolio, rule, count(*) AS n, round(avg(went_bad), 6) AS rate, median(CASE WHEN to_npa > 0 THEN to_npa END)::DOUBLE AS median_to_npa
FROM r GROUP BY 1, 2""")
def rates_by_rule(t: Tables):
    stricter = labels.standard_rows(labels.with_first_npa(_dense(t), 72.0), 72.0).where(F.col("period") <= t.quarters().last_labelable)
    stricter = stricter.withColumn("to_npa", labels.to_npa(F.col("npa_period"), F.col("period"))).withColumn(
        "went_bad", labels.bad_within(F.col("to_npa"), 4))
    both = hazard.rates_by_rule(t.eligible(), "idle>=10").unionByName(hazard.rates_by_rule(stricter, "idle>=8"))
    return both.withColumn("rate", F.round("rate", 6))


@query("ag34_median_first_warning", f"""
WITH {LEAD_SQL}, f AS (SELECT lead FROM leads WHERE account_id IN (SELECT account_id FROM npa))
SELECT count(*) AS n, median(lead)::DOUBLE AS median_lead, round(avg(lead), 6) AS mean_lead,
 round(avg(CASE WHEN lead >= 2 THEN 1 ELSE 0 END), 6) AS share_early, round(avg(CASE WHEN lead = 0 THEN 1 ELSE 0 END), 6) AS share_never FROM f""")
def median_first_warning(t: Tables):
    failing = t.panel().where(F.col("npa_period").isNotNull())
    out = leads.warning_census(leads.sustained_lead(failing, flagged(), 4), 2)
    return out.select("n", "median_lead", *[F.round(c, 6).alias(c) for c in ("mean_lead", "share_early", "share_never")])


@query("ag35_leads_by_bucket", f"""
WITH {LEAD_SQL}, f AS (SELECT lead FROM leads WHERE account_id IN (SELECT account_id FROM npa))
SELECT bucket, count(lead) AS n, round(count(lead) / (SELECT count(*) FROM f), 6) AS share
FROM (VALUES ('1-2', 1, 2), ('3-3', 3, 3), ('4-4', 4, 4)) v(bucket, lo, hi) LEFT JOIN f ON lead BETWEEN lo AND hi GROUP BY 1""")
def leads_by_bucket(t: Tables):
    failing = t.panel().where(F.col("npa_period").isNotNull())
    out = leads.leads_by_bucket(leads.sustained_lead(failing, flagged(), 4), [(1, 2), (3, 3), (4, 4)])
    return out.withColumn("share", F.round("share", 6))


@query("fl01_eligible_rows", "SELECT account_id, period FROM panel WHERE labelable = 1")
def eligible_rows(t: Tables):
    return labels.eligible_rows(t.panel()).select(*KEY)


@query("fl02_standard_rows", """
SELECT account_id, period FROM run LEFT JOIN npa USING (account_id) WHERE npa_period IS NULL OR period < npa_period""")
def standard_rows(t: Tables):
    return labels.standard_rows(labels.with_first_npa(_dense(t))).select(*KEY)


@query("fl03_snapshot", "SELECT account_id, period, decision_score FROM panel WHERE period = (SELECT periods - 5 FROM bounds)")
def snapshot(t: Tables):
    # the reference period lies outside the panel, so the latest eligible one is used
    return labels.snapshot(t.panel(), 40).select(*KEY, "decision_score")


@query("fl06_lead_bucket", "SELECT account_id, period, to_npa FROM panel WHERE went_bad = 1 AND to_npa BETWEEN 3 AND 4")
def lead_bucket(t: Tables):
    return labels.lead_bucket(t.panel(), 3, 4).select(*KEY, "to_npa")
