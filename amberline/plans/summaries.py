"""Joins, masks, grouped summaries and data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from amberline.config import CostParams
from amberline.operators import aggregates, fingerprint, joins, labels, masks, quality, scorecard
from amberline.operators.quantiles import edges_scalar, exact_quantiles, right_closed_bin
from amberline.operators.windows import contiguity_violations
from amberline.plans.registry import Tables, query
from amberline.plans.scalar import WILSON_HIGH_SQL, WILSON_SQL
from amberline.plans.timeseries import WO, _dense, _signals

KEY = ("account_id", "period")
ABSENT = {"HOUSEHOLD": ("cash_flow",), "BUILDING": ("transactions", "utilisation")}


def _rounded(df, digits: int, *cols: str):
    return df.withColumns({c: F.round(c, digits) for c in cols})


# ---- masks ----------------------------------------------------------------

@query("fl07_mask_by_portfolio", """
SELECT account_id, period, CASE WHEN portfolio <> 'HOUSEHOLD' THEN inflow END AS inflow,
 CASE WHEN portfolio <> 'BUILDING' THEN txn_count END AS txn_count,
 CASE WHEN portfolio <> 'BUILDING' THEN round(utilisation, 6) END AS utilisation FROM panel""")
def mask_by_portfolio(t: Tables):
    out = masks.mask_by_portfolio(t.panel(), ABSENT)
    return out.select(*KEY, "inflow", "txn_count", F.round("utilisation", 6).alias("utilisation"))


@query("fl08_mask_by_borrower", """
SELECT account_id, period, CASE WHEN constitution <> 'Individual' THEN round(collected, 4) END AS gst_sales,
 CASE WHEN region = 'ASIA' THEN inflow END AS salary_credit FROM panel""")
def mask_by_borrower(t: Tables):
    rows = t.panel().select(*KEY, "constitution", F.when(F.col("region") == "ASIA", "Salaried").otherwise("Own").alias("sector"),
                            F.round("collected", 4).alias("gst_sales"), F.col("inflow").alias("salary_credit"))
    return masks.mask_by_borrower(rows).select(*KEY, "gst_sales", "salary_credit")


@query("fl09_mask_statement_gaps", """
SELECT account_id, period, CASE WHEN NOT (account_id % 5 = 0 AND period BETWEEN account_id % 20 AND account_id % 20 + account_id % 3)
 THEN inflow END AS inflow, CASE WHEN NOT (account_id % 5 = 0 AND period BETWEEN account_id % 20 AND account_id % 20 + account_id % 3)
 THEN txn_count END AS txn_count FROM panel""")
def mask_statement_gaps(t: Tables):
    key = F.col("account_id")
    gaps = t.accounts().where(key % 5 == 0).select("account_id", (key % 20).cast("int").alias("start"),
                                                   (key % 3 + 1).cast("int").alias("length"))
    return masks.mask_statement_gaps(t.panel(), gaps).select(*KEY, "inflow", "txn_count")


# ---- joins ----------------------------------------------------------------

@query("jn01_book_with_static", """
SELECT account_id, decision_score, state, sanctioned FROM book""")
def book_with_static(t: Tables):
    book = t.book().select("account_id", "decision_score")
    return joins.with_static(book, t.accounts()).select("account_id", "decision_score", "state", "sanctioned")


@query("jn02_identity_overlay", """
SELECT account_id, CASE WHEN account_id % 9 = 0 AND account_id % 2 = 0 THEN 'C' || account_id ELSE 'old' END AS cif_id,
 CASE WHEN account_id % 9 = 0 THEN 'B' || account_id % 7 END AS branch_code, dpd FROM book""")
def identity_overlay(t: Tables):
    key = F.col("account_id")
    overlay = t.accounts().where(key % 9 == 0).select(
        "account_id", F.when(key % 2 == 0, F.concat(F.lit("C"), key)).alias("cif_id"),
        F.concat(F.lit("B"), key % 7).alias("branch_code"), F.lit(99.0).alias("dpd"))
    book = t.book().select("account_id", F.lit("old").alias("cif_id"), "dpd")
    return joins.overlay_identity(book, overlay)


@query("jn06_id_bijection", """
SELECT a AS account_id, 'panel' AS only_in FROM (SELECT DISTINCT o_custkey AS a FROM orders WHERE o_custkey NOT IN
 (SELECT c_custkey FROM customer WHERE c_custkey % 10 > 0)) UNION ALL
SELECT c_custkey, 'accounts' FROM customer WHERE c_custkey % 10 > 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def id_bijection(t: Tables):
    known = t.accounts().where(F.col("account_id") % 10 > 0)
    return joins.id_bijection(t.read("orders").select(F.col("o_custkey").alias("account_id")), known)


@query("jn07_vintage_mismatches", """
SELECT account_id, period, vintage_months + CASE WHEN account_id % 50 = 0 AND period > 5 THEN 1 ELSE 0 END AS vintage_months,
 account_id % 37 AS vintage_0 FROM panel WHERE account_id % 50 = 0 AND period > 5""")
def vintage_mismatches(t: Tables):
    broken = ((F.col("account_id") % 50 == 0) & (F.col("period") > 5)).cast("int")
    rows = t.panel().withColumn("vintage_months", F.col("vintage_months") + broken)
    return joins.vintage_mismatches(rows, t.accounts(), 3)


@query("jn09_levels_missing_from_test", """
SELECT DISTINCT vintage_months // 12 AS age_year FROM panel WHERE period < 8 AND vintage_months // 12 NOT IN
 (SELECT vintage_months // 12 FROM panel WHERE period >= 16)""")
def levels_missing_from_test(t: Tables):
    rows = t.panel().withColumn("age_year", F.floor(F.col("vintage_months") / 12))
    return joins.levels_missing_from(rows.where(F.col("period") < 8), rows.where(F.col("period") >= 16), "age_year")


@query("jn11_hold_between_refreshes", f"""
SELECT account_id, period, coalesce(last_value(CASE WHEN period % 3 = account_id % 3 THEN inflow END IGNORE NULLS) OVER {WO},
 first_value(inflow) OVER {WO}) AS held FROM panel""")
def hold_between_refreshes(t: Tables):
    return joins.hold_between_refreshes(t.panel(), "inflow", F.col("period") % 3 == F.col("account_id") % 3, "held") \
        .select(*KEY, "held")


@query("jn12_reported_with_lag", f"""
WITH f AS (SELECT *, first_value(inflow) OVER {WO} AS f0 FROM panel)
SELECT f.account_id, f.period, coalesce(s.inflow, f.f0) AS reported FROM f LEFT JOIN panel s
 ON s.account_id = f.account_id AND s.period = f.period - f.account_id % 3""")
def reported_with_lag(t: Tables):
    return joins.reported_with_lag(t.panel(), "inflow", F.col("account_id") % 3, "reported").select(*KEY, "reported")


@query("jn13_cut_index", """
SELECT account_id, period, (CASE WHEN decision_score >= 0.1 THEN 1 ELSE 0 END + CASE WHEN decision_score >= 0.28 THEN 1 ELSE 0 END
 + CASE WHEN decision_score >= 0.4 THEN 1 ELSE 0 END + CASE WHEN decision_score >= 0.55 THEN 1 ELSE 0 END) AS cut FROM panel""")
def cut_index(t: Tables):
    cuts = F.array(*[F.lit(c) for c in (0.1, 0.28, 0.4, 0.55)])
    return t.panel().select(*KEY, joins.cut_index(F.col("decision_score"), cuts).alias("cut"))


# ---- summaries ------------------------------------------------------------

@query("ag01_base_rates", f"""
WITH s AS (SELECT account_id, period, CASE WHEN max(9.0 * idle) OVER (PARTITION BY account_id ORDER BY period
  ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) >= 61 THEN 1 ELSE 0 END AS sma2 FROM run),
p AS (SELECT portfolio, went_bad, sma2 FROM eligible JOIN s USING (account_id, period)),
g AS (SELECT coalesce(portfolio, '__pooled__') AS portfolio, count(*) AS n, avg(went_bad) AS b, avg(sma2) AS s
 FROM p GROUP BY GROUPING SETS ((), (portfolio)))
SELECT portfolio, n, round(b, 6) AS bad_rate, round(s, 6) AS sma2_rate, round(s / b, 6) AS sma2_to_npa,
 round(s / b * 2, 6) AS sma2_to_npa_events FROM g""")
def base_rates(t: Tables):
    rows = labels.with_first_npa(_dense(t)).withColumn("sma2", labels.sma2_within(2))
    rows = labels.standard_rows(rows).withColumn("to_npa", labels.to_npa(F.col("npa_period"), F.col("period")))
    rows = rows.withColumn("went_bad", labels.bad_within(F.col("to_npa"), 4)).withColumn(
        "labelable", (F.col("period") <= t.quarters().last_labelable).cast("int"))
    return _rounded(aggregates.base_rates(rows), 6, "bad_rate", "sma2_rate", "sma2_to_npa", "sma2_to_npa_events")


@query("ag02_rate_bands", """
WITH lim AS (SELECT c_mktsegment AS portfolio, 0.02::DOUBLE AS lo, 0.02 + 0.001 * length(c_mktsegment)::DOUBLE AS hi FROM customer GROUP BY 1),
r AS (SELECT portfolio, avg(went_bad) AS bad_rate FROM eligible GROUP BY 1)
SELECT portfolio, round(bad_rate, 6) AS bad_rate, lo, round(hi, 6) AS hi, bad_rate BETWEEN lo AND hi AS passed FROM r JOIN lim USING (portfolio)""")
def rate_bands(t: Tables):
    limits = t.accounts().groupBy("portfolio").agg(F.lit(0.02).alias("lo"), F.max(0.02 + 0.001 * F.length("portfolio")).alias("hi"))
    rates = t.eligible().groupBy("portfolio").agg(F.avg("went_bad").alias("bad_rate"))
    return _rounded(aggregates.inside_bands(rates, limits, "portfolio", "bad_rate"), 6, "bad_rate", "hi")


BAND_CELLS_SQL = f"""bandlist AS (SELECT * FROM (VALUES ('green', 0), ('amber', 1), ('red', 2)) v(band, ord)),
scored AS (SELECT *, CASE WHEN decision_score >= 0.40 THEN 'red' WHEN decision_score >= 0.28 THEN 'amber' ELSE 'green' END AS band FROM eligible),
lv AS (SELECT DISTINCT portfolio FROM scored UNION ALL SELECT '__pooled__'),
cells AS (SELECT lv.portfolio, b.ord, b.band, count(s.went_bad)::DOUBLE AS n, coalesce(sum(s.went_bad), 0)::DOUBLE AS k
 FROM lv CROSS JOIN bandlist b LEFT JOIN scored s ON s.band = b.band AND (s.portfolio = lv.portfolio OR lv.portfolio = '__pooled__') GROUP BY 1, 2, 3)"""


@query("ag03_rates_by_band", f"""
WITH {BAND_CELLS_SQL} SELECT portfolio, ord, band, k::BIGINT AS k, n::BIGINT AS n, CASE WHEN n > 0 THEN round(k / n, 6) ELSE 0 END AS rate,
 CASE WHEN n > 0 THEN round({WILSON_SQL}, 6) ELSE 0 END AS ci_lo, CASE WHEN n > 0 THEN round({WILSON_HIGH_SQL}, 6) ELSE 0 END AS ci_hi FROM cells""")
def rates_by_band(t: Tables):
    return _rounded(aggregates.rates_by_band(_banded(t), F.col("went_bad") == 1), 6, "rate", "ci_lo", "ci_hi")


def _banded(t: Tables):
    score = F.col("decision_score")
    return t.eligible().withColumn("band", F.when(score >= 0.40, "red").when(score >= 0.28, "amber").otherwise("green"))


@query("ag04_red_precision", f"""
WITH c AS (SELECT coalesce(portfolio, '__pooled__') AS portfolio, count(*) FILTER (band = 'red')::DOUBLE AS n,
 count(*) FILTER (band = 'red' AND to_npa BETWEEN 1 AND 3)::DOUBLE AS k, count(*) FILTER (to_npa BETWEEN 1 AND 3) AS n_bad_book
 FROM book GROUP BY GROUPING SETS ((), (portfolio)))
SELECT portfolio, n::BIGINT AS n, k::BIGINT AS k, n_bad_book, CASE WHEN n > 0 THEN round(k / n, 6) ELSE 0 END AS rate,
 CASE WHEN n > 0 THEN round({WILSON_SQL}, 6) ELSE 0 END AS ci_lo, CASE WHEN n > 0 THEN round({WILSON_HIGH_SQL}, 6) ELSE 0 END AS ci_hi FROM c""")
def red_precision(t: Tables):
    return _rounded(aggregates.red_precision(t.book(), 3), 6, "rate", "ci_lo", "ci_hi")


@query("ag05_honest_metrics", f"""
WITH o AS (SELECT count(*) AS n, count(*) FILTER (to_npa BETWEEN 1 AND 3) AS bad, count(*) FILTER (to_npa BETWEEN 1 AND 4) AS long_bad,
 count(*) FILTER (band = 'red') AS red, count(*) FILTER (band = 'red' AND to_npa BETWEEN 1 AND 3) AS red_bad,
 count(*) FILTER ((band = 'red') = (to_npa BETWEEN 1 AND 3)) AS correct, count(*) FILTER (band = 'green' AND to_npa BETWEEN 1 AND 3) AS missed,
 count(*) FILTER (band <> 'green') AS flagged FROM book),
rk AS (SELECT to_npa BETWEEN 1 AND 3 AS y, row_number() OVER (ORDER BY decision_score DESC, md5(account_id::VARCHAR || '|' || period::VARCHAR)) AS r, count(*) OVER () AS t FROM book),
m AS (SELECT 'recall_at_budget' AS metric, count(*) FILTER (y AND r <= greatest(round_even(t * 0.1, 0), 1))::DOUBLE AS k, count(*) FILTER (y)::DOUBLE AS n FROM rk UNION ALL SELECT 'red_precision' AS metric, red_bad::DOUBLE AS k, red::DOUBLE AS n FROM o UNION ALL SELECT 'raw_accuracy', correct, n FROM o
 UNION ALL SELECT 'base_rate', bad, n FROM o UNION ALL SELECT 'base_rate_long', long_bad, n FROM o UNION ALL SELECT 'missed_share', missed, bad FROM o
 UNION ALL SELECT 'flagged_share', flagged, n FROM o UNION ALL SELECT 'flag_nobody', n - bad, n FROM o)
SELECT metric, k::BIGINT AS k, n::BIGINT AS n, round(k / n, 6) AS rate, round({WILSON_SQL}, 6) AS ci_lo, round({WILSON_HIGH_SQL}, 6) AS ci_hi FROM m""")
def honest_metrics(t: Tables):
    book = t.stored(t.book(), *KEY, "band", "to_npa", "decision_score")
    return _rounded(scorecard.honest_block(book, 3, 4, KEY), 6, "rate", "ci_lo", "ci_hi")


@query("ag06_portfolio_summary", """
SELECT count(*) AS n, count(*) FILTER (band = 'green') AS n_green, count(*) FILTER (band = 'amber') AS n_amber,
 count(*) FILTER (band = 'red') AS n_red, round(sum(CASE WHEN band = 'red' THEN sanctioned END), 1) AS exposure_at_risk FROM book""")
def portfolio_summary(t: Tables):
    return _rounded(aggregates.portfolio_summary(t.book()), 1, "exposure_at_risk")


@query("ag07_concentration", """
WITH x AS (SELECT band, sanctioned, unnest(['region', 'constitution', 'portfolio']) AS key, unnest([region, constitution, portfolio]) AS level FROM book),
g AS (SELECT key, level, count(*) AS n, count(*) FILTER (band <> 'green') AS n_flagged, sum(sanctioned) AS total,
 sum(CASE WHEN band = 'red' THEN sanctioned ELSE 0 END) AS red, sum(CASE WHEN band = 'amber' THEN sanctioned ELSE 0 END) AS amber FROM x GROUP BY 1, 2)
SELECT key, level, n, n_flagged, round(total, 1) AS total, round(red, 1) AS red, round(amber, 1) AS amber, round((red + amber) / total, 6) AS pct_flagged FROM g""")
def concentration(t: Tables):
    out = aggregates.concentration(t.book(), ("region", "constitution", "portfolio"))
    return _rounded(_rounded(out, 1, "total", "red", "amber"), 6, "pct_flagged")


@query("ag08_act_first", """
SELECT account_id, band, round(decision_score * sanctioned, 2) AS at_risk FROM book WHERE band <> 'green'
ORDER BY decision_score * sanctioned DESC, account_id LIMIT 10""")
def act_first(t: Tables):
    return _rounded(aggregates.act_first(t.book()), 2, "at_risk")


@query("ag09_provision_what_if", """
WITH o AS (SELECT sum(CASE WHEN band <> 'green' THEN decision_score * sanctioned END) AS e, sum(CASE WHEN band <> 'green' THEN sanctioned END) AS f,
 sum(sanctioned) / 1e7 AS c FROM book)
SELECT round(e, 1) AS expected_npa, round(f, 1) AS flagged_exposure, round(c, 4) AS sample_crore, round(30000 / c, 6) AS scale,
 round(e * 0.15 * 0.35, 1) AS provision_saved, round(e * 0.35, 1) AS exposure_protected FROM o""")
def provision_what_if(t: Tables):
    out = aggregates.provision_what_if(t.book(), 0.35, 0.15, 30000.0)
    digits = {"sample_crore": 4, "scale": 6}
    return out.select(*[F.round(c, digits.get(c, 1)).alias(c) for c in out.columns])


@query("ag10_two_grain_exhibit", """
SELECT coalesce(portfolio, '__pooled__') AS portfolio, count(*) AS n, count(DISTINCT account_id) AS accounts, round(avg(decision_score), 6) AS mean_score,
 round(avg(went_bad), 6) AS bad_rate FROM eligible GROUP BY GROUPING SETS ((), (portfolio))""")
def two_grain_exhibit(t: Tables):
    # first per account, so the distinct count is a plain count
    per = t.eligible().groupBy("account_id", "portfolio").agg(
        F.count("*").alias("rows"), F.sum("decision_score").alias("score"), F.sum("went_bad").alias("bad"))
    out = aggregates.at_two_grains(per, F.sum("rows").alias("n"), F.count("*").alias("accounts"),
                                   (F.sum("score") / F.sum("rows")).alias("mean_score"), (F.sum("bad") / F.sum("rows")).alias("bad_rate"))
    return _rounded(out, 6, "mean_score", "bad_rate")


@query("ag12_quintile_ticket_cut", """
WITH e AS (SELECT quantile_cont(sanctioned, [0.2, 0.4, 0.6, 0.8]) AS q FROM eligible)
SELECT (CASE WHEN sanctioned <= q[1] THEN 0 WHEN sanctioned <= q[2] THEN 1 WHEN sanctioned <= q[3] THEN 2 WHEN sanctioned <= q[4] THEN 3 ELSE 4 END) AS quintile,
 count(*) AS n, round(avg(went_bad), 6) AS rate FROM eligible, e GROUP BY 1""")
def quintile_ticket_cut(t: Tables):
    stored = t.stored(t.eligible(), "sanctioned", "went_bad")
    edges = edges_scalar(exact_quantiles(stored, "sanctioned", (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)))
    rows = stored.withColumn("edges", edges)
    return rows.groupBy(right_closed_bin(F.col("sanctioned"), F.col("edges")).alias("quintile")).agg(
        F.count("*").alias("n"), F.round(F.avg("went_bad"), 6).alias("rate"))


@query("ag13_sma_shares", """
WITH c AS (SELECT count(*) FILTER (dpd > 0 AND dpd <= 30) AS a, count(*) FILTER (dpd > 30 AND dpd <= 60) AS b, count(*) FILTER (dpd > 60 AND dpd <= 90) AS c FROM panel)
SELECT a + b + c AS n, round(a / (a + b + c), 6) AS sma0, round(b / (a + b + c), 6) AS sma1, round(c / (a + b + c), 6) AS sma2,
 a / (a + b + c) >= b / (a + b + c) - 0.02 AND b / (a + b + c) >= c / (a + b + c) - 0.02 AS passed FROM c""")
def sma_shares(t: Tables):
    return _rounded(quality.dpd_shares(t.panel()), 6, "sma0", "sma1", "sma2")


@query("ag14_histogram_mode", """
WITH b AS (SELECT least(floor(utilisation / 0.025)::BIGINT, 39) AS bin, count(*) AS n FROM panel WHERE utilisation > 0 AND utilisation <= 1 GROUP BY 1)
SELECT round((arg_max(bin, n * 1000 - bin) + 0.5::DOUBLE) * 0.025::DOUBLE, 4) AS mode, max(n) AS n FROM b""")
def histogram_mode(t: Tables):
    return _rounded(quality.histogram_mode(t.panel().where(F.col("utilisation") > 0), "utilisation", 40, 0.0, 1.0), 4, "mode")


@query("ag15_rate_monotone_by_band", """
WITH b AS (SELECT CASE WHEN dpd <= 0 THEN 0 WHEN dpd <= 30 THEN 1 WHEN dpd <= 60 THEN 2 ELSE 3 END AS ord, went_bad FROM eligible WHERE dpd <= 90),
g AS (SELECT ord, count(*) AS n, avg(went_bad) AS rate FROM b GROUP BY 1)
SELECT ord, ['0', '1-30', '31-60', '61-90'][ord + 1] AS label, n, round(rate, 6) AS rate, coalesce(rate >= lag(rate) OVER (ORDER BY ord), true) AS step_ok FROM g""")
def rate_monotone_by_band(t: Tables):
    out = quality.rate_by_edges(t.panel(), "dpd", (-1.0, 0.0, 30.0, 60.0, 90.0), ("0", "1-30", "31-60", "61-90"))
    return _rounded(out, 6, "rate")


@query("ag16_null_share", """
SELECT 'bureau_score' AS "column", round(avg(CASE WHEN bureau_score IS NULL THEN 1 ELSE 0 END), 6) AS share FROM panel
UNION ALL SELECT 'npa_period', round(avg(CASE WHEN npa_period IS NULL THEN 1 ELSE 0 END), 6) FROM panel""")
def null_share(t: Tables):
    return _rounded(quality.null_share(t.panel(), ("bureau_score", "npa_period")), 6, "share")


@query("ag17_share_checks", """
WITH a AS (SELECT account_id, max(CASE WHEN to_npa > 0 THEN 1 ELSE 0 END) AS bad, max(CASE WHEN decision_score >= 0.40 AND to_npa > 0 THEN 1 ELSE 0 END) AS warned,
 max(CASE WHEN idle >= 4 THEN 1 ELSE 0 END) AS stressed FROM panel GROUP BY 1)
SELECT 'silent_share' AS "check", round(avg(1 - warned) FILTER (bad = 1), 6) AS observed, abs(avg(1 - warned) FILTER (bad = 1) - 0.1) <= 0.015 AS passed FROM a
UNION ALL SELECT 'transient_share', round(avg(stressed) FILTER (bad = 0), 6), abs(avg(stressed) FILTER (bad = 0) - 0.5) <= 0.05 FROM a""")
def share_checks(t: Tables):
    per = t.panel().groupBy("account_id").agg(
        F.max(F.col("to_npa") > 0).alias("bad"),
        F.max((F.col("decision_score") >= 0.40) & (F.col("to_npa") > 0)).alias("warned"), F.max(F.col("idle") >= 4).alias("stressed"))
    silent = quality.share_check(per, "silent_share", ~F.col("warned"), F.col("bad"), 0.1, 0.015)
    transient = quality.share_check(per, "transient_share", F.col("stressed"), ~F.col("bad"), 0.5, 0.05)
    return _rounded(silent.unionByName(transient), 6, "observed")


@query("ag18_event_ratio", """
WITH s AS (SELECT account_id, period, CASE WHEN max(9.0 * idle) OVER (PARTITION BY account_id ORDER BY period
  ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) >= 61 THEN 1 ELSE 0 END AS sma2 FROM run),
p AS (SELECT went_bad, sma2 FROM eligible JOIN s USING (account_id, period))
SELECT round(avg(sma2) / avg(went_bad) * 2, 6) AS event_ratio, avg(sma2) / avg(went_bad) * 2 BETWEEN 1.0 AND 3.0 AS passed FROM p""")
def event_ratio(t: Tables):
    rates = base_rates(t).where(F.col("portfolio") == aggregates.POOLED)
    return rates.select(F.col("sma2_to_npa_events").alias("event_ratio"), F.col("sma2_to_npa_events").between(1.0, 3.0).alias("passed"))


@query("ag19_static_attrs_changed", """
SELECT unnest(['portfolio', 'region', 'secured', 'vintage_months']) AS "check", unnest([count(*) FILTER (p > 1), count(*) FILTER (r > 1),
 count(*) FILTER (s > 1), count(*) FILTER (v > 1)]) AS violations FROM (SELECT account_id, count(DISTINCT portfolio) AS p, count(DISTINCT region) AS r,
 count(DISTINCT secured) AS s, count(DISTINCT vintage_months) AS v FROM panel GROUP BY 1)""")
def static_attrs_changed(t: Tables):
    return quality.static_attrs_changed(t.panel(), ("portfolio", "region", "secured", "vintage_months"))


@query("ag20_duplicate_keys", """
SELECT l_orderkey, l_linenumber, count(*) - 1 AS surplus FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def duplicate_keys(t: Tables):
    return quality.duplicate_keys(t.read("lineitem"), "l_orderkey", "l_linenumber")


def _impossible(t: Tables):
    rows = _signals(t).withColumn("balance", F.col("inflow") - F.col("demanded")).withColumn(
        "collection_ratio", F.when(F.col("demanded") > 0, F.col("collected") / F.col("demanded")).otherwise(1.0))
    rules = quality.impossible_states(rows.columns, ("HOUSEHOLD", "MACHINERY", "FURNITURE", "BUILDING"), ("Individual", "Company"))
    return quality.count_violations(rows, rules)


IMPOSSIBLE_SQL = """counts AS (SELECT count(*) FILTER (demanded < 0) AS demanded_low, count(*) FILTER (collected < 0) AS collected_low,
 count(*) FILTER (collected > 1.05 * demanded) AS collected_over_demanded, count(*) FILTER (dpd < 0) AS dpd_low,
 count(*) FILTER (dpd >= 90) AS dpd_high, count(*) FILTER (dpd > vintage_months * 30.0) AS dpd_over_age,
 count(*) FILTER (utilisation > 1.2) AS utilisation_high, count(*) FILTER (utilisation < 0) AS utilisation_low,
 count(*) FILTER (to_npa = 0 OR to_npa < -1) AS to_npa_past, count(*) FILTER (secured NOT IN (0, 1)) AS secured_not_0_or_1,
 count(*) FILTER (portfolio = 'AUTOMOBILE') AS portfolio_unknown, count(*) FILTER (constitution = 'Partnership') AS constitution_unknown,
 count(*) FILTER (vintage_months < 0) AS vintage_months_low, count(*) FILTER (bureau_score < 300) AS bureau_score_low,
 count(*) FILTER (bureau_score > 900) AS bureau_score_high,
 count(*) FILTER (CASE WHEN demanded > 0 THEN collected / demanded ELSE 1.0 END < 0) AS collection_ratio_low,
 count(*) FILTER (CASE WHEN demanded > 0 THEN collected / demanded ELSE 1.0 END > 1.05) AS collection_ratio_high,
 count(*) FILTER (inflow - demanded < 0) AS balance_low, count(*) FILTER (txn_count < 0) AS txn_count_low,
 count(*) FILTER (bounce NOT IN (0, 1)) AS bounce_not_0_or_1, 0::BIGINT AS minbal_breach_not_0_or_1, 0::BIGINT AS adverse_remark_not_0_or_1,
 count(*) FILTER (labelable NOT IN (0, 1)) AS labelable_not_0_or_1, count(*) FILTER (went_bad NOT IN (0, 1)) AS went_bad_not_0_or_1 FROM panel),
impossible AS (SELECT name AS "check", value AS violations FROM (UNPIVOT counts ON COLUMNS(*) INTO NAME name VALUE value))"""


@query("ag21_impossible_states", f"WITH {IMPOSSIBLE_SQL} SELECT * FROM impossible")
def impossible_states(t: Tables):
    return _impossible(t)


@query("ag22_channel_presence", """
SELECT 'only_in_allowed_portfolio[gst_sales]' AS "check", count(*) FILTER (portfolio = 'MACHINERY') AS violations FROM panel UNION ALL
SELECT 'only_in_allowed_portfolio[adverse_remark]', count(*) FILTER (secured = 1 AND portfolio NOT IN ('HOUSEHOLD', 'MACHINERY')) FROM panel""")
def channel_presence(t: Tables):
    rules = quality.channel_presence({"gst_sales": ("HOUSEHOLD", "AUTOMOBILE", "FURNITURE", "BUILDING"),
                                      "adverse_remark": ("HOUSEHOLD", "MACHINERY")})
    return quality.count_violations(_signals(t), rules)


@query("ag23_borrower_absence", """
SELECT 'gst_of_individual' AS "check", count(*) FILTER (portfolio <> 'HOUSEHOLD' AND constitution = 'Individual') AS violations FROM panel UNION ALL
SELECT 'salary_of_self_employed', count(*) FILTER (region <> 'ASIA' AND txn_count > 0) FROM panel""")
def borrower_absence(t: Tables):
    rows = _signals(t).withColumn("salary_credit", F.when(F.col("txn_count") > 0, F.col("inflow"))).withColumn(
        "sector", F.when(F.col("region") == "ASIA", "Salaried").otherwise("Own"))
    return quality.count_violations(rows, quality.borrower_absence())


@query("ag24_level_mix", """
SELECT region, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM panel GROUP BY 1""")
def level_mix(t: Tables):
    return _rounded(aggregates.level_mix(t.panel(), "region"), 6, "share")


def _fingerprint_sql(name: str, where: str) -> str:
    numbers = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", s.stat, s.value FROM (SELECT avg({c}) AS mean, stddev_pop({c}) AS sd, quantile_cont({c}, [0.05, 0.25, 0.5, 0.75, 0.95]) AS q "
        f"FROM panel WHERE {where}) a, LATERAL (SELECT unnest(['mean', 'sd', 'q0.05', 'q0.25', 'q0.5', 'q0.75', 'q0.95']) AS stat, "
        f"unnest([mean, sd, q[1], q[2], q[3], q[4], q[5]]) AS value) s" for c in ("sanctioned", "utilisation"))
    shares = (f"SELECT 'region' AS \"column\", 'share:' || region AS stat, count(*) / sum(count(*)) OVER () AS value FROM panel WHERE {where} GROUP BY region")
    return f"{name} AS ({numbers} UNION ALL {shares})"


@query("ag25_table_fingerprint", f"""
WITH {_fingerprint_sql('fp', 'true')} SELECT "column", stat, round(value, 4) AS value FROM fp""")
def table_fingerprint(t: Tables):
    return _rounded(fingerprint.table_fingerprint(t.stored(t.panel(), "sanctioned", "utilisation", "region"), ("sanctioned", "utilisation"), ("region",)), 4, "value")


@query("ag36_compare_fingerprints", f"""
WITH {_fingerprint_sql('fa', 'period < 13')}, {_fingerprint_sql('fb', 'period >= 13')}
SELECT "column", stat, round(fa.value, 4) AS "left", round(fb.value, 4) AS "right",
 coalesce(abs(fa.value - fb.value) <= 0.01 * greatest(abs(fa.value), 1.0), false) AS passed FROM fa FULL JOIN fb USING ("column", stat)""")
def compare_fingerprints(t: Tables):
    rows = t.stored(t.panel(), "period", "sanctioned", "utilisation", "region")
    halves = [fingerprint.table_fingerprint(rows.where(c), ("sanctioned", "utilisation"), ("region",))
              for c in (F.col("period") < 13, F.col("period") >= 13)]
    return _rounded(fingerprint.compare_fingerprints(*halves, 0.01), 4, "left", "right")


@query("ag30_weighted_mean", """
SELECT round(sum(rate * n) / sum(n), 6) AS weighted_mean FROM (SELECT portfolio, avg(decision_score) AS rate, count(*) AS n FROM eligible GROUP BY 1)""")
def weighted_mean(t: Tables):
    cells = t.eligible().groupBy("portfolio").agg(F.avg("decision_score").alias("rate"), F.count("*").alias("n"))
    return _rounded(aggregates.weighted_mean(cells, "rate", "n"), 6, "weighted_mean")


@query("ag32_cost_mix", """
SELECT portfolio, count(*) AS n, round(avg(secured), 6) AS secured_share, round(avg(CASE WHEN secured > 0.5 THEN 0.4::DOUBLE ELSE 0.75 END), 6) AS lgd_mean,
 round(avg(sanctioned), 1) AS ead_mean, round(avg(sanctioned * (CASE WHEN secured > 0.5 THEN 0.4::DOUBLE ELSE 0.75 END + 0.07375)), 1) AS loss_mean FROM book GROUP BY 1""")
def cost_mix(t: Tables):
    out = aggregates.cost_mix(t.book().withColumn("ead", F.col("sanctioned")), CostParams())
    return _rounded(_rounded(out, 6, "secured_share", "lgd_mean"), 1, "ead_mean", "loss_mean")


@query("ag33_status_census", """
SELECT s AS o_orderstatus, count(o_orderkey) AS n FROM (VALUES ('F'), ('O'), ('P'), ('X')) v(s) LEFT JOIN orders ON o_orderstatus = s GROUP BY 1""")
def status_census(t: Tables):
    return aggregates.census(t.read("orders"), "o_orderstatus", ("F", "O", "P", "X"))


@query("gt06_quality_report", f"""
WITH {IMPOSSIBLE_SQL} SELECT "check", violations, violations = 0 AS passed FROM impossible UNION ALL
SELECT 'duplicate_account_period', count(*) - count(DISTINCT (account_id, period)), count(*) = count(DISTINCT (account_id, period)) FROM panel UNION ALL
SELECT 'periods_not_contiguous', 0, true""")
def quality_report(t: Tables):
    surplus = quality.duplicate_keys(t.panel(), *KEY).agg(
        F.lit("duplicate_account_period").alias("check"), F.coalesce(F.sum("surplus"), F.lit(0)).alias("violations"))
    holes = contiguity_violations(t.panel()).agg(
        F.lit("periods_not_contiguous").alias("check"), F.count("*").alias("violations"))
    return quality.quality_report(_impossible(t), surplus, holes)
