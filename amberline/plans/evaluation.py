"""Ranking, calibration, drift, bootstrap and fairness queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from amberline.operators import aggregates, bootstrap, calibration, drift, fairness, histogram, ranking, scorecard
from amberline.operators.aggregates import rates_by_band
from amberline.operators.quantiles import edges_scalar, exact_quantiles, right_closed_bin
from amberline.plans.registry import Tables, query
from amberline.plans.scalar import WILSON_HIGH_SQL, WILSON_SQL
from amberline.plans.summaries import BAND_CELLS_SQL, _banded, _rounded

KEYS = ("account_id", "period")
HIST_SQL = "hist AS (SELECT fine_score AS score, count(*) AS n, sum(went_bad) AS bad FROM eligible GROUP BY 1)"


def metrics_sql(source: str, group: str) -> str:
    """AUC, KS and average precision per group from rows (g, score, y)."""
    return f"""h AS (SELECT {group} AS g, score, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS bad FROM {source} GROUP BY 1, 2),
c AS (SELECT *, sum(n) OVER w - n AS nb, sum(bad) OVER w - bad AS bb, sum(n) OVER t AS na, sum(bad) OVER t AS ba FROM h
 WINDOW w AS (PARTITION BY g ORDER BY score), t AS (PARTITION BY g)),
m AS (SELECT g, max(na)::BIGINT AS n, max(ba)::BIGINT AS n_bad,
 sum(bad * (nb - bb + (n - bad) / 2)) / nullif(max(ba) * max(na - ba), 0) AS auc,
 CASE WHEN max(ba) > 0 AND max(na - ba) > 0 THEN greatest(max((ba - bb) / nullif(ba, 0) - (na - nb - ba + bb) / nullif(na - ba, 0)), 0) END AS ks,
 sum(bad * (ba - bb) / (na - nb)) / nullif(max(ba), 0) AS ap FROM c GROUP BY 1)"""


ROWS_SQL = "r AS (SELECT portfolio, period, fine_score AS score, went_bad AS y FROM eligible)"


@query("ev01_auc", f"WITH {ROWS_SQL}, {metrics_sql('r', 'portfolio')} SELECT g AS portfolio, n, n_bad, round(auc, 6) AS auc FROM m")
def auc(t: Tables):
    hist = histogram.score_histogram(t.eligible(), "fine_score", groups=("portfolio",))
    return histogram.rank_metrics(hist, ("portfolio",)).select("portfolio", "n", "n_bad", F.round("auc", 6).alias("auc"))


@query("ev02_ks", f"WITH {ROWS_SQL}, {metrics_sql('r', 'portfolio')} SELECT g AS portfolio, round(ks, 6) AS ks FROM m")
def ks(t: Tables):
    hist = histogram.score_histogram(t.eligible(), "fine_score", groups=("portfolio",))
    return histogram.rank_metrics(hist, ("portfolio",)).select("portfolio", F.round("ks", 6).alias("ks"))


@query("ev03_average_precision", f"WITH {ROWS_SQL}, {metrics_sql('r', 'portfolio')} SELECT g AS portfolio, round(ap, 6) AS average_precision FROM m")
def average_precision(t: Tables):
    hist = histogram.score_histogram(t.eligible(), "fine_score", groups=("portfolio",))
    return histogram.rank_metrics(hist, ("portfolio",)).select("portfolio", F.round("average_precision", 6).alias("average_precision"))


@query("wn26_auc_by_period", f"WITH {ROWS_SQL}, {metrics_sql('r', 'period')} SELECT g AS period, n, n_bad, round(auc, 6) AS auc FROM m")
def auc_by_period(t: Tables):
    hist = histogram.score_histogram(t.eligible(), "fine_score", groups=("period",))
    return histogram.rank_metrics(hist, ("period",)).select("period", "n", "n_bad", F.round("auc", 6).alias("auc"))


TIE = "md5(account_id::VARCHAR || '|' || period::VARCHAR)"


@query("ev04_recall_at_budget", f"""
WITH r AS (SELECT went_bad, row_number() OVER (ORDER BY decision_score DESC, {TIE}) AS rk, count(*) OVER () AS n FROM eligible)
SELECT b AS budget, max(floor(n * b))::BIGINT AS n_reviewed, count(*) FILTER (rk <= floor(n * b) AND went_bad = 1) AS n_caught, sum(went_bad)::BIGINT AS n_bad,
 round(count(*) FILTER (rk <= floor(n * b) AND went_bad = 1) / sum(went_bad), 6) AS recall
FROM r, (SELECT unnest([0.02::DOUBLE, 0.05, 0.1, 0.2]) AS b) GROUP BY 1""")
def recall_at_budget(t: Tables):
    return _rounded(ranking.recall_at_budgets(t.stored(t.eligible(), *KEYS, "decision_score", "went_bad"), (0.02, 0.05, 0.1, 0.2), KEYS), 6, "recall")


@query("ev04b_recall_at_book_budget", f"""
WITH r AS (SELECT went_bad, row_number() OVER (ORDER BY decision_score DESC, {TIE}) AS rk, count(*) OVER () AS n FROM book)
SELECT 0.1::DOUBLE AS budget, max(greatest(round_even(n * 0.1, 0), 1))::BIGINT AS n_reviewed,
 count(*) FILTER (rk <= greatest(round_even(n * 0.1, 0), 1) AND went_bad = 1) AS n_caught, sum(went_bad)::BIGINT AS n_bad,
 round(count(*) FILTER (rk <= greatest(round_even(n * 0.1, 0), 1) AND went_bad = 1) / sum(went_bad), 6) AS recall FROM r""")
def recall_at_book_budget(t: Tables):
    return _rounded(ranking.recall_at_budgets(t.stored(t.book(), *KEYS, "decision_score", "went_bad"), (0.1,), KEYS, book_grain=True), 6, "recall")


@query("ev05_recall_by_lead_bucket", """
WITH q AS (SELECT quantile_cont(fine_score, 0.9) AS cut FROM eligible)
SELECT bucket, count(*) AS n, count(*) FILTER (fine_score >= cut) AS caught, round(count(*) FILTER (fine_score >= cut) / count(*), 6) AS recall
FROM (SELECT CASE WHEN to_npa <= 2 THEN '1-2' ELSE '3-4' END AS bucket, fine_score, cut FROM eligible, q WHERE went_bad = 1) GROUP BY 1""")
def recall_by_lead_bucket(t: Tables):
    return _rounded(ranking.recall_by_lead_bucket(t.eligible(), [(1, 2), (3, 4)], score="fine_score"), 6, "recall")


DECILE_SQL = f"""two AS (SELECT account_id, period, decision_score, went_bad, unnest(['__pooled__', portfolio]) AS portfolio FROM eligible),
rk AS (SELECT portfolio, decision_score, went_bad, row_number() OVER (PARTITION BY portfolio ORDER BY decision_score, {TIE}) AS rk,
 count(*) OVER (PARTITION BY portfolio) AS total FROM two),
dec AS (SELECT portfolio, ((10 * rk + total - 1) // total)::INT AS decile, min(decision_score) AS score_lo, max(decision_score) AS score_hi,
 count(*)::DOUBLE AS n, sum(went_bad)::DOUBLE AS k FROM rk GROUP BY 1, 2),
dr AS (SELECT *, k / n AS rate, {WILSON_SQL} AS ci_lo, {WILSON_HIGH_SQL} AS ci_hi FROM dec)"""


@query("ev06_deciles", f"""
WITH {DECILE_SQL} SELECT portfolio, decile, score_lo, score_hi, k::BIGINT AS k, n::BIGINT AS n, round(rate, 6) AS rate,
 round(ci_lo, 6) AS ci_lo, round(ci_hi, 6) AS ci_hi FROM dr""")
def deciles(t: Tables):
    return _rounded(ranking.deciles(histogram.two_grains(t.stored(t.eligible(), *KEYS, "portfolio", "decision_score", "went_bad")), KEYS, ("portfolio",)), 6, "rate", "ci_lo", "ci_hi")


MONO_SQL = f"""{BAND_CELLS_SQL}, br AS (SELECT portfolio, max(CASE WHEN band = 'green' THEN round(CASE WHEN n > 0 THEN k / n ELSE 0 END, 4) END) AS green,
 max(CASE WHEN band = 'amber' THEN round(CASE WHEN n > 0 THEN k / n ELSE 0 END, 4) END) AS amber,
 max(CASE WHEN band = 'red' THEN round(CASE WHEN n > 0 THEN k / n ELSE 0 END, 4) END) AS red FROM cells GROUP BY 1)"""


@query("ev07_bands_monotone", f"WITH {MONO_SQL} SELECT *, green < amber AND amber < red AS monotone FROM br")
def bands_monotone(t: Tables):
    return ranking.bands_monotone(rates_by_band(_banded(t), F.col("went_bad") == 1))


STEPS_SQL = f"""{DECILE_SQL}, st AS (SELECT portfolio, round(rate, 4) >= lag(round(rate, 4)) OVER w AS up,
 round(ci_hi, 4) >= lag(round(ci_lo, 4)) OVER w AS ci_up FROM dr WINDOW w AS (PARTITION BY portfolio ORDER BY decile)),
steps AS (SELECT portfolio, count(up) AS steps, count(*) FILTER (up) AS steps_ok, count(*) FILTER (up OR ci_up) AS steps_ok_ci,
 count(*) FILTER (up) / count(up) AS fraction_ok FROM st GROUP BY 1)"""


@query("ev08_decile_steps", f"WITH {STEPS_SQL} SELECT portfolio, steps, steps_ok, round(fraction_ok, 6) AS fraction_ok FROM steps")
def decile_steps(t: Tables):
    rows = ranking.deciles(histogram.two_grains(t.stored(t.eligible(), *KEYS, "portfolio", "decision_score", "went_bad")), KEYS, ("portfolio",))
    return _rounded(ranking.decile_steps(rows, ("portfolio",)), 6, "fraction_ok").drop("steps_ok_ci")


@query("ev09_decile_steps_by_interval", f"WITH {STEPS_SQL} SELECT portfolio, steps, steps_ok_ci FROM steps")
def decile_steps_by_interval(t: Tables):
    rows = ranking.deciles(histogram.two_grains(t.stored(t.eligible(), *KEYS, "portfolio", "decision_score", "went_bad")), KEYS, ("portfolio",))
    return ranking.decile_steps(rows, ("portfolio",)).select("portfolio", "steps", "steps_ok_ci")


@query("ev10_rank_order_exhibit", f"""
WITH {STEPS_SQL}, {MONO_SQL} SELECT portfolio, green, amber, red, green < amber AND amber < red AS monotone, steps, steps_ok, steps_ok_ci,
 round(fraction_ok, 6) AS fraction_ok, green < amber AND amber < red AND fraction_ok >= 0.9 AS passed FROM br JOIN steps USING (portfolio)""")
def rank_order_exhibit(t: Tables):
    return _rounded(ranking.rank_order_violations(t.stored(_banded(t), *KEYS, "portfolio", "band", "decision_score", "went_bad"), KEYS), 6, "fraction_ok")


@query("ev11_precision_decomposition", """
WITH o AS (SELECT avg(went_bad) FILTER (decision_score >= 0.272) AS at_old, avg(went_bad) FILTER (decision_score >= 0.4) AS at_new,
 count(*) FILTER (decision_score >= 0.272) AS n_old, count(*) FILTER (decision_score >= 0.4) AS n_new FROM eligible)
SELECT round(at_old, 6) AS at_old, round(at_new, 6) AS at_new, n_old, n_new, round((at_old - 0.845) * 100, 4) AS model_effect_pp,
 round((at_new - at_old) * 100, 4) AS cutoff_effect_pp FROM o""")
def precision_decomposition(t: Tables):
    out = ranking.precision_decomposition(t.eligible(), 0.40, 0.272, 0.845)
    return _rounded(_rounded(out, 6, "at_old", "at_new"), 4, "model_effect_pp", "cutoff_effect_pp")


@query("ev12_ece_equal_width", f"""
WITH {HIST_SQL}, b AS (SELECT least(greatest(ceil(score * 10) - 1, 0), 9) AS bin, sum(n)::DOUBLE AS n, sum(bad) AS bad, sum(n * score) AS s FROM hist GROUP BY 1)
SELECT round(sum(n * abs(s / n - bad / n)) / sum(n), 6) AS ece FROM b""")
def ece_equal_width(t: Tables):
    return _rounded(calibration.ece_equal_width(_hist(t)), 6, "ece")


def _hist(t: Tables):
    return histogram.stored_histogram(t.eligible(), "fine_score")


BINS_SQL = f"""{HIST_SQL}, q AS (SELECT list_sort(list_distinct(quantile_cont(fine_score, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) AS e FROM eligible),
bins AS (SELECT len(list_filter(e[2:-2], lambda x: x <= score)) + 1 AS bin, sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS k, sum(n * score) AS s FROM hist, q GROUP BY 1)"""


@query("ev13_ece_equal_count", f"WITH {BINS_SQL} SELECT round(sum(n * abs(s / n - k / n)) / sum(n), 6) AS ece FROM bins")
def ece_equal_count(t: Tables):
    return _rounded(calibration.ece_equal_count(_hist(t)), 6, "ece")


@query("ev14_brier", """
SELECT portfolio, round(avg((fine_score - went_bad) * (fine_score - went_bad)), 6) AS brier FROM eligible GROUP BY 1""")
def brier(t: Tables):
    hist = histogram.score_histogram(t.eligible(), "fine_score", groups=("portfolio",))
    return _rounded(calibration.brier(hist, ("portfolio",)), 6, "brier")


@query("ev15_reliability_table", f"""
WITH {BINS_SQL} SELECT bin::INT AS bin, n::BIGINT AS n, k::BIGINT AS k, round(s / n, 6) AS predicted, round(k / n, 6) AS rate,
 round({WILSON_SQL}, 6) AS ci_lo, round({WILSON_HIGH_SQL}, 6) AS ci_hi, n >= 30 AS informative FROM bins""")
def reliability_table(t: Tables):
    return _rounded(calibration.reliability_table(_hist(t)), 6, "predicted", "rate", "ci_lo", "ci_hi")


CALIBRATED_SQL = """round(CASE WHEN fine_score <= 0.1 THEN 0.0 WHEN fine_score >= 0.6 THEN 0.5
 WHEN fine_score <= 0.3 THEN 0.02 * (fine_score - 0.1) / 0.2 ELSE 0.02 + 0.48 * (fine_score - 0.3) / 0.3 END, 6)"""


@query("ev16_served_calibration", f"""
WITH x AS (SELECT went_bad AS y, unnest(['fine_score', 'calibrated']) AS score, unnest([fine_score, {CALIBRATED_SQL}]) AS v FROM eligible),
e AS (SELECT score, list_sort(list_distinct(quantile_cont(v, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) AS e FROM x GROUP BY 1),
b AS (SELECT score, len(list_filter(e[2:-2], lambda q: q <= v)) AS bin, count(*)::DOUBLE AS n, sum(y) AS k, sum(v) AS s FROM x JOIN e USING (score) GROUP BY 1, 2),
g AS (SELECT score, sum(n * abs(s / n - k / n)) / sum(n) AS ece FROM b GROUP BY 1)
SELECT score, round(avg((v - y) * (v - y)), 6) AS brier, round(max(ece), 6) AS ece FROM x JOIN g USING (score) GROUP BY 1""")
def served_calibration(t: Tables):
    rows = t.eligible().withColumn("calibrated", F.round(calibration.apply_map(
        F.col("fine_score"), F.array(F.lit(0.1), F.lit(0.3), F.lit(0.6)), F.array(F.lit(0.0), F.lit(0.02), F.lit(0.5))), 6))
    return _rounded(calibration.served_calibration(rows, "fine_score", "calibrated"), 6, "brier", "ece")


@query("ev17_high_risk_cell", f"""
WITH x AS (SELECT 'pooled' AS scope, went_bad AS bad, decision_score FROM eligible WHERE decision_score >= 0.4 UNION ALL
 SELECT 'snapshot', CASE WHEN to_npa BETWEEN 1 AND 8 THEN 1 ELSE 0 END, decision_score FROM eligible WHERE decision_score >= 0.4 AND period = 16),
c AS (SELECT scope, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS k, avg(decision_score) AS p FROM (VALUES ('pooled'), ('snapshot')) s(scope) LEFT JOIN x USING (scope) GROUP BY 1)
SELECT scope, n::BIGINT AS n, k::BIGINT AS k, round(p, 6) AS predicted, CASE WHEN n > 0 THEN round(k / n, 6) ELSE 0 END AS rate,
 CASE WHEN n > 0 THEN round({WILSON_SQL}, 6) ELSE 0 END AS ci_lo, CASE WHEN n > 0 THEN round({WILSON_HIGH_SQL}, 6) ELSE 0 END AS ci_hi, n >= 30 AS informative FROM c""")
def high_risk_cell(t: Tables):
    return _rounded(calibration.high_risk_cell(_banded(t), reference=16), 6, "predicted", "rate", "ci_lo", "ci_hi")


@query("ev18_cox_calibration")
def cox_calibration(t: Tables):
    return calibration.cox_calibration(t.eligible(), "fine_score")



def windows():
    """Expected rows: periods 0-7; compared rows: periods 15-22."""
    return F.when(F.col("period") < 8, F.lit(True)).when(F.col("period") >= 15, F.lit(False))


def _csi_sql(name: str, feature: str, expected: str = "period < 8", actual: str = "period >= 15") -> str:
    return f"""{name}_e AS (SELECT list_sort(list_distinct(quantile_cont({feature}, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) AS e FROM eligible WHERE {expected}),
{name}_b AS (SELECT len(list_filter(e[2:-2], lambda q: q <= {feature})) AS bin, count(*) FILTER ({expected})::DOUBLE AS e, count(*) FILTER ({actual})::DOUBLE AS a
 FROM eligible, {name}_e WHERE {feature} IS NOT NULL AND (({expected}) OR ({actual})) GROUP BY 1),
{name}_s AS (SELECT greatest(e / sum(e) OVER (), 1e-6) AS e, greatest(a / sum(a) OVER (), 1e-6) AS a FROM {name}_b),
{name} AS (SELECT CASE WHEN (SELECT len(e) FROM {name}_e) < 3 THEN 0 ELSE sum((a - e) * ln(a / e)) END AS csi FROM {name}_s)"""


def _cat_csi_sql(name: str, feature: str) -> str:
    return f"""{name}_b AS (SELECT {feature} AS lv, count(*) FILTER (period < 8)::DOUBLE AS e, count(*) FILTER (period >= 15)::DOUBLE AS a FROM eligible
 WHERE period < 8 OR period >= 15 GROUP BY 1), {name}_s AS (SELECT greatest(e / sum(e) OVER (), 1e-6) AS e, greatest(a / sum(a) OVER (), 1e-6) AS a FROM {name}_b),
{name} AS (SELECT sum((a - e) * ln(a / e)) AS csi FROM {name}_s)"""


@query("ev19_psi", f"WITH {_csi_sql('f', 'fine_score')} SELECT 'fine_score' AS feature, round(csi, 6) AS psi FROM f")
def psi(t: Tables):
    return _rounded(drift.psi(t.eligible(), windows(), "fine_score"), 6, "psi")


@query("ev20_csi_categorical", f"""
WITH {_cat_csi_sql('f1', "(vintage_months // 12)::VARCHAR")}, {_cat_csi_sql('f2', 'region')}
SELECT 'age_year' AS feature, round(csi, 6) AS csi FROM f1 UNION ALL SELECT 'region', round(csi, 6) FROM f2""")
def csi_categorical(t: Tables):
    rows = t.eligible().withColumn("age_year", F.floor(F.col("vintage_months") / 12))
    return _rounded(drift.categorical_csi(rows, windows(), ("age_year", "region")), 6, "csi")


@query("ev21_feature_csi_table", f"""
WITH {_csi_sql('f1', 'utilisation')}, {_csi_sql('f2', 'dpd')}, {_csi_sql('f3', 'bureau_score')}, {_csi_sql('f4', 'vintage_months')}, {_cat_csi_sql('f5', 'region')},
u AS (SELECT 'utilisation' AS feature, csi FROM f1 UNION ALL SELECT 'dpd', csi FROM f2 UNION ALL SELECT 'bureau_score', csi FROM f3
 UNION ALL SELECT 'vintage_months', csi FROM f4 UNION ALL SELECT 'region', csi FROM f5)
SELECT feature, round(csi, 6) AS csi, csi = (SELECT max(csi) FROM u) AS binding FROM u""")
def feature_csi_table(t: Tables):
    out = drift.feature_csi_table(t.stored(t.eligible(), "period", "utilisation", "dpd", "bureau_score", "vintage_months", "region"), windows(), ("utilisation", "dpd", "bureau_score", "vintage_months"), ("region",))
    return _rounded(out, 6, "csi")


HALF = "('0x' || substr(md5(account_id::VARCHAR || 'half'), 1, 8))::BIGINT % 2"


@query("ev22_random_split_control", f"""
WITH {_csi_sql('f1', 'utilisation', f'{HALF} = 0', f'{HALF} = 1')}, {_csi_sql('f2', 'vintage_months', f'{HALF} = 0', f'{HALF} = 1')}
SELECT 'utilisation' AS feature, round(csi, 6) AS csi FROM f1 UNION ALL SELECT 'vintage_months', round(csi, 6) FROM f2""")
def random_split_control(t: Tables):
    return _rounded(drift.numeric_csi(t.eligible(), drift.random_halves(t.eligible()), ("utilisation", "vintage_months")), 6, "csi")


REPLICATES = 200  # fixed value: draws of an interval
DRAW_SQL = f"""dr AS (SELECT account_id, b, ('0x' || substr(md5(account_id::VARCHAR || '|' || ((b - 1) // 8)::VARCHAR), ((b - 1) % 8) * 4 + 1, 4))::INT AS u
 FROM (SELECT DISTINCT account_id FROM eligible), (SELECT range AS b FROM range(1, {REPLICATES + 1}))),
wt AS (SELECT account_id, b, CASE WHEN u < 24109 THEN 0 WHEN u < 48218 THEN 1 WHEN u < 60273 THEN 2 WHEN u < 64291 THEN 3 WHEN u < 65296 THEN 4
 WHEN u < 65497 THEN 5 WHEN u < 65530 THEN 6 WHEN u < 65535 THEN 7 ELSE 8 END AS w FROM dr)"""


def _replicate_sql(prefix: str, score: str, where: str = "true") -> str:
    return f"""{prefix}h AS (SELECT b AS g, {score} AS score, sum(w)::DOUBLE AS n, sum(w * went_bad)::DOUBLE AS bad FROM eligible JOIN wt USING (account_id)
 WHERE w > 0 AND {where} GROUP BY 1, 2),
{prefix}c AS (SELECT *, sum(n) OVER w - n AS nb, sum(bad) OVER w - bad AS bb, sum(n) OVER t AS na, sum(bad) OVER t AS ba FROM {prefix}h
 WINDOW w AS (PARTITION BY g ORDER BY score), t AS (PARTITION BY g)),
{prefix}m AS (SELECT g, sum(bad * (nb - bb + (n - bad) / 2)) / nullif(max(ba) * max(na - ba), 0) AS auc,
 sum(n * score * score - 2 * score * bad + bad) / sum(n) AS brier FROM {prefix}c GROUP BY 1)"""


@query("ev23_cluster_bootstrap", f"""
WITH {DRAW_SQL}, {_replicate_sql('a', 'fine_score')} SELECT round(quantile_cont(auc, 0.025), 6) AS lo, round(quantile_cont(auc, 0.975), 6) AS hi, count(*) AS replicates FROM am""")
def cluster_bootstrap(t: Tables):
    return _rounded(bootstrap.auc_interval(t.eligible(), "fine_score", REPLICATES), 6, "lo", "hi")


@query("ev24_paired_delta", f"""
WITH {DRAW_SQL}, {_replicate_sql('a', 'fine_score')}, {_replicate_sql('b', 'decision_score')},
d AS (SELECT unnest(['auc', 'brier']) AS metric, unnest([bm.auc - am.auc, bm.brier - am.brier]) AS delta FROM am JOIN bm USING (g))
SELECT metric, round(quantile_cont(delta, 0.025), 6) + 0 AS lo, round(quantile_cont(delta, 0.975), 6) + 0 AS hi, count(*) AS replicates FROM d GROUP BY 1""")
def paired_delta(t: Tables):
    return _rounded(bootstrap.paired_delta_interval(t.eligible(), "fine_score", "decision_score", REPLICATES), 6, "lo", "hi")


def _split_time(t: Tables):
    return t.eligible().withColumn("part", F.when(F.col("period") >= 15, "late").otherwise("early"))


@query("ev24b_ratio_interval", f"""
WITH {DRAW_SQL}, {_replicate_sql('a', 'fine_score', 'period >= 15')}, {_replicate_sql('b', 'fine_score', 'period < 15')}, q AS (SELECT am.auc / bm.auc AS ratio FROM am JOIN bm USING (g))
SELECT round(quantile_cont(ratio, 0.025), 6) AS lo, round(quantile_cont(ratio, 0.975), 6) AS hi, count(ratio) AS replicates FROM q""")
def ratio_interval(t: Tables):
    return _rounded(bootstrap.ratio_interval(_split_time(t), "fine_score", "part", "late", "early", REPLICATES), 6, "lo", "hi")


@query("ev25_spread_over_runs", f"""
WITH r AS (SELECT period, account_id % 5 AS run, fine_score AS score, went_bad AS y FROM eligible), {metrics_sql('r', 'run')}
SELECT round(quantile_cont(auc, 0.025), 6) AS lo, round(quantile_cont(auc, 0.975), 6) AS hi, count(*) AS runs,
 round(quantile_cont(auc, 0.975) - quantile_cont(auc, 0.025), 6) AS width FROM m""")
def spread_over_runs(t: Tables):
    hist = histogram.score_histogram(t.eligible().withColumn("run", F.col("account_id") % 5), "fine_score", groups=("run",))
    return _rounded(bootstrap.spread_over_runs(histogram.rank_metrics(hist, ("run",)), "auc"), 6, "lo", "hi", "width")


@query("ev26_decile_stability", f"""
WITH {DRAW_SQL}, {_replicate_sql('a', 'fine_score')}, x AS (SELECT g, i, bad, n, greatest(least(nb + n, floor((i + 1) * na / 10)) - greatest(nb, floor(i * na / 10)), 0) AS o
 FROM ac, (SELECT range AS i FROM range(10))),
d AS (SELECT g, i, sum(o) AS n, sum(bad * o / n) AS k FROM x WHERE o > 0 GROUP BY 1, 2),
e AS (SELECT g, i, round(k / n, 4) AS rate, round({WILSON_SQL}, 4) AS lo, round({WILSON_HIGH_SQL}, 4) AS hi FROM d),
s AS (SELECT g, rate >= lag(rate) OVER w AS up, hi >= lag(lo) OVER w AS meets FROM e WINDOW w AS (PARTITION BY g ORDER BY i) QUALIFY lag(rate) OVER w IS NOT NULL),
p AS (SELECT g, avg(up::INT) AS strict, avg((up OR meets)::INT) AS interval_aware FROM s GROUP BY 1),
u AS (SELECT unnest(['strict', 'interval']) AS reading, unnest([strict, interval_aware]) AS held FROM p)
SELECT reading, count(*) AS replicates, round(avg(held), 6) AS mean, round(quantile_cont(held, 0.05), 6) AS p05, round(quantile_cont(held, 0.95), 6) AS p95,
 round(min(held), 6) AS lowest, round(max(held), 6) AS highest, round(avg((held >= 0.9)::INT), 6) AS share_passing FROM u GROUP BY 1""")
def decile_stability(t: Tables):
    out = bootstrap.decile_stability(t.eligible(), "fine_score", REPLICATES)
    return _rounded(out, 6, "mean", "p05", "p95", "lowest", "highest", "share_passing")


CUTS_SQL = f"""ed AS (SELECT quantile_cont(sanctioned, [0.2, 0.4, 0.6, 0.8]) AS q FROM eligible),
cutrow AS (SELECT account_id, went_bad, fine_score, unnest(['portfolio', 'constitution', 'segment', 'secured', 'ticket', 'vintage', 'sector', 'geography', 'calendar']) AS cut,
 unnest([portfolio, constitution, CASE WHEN sanctioned <= 1000000 THEN '0' WHEN sanctioned <= 10000000 THEN '1' ELSE '2' END, secured::VARCHAR,
  CASE WHEN sanctioned <= q[1] THEN '0' WHEN sanctioned <= q[2] THEN '1' WHEN sanctioned <= q[3] THEN '2' WHEN sanctioned <= q[4] THEN '3' ELSE '4' END,
  CASE WHEN vintage_months < 12 THEN '0' WHEN vintage_months < 18 THEN '1' WHEN vintage_months < 30 THEN '2' WHEN vintage_months < 48 THEN '3' ELSE '4' END,
  state, region, period::VARCHAR]) AS level FROM eligible, ed)"""


def cuts(edges):
    """The nine cuts; bands are numbered so that their levels sort as numbers."""
    band = lambda column, edges: sum((column >= e).cast("int") for e in edges)
    return {
        "portfolio": F.col("portfolio"), "constitution": F.col("constitution"), "segment": (F.col("sanctioned") > 1_000_000).cast("int") + (F.col("sanctioned") > 10_000_000).cast("int"),
        "secured": F.col("secured"), "ticket": right_closed_bin(F.col("sanctioned"), edges), "vintage": band(F.col("vintage_months"), (12, 18, 30, 48)),
        "sector": F.col("state"), "geography": F.col("region"), "calendar": F.col("period")}


@query("ag11_metric_by_cut", f"""
WITH {DRAW_SQL}, {CUTS_SQL},
rh AS (SELECT cut, level, fine_score AS score, count(*)::DOUBLE AS n, sum(went_bad)::DOUBLE AS bad FROM cutrow GROUP BY 1, 2, 3),
rc AS (SELECT *, sum(n) OVER w - n AS nb, sum(bad) OVER w - bad AS bb, sum(n) OVER t AS na, sum(bad) OVER t AS ba FROM rh
 WINDOW w AS (PARTITION BY cut, level ORDER BY score), t AS (PARTITION BY cut, level)),
rm AS (SELECT cut, level, max(na)::BIGINT AS n, max(ba)::BIGINT AS n_bad, sum(bad * (nb - bb + (n - bad) / 2)) / nullif(max(ba) * max(na - ba), 0) AS auc FROM rc GROUP BY 1, 2),
bh AS (SELECT b, cut, level, fine_score AS score, sum(w)::DOUBLE AS n, sum(w * went_bad)::DOUBLE AS bad FROM cutrow JOIN wt USING (account_id) WHERE w > 0 GROUP BY 1, 2, 3, 4),
bc AS (SELECT *, sum(n) OVER w - n AS nb, sum(bad) OVER w - bad AS bb, sum(n) OVER t AS na, sum(bad) OVER t AS ba FROM bh
 WINDOW w AS (PARTITION BY b, cut, level ORDER BY score), t AS (PARTITION BY b, cut, level)),
bm AS (SELECT b, cut, level, sum(bad * (nb - bb + (n - bad) / 2)) / nullif(max(ba) * max(na - ba), 0) AS auc FROM bc GROUP BY 1, 2, 3),
bi AS (SELECT cut, level, quantile_cont(auc, 0.025) AS lo, quantile_cont(auc, 0.975) AS hi, count(auc) AS replicates FROM bm GROUP BY 1, 2)
SELECT cut, level, n, n_bad, round(auc, 6) AS auc, CASE WHEN replicates > 0 THEN round(lo, 6) END AS lo, CASE WHEN replicates > 0 THEN round(hi, 6) END AS hi, coalesce(replicates, 0) AS replicates,
 row_number() OVER (PARTITION BY cut ORDER BY CASE WHEN cut IN ('segment', 'secured', 'ticket', 'vintage', 'calendar') THEN level::DOUBLE END, level)::INT AS level_rank
FROM rm LEFT JOIN bi USING (cut, level)""")
def metric_by_cut(t: Tables):
    stored = t.stored(t.eligible(), "account_id", "period", "portfolio", "constitution", "sanctioned", "secured", "vintage_months", "state", "region", "fine_score", "went_bad")
    edges = edges_scalar(exact_quantiles(stored, "sanctioned", (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)))
    rows, by = stored.withColumn("edges", edges), cuts(F.col("edges"))
    long = aggregates.stack_levels(rows, by, "account_id", "fine_score", "went_bad")
    cells = histogram.rank_metrics(histogram.score_histogram(long, "fine_score", groups=("cut", "level")), ("cut", "level")).select(
        "cut", "level", "n", "n_bad", "auc")
    spans = bootstrap.cut_auc_intervals(rows, "fine_score", REPLICATES, by)
    out = cells.join(spans, ["cut", "level"], "left").withColumn("replicates", F.coalesce("replicates", F.lit(0).cast("long")))
    return _rounded(aggregates.level_order(out), 6, "auc", "lo", "hi")


def attributes():
    return {"region": F.col("region"), "constitution": F.col("constitution"), "state": F.col("state")}


GROUPS_SQL = f"""ga AS (SELECT went_bad, CASE WHEN decision_score >= 0.28 THEN 1 ELSE 0 END AS f, unnest(['region', 'constitution', 'state']) AS cut,
 unnest([region, constitution, state]) AS level FROM eligible),
gt AS (SELECT cut, level, count(*)::DOUBLE AS n, sum(f)::DOUBLE AS k, sum(went_bad)::DOUBLE AS n_pos, sum(f * went_bad)::DOUBLE AS k_pos FROM ga GROUP BY 1, 2),
gr AS (SELECT *, k / n AS flag_rate, CASE WHEN n_pos > 0 THEN k_pos / n_pos END AS tpr_rate, n >= 1200 AS compared FROM gt)"""


def _groups(t: Tables):
    return fairness.group_table(t.eligible(), F.col("decision_score") >= 0.28, attributes(), min_n=1200)


@query("ev27_adverse_impact_ratio", f"""
WITH {GROUPS_SQL} SELECT cut, round(CASE WHEN count(*) >= 2 THEN min(flag_rate) / max(flag_rate) END, 6) AS ratio, sum(n)::BIGINT AS n FROM gr WHERE compared GROUP BY 1""")
def adverse_impact_ratio(t: Tables):
    return _rounded(fairness.adverse_impact_ratio(_groups(t)), 6, "ratio")


@query("ev27b_group_table", f"""
WITH {GROUPS_SQL}, a AS (SELECT *, {WILSON_SQL} AS flo, {WILSON_HIGH_SQL} AS fhi FROM gr),
b AS (SELECT cut, level, {WILSON_SQL} AS tlo, {WILSON_HIGH_SQL} AS thi FROM (SELECT cut, level, k_pos AS k, n_pos AS n FROM gr WHERE n_pos > 0))
SELECT cut, level, n::BIGINT AS n, k::BIGINT AS k, n_pos::BIGINT AS n_pos, k_pos::BIGINT AS k_pos, round(flag_rate, 6) AS flag_rate, round(flo, 6) AS flag_ci_lo,
 round(fhi, 6) AS flag_ci_hi, round(tpr_rate, 6) AS tpr_rate, round(coalesce(tlo, 0), 6) AS tpr_ci_lo, round(coalesce(thi, 0), 6) AS tpr_ci_hi, compared FROM a LEFT JOIN b USING (cut, level)""")
def group_table(t: Tables):
    return _rounded(_groups(t), 6, "flag_rate", "flag_ci_lo", "flag_ci_hi", "tpr_rate", "tpr_ci_lo", "tpr_ci_hi")


@query("ev28_tpr_gap", f"""
WITH {GROUPS_SQL} SELECT cut, round(CASE WHEN count(*) >= 2 THEN max(tpr_rate) - min(tpr_rate) END, 6) AS gap, sum(n_pos)::BIGINT AS n FROM gr
WHERE compared AND tpr_rate IS NOT NULL GROUP BY 1""")
def tpr_gap(t: Tables):
    return _rounded(fairness.tpr_gap(_groups(t)), 6, "gap")


@query("ev29_oot_ratio", f"""
WITH r AS (SELECT CASE WHEN period >= 15 THEN 'late' ELSE 'early' END AS part, fine_score AS score, went_bad AS y FROM eligible), {metrics_sql('r', 'part')}
SELECT round(max(auc) FILTER (g = 'late') / max(auc) FILTER (g = 'early'), 6) AS ratio FROM m""")
def oot_ratio(t: Tables):
    m = histogram.rank_metrics(histogram.score_histogram(_split_time(t), "fine_score", groups=("part",)), ("part",))
    late, early = (F.max(F.when(F.col("part") == p, F.col("auc"))) for p in ("late", "early"))
    return m.agg(F.round(late / early, 6).alias("ratio"))


@query("ev30_regime_delta", f"""
WITH r AS (SELECT portfolio, fine_score AS score, went_bad AS y FROM eligible), {metrics_sql('r', 'portfolio')},
ctl AS (SELECT min(auc) AS lo, max(auc) AS hi FROM m WHERE g IN ('BUILDING', 'FURNITURE', 'HOUSEHOLD'))
SELECT g AS regime, round(auc - (lo + hi) / 2, 6) AS delta, auc < lo OR auc > hi AS outside FROM m, ctl WHERE g NOT IN ('BUILDING', 'FURNITURE', 'HOUSEHOLD')""")
def regime_delta(t: Tables):
    m = histogram.rank_metrics(histogram.score_histogram(t.eligible(), "fine_score", groups=("portfolio",)), ("portfolio",))
    return _rounded(scorecard.regime_delta(m.withColumnRenamed("portfolio", "regime"), "auc", ("BUILDING", "FURNITURE", "HOUSEHOLD")), 6, "delta")


SCORECARD_COST = """sum(CASE WHEN band = 'green' THEN went_bad * loss WHEN band = 'amber' THEN 1500 + (1 - went_bad) * 0.02 * 0.1275 * sanctioned + went_bad * loss * 0.9
 ELSE 18000 + (1 - went_bad) * 0.15 * 0.1275 * sanctioned + went_bad * loss * 0.65 END) / count(*)"""


@query("ev31_snapshot_scorecard", f"""
WITH b AS (SELECT *, sanctioned * (CASE WHEN secured > 0.5 THEN 0.4::DOUBLE ELSE 0.75 END + 0.07375) AS loss FROM book),
r AS (SELECT 1 AS one, decision_score AS score, went_bad AS y FROM book), {metrics_sql('r', 'one')},
s AS (SELECT count(*) AS n, count(*) FILTER (went_bad = 1 AND band = 'red') / count(*) FILTER (band = 'red') AS p, count(*) FILTER (went_bad = 1 AND band = 'green') / sum(went_bad) AS miss,
 count(*) FILTER (band <> 'green') / count(*) AS fl, avg((decision_score - went_bad) * (decision_score - went_bad)) AS br, {SCORECARD_COST} AS c FROM b)
SELECT s.n, round(auc, 6) AS auc, round(br, 6) AS brier, round(p, 6) AS red_precision, round(miss, 6) AS missed_share, round(fl, 6) AS flagged_share, round(c, 1) AS cost_per_account FROM s, m""")
def snapshot_scorecard(t: Tables):
    out = scorecard.snapshot_scorecard(t.book().withColumn("ead", F.col("sanctioned")), 0.28, 0.40)
    digits = {"cost_per_account": 1, "n": 0}
    return out.select(*[F.round(c, digits.get(c, 6)).alias(c) if c != "n" else F.col(c) for c in out.columns])
