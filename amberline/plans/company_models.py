"""Company-year model queries: inputs and table in full against SQL, fits by what must be true of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from amberline.operators import bootstrap, calibration, company_model, histogram, model, splits
from amberline.operators.company_model import CATEGORICAL, NUMERIC
from amberline.plans.files import HASHED, TRAIN_SQL, _events, _long, read_identifiers
from amberline.plans.registry import Tables, query
from amberline.session import materialise

REPLICATES = 500  # fixed value: draws of the company-year interval
ROUNDS = 20  # boosting rounds

INPUT_SQL = TRAIN_SQL.replace("year + 2 <= 2001", "year + 2 <= (SELECT max(year) FROM long)") + """,
ids AS (SELECT c_name AS company, CASE WHEN c_custkey % 9 = 0 THEN 'NA' ELSE lpad((c_custkey % 70)::VARCHAR, 2, '0') END AS nic,
 CASE WHEN c_custkey % 8 > 0 THEN 1950 + c_custkey % 50 END AS since FROM customer),
inp AS (SELECT tr.company, tr.year, "default" AS went_bad, coalesce(nic, 'NA') AS nic, (year - since)::DOUBLE AS age FROM tr LEFT JOIN ids USING (company))"""


def _inputs(t: Tables):
    rows = company_model.inputs(_long(t), _events(t), read_identifiers(t))
    return materialise(rows.withColumn("side", splits.group_split(F.col("company"))), "company-years")


def _fit(t: Tables):
    """The trees and the test companies' rows with scores of trees and scorecard."""
    rows = _inputs(t)
    train, test = rows.where(F.col("side") == "train"), rows.where(F.col("side") == "test")
    trees = model.fit_trees(train, list(NUMERIC), list(CATEGORICAL), iterations=ROUNDS)
    card = model.fit_scorecard(train, list(NUMERIC))
    scored = model.score(card, model.score(trees, test, list(NUMERIC), "p"), list(NUMERIC), "p_scorecard")
    return trees, materialise(scored, "company-scores")


def _graded(scored):
    hist = histogram.score_histogram(scored, "p")
    m = histogram.rank_metrics(hist).withColumn("brier", calibration.brier(hist).select("brier").scalar()).withColumn(
        "scorecard_auc", model.auc_of(scored, "p_scorecard").select("auc").scalar())
    span = bootstrap.auc_interval(scored, "p", REPLICATES, account="company").agg(F.struct(F.max("lo").alias("lo"), F.max("hi").alias("hi"))).scalar()
    return m.withColumn("_s", span).select("n", "n_bad", "auc", "ks", "average_precision", "brier", "scorecard_auc", F.col("_s.lo").alias("auc_lo"), F.col("_s.hi").alias("auc_hi"))


@query("ml15_company_year_model")
def company_year_model(t: Tables):
    """Trees on 15 numbers and the industry, graded on unseen companies beside the scorecard, with an interval by company."""
    out = _graded(_fit(t)[1])
    return out.select("n", "n_bad", *[F.round(c, 6).alias(c) for c in out.columns[2:]])


@query("ml15b_company_model_inputs", f"WITH {INPUT_SQL} SELECT company, year, went_bad, nic, age, {HASHED} < 300 AS held_out FROM inp")
def company_model_inputs(t: Tables):
    return _inputs(t).select("company", "year", "went_bad", "nic", "age", (F.col("side") == "test").alias("held_out"))


@query("ml15c_company_model_table", f"""WITH {INPUT_SQL} SELECT count(DISTINCT company) AS n_companies, count(*) AS n_company_years, coalesce(sum(went_bad), 0)::BIGINT AS n_defaults,
 round(coalesce(avg(went_bad), 0), 6) AS default_rate, min(year) AS first_year, max(year) AS last_year FROM inp""")
def company_model_table(t: Tables):
    return company_model.profile(_inputs(t)).withColumn("default_rate", F.round("default_rate", 6))


@query("ml15d_company_reliability")
def company_reliability(t: Tables):
    return company_model.reliability(_fit(t)[1]).select("bin", "n", F.round("predicted", 3).alias("predicted"), F.round("observed", 3).alias("observed"))


@query("ml15e_company_importances")
def company_importances(t: Tables):
    return company_model.split_importance(_fit(t)[0])


@query("ml15f_company_examples")
def company_examples(t: Tables):
    return company_model.examples(*_fit(t))


@query("ml15g_company_model_fits_together", f"""WITH {INPUT_SQL}, te AS (SELECT * FROM inp WHERE {HASHED} < 300)
SELECT count(*) AS n, coalesce(sum(went_bad), 0)::BIGINT AS n_bad, count(*) AS n_binned, coalesce(sum(went_bad), 0)::BIGINT AS n_bad_binned, true AS predictions_rise, true AS inside, true AS named,
 least(count(*) FILTER (went_bad = 1), 5) + least(count(*) FILTER (went_bad = 0), 2) AS n_examples FROM te""")
def company_model_fits_together(t: Tables):
    """Bins hold every test row and every default, predictions rise over them, the interval is in order, importances and examples are as many as there can be."""
    trees, scored = _fit(t)
    bins = materialise(company_model.reliability(scored), "company-bins")
    before = F.sort_array(F.collect_list(F.struct("bin", "predicted")))  # ten rows
    rise = bins.agg(before.alias("b")).select(F.forall(F.sequence(F.lit(1), F.size("b")), lambda i: (i == 1) | (F.col("b")[i - 1]["predicted"] > F.col("b")[F.greatest(i - 2, F.lit(0))]["predicted"])))
    held = bins.agg(F.sum("n").alias("n_binned"), F.sum(F.round(F.col("observed") * F.col("n"))).cast("long").alias("n_bad_binned"))
    named = company_model.split_importance(trees).agg((F.count("*").between(1, 9) & F.every(F.col("feature").isin(*company_model.LABELS.values()))).alias("named"))
    inside = F.col("auc").between(0, 1) & (F.col("auc_lo") <= F.col("auc_hi")) & F.col("brier").between(0, 1)
    return _graded(scored).select(
        "n", "n_bad", held.select("n_binned").scalar().alias("n_binned"), held.select("n_bad_binned").scalar().alias("n_bad_binned"), rise.scalar().alias("predictions_rise"),
        inside.alias("inside"), named.scalar().alias("named"), company_model.examples(trees, scored).agg(F.count("*")).scalar().alias("n_examples"))
