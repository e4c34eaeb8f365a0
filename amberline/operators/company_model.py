"""The company-year default model: its inputs, what it was fitted to, how far it can be trusted, and examples."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from amberline.functions import reasons
from amberline.operators import company, model
from amberline.operators.quantiles import edges_scalar, exact_quantiles, right_closed_bin

RATIOS = ("interest_cover", "debt_to_equity", "pat_margin", "pbdita_margin", "pbt_margin", "borrow_to_income", "borrow_to_networth",
          "neg_networth", "loss_flag", "log_income", "d_networth", "d_income", "d_pat", "d_borrow")
NUMERIC = (*RATIOS, "age")
CATEGORICAL = ("nic",)
NO_INDUSTRY = "NA"

# fixed values: readable names of the inputs
LABELS = {
    "interest_cover": "Interest cover", "debt_to_equity": "Leverage (D/E)", "pat_margin": "Profit margin", "pbdita_margin": "Operating margin",
    "pbt_margin": "Pre-tax margin", "borrow_to_income": "Borrowings ÷ income", "borrow_to_networth": "Borrowings ÷ net worth",
    "neg_networth": "Negative net worth", "loss_flag": "Loss-making", "log_income": "Company size (income)", "d_networth": "Net-worth trend",
    "d_income": "Income trend", "d_pat": "Profit trend", "d_borrow": "Borrowings trend", "age": "Company age", "nic": "Industry"}


def with_profile(years: DataFrame, identifiers: DataFrame) -> DataFrame:
    """Add the industry (``NA`` where unknown) and the age in the year; a company listed twice counts by its earliest year."""
    own = identifiers.groupBy("company").agg(F.min(F.struct("incorporated", "nic")).alias("_id"), F.min("incorporated").alias("_since"), F.max("nic").alias("_any"))
    joined = years.join(own, "company", "left")
    return joined.withColumns({"nic": F.coalesce("_id.nic", "_any", F.lit(NO_INDUSTRY)), "age": (F.col("year") - F.col("_since")).cast("double")}).drop("_id", "_since", "_any")


def inputs(long: DataFrame, events: DataFrame, identifiers: DataFrame, horizon: int = 2) -> DataFrame:
    """(company, year, went_bad, 15 numbers, industry): company-years before a default, labelled over the horizon.

    The last observable year is the last one of the financials.
    """
    years = company.company_years(long)
    last = years.select(F.max("year")).scalar()
    rows = company.training_rows(company.financial_ratios(years), company.first_default_year(events), last, horizon)
    rows = with_profile(rows.withColumnRenamed("default", "went_bad"), identifiers)
    return rows.select("company", "year", "went_bad", *[F.col(c).cast("double").alias(c) for c in NUMERIC], *CATEGORICAL)


def profile(rows: DataFrame) -> DataFrame:
    """Companies, company-years, defaults and years of the modelling table, one row."""
    return rows.agg(
        F.count_distinct("company").alias("n_companies"), F.count("*").alias("n_company_years"), F.coalesce(F.sum("went_bad"), F.lit(0)).alias("n_defaults"),
        F.coalesce(F.avg("went_bad"), F.lit(0.0)).alias("default_rate"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))


def reliability(scored: DataFrame, bins: int = 10, score: str = "p") -> DataFrame:
    """Mean prediction against observed rate in right-closed bins of equal count; equal edges are merged."""
    edges = edges_scalar(exact_quantiles(scored, score, tuple(i / bins for i in range(bins + 1))))
    binned = scored.where(F.col(score).isNotNull()).withColumn("_edges", edges).withColumn("bin", right_closed_bin(F.col(score), F.col("_edges")))
    return binned.groupBy("bin").agg(F.count("*").alias("n"), F.avg(score).alias("predicted"), F.avg("went_bad").alias("observed"))


def split_importance(fitted: PipelineModel, numeric: tuple[str, ...] = NUMERIC, categorical: tuple[str, ...] = CATEGORICAL,
                     labels: dict[str, str] = LABELS, k: int = 9) -> DataFrame:
    """The ``k`` inputs that trees ask most often, by readable name; asking whether one is missing counts for it."""
    names = [*numeric, *numeric, *categorical]  # as assembled: filled, missing flags, levels
    named = F.create_map(*[F.lit(x) for i, c in enumerate(names) for x in (i, labels.get(c, c))])
    asked = model.tree_nodes(fitted).where(F.col("feature").isNotNull())
    counts = asked.groupBy(F.element_at(named, F.col("feature")).alias("feature")).agg(F.count("*").alias("importance"))
    return counts.orderBy(F.desc("importance"), "feature").limit(k)


def _shown(value: Column, scale: float = 1.0) -> Column:
    return F.round(value * scale, 1)


def examples(fitted: PipelineModel, scored: DataFrame, failed: int = 5, sound: int = 2, score: str = "p") -> DataFrame:
    """The most alarming companies that did default and the safest that did not, without their names, with reasons.

    A report of ``failed + sound`` rows; ties go by company and year.
    """
    worst = scored.where("went_bad = 1").orderBy(F.desc(score), "company", "year").limit(failed)
    safest = scored.where("went_bad = 0").orderBy(score, "company", "year").limit(sound)
    explained = model.tree_contributions(fitted, worst.unionByName(safest), list(NUMERIC), list(CATEGORICAL))
    why = reasons.reason_codes({c: F.col(f"c_{c}") for c in NUMERIC}, {c: F.col(c) for c in NUMERIC}, reasons.FINANCIAL_RULES)
    bad = F.col("went_bad") == 1
    order = W.partitionBy(F.lit(0)).orderBy(F.desc("went_bad"), F.when(bad, -F.col(score)).otherwise(F.col(score)), "company", "year")  # seven rows
    return explained.select(
        F.format_string("company-%03d", F.row_number().over(order)).alias("example"), company.industry_label(F.col("nic")).alias("industry"), "year",
        F.round(score, 3).alias("pd"), F.when(bad, "defaulted within 2 years").otherwise("no default").alias("outcome"), _shown(F.col("interest_cover")).alias("interest_cover"),
        _shown(F.col("debt_to_equity")).alias("debt_to_equity"), _shown(F.col("pat_margin"), 100).alias("pat_margin_pct"), F.array_join(why, "; ").alias("reasons"))
